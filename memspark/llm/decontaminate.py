"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. The words of a document are streamed through it, which gives at
each word the longest run of some item that ends there. Where that run is as long as a window, the window's words are
hit; an item shorter than a window counts as one window of its own length.

Words are maximal runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII. Edge cases: a null or
wordless text has no words and stays as it is; a null or wordless item has no windows; equal items all count, an
item_id that occurs twice counts once, a null item_id takes part under the empty name; rows that repeat are judged each
for itself; other columns are carried on, and those that clash with the added ones are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import column_bytes, map_rows, stored

#: Bytes of item text in one automaton, about 100 MB in a task. More items make more automata, each a pass of its own.
BLOCK_BYTES = 4_000_000
ADDED = ("n_words", "n_hit", "leak_spans", "leak_items")
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text; folding keeps every byte's place."""
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of the word runs of many items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.moves: list[dict[bytes, int]] = [{}]
        self.suffix: list[int] = [-1]
        self.length: list[int] = [0]
        split = [(name, words_of(text)) for name, text in items]
        for _, words in split:
            last = 0
            for word in words:
                last = self._add(last, word)
        n = len(self.moves)
        whole: list[dict[int, set[str]] | None] = [None] * n
        long: list[set[str] | None] = [None] * n
        self.at_window = self._at_window()
        for name, words in split:
            if 0 < len(words) < window:
                state = self._state(words)
                whole[state] = whole[state] or {}
                whole[state].setdefault(len(words), set()).add(name)
            elif words:
                state = 0
                for i, word in enumerate(words):
                    state = self.moves[state][word]
                    if i + 1 >= window:
                        at = self.at_window[state]
                        long[at] = long[at] or set()
                        long[at].add(name)
        self.long = [tuple(x) if x else () for x in long]
        # What ends with a state's runs: a full window, and whole short items.
        self.marks: list[tuple[int, tuple] | None] = [None] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.marks[self.suffix[state]]
            short = (up[1] if up else ()) + tuple((size, tuple(names)) for size, names in (whole[state] or {}).items())
            at = self.at_window[state]
            if short or at >= 0:
                self.marks[state] = (at, short)

    def _add(self, last: int, word: bytes) -> int:
        moves, suffix, length = self.moves, self.suffix, self.length
        to = moves[last].get(word)
        if to is not None:
            return to if length[to] == length[last] + 1 else self._copy(last, word, to)
        state = self._new({}, 0, length[last] + 1)
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = state
            at = suffix[at]
        if at >= 0:
            to = moves[at][word]
            suffix[state] = to if length[to] == length[at] + 1 else self._copy(at, word, to)
        return state

    def _new(self, moves: dict[bytes, int], suffix: int, length: int) -> int:
        self.moves.append(moves)
        self.suffix.append(suffix)
        self.length.append(length)
        return len(self.moves) - 1

    def _copy(self, at: int, word: bytes, to: int) -> int:
        """Split off the shorter runs of a state."""
        copy = self._new(dict(self.moves[to]), self.suffix[to], self.length[at] + 1)
        self.suffix[to] = copy
        while at >= 0 and self.moves[at].get(word) == to:
            self.moves[at][word] = copy
            at = self.suffix[at]
        return copy

    def _at_window(self) -> list[int]:
        """For each state, the one that has the window at the end of its runs; -1 if they are shorter."""
        out = [-1] * len(self.moves)
        for state in sorted(range(1, len(self.moves)), key=self.length.__getitem__):
            if self.length[state] >= self.window:
                up = self.suffix[state]
                out[state] = state if self.length[up] < self.window else out[up]
        return out

    def _state(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.moves[state][word]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words, as first and one past the last, and the items whose windows occur."""
        moves, suffix, length, marks, window = self.moves, self.suffix, self.length, self.marks, self.window
        found: list[tuple[int, int]] = []
        states: set[int] = set()
        names: set[str] = set()
        state = matched = 0
        for i, word in enumerate(words):
            to = moves[state].get(word)
            while to is None and state:
                state = suffix[state]
                matched = length[state]
                to = moves[state].get(word)
            if to is None:
                continue
            state = to
            matched += 1
            mark = marks[state]
            if mark is None:
                continue
            if matched >= window and mark[0] >= 0:
                states.add(mark[0])
                found.append((i + 1 - window, i + 1))
            for size, of in mark[1]:
                if size <= matched:
                    names.update(of)
                    found.append((i + 1 - size, i + 1))
        for at in states:
            names.update(self.long[at])
        return merge_spans(found), names


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and what stands between them; one space is left where text stands on both sides."""
    places = [m.span() for m in _RUN.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last - 1][1]
    out.append(text[at:])
    return b" ".join(x.strip() for x in out if x.strip()) if spans else text


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """All columns, with n_words, n_hit, leak_spans (word ranges, last excluded) and leak_items (names, sorted).

    Items go to the tasks in automata of bounded size; each further automaton reads the documents again, in a pass of its own.
    """
    spark = df.sparkSession
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("n"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    kept = [c for c in df.columns if c not in ADDED]
    out = df.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for block in range(blocks):
        chosen = named if blocks == 1 else named.where(F.pmod(F.xxhash64("n", "t"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(ItemAutomaton([(r.n, r.t.encode()) for r in chosen.collect()], window))

        def scan(batch: pa.RecordBatch, shared=shared, later=block > 0) -> pa.RecordBatch:
            automaton, rows = shared.value, []
            before = batch.select(["leak_spans", "leak_items"]).to_pylist() if later else None
            for i, value in enumerate(column_bytes(batch, text)):
                words = words_of(value)
                spans, names = automaton.scan(words)
                if later:
                    spans = merge_spans(spans + [(x["first"], x["last"]) for x in before[i]["leak_spans"]])
                    names |= set(before[i]["leak_items"])
                rows.append((len(words), sum(b - a for a, b in spans), [{"first": a, "last": b} for a, b in spans], sorted(names)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            types = (pa.int64(), pa.int64(), span, pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types))], names=[*kept, *ADDED])

        if block:
            out = stored(out)
        out = map_rows(out, scan, f"{fields}, n_words long, n_hit long, leak_spans array<struct<first: int, last: int>>, leak_items array<string>")
    return out


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.8, **names: str) -> DataFrame:
    """The documents without the item passages in their texts; those covered beyond max_coverage go as a whole."""
    columns = df.columns
    held = {c: f"own_{c}" for c in ADDED if c in columns}  # clashing columns come through under another name
    found = find_leaks(df.withColumnsRenamed(held), items, held.get(text, text), window=window, **names)
    found = found.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    now = [held.get(c, c) for c in columns]
    at = columns.index(text)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column(len(now)).to_pylist()
        texts = column_bytes(batch, now[at])
        texts = [cut_words(x, [(s["first"], s["last"]) for s in spans[i]]) if spans[i] else x for i, x in enumerate(texts)]
        arrays = batch.columns[: len(now)]
        arrays[at] = pa.array([None if x is None else x.decode() for x in texts], pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_rows(found.select(*now, "leak_spans"), cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def leak_digest(df: DataFrame, items: DataFrame, key: str = "doc_id", window: int = 10) -> DataFrame:
    """Per row the counts and the SHA-256 of the items whose windows occur."""
    found = find_leaks(df.select(F.col(key).cast("long").alias(key), "text"), items, window=window)
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The query's rows in SQL, for items of any length.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dw AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (SELECT doc_id, i, k, string_agg(x, ' ') OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM dw, (SELECT DISTINCT k FROM win WHERE k = 10)),
short AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win WHERE k < 10))),
occ AS (SELECT x.doc_id, x.i, x.k, win.item_id FROM (SELECT * FROM g UNION ALL SELECT * FROM short) x JOIN win ON win.k = x.k AND win.s = x.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""
