"""Fill-in-the-middle transformation with a piece table.

A document is one descriptor (buffer, start, end) over its text, which is never copied or changed; a second buffer holds
the sentinels. Cutting splits the descriptor into prefix, middle and suffix, an arrangement permutes these among the
sentinels, and hashes and outputs stream over the descriptors. A transformed text is put back by cutting it at the
sentinels and applying the inverse permutation.

Cuts fall between units: a word with the white space before it, or the white space at the end of the text. Where they
fall, and whether and how a document is arranged, comes from a hash of seed and key alone, so a rerun gives the same.

Edge cases: null and empty texts are plain and give an empty output (the operator for whole tables keeps a null as
null); a text that holds a sentinel is plain; a text of one unit may have any of its three parts empty; a null key
hashes as an empty one; repeated rows give equal results; texts of any length are scanned in chunks; empty tables give
none; columns named like those added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import column_bytes, map_rows

SEED = 42
#: Of 100 documents so many are transformed, and of 100 transformed ones so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: What stands after which sentinel, by form.
ARRANGED = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
CHUNK = 1 << 20

_SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT, MARKS = 0, 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, end) over immutable buffers."""

    buffers: tuple[bytes, ...]
    pieces: tuple[tuple[int, int, int], ...]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((text, _SENTINELS), ((TEXT, 0, len(text)),))

    def cut(self, *places: int) -> PieceTable:
        """Split at these ascending places, counted over the whole table."""
        out, done = [], 0
        wanted = list(places)
        for buffer, start, end in self.pieces:
            while wanted and wanted[0] <= done + end - start:
                at = start + wanted.pop(0) - done
                out.append((buffer, start, at))
                done += at - start
                start = at
            out.append((buffer, start, end))
            done += end - start
        return PieceTable(self.buffers, tuple(out))

    def arrange(self, form: str) -> PieceTable:
        """Prefix, middle and suffix permuted among the sentinels."""
        out = []
        for mark, part in ARRANGED[form]:
            at = _SENTINELS.index(mark)
            out += [(MARKS, at, at + len(mark)), self.pieces[part]]
        return PieceTable(self.buffers, tuple(out))

    def restore(self, form: str) -> PieceTable:
        """The inverse permutation of a transformed text: its parts by the sentinels, in their old order."""
        (buffer, start, end), = self.pieces
        whole, parts, found = self.buffers[buffer], {}, []
        at = start
        for mark, part in ARRANGED[form]:
            at = whole.index(mark, at, end)
            found.append((at, at + len(mark), part))
            at += len(mark)
        for (_, begin, part), stop in zip(found, [*[a for a, _, _ in found[1:]], end]):
            parts[part] = (buffer, begin, stop)
        return PieceTable(self.buffers, tuple(parts[i] for i in range(3)))

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield memoryview(self.buffers[buffer])[start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def _ends(text: bytes, start: int, stop: int) -> np.ndarray:
    """Ends of the words that end within start..stop, other than at the end of the text."""
    space = _SPACE[np.frombuffer(text, np.uint8, min(stop + 1, len(text)) - start, start)]
    return np.flatnonzero(~space[:-1] & space[1:]) + start + 1


def units(text: bytes) -> tuple[int, list[int]]:
    """The number of units, and how many of them end in each chunk; the end of a text ends its last unit."""
    counts = [len(_ends(text, s, min(s + CHUNK, len(text)))) for s in range(0, len(text), CHUNK)]
    return sum(counts) + bool(text), counts


def unit_end(text: bytes, n: int, counts: list[int], k: int) -> int:
    """Where the first k of n units end."""
    if k == 0 or k == n:
        return len(text) if k else 0
    for i, count in enumerate(counts):
        if k <= count:
            return int(_ends(text, i * CHUNK, min((i + 1) * CHUNK, len(text)))[k - 1])
        k -= count
    raise AssertionError("more units than the text has")


def _points(text: bytes, start: int, end: int) -> int:
    """Code points between two byte positions."""
    return sum(
        int(np.count_nonzero((np.frombuffer(text, np.uint8, min(s + CHUNK, end) - s, s) & 0xC0) != 0x80)) for s in range(start, end, CHUNK)
    )


def transform(text: bytes, key: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """(units, form, cuts or None, piece table of the output) of one text."""
    n, counts = units(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    table = PieceTable.of(text)
    if not text or h[2] % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, table
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    cuts = tuple(unit_end(text, n, counts, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    return n, form, cuts, table.cut(*cuts).arrange(form)


def restored(output: bytes, form: str) -> PieceTable:
    """The text again, from output and form alone."""
    table = PieceTable.of(output)
    return table if form == "plain" else table.restore(form)


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", output: str = "output", form: str = "form",
    seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """All columns, with the transformed text and its form."""
    names = [c for c in df.columns if c not in (output, form)]
    at = names.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(len(names)).to_pylist()
        made, forms = [], []
        for t, k in zip(_bytes_at(batch, at), keys):
            _, shape, _, table = transform(t or b"", k, seed, rate, suffix_first)
            made.append(None if t is None else table.bytes())
            forms.append(shape)
        columns = [*batch.columns[:-1], pa.array(made, pa.binary()).cast(pa.string()), pa.array(forms, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, output, form])

    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("\u0001key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in names]).schema)
    return map_rows(rows, run, f"{fields}, `{output}` string, `{form}` string")


def undo(df: DataFrame, output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """All columns, with the text that output and form come from."""
    names = [c for c in df.columns if c != text]
    at, kind = names.index(output), names.index(form)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [None if t is None else restored(t, f).bytes() for t, f in zip(_bytes_at(batch, at), batch.column(kind).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*names, text])

    rows = df.select(*[f"`{c}`" for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_rows(rows, run, f"{fields}, `{text}` string")


def _bytes_at(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return column_bytes(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"]), "text")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row the units, the form, the code points of prefix and middle, and the hashes of the output and of the text that
    is rebuilt from it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, k in zip(_bytes_at(batch, 1), batch.column(2).to_pylist()):
            n, form, cuts, table = transform(t or b"", k, seed)
            chars = (_points(t, 0, cuts[0]), _points(t, cuts[0], cuts[1])) if cuts else (None, None)
            rows.append((n, form, *chars, table.sha256(), restored(table.bytes(), form).sha256()))
        n, form, before, middle, made, back = zip(*rows)
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(made), pa.array(back)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    return map_rows(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS x, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS y,
  coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
