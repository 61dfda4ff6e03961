"""SentencePiece BPE encoding and decoding.

Encoding keeps, for every prefix of a word, the one last piece that the prefix's encoding ends with. An automaton gives
the pieces that end at a position, longest first; the first that is compatible with the last piece of the prefix before
it is the one. The ids are then read off backwards. Time is linear in the text for a given vocabulary, whatever the word.

Edge cases: null text counts as empty and gives the begin and end ids only; texts of any length are encoded whole;
characters outside the vocabulary become byte pieces; repeated rows, null ids and other columns are left as they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import map_rows

SPACE = "▁"
#: Words remembered per worker process, in two generations; the older goes when the younger is full.
MEMO_WORDS = 60_000
MEMO_CHARS = 48
MEMO_PAIRS = 250_000


def merged(symbols: list[str], order: dict[str, int]) -> list[str]:
    """Plain byte-pair merging of a short list of symbols: best order first, leftmost on ties."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min((order.get(a + b, len(order) + 1), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if best[0] > len(order):
            break
        symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
    return symbols


@dataclass
class Vocabulary:
    """A vocabulary in merge order, with the two halves each piece is merged from; small, and sent to the tasks once."""

    ids: dict[str, int]
    order: dict[str, int]
    halves: dict[str, tuple[str, str]]
    byte_ids: list[int]
    runs: list[bytes]
    begin: int
    end: int
    decoded: list[bytes]
    byte_of: dict[int, int]


def read_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece BPE model with byte fallback and the identity normaliser.

    Raises ValueError for models outside that: other normalisers, unused or user-defined pieces, a space mark inside a
    piece, or equal scores of pieces other than runs of spaces.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    byte_ids = [i for i in range(n) if sp.is_byte(i)]
    if len(byte_ids) != 256 or any(sp.is_unused(i) for i in range(n)):
        raise ValueError("the model must have byte fallback and no unused pieces")
    probe = "  Aﬁ　é\r\n\tx  "
    if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model must leave text as it is, but for the space mark")
    spaces = {names[i]: i for i in plain if set(names[i]) == {SPACE}}
    words = [i for i in plain if names[i] not in spaces or names[i] == SPACE]
    long = [i for i in words if len(names[i]) > 1]
    if any(SPACE in names[i][1:] for i in words) or len({sp.get_score(i) for i in long}) != len(long):
        raise ValueError("space marks inside pieces and equal scores are not supported")
    if spaces and max(sp.get_score(i) for p, i in spaces.items() if len(p) > 1) >= min(sp.get_score(i) for i in long):
        raise ValueError("runs of spaces must merge last")
    order = {names[i]: k for k, i in enumerate(sorted(long, key=lambda i: -sp.get_score(i)), 1)}
    ids = {names[i]: i for i in words if len(names[i]) == 1}
    halves: dict[str, tuple[str, str]] = {}
    for piece in order:
        lower = merged(list(piece), _Below(order, order[piece]))
        if len(lower) == 2:  # otherwise no text is ever encoded with this piece
            halves[piece] = (lower[0], lower[1])
    where = {names[i]: i for i in words}
    ids |= {piece: where[piece] for piece in halves}
    longest = max(map(len, spaces), default=1)
    runs = [b""]
    for length in range(1, 2 * longest + 1):
        runs.append(_ids([spaces[p] for p in _space_run(length, spaces)]))
    decoded = [b"" if sp.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
    decoded[sp.unk_id()] = " ⁇ ".encode()
    return Vocabulary(ids, order, halves, byte_ids, runs, sp.bos_id(), sp.eos_id(), decoded, {i: b for b, i in enumerate(byte_ids)})


class _Below(dict):
    """The merges made before a given one."""

    def __init__(self, order: dict[str, int], limit: int):
        self.order, self.limit = order, limit

    def get(self, key, default=None):
        at = self.order.get(key)
        return at if at is not None and at < self.limit else default

    def __len__(self):
        return len(self.order)


def _space_run(length: int, spaces: dict[str, int]) -> list[str]:
    """Runs of spaces have one score, so the leftmost pair that makes a piece merges first, again and again."""
    symbols = [SPACE] * length
    at = 0
    while at + 1 < len(symbols):
        if symbols[at] + symbols[at + 1] in spaces:
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            at = 0
        else:
            at += 1
    return symbols


class _Moves(dict):
    """The moves from one state of the automaton. One that isn't there is that of the state's longest suffix, and is kept."""

    __slots__ = ("suffix",)

    def __missing__(self, char: str) -> int:
        to = self[char] = self.suffix[char] if self.suffix is not None else 0
        return to


def automaton(words: dict[str, tuple[int, int]]) -> tuple[list[_Moves], list[tuple]]:
    """Moves of each state, and the words that end at it, longest first."""
    goto, ends = [_Moves()], [()]
    goto[0].suffix = None
    for word, value in words.items():
        state = 0
        for char in word:
            if dict.get(goto[state], char) is None:
                dict.__setitem__(goto[state], char, len(goto))
                goto.append(_Moves())
                ends.append(())
            state = dict.get(goto[state], char)
        ends[state] = (value,)
    queue = [(to, 0) for to in goto[0].values()]
    for state, suffix in queue:  # nearest to the root first; the queue grows meanwhile
        children = list(goto[state].items())
        goto[state].suffix = goto[suffix]
        ends[state] += ends[suffix]
        queue += [(to, goto[suffix][char]) for char, to in children]
    return goto, ends


def _ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder of one task, with a bounded memo of words."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.goto, self.ends = automaton({piece: (i, len(piece)) for piece, i in v.ids.items()})
        self.names = {i: piece for piece, i in v.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        known = "".join(c for c in v.ids if len(c) == 1)
        self.outside = re.compile(f"([^{re.escape(known)}])")
        self.units = re.compile(f"({SPACE}+)([^{SPACE}]*)")
        self.space = _ids([v.ids[SPACE]])

    def compatible(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart when their texts are encoded together.

        The merges along the seam are undone from the last to the first. If, before some undone merge, the two symbols
        at the seam would have merged earlier than it, the pieces don't stay as they are.
        """
        order, halves, limit, out = self.v.order, self.v.halves, len(self.v.order) + 2, True
        left, right = self.names[a], self.names[b]
        while True:
            joint = order.get(left + right)
            if joint is not None and joint < limit:
                out = False
                break
            a_at, b_at = order.get(left, 0), order.get(right, 0)
            if a_at == b_at == 0:
                break
            if a_at > b_at:
                limit, left = a_at, halves[left][1]
            else:  # of two equal merges the left one came first, and the seam lies left of this one
                limit, right = b_at + 1, halves[right][0]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = out
        return out

    def table(self, part: str) -> list[tuple[int, int]]:
        """The last piece of every prefix, as id and length, of a part whose characters are all in the vocabulary."""
        last: list[tuple[int, int]] = []
        goto, ends, known, compatible = self.goto, self.ends, self.pairs.get, self.compatible
        state = 0
        for end, char in enumerate(part):
            state = goto[state][char]
            for piece in ends[state]:
                start = end - piece[1]
                if start < 0:
                    last.append(piece)
                    break
                before = last[start][0]
                apart = known(before << 32 | piece[0])
                if compatible(before, piece[0]) if apart is None else apart:
                    last.append(piece)
                    break
        return last

    def part(self, part: str) -> bytes:
        """Ids of a part whose characters are all in the vocabulary."""
        last, at, ids = self.table(part), len(part), []
        while at:
            piece = last[at - 1]
            ids.append(piece[0])
            at -= piece[1]
        return _ids(ids[::-1])

    def word(self, text: str) -> bytes:
        """Ids of a text in which the space mark is the first character or none."""
        out = []
        for i, part in enumerate(self.outside.split(text)):
            if i % 2:
                out.append(_ids([self.v.byte_ids[b] for b in part.encode("utf-8", "replace")]))
            elif part:
                found = self.words.get(part)
                if found is None:
                    found = self.older.get(part) or self.part(part)
                    if len(part) <= MEMO_CHARS:
                        self.words[part] = found
                out.append(found)
        return b"".join(out)

    def run(self, length: int) -> bytes:
        if length < len(self.v.runs):
            return self.v.runs[length]
        longest = len(self.v.runs) // 2
        times = (length - len(self.v.runs)) // longest + 1
        return self.v.runs[longest] * times + self.v.runs[length - longest * times]

    def __call__(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, with begin and end ids."""
        begin, end = _ids([self.v.begin]), _ids([self.v.end])
        if not text:
            return begin + end
        if len(self.words) >= MEMO_WORDS:
            self.words, self.older = {}, self.words
        words, out = self.words, [begin]
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            for word in (SPACE + text.replace(" ", " " + SPACE)).split(" "):
                ids = words.get(word)
                out.append(self.word(word) if ids is None else ids)
        else:
            for marks, word in self.units.findall(SPACE + text.replace(" ", SPACE)):
                ids, n = self.word(SPACE + word), len(marks)
                if ids.startswith(self.space):
                    out += [self.run(n), ids[4:]]
                else:
                    out += [self.run(n - 1), ids]
        out.append(end)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: pieces joined, bytes put together, the space mark in front of the text left out.

        Bytes that are no UTF-8 become one replacement character each.
        """
        decoded, byte_of = self.v.decoded, self.v.byte_of
        out: list[bytes] = []
        pending = bytearray()
        values = memoryview(ids).cast("I").tolist() if len(ids) else []
        if not byte_of.keys() & set(values):
            text = b"".join(map(decoded.__getitem__, values))
        else:
            for i in values:
                b = byte_of.get(i)
                if b is not None:
                    if b < 128 and not pending:
                        out.append(b"%c" % b)
                    else:
                        pending.append(b)
                    continue
                if pending:
                    out.append(_utf8(bytes(pending)))
                    pending.clear()
                out.append(decoded[i])
            if pending:
                out.append(_utf8(bytes(pending)))
            text = b"".join(out)
        return text[1:] if text[:1] == b" " else text


def _utf8(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
                break
            except UnicodeDecodeError:
                pass
        else:
            size = 0
        out.append(raw[at : at + size] if size else "�".encode())
        at += size or 1
    return b"".join(out)


_CODECS: dict[str, Codec] = {}


def _codec(shared, name: str) -> Codec:
    """One codec for each worker process and model, so that its memo lasts from task to task."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(shared.value)
    return _CODECS[name]


def _shared(df: DataFrame, model: str):
    """The vocabulary as a broadcast, whose size is that of the model file and not of the data, and the model's digest."""
    with open(model, "rb") as file:
        name = hashlib.sha256(file.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(model)), name


def encode_texts(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, with the ids (binary, little-endian 32-bit) and the text that these ids decode to."""
    shared, name = _shared(df, model)
    names = [c for c in df.columns if c not in (ids, decoded)]

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, name)
        coded = [codec(x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        back = [codec.decode(x).decode() for x in coded]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary()), pa.array(back, pa.string())], names=[*names, ids, decoded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return map_rows(df.select(*names), encode, f"{fields}, `{ids}` binary, `{decoded}` string")


def encode_digest(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids and the SHA-256 of ids and decoded text, without carrying either on."""
    shared, name = _shared(df, model)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(shared, name)
        coded = [codec(x or "") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded]),
            ],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return map_rows(rows, digest, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
