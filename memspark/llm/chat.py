"""Chat formatting: roles of a transcript by a hidden Markov model, then turns in one form.

A transcript is lines of text. Hidden states are the three roles, each as the first line of a turn or a later one. A line
shows a speaker marker or none (User:, ### Response:, <|assistant|>, [Human] and the like) and features of its text. How
roles follow each other, how long turns are and what lines of each role look like is counted in Spark over all
conversations with known roles; how markers show is fixed. Viterbi finds the likeliest states of each transcript, and
each turn is rendered as <|role|>, its text, <|end|>.

A conversation is read in pieces of TURNS turns, by their place in it, and still parsed whole: a piece is summed up as the
best score from each state before it to each state at its end, such matrices are put together FAN at a time until one is
left for each conversation, and the way back tells each piece the states between which its own path runs, and how many
turns began before it. Scores are whole numbers, so putting them together in another order changes nothing. No group has
more than FAN rows, however long a conversation is; only the text of one turn is ever in one place.

Edge cases: null and empty texts are empty turns; a null conv_id is a conversation of its own; null turns come first;
null and unknown roles count as none in training; rows that repeat whole count once; rows that share conv_id and turn are
ordered by the first 64 characters and then the hash of their texts; equally likely paths are told apart by the lower state
at the end of each piece, then within it; lines of any length are one line each; an empty table gives no turns and a model of its priors; columns
beside conv_id, turn, role and text play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import map_rows, stored
from memspark.operators.placing import rank_rows

ROLES = ("system", "user", "assistant")
TURNS = 64
FAN = 512
#: Parts of a unit of logarithm that scores are counted in.
SCALE = 1 << 20
NAMES = {
    "system": ("system", "sys", "context"),
    "user": ("user", "human", "customer", "client", "question", "instruction", "prompt", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "response", "output", "a"),
}
#: How turns are marked in transcripts made from tables, by conversation; the last has no markers but blank lines.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Context:\n", "user": "### Instruction:\n", "assistant": "### Response:\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "[System] ", "user": "Q: ", "assistant": "A: "},
    {"system": "", "user": "", "assistant": ""},
)
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = re.compile(
    r"^\s*(?:\#{1,4}\s*(?P<a>[a-z]{1,12})\s*:?\s*$|<\|(?:im_start\|>)?\s*(?P<b>[a-z]{1,12})\s*(?:\|>)?\s*$|\[(?P<c>[a-z]{1,12})\]:?|\*{0,2}(?P<d>[a-z]{1,12})\s*\*{0,2}:\*{0,2}(?=\s|$))[ \t]*",
    re.I,
)
#: Chances that a turn's first line shows its own role's marker, none, or each other role's, in a transcript that begins with
#: a marker and in one that doesn't; and that a later line shows any one.
CHANCES = {True: (0.98, 1e-6, 0.009), False: (0.1, 0.88, 0.01)}
LATER = 0.002
_SIZES = (0, 1, 40, 120, 300, 1000)
FEATURES = (len(_SIZES), 2, 2, 2)


def marker(line: str) -> tuple[int, int]:
    """The role that a line's marker names, or -1, and where the text after it begins."""
    found = _MARKER.match(line)
    if found:
        role = _ROLE_OF.get(next(x for x in found.groups() if x).lower())
        if role is not None:
            return role, found.end()
    return -1, 0


def look(text: str) -> tuple[int, ...]:
    """Features of a line: size class, whether it asks, whether it begins with a capital, whether it is a list or code line."""
    size = max(i for i, least in enumerate(_SIZES) if len(text) >= least)
    bare = text.strip()
    return size, int(bare.endswith("?")), int(bare[:1].isupper()), int(bare[:2] in ("- ", "* ", "1.") or bare[:3] == "```")


@dataclass
class Model:
    """Logarithms of the chances, in whole parts; states are role, or role + 3 for later lines."""

    start: np.ndarray
    move: np.ndarray
    seen: list[np.ndarray]

    def shown(self, lines: list[str], marked: bool | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """How well each line fits each state, and each line's marker; marked: whether the transcript begins with a marker."""
        marks = [marker(x) for x in lines]
        shows, none, other = CHANCES[marks[0][0] >= 0 if marked is None else marked]
        later = [_parts(1 - 3 * LATER)] * 3, [_parts(LATER)] * 3
        of_role = {role: np.array([_parts(none if role < 0 else shows if role == own else other) for own in range(3)] + later[role >= 0]) for role in range(-1, 3)}
        fit = np.array([of_role[role] for role, _ in marks], dtype=np.int64)
        for feature, values in enumerate(np.array([look(line[begin:]) for line, (_, begin) in zip(lines, marks)]).T):
            fit += self.seen[feature].T[values]
        return fit, marks

    def path(self, fit: np.ndarray, entry: int | None = None, end: int | None = None) -> list[int]:
        """The likeliest states of the lines (Viterbi), after a state and up to one where these are known."""
        best, back, every = (self.start if entry is None else self.move[entry]) + fit[0], [], np.arange(6)
        for row in fit[1:]:
            paths = best[:, None] + self.move
            at = paths.argmax(0)
            back.append(at)
            best = paths[at, every] + row
        out = [int(best.argmax()) if end is None else end]
        for at in reversed(back):
            out.append(int(at[out[-1]]))
        return out[::-1]

    def states(self, lines: list[str]) -> tuple[list[int], list[tuple[int, int]]]:
        """The likeliest state of each line of a whole transcript, and each line's marker."""
        fit, marks = self.shown(lines)
        return self.path(fit), marks

    def summary(self, fit: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each state before the lines and each at their end: the best score between them, and how many turns begin on that path."""
        before, every = np.arange(6)[:, None], np.arange(6)[None, :]
        begins = (np.arange(6) < 3).astype(np.int64)
        best = (np.broadcast_to(self.start, (6, 6)) if first else self.move) + fit[0]
        turns = np.broadcast_to(begins, (6, 6))
        for row in fit[1:]:
            paths = best[:, :, None] + self.move
            at = paths.argmax(1)
            best = paths[before, at, every] + row
            turns = turns[before, at] + begins
        return best, turns


def _parts(chance: float) -> int:
    return round(float(np.log(chance)) * SCALE)


def model_of(counts: dict[tuple[str, int, int], int]) -> Model:
    """Chances from counts, each with a little added so that nothing is impossible that can be."""
    got = lambda kind, i, j: counts.get((kind, i, j), 0)
    start = np.full(6, -1e9)
    first = np.array([got("start", 0, r) + 1.0 for r in range(3)])
    start[:3] = np.log(first / first.sum())
    move = np.full((6, 6), -1e9)
    for r in range(3):
        turns, lines = got("turns", r, 0) + 1.0, got("lines", r, 0) + 2.0
        more = min(0.95, max(0.05, 1 - turns / lines))
        after = np.array([got("next", r, q) + 0.5 for q in range(3)])
        after /= after.sum()
        for state in (r, r + 3):
            move[state, r + 3] = np.log(more)
            move[state, :3] = np.log((1 - more) * after)
    seen = []
    for feature, values in enumerate(FEATURES):
        table = np.array([[got(f"f{feature}", state, v) + 1.0 for v in range(values)] for state in range(6)])
        seen.append(np.log(table / table.sum(1, keepdims=True)))
    parts = lambda x: np.rint(x * SCALE).astype(np.int64)
    return Model(parts(start), parts(move), [parts(x) for x in seen])


def segments(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text as pieces of TURNS turns: conv (the conv_id as a name without nulls), piece, its turns in
    order and the role of the turn before them."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.select(conv.alias("conv"), "*", F.substring("text", 1, 64).alias("head"), F.sha2(F.col("text").cast("binary"), 256).alias("code"))
    placed = rank_rows(rows, "conv", ["turn", "head", "code", "role"], "at")
    piece = F.expr(f"at div {TURNS}")
    # A piece's last row goes to the next one too, as the turn before it.
    to = F.when(F.col("at") % TURNS == TURNS - 1, F.array(piece, piece + 1)).otherwise(F.array(piece))
    own = piece == F.col("piece")
    pieces = placed.select("conv", "at", "text", "role", F.explode(to).alias("piece")).groupBy("conv", "piece")
    listed = F.sort_array(F.collect_list(F.when(own, F.struct("at", "text", "role"))))
    return pieces.agg(listed.alias("turns"), F.max(F.when(~own, F.col("role"))).alias("before")).where(F.size("turns") > 0)


def fit(pieces: DataFrame) -> Model:
    """Count over all pieces; each task sends one row per count."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[tuple[str, int, int], int] = {}

        def add(kind: str, i: int, j: int) -> None:
            total[kind, i, j] = total.get((kind, i, j), 0) + 1

        for number, turns, role_before in zip(*(c.to_pylist() for c in batch.columns)):
            before = ROLES.index(role_before) if role_before in ROLES else None
            for at, turn in enumerate(turns):
                role = ROLES.index(turn["role"]) if turn["role"] in ROLES else None
                if role is not None:
                    if at == 0 and number == 0:
                        add("start", 0, role)
                    if before is not None:
                        add("next", before, role)
                    add("turns", role, 0)
                    for i, line in enumerate(turn["text"].split("\n")):
                        add("lines", role, 0)
                        for feature, value in enumerate(look(line)):
                            add(f"f{feature}", role + 3 * (i > 0), value)
                before = role
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
            names=["kind", "i", "j", "n"],
        )

    counted = map_rows(pieces.select("piece", "turns", "before"), count, "kind string, i int, j int, n long", rows=2048)
    rows = counted.groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect()  # at most one row per chance of the model
    return model_of({(r.kind, r.i, r.j): r.n for r in rows})


def _turns(lines: list[str], states: list[int], marks: list[tuple[int, int]]) -> list[tuple[int, list[str]]]:
    """Turns as role and lines, markers left out; the first one may have begun before."""
    out: list[tuple[int, list[str]]] = []
    for line, state, (role, begin) in zip(lines, states, marks):
        if state < 3:
            text = line[begin:] if role == state else line
            out.append((state, [text] if text or role < 0 else []))
        elif out:
            out[-1][1].append(line)
        else:
            out.append((state % 3, [line]))
    return out


def parse(lines: list[str], model: Model) -> list[tuple[str, str]]:
    """Turns of a transcript as role and text, markers left out; blank lines at a turn's ends don't count."""
    return [(ROLES[role], "\n".join(text).strip("\n")) for role, text in _turns(lines, *model.states(lines))]


def render(role: str, text: str) -> str:
    """A turn in the one form; what looks like its signs in the text is spaced apart."""
    return f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n"


def parse_transcripts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, once for each turn: turn_no, role, content and rendered."""
    added = ("turn_no", "role", "content", "rendered")
    kept = [c for c in df.columns if c != text and c not in added]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, number, of = [], [], []
        for i, value in enumerate(batch.column(len(kept)).to_pylist()):
            for at, turn in enumerate(parse((value or "").split("\n"), shared.value)):
                of.append(i)
                number.append(at)
                rows.append(turn)
        picked = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(c.take(picked) for c in batch.columns[:-1]), pa.array(number, pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([render(*r) for r in rows], pa.string())],
            names=[*kept, *added],
        )

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return map_rows(df.select(*kept, text), run, f"{fields}turn_no int, role string, content string, rendered string")


def _style() -> Column:
    return F.pmod(F.xxhash64("conv"), F.lit(len(STYLES))).cast("int")


def transcripts(pieces: DataFrame) -> DataFrame:
    """Pieces of plain transcripts, marked in one of the styles by the hash of the conversation; their lines in order of the
    pieces are the transcript's."""
    marks = F.create_map(*(x for i, names in enumerate(STYLES) for role, mark in names.items() for x in (F.lit(f"{i}{role}"), F.lit(mark))))
    turns = F.transform("turns", lambda t: F.concat(F.coalesce(marks[F.concat(F.col("style").cast("string"), t["role"])], F.lit("")), t["text"]))
    blank = F.concat(F.when(F.col("piece") > 0, "\n").otherwise(""), F.array_join(turns, "\n\n"))
    text = F.when(F.col("style") == len(STYLES) - 1, blank).otherwise(F.array_join(turns, "\n"))
    return pieces.withColumn("style", _style()).select("conv", "piece", text.alias("text"))


def _matrices(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(frame["m"]), dtype="<i8").reshape(-1, 2, 6, 6)
    return both[:, 0], both[:, 1]


def _together(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One matrix for a block of neighbouring ones."""
    scores, turns = _matrices(frame.sort_values("at"))
    best, begun, before, every = scores[0], turns[0], np.arange(6)[:, None], np.arange(6)[None, :]
    for score, turn in zip(scores[1:], turns[1:]):
        paths = best[:, :, None] + score
        by = paths.argmax(1)
        best, begun = paths[before, by, every], begun[before, by] + turn[by, every]
    return pd.DataFrame({"conv": [key[0]], "at": [key[1]], "m": [np.stack([best, begun]).astype("<i8").tobytes()]})


def _apart(key: tuple, frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The states before and at the end of each matrix of a block, and the turns begun before, from those of the block."""
    frame = frame.sort_values("at")
    scores, turns = _matrices(frame)
    first, last, begun = (int(ends[c].iloc[0]) for c in ("entry", "exit", "begun"))
    best, back = scores[0][first], []
    for score in scores[1:]:
        paths = best[:, None] + score
        back.append(paths.argmax(0))
        best = paths.max(0)
    out = [last]
    for by in reversed(back):
        out.append(int(by[out[-1]]))
    out = [first, *out[::-1]]
    here = np.array([turn[a, b] for turn, a, b in zip(turns, out, out[1:])])
    return pd.DataFrame({"conv": key[0], "at": frame["at"], "entry": out[:-1], "exit": out[1:], "begun": begun + np.cumsum(here) - here})


ENDS = "conv string, at long, entry int, exit int, begun long"


def boundaries(texts: DataFrame, model: Model, pieces: int, fan: int = FAN) -> DataFrame:
    """Of conversations of more than one piece (conv, piece, text), for each piece: whether the conversation begins with a marker,
    the states before and at the end of the piece on its best path, and how many turns began before. pieces: the most that one has."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    opening = F.substring_index("text", "\n", 1)

    def begins(batch: pa.RecordBatch) -> pa.RecordBatch:
        marked = [marker(x)[0] >= 0 for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marked, pa.bool_())], names=["conv", "marked"])

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for at, text, marked in zip(*(c.to_pylist() for c in batch.columns[1:])):
            fit, _ = shared.value.shown(text.split("\n"), marked)
            out.append(np.stack(shared.value.summary(fit, at == 0)).astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], names=["conv", "at", "marked", "m"])

    long = texts.join(texts.where("piece = 1").select("conv"), "conv", "left_semi")
    marks = map_rows(long.where("piece = 0").select("conv", opening), begins, "conv string, marked boolean")
    summed = stored(map_rows(long.join(marks, "conv").select("conv", "piece", "text", "marked"), sums, "conv string, at long, marked boolean, m binary", rows=64))
    levels = [summed.select("conv", "at", "m")]
    while pieces > 1:
        pieces = -(-pieces // fan)
        block = F.expr(f"at div {fan}").alias("block")
        levels.append(stored(levels[-1].groupBy("conv", block).applyInPandas(_together, "conv string, at long, m binary")))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        last = [int(np.frombuffer(m, dtype="<i8").reshape(2, 6, 6)[0, 0].argmax()) for m in batch.column(2).to_pylist()]
        zero = np.zeros(n, dtype=np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(zero.astype(np.int32)), pa.array(last, pa.int32()), pa.array(zero)], names=["conv", "at", "entry", "exit", "begun"])

    ends = map_rows(levels.pop(), whole, ENDS)
    while levels:
        ends = levels.pop().groupBy("conv", F.expr(f"at div {fan}")).cogroup(ends.groupBy("conv", "at")).applyInPandas(_apart, ENDS)
    return ends.join(summed.select("conv", "at", "marked"), ["conv", "at"]).withColumnRenamed("at", "piece")


PARTS = "conv string, piece long, turn_no long, role string, edge boolean, blank boolean, content string"


def parse_pieces(texts: DataFrame, model: Model, fan: int = FAN) -> DataFrame:
    """Transcripts in pieces (conv, piece, text), as turns: conv, turn_no, role, content and rendered."""
    pieces = (texts.agg(F.max("piece")).first()[0] or 0) + 1
    if pieces > 1:
        known = texts.select("conv", "piece", "text").join(boundaries(texts, model, pieces, fan), ["conv", "piece"], "left")
    else:
        known = texts.selectExpr("conv", "piece", "text", "int(null) entry", "int(null) exit", "bigint(null) begun", "boolean(null) marked")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, of = [], []
        for i, (at, text, entry, end, begun, marked) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            lines = text.split("\n")
            fit, marks = shared.value.shown(lines, marked)
            states = shared.value.path(fit, entry if at else None, end)
            turns = _turns(lines, states, marks)
            first = (begun or 0) - (states[0] >= 3)
            for k, (role, found) in enumerate(turns):
                edge = end is not None and k in (0, len(turns) - 1)
                content = "\n".join(found)
                of.append(i)
                rows.append((first + k, ROLES[role], edge, not found, content if edge else content.strip("\n")))
        picked = pa.array(of, pa.int64())
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), *columns], names=["conv", "piece", "turn_no", "role", "edge", "blank", "content"])

    parts = map_rows(known.select("conv", "piece", "text", "entry", "exit", "begun", "marked"), read, PARTS)
    turns = parts.where("NOT edge").select("conv", "turn_no", "role", "content")
    if pieces > 1:
        parts = stored(parts)
        turns = parts.where("NOT edge").select("conv", "turn_no", "role", "content")
        lines = F.sort_array(F.collect_list(F.when(~F.col("blank"), F.struct("piece", "content"))))["content"]
        split = parts.where("edge").groupBy("conv", "turn_no", "role").agg(F.array_join(lines, "\n").alias("content"))
        turns = turns.unionByName(split.withColumn("content", F.regexp_replace("content", r"\A\n+|\n+\z", "")))
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.replace("content", F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))
    return turns.withColumn("rendered", rendered)


def format_conversations(turns: DataFrame, fan: int = FAN) -> DataFrame:
    """Conversations with known roles as transcripts, parsed and rendered anew: a row for each turn found."""
    pieces = stored(segments(turns))
    found = parse_pieces(transcripts(pieces), fit(pieces), fan)
    conv_id = F.when(F.col("conv") != "-", F.expr("substring(conv, 2)")).cast(turns.schema["conv_id"].dataType)
    return found.select(conv_id.alias("conv_id"), _style().alias("style"), "turn_no", "role", "content", "rendered")
