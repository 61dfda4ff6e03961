"""Personal data: patterns with checks, and a skip-chain conditional random field that makes labels consistent.

Patterns find e-mail addresses, IP addresses, card and phone numbers; those that fail their check are dropped. The words
that hold a digit or an at sign are the variables of a random field with the labels none, e-mail, IP, card and phone.
Words next to each other share a chain potential. Words of a document that are equal or similar, however far apart (the
same digits, the same last seven digits of a phone number, the same name before an at sign), share a skip potential: each
is tied to one hidden label of their group, which gives as many links as words and not all pairs. All other words are
none and cut the chain, which is exact. Words of pattern matches keep their labels, and loopy message passing carries
them to the others: ``(246) 555-1219`` is a phone number in a document that has ``+1 (246) 555-1219``, and nowhere else.

The weights are fitted to the patterns' own labels by pseudo-likelihood. Its data are counts of settings (shape of the
word, labels of its neighbours and of its group, own label) over all documents; there are fewer than ``SHAPES * 1080``
settings whatever the size of the table, so the sum that reaches the driver is bounded. Counts are scaled to one total,
so that the weights behave alike at every size. Where an entity would start among words that no pattern
matches, ``UNSEEN`` is taken off, since nothing can be learned from the patterns about what they miss.

Edge cases: null and empty texts have no spans; positions are code points; a text of any length is searched whole, in
linear time; of overlapping matches of unlike kinds all stay, and the word gets the first kind's label; repeated rows,
null keys and extra columns are carried through; a table without any match has no added spans; an empty table none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import ArrowRows, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
NO_LABEL = LABELS  # a neighbour that is not there
#: Scores in log units: taken off for an entity without a match; the prior mean of the skip potential.
UNSEEN, AGREE = 5.0, 10.0
#: Prior variances of the weights of shapes and chains, and of skips.
LOOSE, TIGHT = 4.0, 0.25
EVIDENCE = 10_000
ROUNDS, DAMPING, SURE = 40, 0.5, 0.85
#: Words whose messages are passed together; a document is never split.
WORDS_AT_ONCE = 50_000

_HINT = re.compile(r"[0-9@]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_AROUND = ".,;:!?\"'<>[]{}"
_AT = re.compile(r"@|\(at\)|\[at\]")
_FOUR = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_MIXED = re.compile(r"[0-9][()/-]|[(][0-9]")


def _small(part: str) -> bool:
    """At most 255, however many zeros stand before it."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign, names to the left as far as the last match, domains to the right."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at += 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        if all(_small(part) for part in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches that pass their check, by kind and start."""
    if not _HINT.search(text):
        return []
    found = [(0, *span) for span in _emails(text)]
    found += [(1, *span) for span in _ips(text)] + [(2, *span) for span in _cards(text)]
    return found + [(3, *span) for span in _phones(text)] if "+" in text else found


# The shape of a word: how many digits it has and eight marks.
_BUCKETS = (0, 1, 3, 5, 9, 13, 20)
MARKS = 8
SHAPES = len(_BUCKETS) << MARKS


def shape(core: str, digits: str) -> int:
    marks = (
        "@" in core,
        bool("@" in core and _DOMAIN.match(core, core.index("@") + 1)),
        four := _FOUR.fullmatch(core) is not None,
        four and all(_small(x) for x in core.split(".")),
        core.startswith("+"),
        _MIXED.search(core) is not None,
        any(c.isalpha() for c in core),
        13 <= len(digits) <= 19 and luhn(digits),
    )
    bucket = bisect_right(_BUCKETS, len(digits)) - 1
    return bucket << MARKS | sum(1 << i for i, x in enumerate(marks) if x)


def group_key(core: str, digits: str) -> str:
    """What equal and similar words have in common; empty for short numbers, which say too little."""
    if "@" in core or "(at)" in core or "[at]" in core:
        name = _AT.split(core, maxsplit=1)[0]
        start = len(name)
        while start and name[start - 1] in _NAME:
            start -= 1
        return name[start:].casefold()
    if len(digits) >= 7:
        return "#" + (digits[-7:] if len(digits) <= 12 else digits)
    core = core.strip("()")
    return core.casefold() if len(core) >= 5 and not core.isdigit() else ""


@dataclass
class Words:
    """The variables of one text, and the matches that label them."""

    base: list[tuple[int, int, int]]
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    shapes: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)  # 0 where no pattern matches
    joined: list[bool] = field(default_factory=list)  # only white space before it, back to the word before


def read_words(text: str) -> Words:
    out = Words(base_spans(text))
    if not _HINT.search(text):
        return out
    names: dict[str | int, int] = {}
    last = 0
    for m in _WORD.finditer(text):
        word = m.group()
        core = word.strip(_AROUND)
        start = m.start() + len(word) - len(word.lstrip(_AROUND))
        digits = _NOT_DIGIT.sub("", core)
        out.joined.append(bool(out.ends) and not text[last : m.start()].strip(_SPACE))
        out.starts.append(start)
        out.ends.append(start + len(core))
        out.shapes.append(shape(core, digits))
        out.groups.append(names.setdefault(group_key(core, digits) or start, len(names)))
        last = m.end()
    out.labels = [0] * len(out.starts)
    for kind, start, end in reversed(out.base):
        for i in range(bisect_right(out.ends, start), bisect_left(out.starts, end)):
            out.labels[i] = kind + 1
    return out


def settings(words: Words) -> Iterator[tuple[int, int, int, int, int]]:
    """(shape, label before, label after, label of the group's next word, own label) of each word."""
    members: dict[int, list[int]] = {}
    for i, g in enumerate(words.groups):
        members.setdefault(g, []).append(i)
    other = {i: m[(k + 1) % len(m)] for m in members.values() if len(m) > 1 for k, i in enumerate(m)}
    n = len(words.labels)
    for i in range(n):
        before = words.labels[i - 1] if words.joined[i] else NO_LABEL
        after = words.labels[i + 1] if i + 1 < n and words.joined[i + 1] else NO_LABEL
        yield words.shapes[i], before, after, words.labels[other[i]] if i in other else NO_LABEL, words.labels[i]


@dataclass(frozen=True)
class Model:
    """Weights in log units: of shape features by label, of neighbouring labels, of agreement with the group."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        on = _features(shapes)
        # Added up feature by feature, so that a word's score is the same in any company.
        out = np.zeros((len(shapes), LABELS))
        for k in range(on.shape[1]):
            out += on[:, k : k + 1] * self.unary[k]
        return out


FEATURES = 1 + len(_BUCKETS) + MARKS


def _features(shapes: np.ndarray) -> np.ndarray:
    shapes = np.asarray(shapes, dtype=np.int64)
    out = np.zeros((len(shapes), FEATURES))
    out[:, 0] = 1
    out[np.arange(len(shapes)), 1 + (shapes >> MARKS)] = 1
    out[:, 1 + len(_BUCKETS) :] = shapes[:, None] >> np.arange(MARKS) & 1
    return out


def fit(counted: list[tuple[int, int, int, int, int, int]]) -> Model:
    """Largest pseudo-likelihood with a Gaussian prior, by Newton's method. Rows: a setting and how often it occurs."""
    rows = np.array(sorted(counted), dtype=np.int64).reshape(-1, 6)
    edge, skip = FEATURES * LABELS, FEATURES * LABELS + LABELS**2
    size = skip + LABELS
    mean, variance = np.zeros(size), np.full(size, LOOSE)
    mean[skip:], variance[skip:] = AGREE, TIGHT
    w = mean.copy()
    total = rows[:, 5].sum()
    labels = np.arange(LABELS)

    def design(part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), LABELS, size))
        on, at = _features(part[:, 0]), np.arange(len(part))
        for y in labels:
            x[:, y, y : FEATURES * LABELS : LABELS] = on
            for column, place in ((1, lambda v: edge + v * LABELS + y), (2, lambda v: edge + y * LABELS + v)):
                has = part[:, column] < NO_LABEL
                np.add.at(x, (at[has], y, place(part[has, column])), 1)
            x[part[:, 3] == y, y, skip + y] = 1
        return x

    def climb(w: np.ndarray, slopes: bool):
        value, slope, curve = -((w - mean) ** 2 / variance).sum() / 2, -(w - mean) / variance, np.diag(1 / variance)
        for start in range(0, len(rows), 2000):
            part = rows[start : start + 2000]
            x, weight = design(part), part[:, 5] * (EVIDENCE / total)
            logits = x @ w
            top = logits.max(axis=1, keepdims=True)
            p = np.exp(logits - top)
            norm = p.sum(axis=1, keepdims=True)
            p /= norm
            own = np.arange(len(part)), part[:, 4]
            value += (weight * (logits[own] - top[:, 0] - np.log(norm[:, 0]))).sum()
            if slopes:
                mid = np.einsum("cy,cyp->cp", p, x)
                slope = slope + weight @ (x[own] - mid)
                flat, p_weight = x.reshape(-1, size), (p * weight[:, None]).reshape(-1)
                curve = curve + flat.T @ (flat * p_weight[:, None]) - mid.T @ (mid * weight[:, None])
        return value, slope, curve

    for _ in range(50 if len(rows) else 0):
        value, slope, curve = climb(w, True)
        step = np.linalg.solve(curve, slope)
        if np.abs(step).max() < 1e-6:
            break
        scale = 1.0
        while climb(w + scale * step, False)[0] < value and scale > 1e-6:
            scale /= 2
        w = w + scale * step
    return Model(w[:edge].reshape(FEATURES, LABELS), w[edge:skip].reshape(LABELS, LABELS), w[skip:])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _agree(x: np.ndarray, bonus: np.ndarray) -> np.ndarray:
    """Message over a potential that pays for equal labels."""
    top = x.max(axis=1, keepdims=True)
    e = np.exp(x - top)
    out = np.log(e.sum(axis=1, keepdims=True) + e * np.expm1(bonus)) + top
    return out - out.max(axis=1, keepdims=True)


def marginals(documents: list[Words], model: Model, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Label probabilities of all words of some documents, by loopy message passing in a fixed number of rounds."""
    shapes = np.array([s for d in documents for s in d.shapes], dtype=np.int64)
    labels = np.array([x for d in documents for x in d.labels], dtype=np.int64)
    joined = np.flatnonzero([j for d in documents for j in d.joined])
    groups, shift = [], 0
    for d in documents:
        groups += [g + shift for g in d.groups]
        shift += 1 + max(d.groups, default=-1)
    _, group, size = np.unique(np.array(groups, dtype=np.int64), return_inverse=True, return_counts=True)
    linked = np.flatnonzero(size[group] > 1) if len(groups) else np.zeros(0, dtype=np.int64)
    hubs, hub = np.unique(group[linked], return_inverse=True)

    own = model.scores(shapes)
    unseen = labels == 0
    first = unseen.copy()
    first[joined] &= ~unseen[joined - 1]
    own[first, 1:] -= UNSEEN
    chain = np.broadcast_to(model.chain, (len(joined), LABELS, LABELS)).copy()
    chain[unseen[joined] & unseen[joined - 1], 0, 1:] -= UNSEEN
    fixed = np.flatnonzero(labels)
    own[fixed] = -1e4
    own[fixed, labels[fixed]] = 0.0
    right, left = np.zeros((len(joined), LABELS)), np.zeros((len(joined), LABELS))
    down = np.zeros((len(linked), LABELS))
    up = np.zeros((len(linked), LABELS))
    before = joined - 1

    def total() -> np.ndarray:
        out = own.copy()
        out[joined] += right
        out[before] += left
        out[linked] += down
        return out

    for _ in range(rounds):
        belief = total()
        new_right = _log_sum((belief[before] - left)[:, :, None] + chain, 1)
        new_left = _log_sum((belief[joined] - right)[:, None, :] + chain, 2)
        new_up = _agree(belief[linked] - down, model.skip)
        new_right -= new_right.max(axis=1, keepdims=True)
        new_left -= new_left.max(axis=1, keepdims=True)
        up = damping * up + (1 - damping) * new_up
        met = np.zeros((len(hubs), LABELS))
        np.add.at(met, hub, up)
        right = damping * right + (1 - damping) * new_right
        left = damping * left + (1 - damping) * new_left
        down = damping * down + (1 - damping) * _agree(met[hub] - up, model.skip)
    belief = total()
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def _added(words: Words, sure: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of joined words without a match whose label is sure."""
    label = np.where(sure.max(axis=1) >= SURE, sure.argmax(axis=1), 0) if len(sure) else []
    out: list[tuple[int, int, int]] = []
    last = None
    for i, x in enumerate(label):
        if not x or words.labels[i]:
            continue
        if last == i - 1 and words.joined[i] and label[last] == x:
            out[-1] = (out[-1][0], out[-1][1], words.ends[i])
        else:
            out.append((int(x) - 1, words.starts[i], words.ends[i]))
        last = i
    return out


def find(texts: list[str], model: Model) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, whether a pattern matches) for each text, by kind and start."""
    out: list[list[tuple[int, int, int, bool]]] = []
    waiting: list[Words] = []

    def settle() -> None:
        open_words = [d for d in waiting if not all(d.labels)]
        sure = marginals(open_words, model) if open_words else None
        at = 0
        for d in waiting:
            spans = [(*s, True) for s in d.base]
            if not all(d.labels):
                spans += [(*s, False) for s in _added(d, sure[at : at + len(d.labels)])]
                at += len(d.labels)
            out.append(sorted(spans))
        waiting.clear()

    held = 0
    for text in texts:
        waiting.append(read_words(text))
        held += len(waiting[-1].labels)
        if held >= WORDS_AT_ONCE:
            settle()
            held = 0
    settle()
    return out


def _column(batch: pa.RecordBatch, at: int) -> list[str]:
    return [x or "" for x in batch.column(at).to_pylist()]


def count_settings(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each setting occurs in the whole table."""
    names = ["shape", "before", "after", "beside", "own"]

    def count(batches: ArrowRows) -> ArrowRows:
        seen: Counter = Counter()
        for batch in pieces(batches):
            for x in _column(batch, 0):
                seen.update(settings(read_words(x)))
        if seen:
            columns = [pa.array(c, pa.int32()) for c in zip(*seen)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=[*names, "n"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(count, ", ".join(f"{n} int" for n in names) + ", n long")
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text") -> Model:
    """Weights from the pattern matches of the whole table; what reaches the driver is bounded by the number of settings."""
    return fit([tuple(r) for r in count_settings(df, text).collect()])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_personal_data(df: DataFrame, model: Model | None = None, text: str = "text", spans: str = "spans", keep_text: bool = True) -> DataFrame:
    """All columns, with the spans of personal data by kind and start; ``base`` tells pattern matches from added ones."""
    model = model or train(df, text)
    names = [c for c in df.columns if c != spans]
    at = names.index(text)
    kept = [i for i, c in enumerate(names) if keep_text or i != at]

    def run(batches: ArrowRows) -> ArrowRows:
        for batch in pieces(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in row] for row in find(_column(batch, at), model)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(found, _SPANS)], names=[*[names[i] for i in kept], spans])

    rows = df.select(*[f"`{c}`" for c in names])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(rows.schema) if i in kept]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{spans}` {SPANS}"]))


def mask_personal_data(df: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """All columns; in the text each span, or spans that overlap, is the name of the first kind in brackets."""
    model = model or train(df, text)
    names, schema = df.columns, df.schema
    at = names.index(text)

    def mask(value: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
        out, done, name = [], 0, ""
        for start, end, kind in sorted((a, b, k) for k, a, b, _ in spans):
            if start < done and name:
                done = max(done, end)
                continue
            name = f"[{KINDS[kind].upper()}]"
            out += [value[done:start], name]
            done = end
        return value if not out else "".join([*out, value[done:]])

    def run(batches: ArrowRows) -> ArrowRows:
        for batch in pieces(batches):
            values = batch.column(at).to_pylist()
            masked = pa.array([mask(v, s) for v, s in zip(values, find([v or "" for v in values], model))], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else batch.column(i) for i in range(len(names))], names=names)

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the matches of each kind, the hash of all matches, and all spans as kind:start:end."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = find_personal_data(rows, keep_text=False)
    written = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = "filter(spans, x -> x.base)"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(written.format(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(written.format("spans")).alias("spans"), F.expr("cast(size(filter(spans, x -> NOT x.base)) AS bigint)").alias("n_added"),
    )
