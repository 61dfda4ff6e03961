"""Near duplicates of documents by SetSketch registers.

A document's set is hashed word shingles. Each register holds the exponentially spaced, truncated minimum of one hash
over the set; registers of parts merge by their maximum, and two registers agree about as often as the sets overlap.
Bands of registers bring documents together; the overlap of two is estimated from all registers and both set sizes by
maximum likelihood, and what the estimate leaves is verified on the full sets.

Work on groups is kept linear where the group is alike: equal sets are one class; then each class is compared with the
first of its bands; only classes that are still in different components are compared further. No pair is left out that
shares a band and isn't linked otherwise.

Edge cases: null, empty and wordless texts have no shingles, are linked with nothing and stay; texts of fewer words than a
shingle are one shingle; a row without doc_id has no component, links with nothing and stays; rows that share a doc_id
count as one document; texts of any length are taken whole; other columns are carried on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import column_bytes, map_rows, stored
from memspark.llm.components import components

SHINGLE = 5
BAND, BANDS = 4, 28
REGISTERS = BAND * BANDS
#: Base and rate of the registers: fine enough that unequal minima hardly meet, with room for sets of any size.
BASE, RATE, LAST = 1.001, 20.0, 65534
#: Five standard errors of the estimate below the threshold.
SLACK = 0.2
#: Bytes of text hashed together.
PIECE = 500_000
#: Rows and shingles of a block, two of which meet in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 300_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if 9 <= b <= 13 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_TIMES = (_rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64)
_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the root and of its inverse, as far as needed so far."""

    root = _powers(_ROOT, 1 << 16)
    inverse = _powers(_INVERSE, 1 << 16)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.root) < n:
            cls.root, cls.inverse = _powers(_ROOT, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.root[:n], cls.inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and its hash. Long texts are taken in pieces that end at a space."""
    found, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        chars = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.zeros(len(chars) + 2, np.int8)
        inside[1:-1] = chars != 32
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, back = _Powers.upto(len(chars) + 1)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_BYTE[chars] * power[: len(chars)], out=sums[1:])
        found.append((starts + at, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))))
        at = end
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    joined = b" ".join((x or b"") for x in texts).translate(_FOLD)
    ends_at = np.cumsum([len(x or b"") + 1 for x in texts])
    empty = np.empty(0, np.uint64)
    if not joined:
        return [empty] * len(texts)
    starts, words = _hashed_words(joined)
    if not len(starts):
        return [empty] * len(texts)
    first = np.searchsorted(starts, np.concatenate([[0], ends_at[:-1]]))
    last = np.append(first[1:], len(words))
    out = []
    rolled = None
    if len(words) >= size:
        rolled = reduce(np.add, (words[j : len(words) - size + 1 + j] * _PLACE[j] for j in range(size)))
        rolled = mix(rolled)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of sets that aren't empty, a row each."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((joined ^ _XOR[i]) * _TIMES[i], starts)
    minima = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(minima, 1e-300)) / np.log(BASE)), 0, LAST + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Overlap (Jaccard) of pairs with the greatest likelihood, given registers and set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = chance(u - v * j), chance(v - u * j)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        left, right = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def sketch(df: DataFrame) -> DataFrame:
    """Rows of doc_id and text as doc_id, n_shingles, two sums that stand for the set, registers and band keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(column_bytes(batch, "text"))
        n = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(n)
        sums = np.zeros((2, len(sets)), np.uint64)
        regs: list[bytes | None] = [None] * len(sets)
        bands: list[list[int] | None] = [None] * len(sets)
        if len(full):
            chosen = [sets[i] for i in full]
            joined, starts = np.concatenate(chosen), np.cumsum([0] + [len(x) for x in chosen[:-1]])
            sums[0, full] = np.add.reduceat(mix(joined), starts)
            sums[1, full] = np.add.reduceat(mix(joined ^ _XOR[0]), starts)
            got = registers(chosen)
            keys = (got.reshape(len(full), BANDS, BAND).astype(np.uint64) * _PLACE[:BAND]).sum(2, dtype=np.uint64)
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _PLACE[8]).view(np.int64)
            for row, i in enumerate(full.tolist()):
                regs[i], bands[i] = got[row].tobytes(), keys[row]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "s1", "s2", "registers", "bands"],
        )

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, s1 long, s2 long, registers binary, bands array<long>", rows=64)


def _promising(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose estimated overlap isn't far below the threshold."""
    of = nodes.select("node", "registers", "n_shingles")
    side = lambda c: of.select(F.col("node").alias(c), F.struct("registers", "n_shingles").alias(f"of_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(F.least("of_a.n_shingles", "of_b.n_shingles") >= threshold * F.greatest("of_a.n_shingles", "of_b.n_shingles") - 1)
    flat = both.select("a", "b", F.col("of_a.registers").alias("ra"), F.col("of_b.registers").alias("rb"), F.col("of_a.n_shingles").alias("na"), F.col("of_b.n_shingles").alias("nb"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5))
        return batch.select(["a", "b"]).filter(pa.array(estimate(a, b, na, nb) >= threshold - SLACK))

    return map_rows(flat, run, "a long, b long", rows=4096)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets overlap enough. b's text moves with the pair; a, which may be in many pairs, is met last."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, a, b = batch.column(0).to_pylist(), column_bytes(batch, "text_a"), column_bytes(batch, "text_b")
        keep, held = [], {}
        sets_b = shingle_sets(b)
        for i, x in enumerate(ids):
            if x not in held or held[x][0] != a[i]:
                held = {x: (a[i], shingle_sets([a[i]])[0])}
            one, two = held[x][1], sets_b[i]
            joint = np.intersect1d(one, two, assume_unique=True).size
            keep.append(bool(joint) and 100 * joint >= percent * (len(one) + len(two) - joint))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(both, run, "a long, b long", rows=64).distinct()


def _block_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of one band and different labels that overlap enough by 32 bits of each shingle, give or take a hundredth.

    A band of several labels is cut into blocks by the hash of its nodes, as many as its rows and shingles ask for. Every
    two blocks meet in a task of bounded size, which gives out links and no other pairs. A pair is looked at in the first
    band that it shares.
    """
    mixed = members.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    members = stored(members.join(mixed, "band", "left_semi"))
    chosen = members.select(F.col("node").alias("doc_id")).distinct()

    def short(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(column_bytes(batch, "text"))
        halves = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(halves, pa.binary())], names=["node", "n", "short"])

    sets = stored(map_rows(texts.join(chosen, "doc_id", "left_semi").select("doc_id", "text"), short, "node long, n long, short binary"))
    bands = members.groupBy("node").agg(F.sort_array(F.collect_list("band")).alias("bands"))  # at most one for each band of the sketch
    sized = members.join(sets.select("node", "n"), "node").groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sized, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("band", "node", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    cells = cells.join(bands, "node").join(sets.drop("n"), "node")

    def compare(cell: pa.Table) -> pa.Table:
        nodes, labels, block = (cell.column(c).to_numpy() for c in ("node", "label", "block"))
        band, i, j = (cell.column(c)[0].as_py() for c in ("band", "i", "j"))
        parts = [np.frombuffer(x, np.uint32) for x in cell.column("short").to_pylist()]
        sizes = np.array([len(x) for x in parts])
        _, place, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(parts)), sizes)
        shared = often[place] > 1
        row, column = row[shared], (np.cumsum(often > 1) - 1)[place[shared]]
        joint = np.zeros((len(parts), len(parts)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            low, high = np.searchsorted(column, [start, start + 4096])
            has = np.zeros((len(parts), 4096), np.float32)
            has[row[low:high], column[low:high] - start] = 1
            joint += has @ has.T
        near = 100 * joint >= (percent - 1) * (sizes[:, None] + sizes[None, :] - joint)
        near &= (labels[:, None] != labels[None, :]) & (nodes[:, None] < nodes[None, :])
        near &= ((block[:, None] == i) & (block[None, :] == j)) | ((block[:, None] == j) & (block[None, :] == i))
        a, b = np.nonzero(near)
        of = cell.column("bands").to_pylist()
        first = [min(set(of[x]) & set(of[y])) == band for x, y in zip(a.tolist(), b.tolist())]
        return pa.table({"a": nodes[a][first].astype(np.int64), "b": nodes[b][first].astype(np.int64)})

    return cells.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def near_groups(df: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the least doc_id of the group) and kept."""
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(sketch(texts))
    classes = stored(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("s1", "s2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    )
    threshold = percent / 100
    members = classes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    members = stored(members.join(buckets, "band"))
    wanted = members.select("node").distinct()
    nodes = stored(classes.join(wanted, "node", "left_semi").select("node", "registers", "n_shingles"))
    links = None
    labels = None
    # First each class with the least leader of its bands, then with all its leaders, then all that share a band, in blocks.
    for step in range(3):
        if step == 0:
            pairs = members.groupBy("node").agg(F.min("leader").alias("a")).where("a < node").select("a", F.col("node").alias("b"))
        else:
            labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            if step == 1:
                of_leader = labels.select(F.col("node").alias("leader"), F.col("component").alias("to"))
                pairs = labelled.where("leader < node").join(of_leader, "leader", "left").where("coalesce(to, leader) <> label").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
            else:
                pairs = _block_links(labelled.select("band", "node", "label"), texts, percent)
        if step < 2:
            pairs = stored(_promising(pairs, nodes, threshold))
        found = stored(_verified(pairs, texts, percent))
        links = found if links is None else links.union(found)
        labels = components(links)
    moved = classes.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    moved = moved.where("copies > 1 OR component_id <> node").select("s1", "s2", "n_shingles", "component_id")
    out = rows.join(moved, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group, with all columns; of rows alike in doc_id one stays. Rows that link with nothing stay."""
    gone = near_groups(df, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    left = df.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    twice = df.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id"))
    if twice.isEmpty():
        return left
    same = F.col("doc_id") == F.col("twice_id")
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))
