"""Merkle manifest of a dataset: a hash tree for each group, a tree over the groups, and every row's proof.

The leaves of a group lie in the order of their key. A superblock is a subtree of ``FAN ** LEVELS`` leaves. On the way up the
nodes of each superblock are reduced to one, which is a leaf of the next round, until every tree has one node. On the way
down the nodes of a superblock are cogrouped with the one row that holds all that a proof needs from outside of it: the
siblings from its top to the root. There the subtree is reduced again, its siblings are put before the outer ones, and
proofs are joined, hashed and folded in the same task. Each side of the exchange has one superblock, never a group.

Where a leaf stands in its tree comes from one range sort: positions within sorted partitions, and the counts of the
partitions before. No window runs over a group's rows.

Edge cases: a null field hashes as ``-``, so null and empty text differ; a null group is a group of its own and comes
first; null keys come first in their group and are never tampered with in the digest; equal keys are ordered by leaf, and
rows that are equal in everything have neighbouring places in any order; a group of one row is its own subroot; an empty
table has no rows and no root; other columns, whatever their names, take no part; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import ArrowRows, stored

FAN = 8
#: Levels of a superblock, which has FAN ** LEVELS leaves.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_OUTER = "tree string, block long, befores array<string>, afters array<string>, subroot string, root string"
_NODE = "tree string, at long, n long, digest string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Each field as its length in bytes, a colon and its value, or a dash; then the hash of all."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _tree(group: Column) -> Column:
    """A group's name that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def _numbered(batches: ArrowRows) -> ArrowRows:
    """Rows of a sorted partition with its number and their place in the partition's run of their tree (column 0)."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = pc.dictionary_encode(batch.column(0))
        runs = codes.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1))
        first, final = codes.dictionary[int(runs[0])].as_py(), codes.dictionary[int(runs[-1])].as_py()
        place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(starts, append=batch.num_rows))
        if first == last:
            place[: starts[1] if len(starts) > 1 else batch.num_rows] += seen
        last, seen = final, int(place[-1]) + 1
        columns = [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with their place in their tree (at) and its size (n). Order has to tell all unlike rows apart."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_numbered, f"{fields}, part int, place long"))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    # A tree has a row for each sorted partition here, not for each leaf.
    offsets = counts.selectExpr(
        "tree", "part", "sum(rows) OVER (PARTITION BY tree) AS n",
        "coalesce(sum(rows) OVER (PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
    )
    return placed.join(offsets, ["tree", "part"]).withColumn("at", F.col("place") + F.col("before")).drop("part", "place", "before")


def _levels(n: int, most: int) -> int:
    """Levels, up to most, that a superblock of a tree with n nodes on this level still has."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _reduced(digests: list[str], levels: int) -> list[list[str]]:
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([_hash("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def _up(nodes: pd.DataFrame, height: int) -> pd.DataFrame:
    """One superblock as the one node it comes to."""
    nodes = nodes.sort_values("at")
    n = int(nodes["n"].iloc[0])
    levels = _levels(n, height)
    top = _reduced(nodes["digest"].tolist(), levels)[-1]
    for _ in range(levels):
        n = -(-n // FAN)
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1].tolist(), "at": [int(nodes["at"].iloc[0]) // FAN**height], "n": [n], "digest": top})


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {FAN**height}"))


def _climb(leaves: DataFrame, most: int, height: int) -> list[DataFrame]:
    """The nodes above the leaves, one for each superblock of the table before; the last has one for each tree."""
    found, nodes = [], leaves.select("tree", "at", "n", "digest")
    while most > 1 or not found:
        nodes = stored(_blocked(nodes, height).groupBy("tree", "block").applyInPandas(lambda x: _up(x, height), _NODE))
        found.append(nodes)
        most = -(-most // FAN**height)
    return found


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[tuple[list[str], list[str]]], pd.Series]:
    """The nodes of a superblock in order, and of each what stands before and after it on every level up to the root."""
    nodes, rest = nodes.sort_values("at"), outer.iloc[0]
    levels = _reduced(nodes["digest"].tolist(), _levels(int(nodes["n"].iloc[0]), height))[:-1]
    beside = []
    for digests in levels:
        pairs = []
        for i in range(len(digests)):
            start = i - i % FAN
            pairs.append(("".join(digests[start:i]), "".join(digests[i + 1 : start + FAN])))
        beside.append(pairs)
    above = list(rest["befores"]), list(rest["afters"])
    paths = []
    for i in range(len(nodes)):
        own = [pairs[i // FAN**k] for k, pairs in enumerate(beside)]
        paths.append(([b for b, _ in own] + above[0], [a for _, a in own] + above[1]))
    return nodes, paths, rest


def _down(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    """What the superblocks below need from outside: one row for each node of this one."""
    nodes, paths, rest = _paths(nodes, outer, height)
    return pd.DataFrame(
        {
            "tree": nodes["tree"].tolist(), "block": nodes["at"].tolist(), "befores": [b for b, _ in paths], "afters": [a for _, a in paths],
            "subroot": [rest["subroot"]] * len(nodes), "root": [rest["root"]] * len(nodes),
        }
    )


def _meet(nodes: DataFrame, outer: DataFrame, run, schema: str, height: int) -> DataFrame:
    both = _blocked(nodes, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return both.applyInPandas(lambda inside, outside: run(inside, outside, height), schema)


def _proofs(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    nodes, paths, rest = _paths(nodes, outer, height)
    return pd.DataFrame(
        {
            "row": nodes["row"].tolist(), "leaf": nodes["digest"].tolist(), "subroot": [rest["subroot"]] * len(nodes), "root": [rest["root"]] * len(nodes),
            "befores": [b for b, _ in paths], "afters": [a for _, a in paths],
        }
    )


def _folds(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> pd.DataFrame:
    nodes, paths, rest = _paths(nodes, outer, height)
    proofs, folded = [], []
    for now, (befores, afters) in zip(nodes["now"], paths):
        proofs.append(_hash("".join(x for pair in zip(befores, afters) for x in pair)))
        for before, after in zip(befores, afters):
            now = _hash(before + now + after)
        folded.append(now)
    return pd.DataFrame(
        {
            "row": nodes["row"].tolist(), "leaf": nodes["digest"].tolist(), "subroot": [rest["subroot"]] * len(nodes), "root": [rest["root"]] * len(nodes),
            "proof_sha256": proofs, "folded_root": folded,
        }
    )


def _exchange(leaves: DataFrame, run, schema: str, height: int) -> DataFrame:
    """Apply run to the superblocks of leaves(tree, row, digest, ...), each with its outer row."""
    leaves = _ranked(leaves, ["row", "digest", "spot"])
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return leaves.sparkSession.createDataFrame([], schema)
    # Trees of the groups, then the tree of their roots.
    levels = _climb(leaves, most, height)
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("row"), "digest")
    tops = _ranked(roots, ["row"])
    above = _climb(tops, tops.agg(F.max("n")).first()[0], height)
    none = F.array().cast("array<string>")
    outer = above[-1].select("tree", F.col("at").alias("block"), none.alias("befores"), none.alias("afters"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        outer = _meet(nodes, outer, _down, _OUTER, height)
    outer = _meet(tops, outer, _proofs, "row string, leaf string, subroot string, root string, befores array<string>, afters array<string>", height)
    outer = outer.select(F.col("row").alias("tree"), F.lit(0).cast("long").alias("block"), "befores", "afters", F.col("leaf").alias("subroot"), "root")
    for nodes in reversed(levels[:-1]):
        outer = stored(_meet(nodes, outer, _down, _OUTER, height))
    return _meet(leaves, outer, run, schema, height)


def _leaves(docs: DataFrame, key: str, group: str, fields: Sequence[str], now: Column | None = None) -> DataFrame:
    """tree, row (the key), digest, spot (tells equal rows apart) and, where given, the hash that a row has by now."""
    columns = [_tree(F.col(group)).alias("tree"), F.col(key).alias("row"), leaf_hash([F.col(c) for c in fields]).alias("digest")]
    if now is not None:
        columns.append(now.alias("now"))
    return stored(docs.select(*columns, F.monotonically_increasing_id().alias("spot")))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, height: int = LEVELS) -> DataFrame:
    """For each row its key, leaf, subroot and root, and its proof: the hashes before and after it on each level."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"row {kind}, leaf string, subroot string, root string, befores array<string>, afters array<string>"
    return _exchange(_leaves(docs, key, group, fields), _proofs, schema, height).withColumnRenamed("row", key)


def fold(leaf: Column, befores: Column, afters: Column) -> Column:
    """The root that a leaf comes to along a proof."""
    return F.aggregate(
        F.arrays_zip(befores.alias("b"), afters.alias("a")), leaf, lambda now, x: F.sha2(F.concat(x["b"], now, x["a"]).cast("binary"), 256)
    )


def verify(docs: DataFrame, made: DataFrame, key: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Hold rows against a stored manifest, each by its own proof: key and verified, false also for keys that one side lacks.

    Keys have to be unlike; of equal ones, each row of docs is held against each row of the manifest."""
    found = docs.select(F.col(key).alias(key), leaf_hash([F.col(c) for c in fields]).alias("now"))
    same = F.coalesce(fold(F.col("now"), F.col("befores"), F.col("afters")) == F.col("root"), F.lit(False))
    return found.join(made.select(key, "befores", "afters", "root"), key, "full").select(key, same.alias("verified"))


def tampered(key: Column) -> Column:
    """Rows that the digest tampers with: the CRC-32 of the key's decimals can be divided by three."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def digest(docs: DataFrame, height: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and proof hash of each document, and what a copy with tampered texts folds to."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    docs = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    changed = [F.translate("text", upper, lower) if c == "text" else F.col(c) for c in FIELDS]
    now = F.when(tampered(F.col("doc_id")), leaf_hash(changed)).otherwise(leaf_hash([F.col(c) for c in FIELDS]))
    schema = "row long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _exchange(_leaves(docs, "doc_id", "lang", FIELDS, now), _folds, schema, height)
    return out.withColumnRenamed("row", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(group_levels: int = 9, top_levels: int = 5) -> str:
    """The same, for groups of up to 8 ** group_levels rows and up to 8 ** top_levels groups."""

    def levels(name: str, count: int) -> str:
        out = []
        for k in range(count):
            out.append(
                f"{name}b{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b, "
                f"CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a FROM {name}{k})"
            )
            out.append(
                f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d FROM {name}{k} GROUP BY tree, pos // 8, n)"
            )
        return ",\n".join(out)

    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"

    steps = [("g", k, "l.tree", "l.pos") for k in range(group_levels)] + [("t", k, "''", "top.pos") for k in range(top_levels)]
    joins = "\n".join(f"JOIN {t}b{k} AS {t}{k}x ON {t}{k}x.tree = {tree} AND {t}{k}x.pos = {pos} // {FAN**k}" for t, k, tree, pos in steps)
    proof = " || ".join(f"{t}{k}x.b || {t}{k}x.a" for t, k, _, _ in steps)
    columns = ", ".join(f"{t}{k}x.b AS {t}{k}b, {t}{k}x.a AS {t}{k}a, {t}{k}x.n AS {t}{k}n" for t, k, _, _ in steps)
    folds, last = [], "p"
    for i, (t, k, _, _) in enumerate(steps):
        folds.append(f"f{i} AS (SELECT * REPLACE (CASE WHEN {t}{k}n > 1 THEN sha256({t}{k}b || f || {t}{k}a) ELSE f END AS f) FROM {last})")
        last = f"f{i}"
    return f"""
WITH RECURSIVE c AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x FROM c WHERE k < 8 * length(s)) q),
crc AS (SELECT s, xor(v, 4294967295) % 3 = 0 AS hit FROM c WHERE k = 8 * length(s)),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {leaf("text")} AS leaf,
    CASE WHEN crc.hit THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS now
  FROM documents LEFT JOIN crc ON s = CAST(doc_id AS VARCHAR)) q),
g0 AS (SELECT tree, pos, n, leaf AS d FROM l),
{levels("g", group_levels)},
top AS (SELECT tree AS own, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM g{group_levels}),
t0 AS (SELECT '' AS tree, pos, n, subroot AS d FROM top),
{levels("t", top_levels)},
p AS (SELECT l.doc_id, l.leaf, top.subroot, r.d AS root, sha256({proof}) AS proof_sha256, l.now AS f, {columns}
FROM l JOIN top ON top.own = l.tree JOIN t{top_levels} r ON TRUE
{joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {last}"""
