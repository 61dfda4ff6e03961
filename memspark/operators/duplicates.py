"""Duplicate entities, duplicate review and memories that repeat each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memspark.functions.text import content_overlap, title_similarity
from memspark.operators import close_names
from memspark.operators.matching import substring_pairs
from memspark.operators.ranking import top_per_group, with_project
from memspark.runtime import cut_lineage
from memspark.sources.tables import spread

EXACT_CONFIDENCE = 0.98


#: Names up to this long meet on what is left of them without some letters. A pair with a longer name meets on a part.
SHORT_NAME = 32
#: Names beyond which that is done in groups of a few names (close_names.py); below, one join without Python is soon done.
FEW_NAMES = 20_000


def _cut(length: Column | int, part: int, parts: int) -> Column:
    """Where a part of a name begins (from 0) when the name is cut into nearly equal parts; the last part ends at the length."""
    return F.floor(length * F.lit(part) / F.lit(parts)).cast("int")


def _without(name: Column, letters: int) -> list[Column]:
    """What is left of a name without 0, 1, ... ``letters`` of its letters, as arrays of distinct texts."""
    level = F.array(F.struct(name.alias("left"), F.lit(1).alias("at")))
    out = [F.array(name)]
    for _ in range(letters):
        # Letters go from left to right, so no set of them goes twice.
        level = F.flatten(
            F.transform(
                level,
                lambda s: F.transform(
                    F.when(s["at"] <= F.char_length(s["left"]), F.sequence(s["at"], F.char_length(s["left"]))).otherwise(F.array().cast("array<int>")),
                    lambda i: F.struct(F.concat(F.substring(s["left"], F.lit(1), i - 1), F.substring(s["left"], i + 1, F.char_length(s["left"]))).alias("left"), i.alias("at")),
                ),
            )
        )
        out.append(F.array_distinct(F.transform(level, lambda s: s["left"])))
    return out


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _short_pairs(able: DataFrame, max_dist: int, prefix: int = 0) -> DataFrame:
    """Pairs (rep, rep2, dist) of names of at most SHORT_NAME letters with at most ``max_dist`` edits, each pair once.

    Of many names, each is sent to a few groups, not once for everything that it may be without two letters; large groups
    are dealt over more buckets by what is left of the names. Names and groups are counted first, which are jobs while planning.
    """
    able = able.filter(F.col("n") <= SHORT_NAME)
    many = able.count() > FEW_NAMES
    able = spread(able)
    if max_dist > 2 or not many:
        return _measured(_left_pairs(able, max_dist), max_dist, prefix)
    # The length keeps apart what the concatenation would join.
    scope = F.concat(F.char_length("project").cast("string"), F.lit(":"), F.col("project").cast("string"), F.col("type").cast("string"))
    able = able.select(F.xxhash64("project", "type").alias("seed"), scope.alias("scope"), "key", "rep")
    rep = able.schema["rep"].dataType
    long, whole = T.LongType(), T.IntegerType()
    named = {"scope": T.StringType(), "key": T.StringType(), "rep": rep}
    counted, routed = _schema(g=long, weight=long), _schema(g=long, weight=long, what=whole, **named)
    dealt, found = _schema(g=long, part=whole, parts=whole, weight=long, what=whole, **named), _schema(rep=rep, rep2=rep, dist=whole)
    groups = able.mapInArrow(close_names.route(to_arrow_schema(counted), True), counted).groupBy("g").agg(F.sum("weight").alias("weight"))
    hot = groups.filter(F.col("weight") > close_names.GROUP_KEYS)
    hot = cut_lineage(hot.select("g", F.ceil(F.col("weight") / close_names.GROUP_KEYS).cast("int").alias("parts")))
    rows = able.mapInArrow(close_names.route(to_arrow_schema(routed), False), routed)
    if hot.isEmpty():
        rows = rows.withColumns({"part": F.lit(0), "parts": F.lit(1)})
    else:
        rows = rows.join(hot, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.mapInArrow(close_names.deal(to_arrow_schema(dealt)), dealt)
    # A number, as few bytes here are much work.
    rows = rows.repartition(int(able.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g")
    return rows.mapInArrow(close_names.meet(to_arrow_schema(found), max_dist, prefix), found)


def _left_pairs(able: DataFrame, max_dist: int) -> DataFrame:
    """Candidate pairs (key, key2, rep, rep2) from one join on what is left.

    Names within ``max_dist`` edits are equal once that many letters of the longer one are gone, and of the shorter one as
    many less as it is shorter. Both sides of the join are one shuffle. A common beginning doesn't bring names together.
    """
    hashed = lambda left, gone: F.transform(left, lambda x: F.struct(F.xxhash64("project", "type", x).alias("h"), F.lit(gone).alias("gone")))
    keys = F.concat(*[hashed(left, gone) for gone, left in enumerate(_without(F.col("key"), max_dist))])
    met = able.select("project", "type", "key", "rep", F.inline(keys)).repartition("h")
    a, b = met.alias("a"), met.hint("merge").alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.greatest("a.gone", "b.gone") == max_dist) & (F.col("a.key") < F.col("b.key"))
    same = same & (F.col("a.project") == F.col("b.project")) & (F.col("a.type") == F.col("b.type"))
    return a.join(b, same).select(F.col("a.key").alias("key"), F.col("b.key").alias("key2"), F.col("a.rep").alias("rep"), F.col("b.rep").alias("rep2"))


def _long_pairs(able: DataFrame, max_dist: int) -> DataFrame:
    """Candidate pairs of which the longer name has more than SHORT_NAME letters.

    The shorter name is cut into one part more than ``max_dist``; one part at least survives the edits, and stands in the
    other name at most that far from its place, so the names meet in an equi-join on the part.
    """
    parts = max_dist + 1
    able = spread(able.filter(F.col("n") > SHORT_NAME - max_dist))

    def piece(i: int, length: Column, start: Column) -> Column:
        return F.struct(length.alias("n"), F.lit(i).alias("part"), F.substring("key", start + 1, _cut(length, i + 1, parts) - _cut(length, i, parts)).alias("piece"))

    own = F.array(*[piece(i, F.col("n"), _cut(F.col("n"), i, parts)) for i in range(parts)])
    # In the longer name: for every length the shorter may have, each of its parts at every place it may have moved to.
    other = F.array(
        *[
            piece(i, F.col("n") - less, _cut(F.col("n") - less, i, parts) + shift)
            for less in range(max_dist + 1) for i in range(parts) for shift in range(-max_dist, max_dist + 1)
        ]
    )
    other = F.array_distinct(F.filter(other, lambda x: (x["n"] >= parts) & (F.char_length(x["piece"]) > 0)))
    a = able.select("project", "type", "key", "rep", F.inline(own))
    b = able.filter(F.col("n") > SHORT_NAME).select("project", "type", F.col("key").alias("key2"), F.col("rep").alias("rep2"), F.inline(other))
    # Names of equal length meet from both sides; one side is enough.
    once = (F.char_length("key2") > F.char_length("key")) | (F.col("key") < F.col("key2"))
    return a.join(b.hint("merge"), ["project", "type", "n", "part", "piece"]).filter(once).select("key", "key2", "rep", "rep2")


def _measured(candidates: DataFrame, max_dist: int, prefix: int) -> DataFrame:
    """Candidate pairs with the edits between them, those within ``max_dist`` once each."""
    same_head = F.lit(True) if not prefix else F.substring("key", 1, prefix) == F.substring("key2", 1, prefix)
    return (
        candidates.filter(same_head)
        .withColumn("dist", F.levenshtein("key", "key2", max_dist))
        .filter("dist > 0")
        .select("rep", "rep2", "dist")
        .distinct()
    )


def flag_duplicates(entities: DataFrame, max_dist: int = 2, prefix: int | None = None, longest: int | None = None) -> DataFrame:
    """(source_id, target_id, confidence, match_type) of likely equal entities within a project and type.

    Exact: equal lower-cased names, every entity paired with the smallest id of its name, which is a link per entity and
    never all pairs. Fuzzy: names (represented by that smallest id) at most ``max_dist`` edits apart, met by what is left
    of short names without some letters, and by parts of long ones. Names with fewer letters than ``max_dist`` + 1 are only
    compared as a whole. ``prefix`` asks for so many equal first letters, ``longest`` leaves longer names (in bytes) out;
    both are off. Candidates are never broadcast: from a small table come many.
    """
    named = entities.select("id", "project", "type", F.lower("name").alias("key"))
    reps = cut_lineage(named.groupBy("project", "type", "key").agg(F.min("id").alias("rep")))
    exact = (
        named.join(reps, ["project", "type", "key"])
        .filter(F.col("id") != F.col("rep"))
        .select(F.col("rep").alias("source_id"), F.col("id").alias("target_id"), F.lit(EXACT_CONFIDENCE).alias("confidence"), F.lit("exact").alias("match_type"))
    )
    able = reps.filter(F.col("project").isNotNull() & F.col("type").isNotNull()).withColumn("n", F.char_length("key"))
    able = able.filter(F.col("n") >= max(max_dist + 1, prefix or 0))
    if longest is not None:
        able = able.filter(F.octet_length("key") <= longest)
    close = _short_pairs(able, max_dist, prefix or 0)
    if not able.filter(F.col("n") > SHORT_NAME).isEmpty():
        close = close.unionByName(_measured(_long_pairs(able, max_dist), max_dist, prefix or 0))
    fuzzy = close.select(
        F.least("rep", "rep2").alias("source_id"), F.greatest("rep", "rep2").alias("target_id"), F.round(1 - F.col("dist") * 0.1, 2).alias("confidence"), F.lit("fuzzy").alias("match_type")
    )
    return exact.unionByName(fuzzy)


def upsert_same_as(same_as: DataFrame, found: DataFrame) -> DataFrame:
    """Highest confidence and latest match type per pair; a review status stays. Rows carry ``created_at``."""
    old = same_as.withColumn("__new", F.lit(0))
    new = found.withColumns({"status": F.lit("pending"), "__new": F.lit(1)})
    # Texts make these sorted aggregates. Nearly every pair is there once, so they aren't sorted before the shuffle too.
    return (
        old.unionByName(new)
        .repartition("source_id", "target_id")
        .groupBy("source_id", "target_id")
        .agg(
            F.max("confidence").alias("confidence"),
            F.max(F.struct("__new", "created_at", "match_type"))["match_type"].alias("match_type"),
            F.min(F.struct("__new", "created_at", "status"))["status"].alias("status"),
            F.min("created_at").alias("created_at"),
        )
    )


def pending_duplicates(same_as: DataFrame, entities: DataFrame, min_confidence: float = 0.7, project: str | None = None, limit: int = 100) -> DataFrame:
    owners = with_project(entities, project).select(F.col("id").alias("source_id"), "project")
    return (
        same_as.filter((F.col("status") == "pending") & (F.col("confidence") >= min_confidence))
        .join(owners, "source_id")
        .orderBy(F.desc("confidence"), "source_id", "target_id")
        .limit(limit)
    )


def review_duplicates(same_as: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reviews(source_id, target_id, confirm)``; unreviewed pairs stay as they are."""
    return (
        same_as.join(reviews.withColumnRenamed("confirm", "__confirm"), ["source_id", "target_id"], "left")
        .withColumn(
            "status",
            F.when(F.col("__confirm"), "confirmed").when(~F.col("__confirm"), "rejected").otherwise(F.col("status")),
        )
        .drop("__confirm")
    )


def auto_merge(same_as: DataFrame, entities: DataFrame, min_confidence: float = 0.95, project: str | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Confirm every pending pair at or above the threshold -> (new table, report(found, merged, dry_run))."""
    owners = with_project(entities, project).select(F.col("id").alias("source_id"))
    pick = (F.col("status") == "pending") & (F.col("confidence") >= min_confidence)
    chosen = same_as.filter(pick).join(owners, "source_id", "left_semi")
    count = F.count(F.lit(1))
    report = chosen.agg(count.alias("found"), (F.lit(0).cast("bigint") if dry_run else count).alias("merged")).withColumn("dry_run", F.lit(dry_run))
    if dry_run:
        return same_as, report
    done = chosen.select("source_id", "target_id", F.lit(True).alias("confirm"))
    return review_duplicates(same_as, done), report


def canonical_ids(same_as: DataFrame) -> DataFrame:
    """(id, canonical_id) over confirmed pairs: the smallest id of each connected group.

    Label propagation with a jump through the label's own label each round; rounds are checkpointed.
    """
    pairs = same_as.filter("status = 'confirmed'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    pairs = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        near = pairs.join(labels.select(F.col("a").alias("b"), "label"), "b").select("a", "label")
        jump = labels.join(labels.select(F.col("a").alias("label"), F.col("label").alias("next")), "label").select("a", F.col("next").alias("label"))
        grown = labels.unionByName(near).unionByName(jump).groupBy("a").agg(F.min("label").alias("new"))
        step = cut_lineage(grown.join(labels, "a").select("a", F.col("new"), (F.col("new") != F.col("label")).alias("moved")))
        labels = step.select("a", F.col("new").alias("label"))
        if step.filter("moved").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("canonical_id"))


def similar_memories(new: DataFrame, memories: DataFrame, candidates: int = 5, title_min: float = 0.6, content_min: float = 0.5) -> DataFrame:
    """Existing memories a new one may repeat: (new_id, memory_id, title, strength).

    A candidate's title or content contains the whole new content; the five strongest candidates are compared by words.
    Everything runs over distinct texts: per project and text only the five strongest memories can matter.
    """
    strongest = [F.desc("strength"), F.asc("id")]
    texts = memories.select("id", "project", "title", "content", "strength", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower("content")))).alias("text"))
    best = top_per_group(texts, ["project", "text"], strongest, candidates).drop("rank")
    asked = new.select(F.coalesce("project", F.lit("")).alias("q_project"), F.lower("content").alias("needle")).filter("needle <> ''").distinct()
    found = (
        asked.join(substring_pairs(asked, texts), "needle")
        .join(best, "text")
        .filter((F.col("q_project") == "") | (F.col("q_project") == F.col("project")))
        .dropDuplicates(["q_project", "needle", "id"])
    )
    top = top_per_group(found, ["q_project", "needle"], strongest, candidates)
    top = top.select("q_project", "needle", F.col("id").alias("memory_id"), F.col("title").alias("m_title"), F.col("content").alias("m_content"), "strength")
    asked_rows = new.select(
        F.col("id").alias("new_id"), F.coalesce("project", F.lit("")).alias("q_project"), F.lower("content").alias("needle"), "title", "content"
    )
    alike = (title_similarity(F.col("m_title"), F.col("title")) >= title_min) | (content_overlap(F.col("m_content"), F.col("content")) >= content_min)
    return asked_rows.join(top, ["q_project", "needle"]).filter(alike).select("new_id", "memory_id", F.col("m_title").alias("title"), "strength")
