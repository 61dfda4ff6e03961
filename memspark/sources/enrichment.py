"""Join of entities with a supplied enrichment table, with an age limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TTL_DAYS = 7


def fresh_enrichment(enrichment: DataFrame, now, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Latest record per (type, folded name) that is not older than the limit."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(ttl_days))
    latest = enrichment.groupBy("type", F.lower("name").alias("key")).agg(F.max(F.struct("fetched_at", "summary")).alias("l"))
    return latest.filter(F.col("l.fetched_at") >= limit).select("type", "key", F.col("l.summary").alias("summary"), F.col("l.fetched_at").alias("fetched_at"))


def enrich(entities: DataFrame, enrichment: DataFrame, now, ttl_days: int = TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """-> (entities with enrichment where known, entities to fetch). Unnamed and sensitive entities are never fetched."""
    fresh = fresh_enrichment(enrichment, now, ttl_days)
    open_to = (F.coalesce("name", F.lit("")) != "") & ~F.coalesce("sensitive", F.lit(False))
    keyed = entities.withColumn("key", F.when(open_to, F.lower("name")))
    joined = keyed.join(fresh, ["type", "key"], "left")
    todo = keyed.filter("key IS NOT NULL").join(fresh, ["type", "key"], "left_anti").select("type", "key").distinct()
    return joined.drop("key"), todo


def set_enrichment(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates(id, enriched, latitude, longitude)``: given values overwrite, missing ones leave the entity as it is."""
    cols = ["enriched", "latitude", "longitude"]
    new = updates.select("id", *[F.col(c).alias(f"__{c}") for c in cols])
    joined = entities.join(new, "id", "left")
    for c in cols:
        old = F.col(c) if c in entities.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(F.col(f"__{c}"), old))
    return joined.drop(*[f"__{c}" for c in cols])
