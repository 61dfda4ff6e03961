"""Substring matching between two tables without a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memspark.sources.tables import spread

GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    count = F.char_length(text) - n + 1
    starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def substring_pairs(needles: DataFrame, texts: DataFrame, needle_col: str = "needle", text_col: str = "text") -> DataFrame:
    """Distinct (needle, text) pairs where the text contains the needle; both sides as given, case included.

    A text that contains a needle contains each of its three-letter pieces (the whole needle when it is shorter). Every
    needle is keyed by the piece found in the fewest texts, and joined on that piece only, so the candidates of a needle
    are the fewest an equi-join can give; ``contains`` then decides. Both inputs are made distinct first, so repeated
    texts or needles cost nothing.
    """
    n = needles.select(F.col(needle_col).alias("needle")).filter(F.char_length("needle") > 0).distinct()
    t = texts.select(F.col(text_col).alias("text")).filter(F.char_length("text") > 0).distinct()
    n_grams = n.select("needle", F.explode(_grams(F.col("needle"), F.least(F.lit(GRAM), F.char_length("needle")))).alias("gram"))
    # Usually every needle has three letters or more; at most three different sizes come back.
    sizes = sorted(r[0] for r in n.select(F.least(F.lit(GRAM), F.char_length("needle"))).distinct().collect()) or [GRAM]
    # Pieces move with the text's hash; the text itself is fetched for the last test only, which also sorts out equal hashes.
    t = spread(t).withColumn("text_key", F.xxhash64("text"))
    wanted = n_grams.select("gram").distinct()
    t_grams = t.select("text_key", F.explode(F.concat(*[_grams(F.col("text"), size) for size in sizes])).alias("gram")).join(wanted, "gram", "left_semi")
    # A shuffle of their own shows their true size: from a small table come many pieces, which must not be sent to one task
    # of needles.
    t_grams = t_grams.repartition("text_key")
    seen = t_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    keyed = (
        n_grams.join(seen, "gram")
        .groupBy("needle")
        .agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"))
    )
    candidates = keyed.join(t_grams, "gram").select("needle", "text_key").repartition("text_key")
    return candidates.join(t, "text_key").filter(F.contains("text", "needle")).select("needle", "text").distinct()
