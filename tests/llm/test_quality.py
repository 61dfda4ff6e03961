"""Quality: held-out accuracy, the shrinking of sites, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from memspark.llm import quality as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = Q.classify(docs, labels, max_labelled=2500, with_text=False)
    used = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2500).select("doc_id")
    held = out.join(labels, "doc_id").join(used, "doc_id", "left_anti").select("quality", "toxic", "kept").toPandas()
    bad = (held.quality == 0) | (held.toxic == 1)
    assert len(held) > 1000 and bad.sum() > 200
    assert (bad & ~held.kept).sum() >= 0.95 * bad.sum()
    assert (~bad & ~held.kept).sum() <= 0.01 * (~bad).sum()


def test_sites_shrink_toward_the_global_mean(spark):
    rng = np.random.default_rng(1)
    rows = [("bad", "x", float(p)) for p in rng.uniform(0.6, 0.9, 400)] + [("good", "x", float(p)) for p in rng.uniform(0.0, 0.1, 400)] + [("new", "y", 0.9)]
    df = spark.createDataFrame([(h, p, e, 0.01) for h, p, e in rows], "source string, lang string, e_poor double, e_toxic double")
    sites, facts = Q.site_posteriors(df, "source", ("lang",))
    prior = {r.source: r.prior_poor for r in sites.collect()}
    assert prior["bad"] > 0.7 and prior["good"] < 0.1
    assert facts["mean_poor"] < prior["new"] < 0.9 and facts["host_poor"] >= 1


def test_odd_rows(spark):
    words = "plain words of a clean text that goes on for a while and says nothing odd at all".split()
    rows, marks = [], []
    for i in range(60):
        text = " ".join(words[i % 7 :] + words[: i % 7] + [f"n{i}"])
        rows.append((i, text if i % 3 else " ".join(["SPAM!!"] * 30 + [f"n{i}"]), "s" if i % 2 else None, None, "own"))
        marks.append((i, int(i % 3 != 0), 0))
    rows += [(900, None, "s", "en", "own"), (901, "", None, "en", None), (902, "...", "s", None, "x"), (1, rows[1][1], "s", None, "own"), (None, rows[1][1], "s", None, "own")]
    marks += [(0, 1, 0), (5000, 0, 1), (None, 0, 0), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p_poor string").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = Q.classify(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id < 60:
            assert r.kept == (r.doc_id % 3 != 0)
    assert all(r.kept for r in out if r.doc_id in (900, 901))
    assert {r.doc_id for r in out if r.text is None} == {900}
    assert Q.classify(docs.limit(0), labels).count() == 0
    nothing = Q.classify(docs, labels.limit(0)).collect()
    assert len(nothing) == len(rows) and all(r.kept for r in nothing)


def test_the_same_however_rows_are_dealt(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, labels = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10**9)), labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 10**9))
    got = []
    for dealt in (docs.coalesce(1).orderBy("doc_id"), docs.repartition(3, "lang"), docs.orderBy(F.desc("doc_id")).repartition(7)):
        got.append({r.doc_id: r.kept for r in Q.classify(dealt, labels, with_text=False).select("doc_id", "kept").collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == docs.count()
