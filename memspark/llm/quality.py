"""Quality classifier by hierarchical empirical Bayes.

Each document gets evidence of its own from a small classifier on style and on words that speak for a fault. Its site (a
path such as source and language, in a host such as the source) has a posterior of its own: the mean evidence of its
documents, shrunk toward the host's, which is shrunk toward the global mean. How strongly follows from how much hosts and
paths differ (method of moments). A document's odds are moved by how its site's odds, without its own part, differ from
the global ones. There are two faults, poor quality and toxicity; a document likely to have either is rejected.

Fitted on a bounded sample of the labelled rows; all counts of sites run over all documents.

Edge cases: a null, empty or wordless text gives no evidence, and its site decides; null hosts and paths are a site of
their own; labels without a document, null labels and repeated labels of one document (the worst counts) are
allowed; without labels of both kinds a fault has no evidence and rejects nothing; repeated rows are scored each; an empty
table gives no rows; other columns are carried on, and those with the names of the added columns are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import column_bytes, map_rows, stored
from memspark.llm.decontaminate import words_of

#: Labelled documents that the classifier is fitted on, chosen by the hash of their ids.
MAX_LABELLED = 20_000
#: Words and word beginnings kept per fault, and how many distinct texts must hold one.
LEXICON, SUPPORT = 2_000, 6
PREFIXES = (4, 5, 6)
FAULTS = ("poor", "toxic")
ADDED = ("p_poor", "p_toxic", "kept")
_SHOUT, _SIGNS = re.compile(rb"[A-Z]"), re.compile(rb"[!#$%&*@^~|<>{}=_+\\/\[\]]")


def style(text: bytes | None) -> list[float]:
    """Shares of capitals, of odd signs, of words that repeat the one before, of bars between words, of distinct words."""
    tokens = (text or b"").split()
    n = len(tokens)
    if not n:
        return [0.0] * 6
    size = len(text)
    repeats = sum(map(bytes.__eq__, tokens, tokens[1:])) if n > 1 else 0
    return [1.0, len(_SHOUT.findall(text)) / size, len(_SIGNS.findall(text)) / n, repeats / n, tokens.count(b"|") / n, np.log1p(n) / 10]


def features(text: bytes | None) -> set[bytes]:
    """Distinct words and beginnings of words; beginnings end in a star."""
    words = set(words_of(text))
    out = set(words)
    for k in PREFIXES:
        out |= {w[:k] + b"*" for w in words if len(w) > k}
    return out


@dataclass
class Model:
    """Weights of the style and of the lexicon of each fault."""

    lexicon: dict[str, dict[bytes, float]]
    weights: dict[str, np.ndarray]

    def evidence(self, text: bytes | None) -> tuple[float | None, ...]:
        """Probability of each fault by the document alone; None without words."""
        shape = style(text)
        if not shape[0]:
            return (None,) * len(FAULTS)
        words = features(text) if any(self.lexicon.values()) else set()
        out = []
        for fault in FAULTS:
            w = self.weights.get(fault)
            if w is None:
                out.append(None)
                continue
            known = self.lexicon[fault]
            score = sum(known[x] for x in known.keys() & words)
            out.append(float(_logistic(np.dot(w, [*shape, score]))))
        return tuple(out)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    for _ in range(30):
        p = _logistic(x @ w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most max_labelled labelled documents. Copies and near copies count once, lest their words look like signs."""
    rows = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") < 1).cast("int").alias("poor"), F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.select(F.col("doc_id").alias("labelled_id"), "poor", "toxic").orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)
    sample = df.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", "poor", "toxic")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column_bytes(batch, "text")
        marks = [_least_shingles(words_of(x)) for x in texts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([style(x) for x in texts], pa.list_(pa.float64())),
                pa.array([sorted(features(x)) for x in texts], pa.list_(pa.binary())),
                batch.column(1),
                batch.column(2),
                *(pa.array([m[i] for m in marks], pa.int64()) for i in range(3)),
            ],
            names=["style", "words", "poor", "toxic", "m0", "m1", "m2"],
        )

    described = map_rows(sample, describe, "style array<double>, words array<binary>, poor int, toxic int, m0 long, m1 long, m2 long")
    # Of rows alike in one of the marks the least one stays, by all columns, so the fit doesn't depend on how rows are dealt.
    described = described.withColumn("code", F.xxhash64("words", "style"))
    order = ["code", *FAULTS, "words", "style", "m0", "m1", "m2"]
    for mark in ("m0", "m1", "m2"):
        described = described.groupBy(F.col(mark).alias("same")).agg(F.min(F.struct(*order)).alias("least")).select("least.*")
    described = stored(described)
    total = described.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in FAULTS)).first()
    counts = described.select(F.explode("words").alias("word"), *FAULTS).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f) for f in FAULTS))
    lexicon: dict[str, dict[bytes, float]] = {}
    for fault in FAULTS:
        bad = total[fault] or 0
        lexicon[fault] = {}
        if not 0 < bad < total["n"]:
            continue
        odds = F.log((F.col(fault) + 0.5) / (F.col("n") - F.col(fault) + 0.5)) - float(np.log(bad / (total["n"] - bad)))
        strong = counts.where((F.col(fault) >= SUPPORT) & (F.col(fault) >= 0.9 * F.col("n"))).select("word", odds.alias("odds"), fault)
        best = strong.orderBy(F.desc(F.col("odds") * F.sqrt(fault)), "word").limit(LEXICON).collect()
        lexicon[fault] = {bytes(r.word): r.odds for r in best}
    every = sorted(set().union(*lexicon.values()))
    known = df.sparkSession.createDataFrame([(bytearray(w),) for w in every], "word binary")
    held = described.withColumn("id", F.monotonically_increasing_id())
    held = stored(held.select("id", "code", "style", "words", *FAULTS))
    hits = held.select("id", F.explode("words").alias("word")).join(F.broadcast(known), "word").groupBy("id").agg(F.collect_list("word").alias("known"))
    rows = held.select("id", "code", "style", *FAULTS).join(hits, "id", "left").orderBy("code", *FAULTS, "style").collect()  # at most max_labelled
    weights = {}
    for fault in FAULTS:
        y = np.array([r[fault] or 0 for r in rows], float)
        if 0 < y.sum() < len(y):
            own = lexicon[fault]
            x = np.array([[*r.style, sum(own.get(bytes(w), 0.0) for w in sorted(r.known or ()))] for r in rows])
            weights[fault] = _fit(x, y)
    return Model(lexicon, weights)


def _least_shingles(words: list[bytes]) -> tuple[int, int, int]:
    """Three least hashes of runs of five words, which near copies mostly share."""
    import zlib

    runs = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return tuple(min(zlib.crc32(r, seed) for r in runs) for seed in (1, 99, 12345))


def score(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns to keep, with the document's own evidence as e_poor and e_toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, F.col("text").alias("text_to_score"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.evidence(x) for x in column_bytes(batch, "text_to_score")]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[i] for x in found], pa.float64()) for i in range(len(FAULTS)))], names=[*keep, "e_poor", "e_toxic"])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return map_rows(source, run, f"{fields}e_poor double, e_toxic double")


def _strength(groups: DataFrame, prior: str) -> float:
    """How many documents the prior is worth: the mean's variance within groups over that between them."""
    s = groups.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.sum(F.expr(f"n * pow(s / n - {prior}, 2)")).alias("between"),
        F.sum(F.expr(f"n * {prior} * (1 - {prior})")).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.expr("n * n")).alias("nn"),
    ).first()
    if not s["n"] or s["k"] < 2:
        return 100.0
    noise = s["within"] / s["n"]
    spread = (s["between"] - (s["k"] - 1) * noise) / max(1e-9, s["n"] - s["nn"] / s["n"])
    return float(np.clip(noise / spread, 1.0, 1e6)) if spread > 0 and noise > 0 else 1e6


def site_posteriors(evidence: DataFrame, host: str, path: tuple[str, ...]) -> tuple[DataFrame, dict[str, float]]:
    """For each path its host's posterior and its own sums; and the global means and the strengths of the priors."""
    sums = [x for f in FAULTS for x in (F.count(f"e_{f}").alias(f"n_{f}"), F.coalesce(F.sum(f"e_{f}"), F.lit(0.0)).alias(f"s_{f}"))]
    paths = stored(evidence.groupBy(host, *path).agg(*sums))
    hosts = stored(paths.groupBy(host).agg(*(F.sum(f"{x}_{f}").alias(f"h{x}_{f}") for f in FAULTS for x in "ns")))
    total = hosts.agg(*(F.sum(f"h{x}_{f}").alias(f"{x}_{f}") for f in FAULTS for x in "ns")).first()
    facts: dict[str, float] = {}
    joined = paths.join(hosts.withColumnRenamed(host, "host_of_site"), F.col(host).eqNullSafe(F.col("host_of_site"))).drop("host_of_site")
    for f in FAULTS:
        mean = min(0.999, max(0.001, total[f"s_{f}"] / total[f"n_{f}"])) if total[f"n_{f}"] else 0.5
        facts[f"mean_{f}"] = mean
        facts[f"host_{f}"] = kappa = _strength(hosts.select(F.col(f"hn_{f}").alias("n"), F.col(f"hs_{f}").alias("s")), f"{mean!r}D")
        joined = joined.withColumn(f"prior_{f}", F.expr(f"(hs_{f} + {kappa!r}D * {mean!r}D) / (hn_{f} + {kappa!r}D)"))
        facts[f"path_{f}"] = _strength(joined.select(F.col(f"n_{f}").alias("n"), F.col(f"s_{f}").alias("s"), f"prior_{f}"), f"prior_{f}")
    return stored(joined.drop(*(f"h{x}_{f}" for f in FAULTS for x in "ns"))), facts


def classify(df: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("lang",), max_labelled: int = MAX_LABELLED, limit: float = 0.5, with_text: bool = True) -> DataFrame:
    """All columns (the text if asked for) with p_poor, p_toxic and kept."""
    model = fit(df, labels, max_labelled)
    keys = [host, *path]
    sites, facts = site_posteriors(score(df, model, keys), host, path)
    held = sites.withColumnsRenamed({c: f"site_{c}" for c in keys})
    kept = [c for c in df.columns if c not in ADDED and (with_text or c != "text")]
    scored = score(df.withColumnsRenamed({c: f"own_{c}" for c in kept if c in held.columns}), model, [f"own_{c}" if c in held.columns else c for c in kept])
    on = [F.col(c).eqNullSafe(F.col(f"site_{c}")) for c in keys]
    joined = scored.join(held, on, "left")
    logit = lambda x: f"ln(({x}) / (1 - ({x})))"
    for f in FAULTS:
        mean, kappa = facts[f"mean_{f}"], facts[f"path_{f}"]
        site = f"least(0.999D, greatest(0.001D, (s_{f} - coalesce(e_{f}, 0D) + {kappa!r}D * prior_{f}) / (n_{f} - if(e_{f} IS NULL, 0, 1) + {kappa!r}D)))"
        own = f"least(0.999999D, greatest(0.000001D, coalesce(e_{f}, {mean!r}D)))"
        joined = joined.withColumn(f"p_{f}", F.expr(f"1 / (1 + exp(-({logit(own)} + {logit(site)} - {logit(f'{mean!r}D')})))"))
    clean = " AND ".join(f"p_{f} <= {limit}" if f in model.weights else "true" for f in FAULTS)
    return joined.select(*(F.col(f"own_{c}" if c in held.columns else c).alias(c) for c in kept), "p_poor", "p_toxic", F.expr(clean).alias("kept"))
