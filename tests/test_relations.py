"""Relations from windows around verbs against every verb's pattern over the whole text."""

import random
import re

from memspark.operators.extraction import PHRASE, VERB_TYPES, extract_verb_relations
from memspark.sources.tables import spread


def clean(phrase):
    return re.sub(r"^(?:the )?(?:a )?(?:an )?", "", phrase.strip(" \t\n.,;:"), flags=re.I)


def whole(text):
    out = {}
    for verb, kind in VERB_TYPES.items():
        for found in re.finditer(PHRASE + r"\s+" + verb + r"\s+" + PHRASE + r"(?=[\s,.;:]|$)", text, re.I | re.A):
            source, target = clean(found.group(1)), clean(found.group(2))
            if source and target and source.lower() != target.lower():
                out.setdefault((source.lower(), target.lower(), kind), (source, target))
    return {(*spelled, key[2]) for key, spelled in out.items()}


def test_windows_lose_nothing(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta_1", "the", "a", "x.y", "9lives", "(odd)", "end.", "src/a.py", "Depends", "on", "of", *VERB_TYPES, "USES", "uses,", "uses"]
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \t"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += [" ".join(["uses"] * 900), "w " * 2000 + "a uses b" + " w" * 2000, "x" * 50000 + " uses y"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id long, text string")
    got = {}
    for r in extract_verb_relations(df).collect():
        got.setdefault(r.id, set()).add((r.source, r.target, r.type))
    assert sum(map(len, got.values())) > 500
    for i, text in enumerate(texts[:-1]):
        assert got.get(i, set()) == whole(text), text[:200]
    assert got[len(texts) - 1] == {("x" * 50000, "y", "DEPENDS_ON")}


def test_spread_moves_few_files_only(spark, tmp_path):
    spark.range(100).repartition(2).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert "Repartition" in str(spread(df, 8)._jdf.queryExecution().logical())
    assert spread(df, 2) is df
