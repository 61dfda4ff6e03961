"""Entities and relations from text by pattern, as array expressions exploded into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.events import FILE_PATH, classify_subtype

# Entity families in order: pattern, type, subtype, confidence.
FAMILIES = (
    ("file", FILE_PATH, "OBJECT", "FILE", 0.7),
    ("camel", r"(?U)\b[a-z]+(?:[A-Z][a-z0-9]+){1,}\b", "OBJECT", "FUNCTION", 0.6),
    ("pascal", r"(?U)\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+){1,}\b", "OBJECT", "CLASS", 0.55),
    ("snake", r"(?U)\b[a-z][a-z0-9]+(?:_[a-z0-9]+){1,}\b", "OBJECT", "IDENTIFIER", 0.55),
    ("url", r"""(?U)https?://[^\s"'<>)]+""", "OBJECT", "URL", 0.85),
    ("email", r"(?U)\b[\w.\-]+@[\w.\-]+\.\w{2,}\b", "OBJECT", "EMAIL", 0.9),
    ("phrase", r"(?U)\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b", "PERSON", None, 0.4),
)

# Edge type of each verb phrase, in order.
VERB_TYPES = {
    "depends on": "DEPENDS_ON",
    "imports": "DEPENDS_ON",
    "uses": "DEPENDS_ON",
    "requires": "DEPENDS_ON",
    "implements": "IMPLEMENTS",
    "extends": "IMPLEMENTS",
    "works at": "WORKS_AT",
    "employed by": "WORKS_AT",
    "member of": "WORKS_AT",
    "supersedes": "SUPERSEDES",
    "replaces": "SUPERSEDES",
    "deprecates": "SUPERSEDES",
    "contradicts": "CONTRADICTS",
    "conflicts with": "CONTRADICTS",
    "derived from": "DERIVED_FROM",
    "based on": "DERIVED_FROM",
    "forked from": "DERIVED_FROM",
}
# A subject or object is up to four words.
PHRASE = r"([A-Za-z_][\w./]*?(?:\s+[A-Za-z_][\w./]*?){0,3})"
RELATION_CONFIDENCE = 0.6
CO_OCCURRENCE_CONFIDENCE = 0.3
CO_OCCURRENCE_NAMES = 8


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def entity_array(text: Column) -> Column:
    """array<struct<name, type, subtype, confidence>> of one text, families in order, each name once per family."""
    text = F.coalesce(text, F.lit(""))
    files = _found(text, FAMILIES[0][1])

    def family(i: int, names: Column) -> Column:
        _, _, kind, subtype, confidence = FAMILIES[i]
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("name"), F.lit(kind).alias("type"),
                (F.lit(subtype) if subtype else classify_subtype(n, F.lit(kind))).cast("string").alias("subtype"),
                F.lit(confidence).alias("confidence"),
            ),
        )

    def outside_files(names: Column) -> Column:
        return F.filter(names, lambda n: ~F.exists(files, lambda f: F.contains(f, n)))

    first = F.concat(
        family(0, files),
        family(1, outside_files(_found(text, FAMILIES[1][1]))),
        family(2, outside_files(_found(text, FAMILIES[2][1]))),
        *[family(i, _found(text, FAMILIES[i][1])) for i in (3, 4, 5)],
    )
    taken = F.transform(first, lambda e: F.lower(e["name"]))
    phrases = F.filter(
        _found(text, FAMILIES[6][1]), lambda p: F.contains(p, F.lit(" ")) & ~F.array_contains(taken, F.lower(p))
    )
    return F.concat(first, family(6, phrases))


def extract_entities(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per entity of a text: (id, pos, name, type, subtype, confidence); ``pos`` is the order of discovery."""
    return (
        docs.select(F.col(id_col).alias("id"), F.posexplode(entity_array(F.col(text_col))).alias("pos", "e"))
        .select("id", "pos", "e.name", "e.type", "e.subtype", "e.confidence")
    )


def merge_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge by (lower name, type): the surest mention wins, the first of equals.

    -> (entities, sources): the union of source ids is a table of its own, so no row grows with the mentions.
    """
    keyed = mentions.withColumn("key", F.lower("name"))
    # Smaller is better: confidence negated, then the order of the mentions.
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "id", "pos", "name", "subtype"))
    entities = (
        keyed.groupBy("key", "type").agg(best.alias("b"))
        .select("key", "type", F.col("b.name").alias("name"), F.col("b.subtype").alias("subtype"), (-F.col("b.c")).alias("confidence"))
    )
    return entities, keyed.select("key", "type", F.col("id").alias("source_id")).distinct()


def _clean(phrase: Column) -> Column:
    """Without outer blanks and punctuation, and without leading articles, each of which goes once and in this order."""
    return F.regexp_replace(F.btrim(phrase, F.lit(" \t\n.,;:")), "(?i)^(?:the )?(?:a )?(?:an )?", "")


def _matched(text: Column, pattern: str) -> Column:
    """All matches without regard to case. ASCII texts take the cheap character classes, which mean the same for them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(0))
    )


def verb_windows(text: Column) -> Column:
    """The parts of a text that its relations lie in, in order: a verb phrase with four words on either side.

    A subject or object has at most four words, so a relation never reaches beyond the window of its verb. Windows that
    touch are one part, so that what an earlier match uses up stays used up. The text is scanned once for all verbs.
    """
    verb = "(?:" + "|".join(VERB_TYPES) + r")(?=\s)"
    return _matched(text, rf"(?<!\S)(?:\S++\s++){{0,4}}?{verb}(?:\s++(?:\S++\s++){{0,8}}?{verb})*+(?:\s++\S++){{0,4}}")


def _verb_relations(window: Column, i: int, verb: str, kind: str) -> Column:
    phrase = PHRASE + r"\s+" + verb + r"\s+" + PHRASE
    # The verb as plain text decides first. A window is searched once; subject and object are then read from each short
    # match, which the lookahead is not part of.
    hits = F.when(F.contains(F.lower(window), F.lit(verb)), _matched(window, phrase + r"(?=[\s,.;:]|$)"))
    whole = "(?iU)" + phrase + "$"

    def read(hit: Column, group: int) -> Column:
        return _clean(F.regexp_extract(hit, whole, group))

    return F.coalesce(
        F.transform(hits, lambda h, at: F.struct(read(h, 1).alias("source"), read(h, 2).alias("target"), F.lit(kind).alias("type"), F.lit(i).alias("verb"), at.alias("at"))),
        F.array().cast("array<struct<source:string,target:string,type:string,verb:int,at:int>>"),
    )


def extract_verb_relations(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, source, target, type, confidence) from verb phrases; no self loops, each relation of a text once."""
    windows = docs.select(F.col(id_col).alias("id"), F.posexplode(verb_windows(F.col(text_col))).alias("part", "window"))
    every = F.concat(*[_verb_relations(F.col("window"), i, v, k) for i, (v, k) in enumerate(VERB_TYPES.items())])
    rows = windows.select("id", "part", F.inline(every)).where((F.col("source") != "") & (F.col("target") != "") & (F.lower("source") != F.lower("target")))
    # The first spelling of a relation stays: by verb, then by place.
    return (
        rows.groupBy("id", F.lower("source").alias("s"), F.lower("target").alias("t"), "type")
        .agg(F.min(F.struct("verb", "part", "at", "source", "target")).alias("first"))
        .select("id", F.col("first.source").alias("source"), F.col("first.target").alias("target"), "type", F.lit(RELATION_CONFIDENCE).alias("confidence"))
    )


def co_occurrence(docs: DataFrame, id_col: str = "id", text_col: str = "text", first: int | None = CO_OCCURRENCE_NAMES) -> DataFrame:
    """RELATED_TO between the first entity names of a text, eight unless asked otherwise; None takes all of them."""
    names = F.transform(entity_array(F.col(text_col)), lambda e: e["name"])
    names = names if first is None else F.slice(names, 1, first)
    left = docs.select(F.col(id_col).alias("id"), names.alias("names")).select("id", "names", F.posexplode("names").alias("i", "source"))
    later = F.when(F.col("i") + 1 < F.size("names"), F.slice("names", F.col("i") + 2, F.size("names")))
    return (
        left.select("id", "source", F.explode(later).alias("target"))
        .filter(F.lower("source") != F.lower("target"))
        .select("id", "source", "target", F.lit("RELATED_TO").alias("type"), F.lit(CO_OCCURRENCE_CONFIDENCE).alias("confidence"))
    )


def extract_relations(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Verb relations, and co-occurrence for the texts that have none."""
    verbs = extract_verb_relations(docs, id_col, text_col)
    rest = docs.join(verbs.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    return verbs.unionByName(co_occurrence(rest, id_col, text_col))
