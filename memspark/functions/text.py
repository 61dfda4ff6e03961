"""Tokenizer, stemmer and small string helpers as Column expressions (no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Words left out of the index.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for", "to", "of", "in", "on", "at", "by",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "this", "that", "with", "from", "as", "it",
)

# Query-side synonyms.
SYNONYMS = {
    "auth": ("authentication", "authz"),
    "authentication": ("auth",),
    "db": ("database",),
    "database": ("db",),
    "fn": ("function",),
    "function": ("fn",),
    "api": ("endpoint",),
    "endpoint": ("api",),
    "jwt": ("token",),
}

# Scripts whose characters are tokens of their own (kana, CJK ideographs, Hangul syllables).
CJK_CLASS = "[぀-ゟ゠-ヿ一-鿿가-힯]"

WORD = r"[\p{L}\p{Nd}]+"


def fold_case(text: Column) -> Column:
    """Lower case character by character; the two letters whose full mapping depends on context go first."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def words(text: Column) -> Column:
    """Index words of a text before stemming, in order, repeats kept."""
    spaced = F.regexp_replace(fold_case(F.coalesce(text, F.lit(""))), f"({CJK_CLASS})", " $1 ")
    return F.filter(
        F.regexp_extract_all(spaced, F.lit(WORD), F.lit(0)),
        lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOPWORDS),
    )


def stem(word: Column) -> Column:
    """Light suffix stripping. Lengths are byte lengths."""
    size = F.octet_length(word)

    def cut(n: int) -> Column:
        return F.substring(word, F.lit(1), F.char_length(word) - n)

    return (
        F.when(word.endswith("ies") & (size > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("sses") & (size > 5), cut(2))
        .when(word.endswith("ing") & (size > 5), cut(3))
        .when(word.endswith("ed") & (size > 4), cut(2))
        .when(word.endswith("es") & (size > 3), cut(1))
        .when(word.endswith("s") & (size > 3) & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def runs(items: Column) -> Column:
    """The distinct items of an array with their counts, ``array<struct<item, n>>``, from one sort within the row."""
    # Each lambda around a single value computes it once.
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    both = F.transform(F.array(F.sort_array(items)), lambda s: F.struct(s.alias("s"), starts(s).alias("p")))
    item = lambda b, p, j: F.struct(F.get(b["s"], p).alias("item"), (F.coalesce(F.get(b["p"], j + 1), F.size(b["s"])) - p).cast("bigint").alias("n"))
    return F.transform(both, lambda b: F.transform(b["p"], lambda p, j: item(b, p, j)))[0]


def tokenize(text: Column) -> Column:
    return F.transform(words(text), stem)


def expand_synonyms(terms: Column) -> Column:
    """Each term followed by its synonyms, first occurrence kept."""
    table = F.create_map(
        *[x for k, vs in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))]
    )
    grown = F.transform(
        terms,
        lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))),
    )
    return F.array_distinct(F.flatten(grown))


def query_terms(text: Column) -> Column:
    return expand_synonyms(tokenize(text))


def highlight_terms(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def index_text(title: Column, subtitle: Column, narrative: Column, concepts: Column, files: Column, facts: Column) -> Column:
    """The searchable text of one observation; empty parts are left out."""
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in (concepts, files, facts)]
    parts = F.concat(F.array(title, subtitle, narrative), *lists)
    return F.concat_ws(" ", F.array_remove(parts, ""))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when something was cut."""
    if limit <= 0:
        return F.lit("")
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def truncate_dots(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, ending in three dots when something was cut."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def clip_snippet(text: Column, limit: int) -> Column:
    """Cut at the last blank of the second half of the window, else at the limit."""
    if limit <= 0:
        return F.lit("")
    window = F.substring(text, 1, limit)
    head = F.regexp_extract(window, r"(?s)^(.*)[ \t\n]", 1)
    short = F.when(F.char_length(head) > limit // 2, head).otherwise(window)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(short, F.lit("…")))


def first_sentence(text: Column) -> Column:
    """Text before the first of ``.!?`` when that comes within 200 characters, else the first 200."""
    stop = F.regexp_instr(text, F.lit("[.!?]"))
    return F.when((stop > 0) & (stop <= 201), F.substring(text, F.lit(1), stop - 1)).otherwise(F.substring(text, 1, 200))


def fields(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\u0085 ]+"), lambda w: w != "")


def auto_title(content: Column) -> Column:
    lead = F.concat_ws(" ", F.slice(fields(content), 1, 8))
    return F.when(F.char_length(lead) > 60, F.concat(F.substring(lead, 1, 57), F.lit("..."))).otherwise(lead)


def word_jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of lower-cased word sets; ``both_empty`` is the answer when neither has a word."""
    wa, wb = F.array_distinct(fields(F.lower(a))), F.array_distinct(fields(F.lower(b)))
    inter = F.size(F.array_intersect(wa, wb))
    union = F.size(F.array_union(wa, wb))
    return F.when(union == 0, F.lit(both_empty)).otherwise(inter / union)


def title_similarity(a: Column, b: Column) -> Column:
    return word_jaccard(a, b, 1.0)


def content_overlap(a: Column, b: Column) -> Column:
    return word_jaccard(a, b, 0.0)


def token_estimate(text: Column) -> Column:
    return F.floor(F.size(fields(text)) * 4 / 3).cast("int")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def sorted_pair(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(" + "), F.greatest(a, b))


def fnv1a_hex(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes as eight hex digits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.transform(
        F.when(F.length(text) > 0, F.sequence(F.lit(0), F.octet_length(text) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    folded = F.aggregate(
        octets,
        F.lit(2166136261).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def is_observation_id(value: Column) -> Column:
    return value.rlike(r"^obs-[A-Za-z0-9_-]{4,}$")


def is_session_id(value: Column) -> Column:
    return value.rlike(r"^sess-[A-Za-z0-9_-]{4,}$")


def stable_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id, so that a job run again gives the same rows."""
    glued = reduce(lambda x, y: F.concat(x, F.lit("\u0001"), y), [F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(glued, 256), 1, 20))


def contains_ci(text: Column, needle: Column | str) -> Column:
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text), F.lower(n))
