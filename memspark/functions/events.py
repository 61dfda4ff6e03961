"""Fields, keys and compression of hook events as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memspark.functions.text import clip

# Hook types a payload may carry.
HOOK_TYPES = (
    "session_start", "session_end", "user_prompt", "pre_tool_use",
    "post_tool_use", "post_tool_failure", "subagent_end", "notification",
)
# Enum domains of observations, sessions and memories.
MODALITIES = ("text", "image", "mixed")
SESSION_STATUSES = ("active", "completed", "abandoned")
MEMORY_TYPES = ("pattern", "preference", "architecture", "bug", "workflow", "fact")
MEMORY_TIERS = ("working", "episodic", "semantic", "procedural")

# Observation type of each known tool; other tools are "tool_use".
TOOL_TYPES = {
    "read": "file_read", "open": "file_read", "cat": "file_read",
    "edit": "file_edit", "write": "file_edit", "patch": "file_edit",
    "shell": "command", "bash": "command", "exec": "command", "run": "command",
    "search": "search", "grep": "search", "ripgrep": "search", "rg": "search", "glob": "search", "find": "search",
    "fetch": "network", "curl": "network", "http": "network",
    "test": "test_run", "pytest": "test_run", "go_test": "test_run",
}

# File name endings that make a word a path.
FILE_EXTENSIONS = (
    "go|py|ts|tsx|js|jsx|rs|java|kt|swift|rb|php|"
    "c|h|cc|cpp|hpp|cs|scala|"
    "md|json|yaml|yml|toml|xml|html|css|sql|sh|bash|"
    "proto|graphql|tf|dockerfile"
)
# A path starts the text or follows a blank or a quote.
FILE_PATH = r"""(?U)(?:(?<=[\s"'`])|^)(?:\.{0,2}/)?(?:[\w.\-]+/)*[\w.\-]+\.(?:""" + FILE_EXTENSIONS + r")\b"
# An inline image, at least 16 base64 characters.
DATA_IMAGE = r"data:image/[a-zA-Z0-9.+\-]+;base64,[A-Za-z0-9+/=]{16,}"
# Name endings that refine an OBJECT.
FILE_SUBTYPE_ENDINGS = (".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".java", ".sql", ".sh")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def canonical_json(text: Column) -> Column:
    """Keys sorted at every level, no blanks, equal numbers alike; null or empty gives ``null``, bad JSON stays as it is."""
    parsed = F.to_json(F.try_parse_json(text))
    return F.when(text.isNull() | (text == ""), F.lit("null")).otherwise(F.coalesce(parsed, text))


def dedup_key(session: Column, tool: Column, tool_input: Column, *extra: Column) -> Column:
    """SHA-256 over session, tool and canonical input, zero bytes between; ``extra`` columns make it stricter."""
    parts = [F.coalesce(session, F.lit("")), F.coalesce(tool, F.lit("")), canonical_json(tool_input)]
    parts += [F.coalesce(e, F.lit("")) for e in extra]
    zero = F.char(F.lit(0))
    return F.sha2(reduce(lambda a, b: F.concat(a, zero, b), parts), 256)


def tool_fields(df: DataFrame, data_col: str = "data") -> DataFrame:
    """Add tool_name, tool_input, tool_output and user_prompt; missing text fields are empty, output objects stay JSON."""
    v = F.try_parse_json(F.col(data_col))

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    return df.select(
        "*",
        text("$.tool_name").alias("tool_name"),
        F.to_json(F.try_variant_get(v, "$.tool_input", "variant")).alias("tool_input"),
        text("$.tool_output").alias("tool_output"),
        text("$.user_prompt").alias("user_prompt"),
    )


def modality(raw: Column) -> Column:
    """``image`` when fewer than 100 bytes surround the first inline image, ``mixed`` when more do, else ``text``."""
    image = F.regexp_extract(raw, DATA_IMAGE, 0)
    rest = F.octet_length(raw) - F.octet_length(image)
    return F.when(F.coalesce(F.length(image), F.lit(0)) == 0, "text").when(rest < 100, "image").otherwise("mixed")


def hook_reject_reason(hook_type: Column, session_id: Column, timestamp: Column) -> Column:
    """First failed rule of a hook payload, null when it is good."""
    return (
        F.when(~F.coalesce(hook_type.isin(*HOOK_TYPES), F.lit(False)), "invalid hookType")
        .when(F.coalesce(session_id, F.lit("")) == "", "sessionId required")
        .when(timestamp.isNull(), "timestamp required")
    )


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def raw_reject_reason(df: DataFrame) -> DataFrame:
    """Default the modality to text and name the first failed rule of a raw observation."""
    df = df.withColumn("modality", F.when(_blank(F.col("modality")), "text").otherwise(F.col("modality")))
    reason = (
        F.when(_blank(F.col("id")), "id required")
        .when(_blank(F.col("session_id")), "sessionId required")
        .when(~F.coalesce(F.col("hook_type").isin(*HOOK_TYPES), F.lit(False)), "invalid hookType")
        .when(~F.col("modality").isin(*MODALITIES), "invalid modality")
        .when(F.col("created_at").isNull(), "timestamp required")
    )
    return df.withColumn("reject_reason", reason)


def compressed_reject_reason(df: DataFrame) -> DataFrame:
    reason = (
        F.when(_blank(F.col("id")), "id required")
        .when(_blank(F.col("session_id")), "sessionId required")
        .when(_blank(F.col("type")), "type required")
        .when(_blank(F.col("title")), "title required")
        .when(~F.coalesce(F.col("importance").between(0, 10), F.lit(False)), "importance out of [0,10]")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of [0,1]")
    )
    return df.withColumn("reject_reason", reason)


def memory_reject_reason(df: DataFrame) -> DataFrame:
    reason = (
        F.when(_blank(F.col("id")), "id required")
        .when(~F.coalesce(F.col("type").isin(*MEMORY_TYPES), F.lit(False)), "invalid type")
        .when(~F.coalesce(F.col("tier").isin(*MEMORY_TIERS), F.lit(False)), "invalid tier")
        .when(_blank(F.col("title")), "title required")
        .when(~F.coalesce(F.col("strength").between(0, 1), F.lit(False)), "strength out of [0,1]")
    )
    return df.withColumn("reject_reason", reason)


def patch_compressed(df: DataFrame) -> DataFrame:
    """Clamp ranges and fill defaults; rows without an id get a ``reject_reason`` for the quarantine table."""
    kind, title = F.nullif(F.col("type"), F.lit("")), F.nullif(F.col("title"), F.lit(""))
    reason = F.when(_blank(F.col("id")), "id required").when(_blank(F.col("session_id")), "session_id required")
    return (
        df.withColumn("title", F.coalesce(title, kind, F.lit("observation")))
        .withColumn("type", F.coalesce(kind, F.lit("tool_use")))
        .withColumn("importance", F.greatest(F.lit(0), F.least(F.lit(10), F.col("importance"))))
        .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
        .withColumn("reject_reason", reason)
    )


def infer_type(tool: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TOOL_TYPES.items() for x in kv])
    known = F.coalesce(F.try_element_at(table, F.lower(tool)), F.lit("tool_use"))
    return F.when(F.coalesce(tool, F.lit("")) == "", F.lit("user_event")).otherwise(known)


def extract_files(*texts: Column) -> Column:
    """File paths of all texts in order of appearance, each once."""
    found = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(FILE_PATH), F.lit(0)) for t in texts]
    return F.array_distinct(F.concat(*found))


def classify_subtype(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    is_file = reduce(lambda a, b: a | b, [F.contains(low, F.lit(e)) for e in FILE_SUBTYPE_ENDINGS])
    return F.when(kind == "OBJECT", F.when(is_file, "FILE").when(F.contains(low, F.lit("()")), "FUNCTION"))


def compress(raw: DataFrame) -> DataFrame:
    """Rule-based compression of raw observations: one searchable row per raw row, confidence 0.3."""
    given = F.coalesce(F.col("tool_input"), F.lit(""))
    output = F.coalesce(F.col("tool_output"), F.lit(""))
    name = F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.col("hook_type"))
    return raw.withColumn("files", extract_files(given, output, F.col("user_prompt"))).select(
        "id",
        "session_id",
        infer_type(F.col("tool_name")).alias("type"),
        clip(name, 120).alias("title"),
        clip(F.coalesce(F.get("files", F.lit(0)), F.lit("")), 200).alias("subtitle"),
        empty_strings().alias("facts"),
        clip(F.concat_ws(" | ", F.array_remove(F.array(name, given, clip(output, 400)), "")), 1000).alias("narrative"),
        empty_strings().alias("concepts"),
        "files",
        F.lit(5).alias("importance"),
        F.lit(0.3).alias("confidence"),
    )


def _tag(text: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def _tags(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))


_ENVELOPE = (
    "type string, title string, subtitle string, narrative string, importance string,"
    " facts struct<fact:array<string>>, concepts struct<concept:array<string>>, files struct<file:array<string>>,"
    " _bad string"
)


def parse_compression_reply(raw: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Read stored model replies. Well-formed envelopes score 0.85, ones read by pattern 0.7, rows with none fall
    back to the rule-based compression (0.3)."""
    env = F.regexp_extract(F.coalesce(F.col(reply_col), F.lit("")), r"(?s)<compressed>.*?</compressed>", 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreSurroundingSpaces": "true"}
    df = raw.withColumn("__env", env)
    df = df.withColumn("__xml", F.when(F.col("__env") != "", F.from_xml(F.col("__env"), _ENVELOPE, options)))
    strict = F.col("__xml").isNotNull() & F.col("__xml._bad").isNull()
    name = F.coalesce(F.nullif(F.col("tool_name"), F.lit("")), F.col("hook_type"))

    def scalar(tag: str) -> Column:
        return F.coalesce(F.when(strict, F.trim(F.col(f"__xml.{tag}"))).otherwise(_tag(F.col("__env"), tag)), F.lit(""))

    def listed(tag: str, child: str) -> Column:
        good = F.filter(F.transform(F.col(f"__xml.{tag}.{child}"), F.trim), lambda x: x != "")
        return F.when(strict, F.coalesce(good, empty_strings())).otherwise(_tags(F.col("__env"), child))

    level = F.try_to_number(scalar("importance"), F.lit("999")).cast("int")
    parsed = df.select(
        "id",
        "session_id",
        (F.col("__env") != "").alias("parsed"),
        F.coalesce(F.nullif(scalar("type"), F.lit("")), F.lit("tool_use")).alias("type"),
        clip(F.coalesce(F.nullif(scalar("title"), F.lit("")), name), 120).alias("title"),
        clip(scalar("subtitle"), 200).alias("subtitle"),
        listed("facts", "fact").alias("facts"),
        clip(scalar("narrative"), 1000).alias("narrative"),
        listed("concepts", "concept").alias("concepts"),
        listed("files", "file").alias("files"),
        F.coalesce(level, F.lit(5)).alias("importance"),
        F.when(strict, 0.85).otherwise(0.7).alias("confidence"),
    )
    rules = compress(raw.filter(env == "").drop(reply_col)).withColumn("parsed", F.lit(False))
    return parsed.filter("parsed").unionByName(rules)


def parse_summary_reply(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Read stored session-summary replies; rows without an envelope or without title and narrative have parsed = false."""
    body = F.regexp_extract(F.coalesce(F.col(reply_col), F.lit("")), "(?s)<summary>(.*?)</summary>", 1)

    def listed(parent: str, item: str) -> Column:
        inner = F.regexp_extract(F.col("__body"), f"(?s)<{parent}>(.*?)</{parent}>", 1)
        return F.transform(F.regexp_extract_all(inner, F.lit(f"(?s)<{item}>(.*?)</{item}>"), F.lit(1)), F.trim)

    title, text = _tag(F.col("__body"), "title"), _tag(F.col("__body"), "narrative")
    return df.withColumn("__body", body).select(
        "session_id",
        ((title != "") | (text != "")).alias("parsed"),
        clip(F.coalesce(F.nullif(title, F.lit("")), F.lit("Session")), 120).alias("title"),
        clip(text, 2000).alias("narrative"),
        listed("decisions", "d").alias("key_decisions"),
        listed("files", "f").alias("files_modified"),
        listed("concepts", "c").alias("concepts"),
    )
