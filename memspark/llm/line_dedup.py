"""Fuzzy line deduplication, in DataFrame operations only.

Lines are normalised to lower-case words. Equal lines are one class. A class has its words in eight blocks: a word is in
one block only, chosen by its hash, and a block is one number, the sum of what its words vote. An edit changes two blocks at most,
so of two lines within a few edits some blocks are the very same (pigeonhole), and classes meet on these: single blocks of long lines, pairs of neighbouring blocks of shorter
ones, and pairs of quarters of the shortest, whose blocks have few words. A line near the end of a length range has the
keys of both. The same numbers give a SimHash of 56 bits: words vote in a block of it with seven numbers of four bits, and
a bit is set if its votes are over their mean. Classes that meet, whose SimHashes are within BITS_APART bits and whose words,
each one of 128 bits, don't need more edits, have their words fetched and are verified by edit similarity, counted in
words and on the words themselves. Of each connected group one occurrence stays, that with the least doc_id and place;
the others are cut out.

Keys that one class has alone are dropped before anything but the class is with them. As in other groups of copies, a
class is first compared with the first of its key, and only classes still apart are compared further, in tiles of bounded
size, with all conditions inside the join. Where more than DIRECT classes have a key, those
meet that share a word which is rare there, as close lines must, and edits of hashed words are a condition too. Lines with many edits may have no key in common; the README gives the recall.

Edge cases: null and empty texts stay as they are; lines without words are never cut, and those of one or two only
as exact copies, as one edit is more than a quarter; letters of scripts without spaces count as words, and such lines are
compared with others from UNSPACED_WORDS on; texts and lines of
any length count whole; ties can't occur but between rows alike in doc_id and text, which are treated as one document and
come out alike, as often as given; a null doc_id is less than all others; a text all of whose lines are cut becomes
empty, and drop_empty leaves out rows that lost lines and have only blank ones left; other columns are carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import stored
from memspark.llm.components import components

MIN_WORDS = 1
#: Letters of scripts without spaces (Thai to Lao, Burmese, Khmer, kana, Han) are words of their own; lines with such are
#: compared from that many words on.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
UNSPACED_WORDS = 12
SIMILARITY = 0.75
#: Of 56 bits of a SimHash. Lines of more words have blocks that say more than their bits, which aren't compared.
BITS_APART = 14
BIT_WORDS = 150
#: Words from which a line's keys are quarters, pairs of neighbouring blocks, and single blocks.
QUARTERS, NEIGHBOURS, SINGLES = 8, 12, 24
#: Rows of a block that meet those of another tile in one task.
TILE = 1024
#: Rows of a block that meet by their bits alone, and those of a tile of them; larger blocks are compared on hashed words.
DIRECT, DIRECT_TILE = 8192, 4096
#: Of the larger ones, rows of a block that meet as they are; the others meet on rare words of the block.
MEET = 64
#: Classes whose texts are fetched by sending their ids to every task (16 bytes each); more are joined.
BROADCAST_LINES = 500_000
#: Words of pairs up to this are told apart by their place, which takes their square; those of longer ones by a hash to
#: this many characters, when a chance in a million for each word doesn't matter.
WORDS_IN_PLACE = 4000
_CODES = 983_040
#: Votes: seven lanes of eight bits, then the number of words in six. Words from this place on vote in four lanes only and
#: aren't counted, so that sums stay below 2^63 for lines of any length.
_VOTES, _LATER, _LATE = 0x000F0F0F0F0F0F0F, 0x0F0F0F0F, 1000


def lines_of(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line: doc_id, the document's key, place, and for lines of enough words their class, number, blocks,
    and their words as 128 bits."""
    unspaced = (F.octet_length("text") > F.length("text")) & F.col("text").rlike(UNSPACED)
    lines = df.select("doc_id", "text", unspaced.alias("mixed"), F.xxhash64("doc_id", "text").alias("doc")).where(F.col("text").isNotNull())
    lines = lines.select("doc_id", "doc", "mixed", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("unspaced", F.col("mixed") & F.col("line").rlike(UNSPACED))
    lines = lines.select("doc_id", "doc", "place", _words(F.col("line"), F.col("unspaced")).alias("words"), "unspaced")
    enough = F.size("words") >= min_words
    compared = enough & (F.size("words") >= 3) & (~F.col("unspaced") | (F.size("words") >= UNSPACED_WORDS))
    # Rows alike are told apart here, as their words are summed. Each line's words are in one task, so what is shuffled is a
    # row for each line.
    at = ["row", "doc_id", "doc", "place", "node", "n"]
    lines = lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", "doc", "place", F.when(enough, _class(F.col("words"))).alias("node"), F.size("words").alias("n"), F.when(compared, F.col("words")).alias("words"))
    # Not the plain form, before which Spark would filter by the size of the words and so cut each line twice.
    words = lines.select(*at, F.posexplode_outer("words").alias("at", "word")).withColumn("h", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    words = words.select(*at, F.expr("cast(shiftrightunsigned(h, 61) as int)").alias("i"), F.expr(f"h & if(at < {_LATE}, {_VOTES}L, {_LATER}L)").alias("vote"), F.expr(f"if(at < {_LATE}, 1L, 0L)").alias("one"), F.expr("cast(shiftrightunsigned(h, 52) & 127 as int)").alias("bit"))
    sums = [F.expr(f"sum(if(i = {i}, vote, 0L))").alias(f"b{i}") for i in range(8)]
    sums += [F.expr(f"sum(if(i div 4 = {j}, shiftleft(one, 14 * (i - {4 * j})), 0L))").alias(f"c{j}") for j in range(2)]
    sums += [F.expr(f"bit_or(if(bit between {64 * j} and {64 * j + 63}, shiftleft(1L, bit - {64 * j}), 0L))").alias(f"w{j}") for j in range(2)]
    blocks = F.array(*(F.expr(f"(b{i} & {(1 << 56) - 1}L) | shiftleft(shiftright(c{i // 4}, {14 * (i % 4)}) & 63L, 56)") for i in range(8)))
    return words.groupBy(*at).agg(*sums).select(*at[1:], F.when(F.expr("c0 + c1 > 0"), blocks).alias("blocks"), "w0", "w1")


def _words(line: Column, unspaced: Column | None = None) -> Column:
    unspaced = line.rlike(UNSPACED) if unspaced is None else unspaced
    apart = F.when(unspaced, F.regexp_replace(line, f"({UNSPACED}\\p{{M}}*)", " $1 ")).otherwise(line)
    return F.array_remove(F.split(F.lower(apart), r"[^\p{L}\p{N}\p{M}]+"), "")


def _class(words: Column) -> Column:
    return F.xxhash64(words)


def simhash(blocks: str) -> Column:
    """56 bits: whether a lane's votes are over their mean. Lanes of a block are compared at once, every other one, in 16 bits each."""
    ones, odd = 0x0001000100010001, 0x000100010001

    def block(i: int) -> str:
        # What a lane lacks of 256 if it is just over the mean, so that a carry tells. Few operations, as Java compiles no long methods.
        v = f"get({blocks}, {i})"
        lacks = f"greatest(255 - shiftright(15 * shiftright({v}, 56), 1), 0L) * {ones}L"
        even, odds = f"shiftright(({v} & {255 * ones}L) + {lacks}, 8) & {ones}L", f"((shiftright({v}, 8) & {255 * odd}L) + {lacks}) & {odd << 8}L"
        return f"shiftleft(({even}) | ({odds}), {7 - i})"

    return F.expr(" | ".join(map(block, range(8))))


def _keys(blocks: str, n: str) -> Column:
    """Keys of equal blocks, by the lengths that close lines may have; null where the blocks have no words."""
    key = lambda kind, *parts: f"if({' | '.join(parts)} <> 0, xxhash64({kind}, {', '.join(parts)}), NULL)"
    v = lambda i: f"{blocks}[{i}]"
    pairs = ", ".join(f"struct({i} AS i, {j} AS j)" for i in range(4) for j in range(i))
    ranges = [
        (0, QUARTERS, f"array({pairs})", key("10 * x.i + x.j", v("2 * x.i"), v("2 * x.i + 1"), v("2 * x.j"), v("2 * x.j + 1"))),
        (QUARTERS, NEIGHBOURS, "sequence(0, 3)", key("100 + x", v("2 * x"), v("2 * x + 1"))),
        (NEIGHBOURS, SINGLES, "sequence(0, 7)", key("200 + x", v("x"), v("(x + 1) % 8"))),
        (SINGLES, 1 << 31, "sequence(0, 7)", key("300 + x", v("x"))),
    ]
    parts = [f"if({n} + 1 >= {low} AND {n} - 1 < {high}L, transform({over}, x -> {made}), array())" for low, high, over, made in ranges]
    # Long lines are most of them; theirs are spelled out, which Spark compiles.
    singles = ", ".join(key(str(300 + i), v(str(i))) for i in range(8))
    return F.expr(f"if({n} > {SINGLES}, array({singles}), concat({', '.join(parts)}))")


def _close(a: str, b: str, similarity: float) -> Column:
    """Whether lengths and bits allow two lines to be close; a and b are what the names of their number of words and bits begin with."""
    edits = f"floor({1 - similarity:.6f}D * greatest({a}n, {b}n) + 1e-9D)"
    return F.expr(f"(bit_count({a}x ^ {b}x) <= {BITS_APART} OR least({a}n, {b}n) > {BIT_WORDS}) AND abs({a}n - {b}n) <= {edits}")


def _shared(a: str, b: str, similarity: float) -> Column:
    """Whether the words, as bits, allow it: a word whose bit the other line lacks has to be edited."""
    edits = f"floor({1 - similarity:.6f}D * greatest({a}n, {b}n) + 1e-9D)"
    lacks = lambda x, y: f"bit_count({x}w0 & ~{y}w0) + bit_count({x}w1 & ~{y}w1) <= {edits}"
    return F.expr(f"{lacks(a, b)} AND {lacks(b, a)}")


def _texts(df: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes' words, read at their first occurrences: node, their hashes, and these as characters."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("first.doc").alias("key_of_doc"), F.col("first.place").alias("place"))
    wanted = stored(wanted.groupBy("key_of_doc").agg(F.collect_list(F.struct("node", "place")).alias("wanted")))
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    # Rows that are alike in doc_id and text have the same lines. Only lines that are wanted leave their text.
    docs = df.select("text", F.xxhash64("doc_id", "text").alias("doc"))
    docs = docs.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), F.col("doc") == F.col("key_of_doc"))
    lines = docs.select(F.inline(F.expr("transform(array(split(text, '\\n', -1)), l -> transform(wanted, w -> struct(w.node AS node, l[w.place] AS line)))[0]")))
    texts = lines.dropDuplicates(["node"]).select("node", F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)).alias("words"))
    return texts.select("*", _spelt("words").alias("spelt"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of which at most 1 - similarity of the longer one's words are edited. A pair's words, by their hashes as in its
    classes, are characters: by the codes of these if they tell all its words apart, else by their place among its distinct words."""
    side = lambda c: texts.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("words", "spelt")))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    allowed = f"cast(floor({1 - similarity:.6f}D * greatest(size(words_a), size(words_b)) + 1e-9D) as int)"
    # Whether the codes are as many as the words. Lambdas, as what is written out is worked out more than once.
    distinct = "array_distinct(concat(words_a, words_b))"
    alike = f"size(k) = size(array_distinct(transform(k, h -> pmod(h, {_CODES})))) OR size(words_a) + size(words_b) > {WORDS_IN_PLACE}"
    # Characters beyond the surrogates, five hexadecimal digits.
    placed = lambda c: f"decode(unhex(concat('000', array_join(transform(words_{c}, w -> hex(array_position(k, w) + 65535)), '000'))), 'UTF-32')"
    spelt = f"if({alike}, struct(spelt_a AS a, spelt_b AS b), struct({placed('a')} AS a, {placed('b')} AS b))"
    near = f"exists(transform(array({distinct}), k -> {spelt}), s -> levenshtein(s.a, s.b, {allowed}) >= 0)"
    return both.where(F.expr(f"abs(size(words_a) - size(words_b)) <= {allowed}") & F.expr(near)).select("a", "b")


def _spelt(hashes: str) -> Column:
    """A line's words as characters, by their hashes: equal words are equal characters, and different ones seldom."""
    return F.decode(F.unhex(F.expr(f"concat('000', array_join(transform({hashes}, h -> hex(pmod(h, {_CODES}) + 65536)), '000'))")), "UTF-32")


def _rare_words(named: DataFrame, similarity: float) -> DataFrame:
    """Rows by block and a word (block, node, bits, label, spelt): close lines of a block share one of these.

    A line of n words has all but floor((1 - similarity) * n) words, copies counted, in common with any close one, so if words
    are put in one order and each line keeps one word more than it may lack, the first in that order, close lines have kept a
    word that both have. The order is by how often a word occurs in the block, so what is kept is rare.
    """
    words = named.select("block", "node", F.explode("hashes").alias("word"))
    # Words of one row are kept, as they take places, but meet nothing.
    often = words.groupBy("block", "word").agg(F.count(F.lit(1)).alias("often"))
    sorted_words = words.join(often, ["block", "word"]).groupBy("block", "node").agg(F.sort_array(F.collect_list(F.struct("often", "word"))).alias("words"))
    kept = F.expr(f"array_distinct(slice(words, 1, cast(floor({1 - similarity:.6f}D * size(words) + 1e-9D) as int) + 1))")
    keys = sorted_words.select("block", "node", F.explode(kept).alias("w")).where("w.often > 1").select("block", "node", "w.word")
    return named.join(keys, ["block", "node"]).select(F.xxhash64("block", "word").alias("block"), "node", "bits", "label", "spelt")


def _mixed(rows: DataFrame) -> DataFrame:
    """Blocks with more than one label, and their rows."""
    return rows.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("rows")).where("x < y").drop("x", "y")


def _apart(named: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of rows of one block (block, node, bits, label, hashes) with different labels that may be close: by lengths,
    bits, and edits of hashes of words, which are never more than those of the words."""
    spelt = F.when(F.col("bits.n") <= BIT_WORDS, _spelt("hashes")).alias("spelt")
    named = named if "rows" in named.columns else named.join(_mixed(named), "block")
    named = stored(named.select("block", "node", "bits", "label", "rows", "hashes", spelt))
    few = named.where(F.col("rows") <= MEET).select("block", "node", "bits", "label", "spelt", "rows")
    rare = stored(_rare_words(named.where(F.col("rows") > MEET), similarity))
    left = few.unionByName(rare.join(_mixed(rare), "block")).withColumn("tiles", F.ceil(F.col("rows") / TILE).cast("int")).drop("rows")
    left = left.withColumn("own", F.pmod(F.hash("node"), F.col("tiles")))
    left = stored(left.select("block", "own", "tiles", "node", F.struct("bits.n", "bits.x", "label", "spelt").alias("line")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    a = left.select("block", "own", other.alias("other"), F.col("node").alias("a"), F.col("line").alias("line_a"))
    b = left.select("block", other.alias("own"), F.col("own").alias("other"), F.col("node").alias("b"), F.col("line").alias("line_b"))
    meet = (a.block == b.block) & (a.own == b.own) & (a.other == b.other)
    edits = f"cast(floor({1 - similarity:.6f}D * greatest(line_a.n, line_b.n) + 1e-9D) as int)"
    near = F.expr(f"coalesce(levenshtein(line_a.spelt, line_b.spelt, {edits}) >= 0, true)")
    return a.join(b, meet & F.expr("a < b AND line_a.label <> line_b.label") & _close("line_a.", "line_b.", similarity) & near).select("a", "b").distinct()


def _direct(named: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of rows of one block with different labels that may be close by lengths and bits."""
    rows = named.withColumn("tiles", F.ceil(F.col("rows") / DIRECT_TILE).cast("int")).withColumn("own", F.pmod(F.hash("node"), F.col("tiles")))
    rows = rows.select("block", "own", "tiles", "node", "label", "bits.*")
    other, line = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), ("label", "n", "x", "w0", "w1")
    a = rows.select("block", "own", other.alias("other"), F.col("node").alias("a"), *(F.col(c).alias(f"a_{c}") for c in line))
    b = rows.select("block", other.alias("own"), F.col("own").alias("other"), F.col("node").alias("b"), *(F.col(c).alias(f"b_{c}") for c in line))
    meet = (a.block == b.block) & (a.own == b.own) & (a.other == b.other) & F.expr("a < b AND a_label <> b_label")
    return a.join(b, meet & _close("a_", "b_", similarity) & _shared("a_", "b_", similarity)).select("a", "b").distinct()


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def line_groups(df: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, lines: DataFrame | None = None) -> DataFrame:
    """Classes with more than one occurrence or in a group: node and the group's first occurrence. lines are those of the
    table, if they are at hand."""
    lines = lines_of(df, min_words) if lines is None else lines
    first = F.min(F.struct("doc_id", "doc", "place")).alias("first")
    numbers = ("n", "blocks", "w0", "w1")
    classes = lines.where("node IS NOT NULL").groupBy("node").agg(first, *(F.first(c).alias(c) for c in numbers), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes)
    keys = classes.where("blocks IS NOT NULL").select("node", _keys("blocks", "n").alias("keys"))
    keyed = keys.select("node", F.explode_outer("keys").alias("block")).where("block IS NOT NULL").repartition("block")
    shared = keyed.groupBy("block").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    # Bare keys meet first, in one pass over them, then bits; words are fetched for those that are left.
    members = stored(keyed.join(shared.hint("shuffle_hash"), "block"))
    # SimHashes are cheaper made again than beside the aggregation, with which they are too long a method for Java to compile.
    bits = lambda c: classes.where("blocks IS NOT NULL").select(F.col("node").alias(c), F.struct("n", simhash("blocks").alias("x"), "w0", "w1").alias(f"{c}_bits"))
    led = members.where("leader < node").select("leader", "node").distinct().join(bits("node"), "node").join(bits("leader"), "leader")
    led = led.where(_close("node_bits.", "leader_bits.", similarity) & _shared("node_bits.", "leader_bits.", similarity))
    near = stored(led.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    labels = components(stored(_verified(near, stored(_texts(df, classes, _nodes(near))), similarity)))
    named = members.where("node <> leader").join(labels, "node", "left").select("block", "node", F.coalesce("component", "node").alias("label"))
    named = stored(named.join(_mixed(named), "block").join(bits("node"), "node").withColumnRenamed("node_bits", "bits"))
    apart, large = _direct(named.where(F.col("rows") <= DIRECT), similarity), named.where(F.col("rows") > DIRECT)
    if not large.isEmpty():
        hashes = _texts(df, classes, large.select("node").distinct()).select("node", F.col("words").alias("hashes"))
        apart = apart.union(_apart(large.join(hashes, "node"), similarity)).distinct()
    apart = stored(apart)
    apart = stored(_verified(apart, stored(_texts(df, classes, _nodes(apart))), similarity))
    # These link groups, or classes alone, which are their own label.
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    links = apart.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    more = components(links)
    moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
    labels = stored(moved.select("node", F.coalesce("next", "component").alias("component")).union(more.join(labels, "node", "left_anti")))
    grouped = classes.select("node", "first").join(labels, "node")
    firsts = grouped.groupBy("component").agg(F.min("first").alias("group_first"))
    joined = grouped.join(firsts, "component").select("node", F.col("group_first").alias("first"))
    alone = classes.where("copies > 1").join(labels, "node", "left_anti").select("node", "first")
    return joined.union(alone)


def dedup_lines(df: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, counts: bool = False, drop_empty: bool = False) -> DataFrame:
    """The documents without the lines that occur before, exactly or nearly. counts adds n_lines and n_cut."""
    lines = stored(lines_of(df, min_words))
    groups = line_groups(df, similarity, min_words, lines)
    cut = lines.select("node", "doc", "place").join(groups, "node").where("first.doc <> doc OR first.place <> place")
    cut = stored(cut.groupBy(F.col("doc").alias("key_of_doc")).agg(F.collect_set("place").alias("cut_of_doc")))
    names = [c for c in df.columns if not counts or c not in ("n_lines", "n_cut")]
    # Texts aren't sorted for this; what is cut of a partition's documents is held, places only.
    out = df.select(*names, F.xxhash64("doc_id", "text").alias("key_of_row")).join(cut.hint("shuffle_hash"), F.col("key_of_row") == F.col("key_of_doc"), "left")
    # The lambda around splits the text once.
    left = F.expr("transform(array(split(text, '\\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), cut_of_doc), i -> l[i]), '\n'))[0]")
    if drop_empty:
        out = out.where(F.col("cut_of_doc").isNull() | left.rlike(r"\S"))
    done = out.select(*(F.when(F.col("cut_of_doc").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(c) for c in names), *((
        F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("cut_of_doc"), F.lit(0)).alias("n_cut"),
    ) if counts else ()))
    return done
