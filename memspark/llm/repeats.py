"""Removal of passages that an earlier document has, by suffixes sorted deep-shallow.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id. Equal strings have
the same least k-gram by hash, their anchor, so suffixes need comparing only where anchors are equal. The text that holds
the suffixes of one anchor is its region. A first exchange of anchor hashes tells which anchors several documents have; a
second, of the hashes of their regions, settles regions that are equal as a whole, as within long copies. Where an anchor
has different regions, the first document of each sends its text, and each bucket of anchors sorts the suffixes to LENGTH
bytes: shallow by multikey quicksort on eight bytes at a time, then deep by blind tries for the groups whose common prefix
is longer. Runs of equal suffixes give the least doc_id of each string, and the spans to remove go back to the documents.

The texts are written once, in batches, bucketed by batch, so that the passes over them move no text. An anchor that very
many batches have is dealt out by its regions, and then by the single strings in them, each batch sending a string once.

Edge cases: null counts as empty; texts shorter than LENGTH lose nothing and cause no loss; a null doc_id is no smaller than
any other; rows that share a doc_id don't affect each other; texts of any length are taken whole; columns beside doc_id and
text play no part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import ArrowRows, column_bytes, pieces, stored
from memspark.llm.near_dedup import _BYTE, _Powers, mix
from memspark.runtime import ensure_checkpoint_dir

LENGTH = 50
GRAM = 26
SHALLOW = 2
#: Text of one batch; text looked at together within it; text whose anchors make one bucket.
BATCH_BYTES, CHUNK_BYTES, BUCKET_BYTES = 4_000_000, 500_000, 4_000_000
#: Batches with the same anchor from which on its strings are dealt out singly.
HOT_BATCHES = 200
_LAST = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 24) - 1)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _words_at(text: np.ndarray, starts: np.ndarray, word: int, depth: int) -> np.ndarray:
    """Eight bytes of each suffix from a depth of 8 * word on, as a number that sorts like them; zero beyond the depth."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        at = 8 * word + i
        out <<= np.uint64(8)
        if at < depth:
            out |= text[starts + at]
    return out


def sort_suffixes(text: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first depth bytes, and for each place in it the number of its run of equals."""
    n = len(starts)
    order = np.arange(n)
    if n == 0:
        return order, order
    # Shallow: sort by one long character after another, within the groups that are equal so far.
    group = np.zeros(n, np.int64)
    for word in range(SHALLOW):
        key = _words_at(text, starts[order], word, depth)
        by = np.lexsort((key, group))
        order, key, group = order[by], key[by], group[by]
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
    # Deep: the groups that are left have a long common prefix. A blind trie of each tells its members apart by how far
    # they go along with its first member and by the byte where they part; members of one branch make the next trie.
    rank = np.empty(n, np.int64)  # of each place, the first place of its run
    size = np.bincount(group)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    rank = first[group]
    open_places = np.flatnonzero(size[group] > 1)
    words = -(-depth // 8)
    while len(open_places):
        members = order[open_places]
        trie = rank[open_places]
        head = np.ones(len(trie), bool)
        head[1:] = trie[1:] != trie[:-1]
        leader = members[np.flatnonzero(head)[np.cumsum(head) - 1]]
        parted = np.full(len(members), depth, np.int64)  # how far each goes along with its leader
        side = np.zeros(len(members), np.int64)
        byte = np.zeros(len(members), np.int64)
        alive = np.flatnonzero(members != leader)
        for word in range(SHALLOW, words):
            if not len(alive):
                break
            a, b = _words_at(text, starts[members[alive]], word, depth), _words_at(text, starts[leader[alive]], word, depth)
            differ = a != b
            at = alive[differ]
            x = a[differ] ^ b[differ]
            skip = np.zeros(len(at), np.int64)
            for i in range(1, 8):
                skip += (x >> np.uint64(8 * (8 - i))) == 0
            shift = (np.uint64(56) - skip.astype(np.uint64) * np.uint64(8))
            parted[at] = 8 * word + skip
            byte[at] = ((a[differ] >> shift) & np.uint64(255)).astype(np.int64)
            side[at] = np.where(a[differ] < b[differ], -1, 1)
            alive = alive[~differ]
        # In order: smaller ones that part early, smaller ones that part late, equals, greater ones late, greater early.
        depth_key = np.where(side < 0, parted, -parted)
        by = np.lexsort((byte, depth_key, side, trie))
        order[open_places] = members[by]
        trie, side, depth_key, byte = trie[by], side[by], depth_key[by], byte[by]
        new = np.ones(len(by), bool)
        new[1:] = (trie[1:] != trie[:-1]) | (side[1:] != side[:-1]) | (depth_key[1:] != depth_key[:-1]) | (byte[1:] != byte[:-1])
        run = np.cumsum(new) - 1
        rank[open_places] = open_places[np.flatnonzero(new)][run]
        many = np.bincount(run)[run] > 1
        open_places = open_places[many & (side != 0)]
    return order, rank


def anchors(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For a text of several documents: hash, document, first and last window, and hash of the region, of every anchor.

    A window is LENGTH bytes of one document; its anchor is the leftmost of its k-grams with the least hash.
    """
    none = np.empty(0, np.int64)
    n = len(chars)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    power, back = _Powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[chars] * power[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[span - width : span - width + n - LENGTH + 1])
    inside = np.zeros(n + 1, np.int64)
    lasting = ends - starts >= LENGTH
    np.add.at(inside, starts[lasting], 1)
    np.add.at(inside, ends[lasting] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[: n - LENGTH + 1]) > 0)
    if not len(windows):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    place = (least[windows] & _LOW).astype(np.int64)
    document = np.searchsorted(starts, windows, side="right") - 1
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(windows)) - 1
    begin, end = windows[at], windows[last]
    region = mix((sums[end + LENGTH] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    return grams[place[at]] >> np.uint64(16), document[at], begin, end, region


class _Batch:
    """Anchors of a batch of texts, chunk by chunk: hash, row, text, and first and last window within the row."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts

    def chunks(self):
        at = 0
        while at < len(self.texts):
            to, size = at, 0
            while to < len(self.texts) and (to == at or size + len(self.texts[to]) <= CHUNK_BYTES):
                size += len(self.texts[to])
                to += 1
            for low, part in self._parts(at, to):
                yield low, *part
            at = to

    def _parts(self, at: int, to: int):
        """A row longer than a chunk is looked at in pieces that overlap by less than a window, so that no window is met twice."""
        if to == at + 1 and len(self.texts[at]) > 8 * CHUNK_BYTES:
            step = 8 * CHUNK_BYTES
            text = self.texts[at]
            for low in range(0, max(1, len(text) - LENGTH + 1), step):
                piece = text[low : low + step + LENGTH - 1]
                yield low, self._found([piece], at)
        else:
            yield 0, self._found(self.texts[at:to], at)

    def _found(self, texts: list[bytes], row: int):
        chars = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts]
        keep = ends > starts
        which = np.flatnonzero(keep)
        hashes, document, first, last, region = anchors(chars, starts[keep].astype(np.int64), ends[keep].astype(np.int64))
        document = which[document] if len(document) else document
        at = starts.astype(np.int64)[document] if len(document) else first
        return chars, hashes, document + row, first, last, at, mix(hashes * _PAIR ^ region)


def _pack(x: np.ndarray) -> bytes:
    """Hashes of 48 bits in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _batched(df: DataFrame) -> DataFrame:
    """The texts in batches, written once and bucketed by batch: batch, row, doc_id, text."""
    spark = df.sparkSession

    def number(batches: ArrowRows) -> ArrowRows:
        batch, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for part in pieces(batches, 64):
            texts = column_bytes(part, "text")
            at, rows = [], []
            for text in texts:
                if size >= BATCH_BYTES:
                    batch, row, size = batch + 1, 0, 0
                at.append(batch)
                rows.append(row)
                row += 1
                size += len(text or b"") + 64
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.int32()), part.column(0), pa.array([x or b"" for x in texts], pa.binary())], names=["batch", "row", "doc_id", "text"])

    named = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(number, "batch long, row int, doc_id long, text binary")
    name = f"memspark_llm_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named.write.bucketBy(buckets, "batch").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the plan reads the files
    return table


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of each value, in order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cuts) if len(x)]


def repeated_spans(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batched texts, and for each batch the spans to remove as packed rows, starts and ends."""
    texts = _batched(df)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def send_hashes(group: pa.Table) -> pa.Table:
        found = [x[2] for x in _Batch(group.column("text").to_pylist()).chunks()]
        hashes = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        rows = _by_bucket((hashes % np.uint64(buckets)).astype(np.int64))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "batch": pa.array([group.column("batch")[0].as_py()] * len(rows), pa.int64()), "hashes": pa.array([_pack(hashes[x]) for _, x in rows], pa.binary())})

    sent = texts.groupBy("batch").applyInArrow(send_hashes, "bucket long, batch long, hashes binary")

    def shared(group: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in group.column("hashes").to_pylist()]
        values, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        often = count[place]
        out, at = [], 0
        for x in lists:
            n = often[at : at + len(x)]
            out.append((_pack(x[(n > 1) & (n < HOT_BATCHES)]), _pack(x[n >= HOT_BATCHES])))
            at += len(x)
        return pa.table({"batch": group.column("batch"), "warm": pa.array([x[0] for x in out], pa.binary()), "hot": pa.array([x[1] for x in out], pa.binary())})

    replies = sent.groupBy("bucket").applyInArrow(shared, "batch long, warm binary, hot binary")

    def send_regions(group: pa.Table, reply: pa.Table) -> pa.Table:
        names = ("bucket", "batch", "keys", "anchors", "hot", "counts", "rows", "places", "sizes", "ids")
        out = []
        if group.num_rows:
            group = group.sort_by("row")
            ids = _ids(group)
            warm, hot = (np.unique(np.concatenate([_unpack(x) for x in reply.column(c).to_pylist()] or [np.empty(0, np.uint64)])) for c in ("warm", "hot"))
            found = [(h, key, row, first - start + low, last - first) for low, _, h, row, first, last, start, key in _Batch(group.column("text").to_pylist()).chunks()]
            anchor, key, row, place, size = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(5))
            # Anchors that only this batch has matter if two of its documents have them.
            by = np.lexsort((row, anchor))
            again = anchor[by][1:][(anchor[by][1:] == anchor[by][:-1]) & (row[by][1:] != row[by][:-1])]
            is_hot = np.isin(anchor, hot)
            chosen = np.flatnonzero(is_hot | np.isin(anchor, warm) | np.isin(anchor, again))
            chosen = chosen[np.lexsort((key[chosen], anchor[chosen]))]
            dealt = np.where(is_hot[chosen], key[chosen], anchor[chosen]) % np.uint64(buckets)
            batch = group.column("batch")[0].as_py()
            for bucket, at in _by_bucket(dealt.astype(np.int64)):
                at = chosen[at]
                new = np.ones(len(at), bool)
                new[1:] = key[at][1:] != key[at][:-1]
                heads = at[new]
                counts = np.diff(np.append(np.flatnonzero(new), len(at))).astype(np.int32)
                out.append((bucket, batch, key[heads].tobytes(), _pack(anchor[heads]), is_hot[heads].tobytes(), counts.tobytes(), row[at].astype(np.int32).tobytes(), place[at].astype(np.int32).tobytes(), size[at].astype(np.int16).tobytes(), ids[row[at]].tobytes()))
        return pa.table({c: pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(names)})

    region_fields = ", ".join(f"{c} binary" for c in ("keys", "anchors", "hot", "counts", "rows", "places", "sizes", "ids"))
    regions = texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(send_regions, f"bucket long, batch long, {region_fields}")
    judged = stored(regions.groupBy("bucket").applyInArrow(_judge_regions, "batch long, spans binary, warm binary, hot binary"))

    def send_suffixes(group: pa.Table, reply: pa.Table) -> pa.Table:
        names = ("bucket", "batch", *_SENT)
        by: dict[int, list] = {}
        if group.num_rows and reply.num_rows:
            group = group.sort_by("row")
            ids = _ids(group)
            warm, hot = (np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in reply.column(c).to_pylist()])) for c in ("warm", "hot"))
            least: dict[int, int] = {}
            wanted = []
            for low, chars, hashes, row, first, last, start, key in _Batch(group.column("text").to_pylist()).chunks():
                raw = None
                for keys, single in ((warm, False), (hot, True)):
                    for i in np.flatnonzero(np.isin(key, keys)).tolist():
                        raw = chars.tobytes() if raw is None else raw
                        k, r, x, y = int(key[i]), int(row[i]), int(first[i]), int(last[i])
                        doc = int(ids[r])
                        least[k] = min(least.get(k, doc), doc)
                        wanted.append((k, single, int(hashes[i]), r, doc, x - int(start[i]) + low, raw[x : y + LENGTH]))
            # Occurrences in later documents of the batch have gone already.
            seen: dict[bytes, tuple[int, list, list]] = {}
            for k, single, anchor, r, doc, place, text in wanted:
                if doc != least[k]:
                    continue
                for at in range(len(text) - LENGTH + 1) if single else (0,):
                    part = text[at : at + LENGTH] if single else text
                    held = seen.get(part)
                    if held is None:
                        dealt = int.from_bytes(hashlib.blake2b(part, digest_size=6).digest(), "little") if single else anchor
                        held = seen[part] = (dealt % buckets, [], [])
                    held[1].append(r)
                    held[2].append(place + at)
            for text, held in seen.items():
                by.setdefault(held[0], []).append((text, held))
        out = []
        for bucket, items in by.items():
            rows = np.array([r for _, h in items for r in h[1]], np.int32)
            out.append(
                (
                    bucket,
                    group.column("batch")[0].as_py(),
                    b"".join(t for t, _ in items),
                    np.array([len(t) for t, _ in items], np.int32).tobytes(),
                    np.array([len(h[1]) for _, h in items], np.int32).tobytes(),
                    rows.tobytes(),
                    np.array([p for _, h in items for p in h[2]], np.int32).tobytes(),
                    ids[rows].tobytes(),
                )
            )
        return pa.table({c: pa.array([x[i] for x in out], pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(names)})

    fields = ", ".join(f"{c} binary" for c in _SENT)
    needed = judged.where(F.octet_length("warm") + F.octet_length("hot") > 0).select("batch", "warm", "hot")
    suffixes = texts.groupBy("batch").cogroup(needed.groupBy("batch")).applyInArrow(send_suffixes, f"bucket long, batch long, {fields}")
    spans = suffixes.groupBy("bucket").applyInArrow(_judge, "batch long, spans binary")
    return texts, spans.union(judged.where(F.octet_length("spans") > 0).select("batch", "spans"))


def _ids(group: pa.Table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in group.column("doc_id").to_pylist()], np.int64)


def _joined(group: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), kind)


def _judge_regions(group: pa.Table) -> pa.Table:
    """Name the spans of regions that an earlier document has whole; ask for the texts of regions that differ at one anchor."""
    batches = group.column("batch").to_numpy()
    heads = [len(x) // 8 for x in group.column("keys").to_pylist()]
    keys, anchor, hot, counts = _joined(group, "keys", np.uint64), _unpack(b"".join(group.column("anchors").to_pylist())), _joined(group, "hot", bool), _joined(group, "counts", np.int32)
    row, place, size, doc = (_joined(group, c, k) for c, k in (("rows", np.int32), ("places", np.int32), ("sizes", np.int16), ("ids", np.int64)))
    _, place_of, same = np.unique(keys, return_index=True, return_inverse=True)
    least = np.full(len(place_of), _LAST, np.int64)
    of = np.repeat(same, counts)
    np.minimum.at(least, of, doc)
    batch_of_head = np.repeat(batches, heads)
    batch = np.repeat(batch_of_head, counts)
    late = np.flatnonzero(doc > least[of])
    _, anchor_of, regions = np.unique(anchor[place_of], return_inverse=True, return_counts=True)
    many = regions[anchor_of] > 1
    # Of each region its first document's batch is asked.
    firsts = np.zeros(len(keys), bool)
    np.logical_or.at(firsts, np.repeat(np.arange(len(keys)), counts), doc == least[of])
    ask = np.flatnonzero(firsts & (hot | many[same]))
    spans = {b: np.stack([row[late][x], place[late][x], place[late][x] + size[late][x] + LENGTH], 1).astype(np.int32).tobytes() for b, x in _by_bucket(batch[late])}
    asked = {b: (keys[ask][x][~hot[ask][x]].tobytes(), keys[ask][x][hot[ask][x]].tobytes()) for b, x in _by_bucket(batch_of_head[ask])}
    every = sorted(spans.keys() | asked.keys())
    return pa.table(
        {
            "batch": pa.array(every, pa.int64()),
            "spans": pa.array([spans.get(b, b"") for b in every], pa.binary()),
            "warm": pa.array([asked.get(b, (b"", b""))[0] for b in every], pa.binary()),
            "hot": pa.array([asked.get(b, (b"", b""))[1] for b in every], pa.binary()),
        }
    )


_SENT = ("strings", "lengths", "counts", "rows", "places", "ids")


def _judge(group: pa.Table) -> pa.Table:
    """Sort a bucket's suffixes and name the spans whose strings an earlier document has."""
    batches = np.array(group.column("batch").to_pylist(), np.int64)
    cat = lambda c, kind: [np.frombuffer(x, kind) for x in group.column(c).to_pylist()]
    strings = cat("strings", np.uint8)
    lengths, counts, rows, places, ids = (cat(c, k) for c, k in (("lengths", np.int32), ("counts", np.int32), ("rows", np.int32), ("places", np.int32), ("ids", np.int64)))
    batch_of = np.repeat(batches, [len(x) for x in rows])
    text, length, count = np.concatenate(strings), np.concatenate(lengths).astype(np.int64), np.concatenate(counts)
    row, place, doc = np.concatenate(rows), np.concatenate(places).astype(np.int64), np.concatenate(ids)
    begin = np.cumsum(length) - length
    # Equal strings from several batches are one: by two hashes and the length.
    power, back = _Powers.upto(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(_BYTE[text]) * power[: len(text)], out=total[1:])
    key = mix((total[begin + length] - total[begin]) * back[begin] + length.astype(np.uint64))
    _, chosen, same = np.unique(key, return_index=True, return_inverse=True)
    of = np.repeat(same, count)  # for each occurrence
    least = np.full(len(chosen), _LAST, np.int64)
    np.minimum.at(least, of, doc)
    windows = length[chosen] - LENGTH + 1
    offset = np.cumsum(windows) - windows
    string = np.repeat(np.arange(len(chosen)), windows)
    starts = begin[chosen][string] + np.arange(windows.sum()) - offset[string]
    order, run = sort_suffixes(text, starts)
    first = np.full(len(order), _LAST, np.int64)
    np.minimum.at(first, run, least[string[order]])
    earliest = np.empty(len(order), np.int64)
    earliest[order] = first[run]  # the least doc_id that has each window
    # An occurrence in a later document than the string's first goes whole; in the first, window by window.
    late = doc > least[of]
    out = [(batch_of[late], row[late], place[late], place[late] + length[chosen][of][late])]
    gone = earliest < least[string]
    edge = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (string[1:] == string[:-1])]))
    stop = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (string[1:] == string[:-1]), [False]]))
    part = string[edge]
    holders = np.flatnonzero(~late)
    holders = holders[np.argsort(of[holders], kind="stable")]
    low, high = np.searchsorted(of[holders], part), np.searchsorted(of[holders], part, side="right")
    each = np.repeat(np.arange(len(part)), high - low)
    who = holders[np.repeat(low, high - low) + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)] if len(each) else np.empty(0, np.int64)
    begin_at = edge[each] - offset[part[each]]
    end_at = stop[each] - offset[part[each]] + LENGTH
    out.append((batch_of[who], row[who], place[who] + begin_at, place[who] + end_at))
    batch, row, starts_at, ends_at = (np.concatenate([x[i] for x in out]) for i in range(4))
    rows_out = [(b, np.stack([row[x], starts_at[x], ends_at[x]], 1).astype(np.int32).tobytes()) for b, x in _by_bucket(batch)]
    return pa.table({"batch": pa.array([x[0] for x in rows_out], pa.int64()), "spans": pa.array([x[1] for x in rows_out], pa.binary())})


def remove_repeats(df: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked for the bytes that stay (kept_bytes).

    df: read again it must give the same rows only until the batches are written, which is done once.
    """
    texts, spans = repeated_spans(df)

    def cut(group: pa.Table, found: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        cuts = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 3) for x in found.column("spans").to_pylist()] or [np.empty((0, 3), np.int32)])
        cuts = cuts[np.lexsort((cuts[:, 1], cuts[:, 0]))]
        at = np.searchsorted(cuts[:, 0], np.arange(group.num_rows + 1))
        out = []
        for i, text in enumerate(group.column("text").to_pylist()):
            kept, last, runs, removed = [], 0, 0, 0
            for _, a, b in cuts[at[i] : at[i + 1]].tolist():
                if b <= last and runs:
                    continue
                if not runs or a > last:
                    kept.append(text[last:a])
                    runs += 1
                    removed += b - a
                else:
                    removed += b - last
                last = b
            kept.append(text[last:])
            rest = b"".join(kept)
            out.append((len(text), removed, runs, hashlib.sha256(rest).hexdigest(), *([rest] if with_bytes else [])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")[: 5 if with_bytes else 4]
        return pa.table({"doc_id": group.column("doc_id"), **{c: pa.array([x[k] for x in out], kinds[k]) for k, c in enumerate(names)}})

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_bytes else "")
    return texts.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(cut, fields)
