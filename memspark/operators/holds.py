"""Timed holds on keys: rolling deduplication and lease replay, exact also for one very hot key.

An event takes a free key and holds it for ``ttl``; events that meet a live hold are refused, unless they come from the
holder itself, which renews. If an event is granted, the next granted event of its key is known from it alone, so the
granted events are those on the path of these steps from the key's first one.

Keys of up to ``piece_rows`` events are whole frames. For larger keys no frame has more rows than that:

1. every event's step is found by sorting for the next event past its time and the next renewal and release;
2. a key's events are cut into pieces of ``piece_rows`` by place, and each event's path is followed to where it leaves
   its piece, which leaves only the events that some path enters a piece by;
3. these jumps are doubled, round by round, and read back from the longest to the shortest: the entries on the path from
   the key's first event, at most one for each piece;
4. every piece follows the path on from its entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memspark.operators.placing import next_values, rank_rows
from memspark.runtime import cut_lineage

#: The most events of one key in one frame.
PIECE_ROWS = 50_000


def _whole_groups(run: Callable[[pd.DataFrame], pd.DataFrame], by: list[str]) -> Callable:
    """Feed ``run`` frames of whole groups from sorted batches; only the group at a batch edge is carried over."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = np.ones(len(batch), dtype=bool)
            for c in by:
                last &= (batch[c] == batch[c].iloc[-1]).to_numpy()
            edge = int(np.argmax(last)) if last.any() else len(batch)
            if edge == 0:
                if rest and any(rest[-1][c].iloc[-1] != batch[c].iloc[0] for c in by):
                    yield run(pd.concat(rest, ignore_index=True))
                    rest = []
                rest.append(batch)
                continue
            yield run(pd.concat([*rest, batch.iloc[:edge]], ignore_index=True))
            rest = [batch.iloc[edge:]]
        if rest:
            yield run(pd.concat(rest, ignore_index=True))

    return over


def _text(values) -> pd.Series:
    return pd.Series(values, dtype=object)


def _next_of(n: int, targets: np.ndarray, target_code: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each of n events the next later target with the same code, or n."""
    if not len(targets):
        return np.full(n, n)
    width = n + 1
    packed = np.sort(target_code[targets] * width + targets)
    at = np.searchsorted(packed, code * width + np.arange(n), side="right")
    hit = packed[np.minimum(at, len(packed) - 1)]
    return np.where((at < len(packed)) & (hit // width == code), hit % width, n)


def _steps(ts: np.ndarray, takes: np.ndarray, holder: np.ndarray | None, start: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Over events of whole keys in time order: the next event granted if this one is (n: none), and each key's first one."""
    n = len(ts)
    first = np.flatnonzero(start)
    group = np.cumsum(start) - 1
    end = np.append(first[1:], n)
    # One increasing axis over all keys; gaps count up to a lifetime.
    gap = np.minimum(np.diff(ts, prepend=ts[0]), ttl)
    axis = np.cumsum(np.where(start, ttl, gap))
    taken = np.flatnonzero(takes)
    next_take = np.full(n + 1, n)
    if len(taken):
        at = np.searchsorted(taken, np.arange(n + 1))
        next_take = np.where(at < len(taken), taken[np.minimum(at, len(taken) - 1)], n)
    cut = np.searchsorted(axis, axis + ttl, side="left")
    follow = np.full(n, n)
    if holder is not None:
        owner = pd.factorize(pd.Series(group).astype(str) + "\u0001" + pd.Series(holder))[0].astype(np.int64)
        follow = _next_of(n, taken, owner, owner)
        releases = np.flatnonzero(~takes)
        freed = np.minimum(_next_of(n, releases, owner, owner), _next_of(n, releases[holder[releases] == ""], group, group))
        cut = np.minimum(cut, freed + 1)
    cut = np.minimum(cut, end[group])
    step = np.where(follow < cut, follow, next_take[cut])
    entry = next_take[first]
    return np.where(step < end[group], step, n), entry[entry < end]


def _granted(step: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All events on the paths from these."""
    out = np.zeros(len(step), dtype=bool)
    while len(at):
        out[at] = True
        at = step[at]
        at = at[at < len(step)]
    return out


def _ids(events: pd.DataFrame) -> pd.Series:
    return events["id"] if pd.api.types.is_integer_dtype(events["id"]) else _text(events["id"].to_numpy())


def _replay(ttl: int, holders: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(events: pd.DataFrame) -> pd.DataFrame:
        key = events["key"].to_numpy()
        start = np.ones(len(events), dtype=bool)
        start[1:] = key[1:] != key[:-1]
        step, entry = _steps(
            events["ts"].to_numpy().astype(np.int64), events["takes"].to_numpy().astype(bool), events["holder"].to_numpy() if holders else None, start, ttl
        )
        return pd.DataFrame({"id": _ids(events), "granted": _granted(step, entry)})

    return run


def _local(events: pd.DataFrame) -> np.ndarray:
    """Steps within a frame of pieces (key, piece), in order of place; n where a path leaves the piece or ends."""
    n = len(events)
    key, piece, pos = events["key"].to_numpy(), events["piece"].to_numpy(), events["pos"].to_numpy().astype(np.int64)
    start = np.ones(n, dtype=bool)
    start[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(start)
    group = np.cumsum(start) - 1
    to = np.where(events["has_step"].to_numpy(), events["step"].to_numpy().astype(np.int64), -1)
    # A piece has every place from its first to its last.
    at = first[group] + to - pos[first][group]
    return np.where((to >= 0) & (at < np.append(first[1:], n)[group]), at, n)


def _leave(events: pd.DataFrame) -> pd.DataFrame:
    """Where the path from each event leaves its piece (-1: it ends there)."""
    n, step = len(events), _local(events)
    last = np.where(step < n, step, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    to = np.where(events["has_step"].to_numpy()[last], events["step"].to_numpy().astype(np.int64)[last], -1)
    out = pd.DataFrame({"key": _text(events["key"].to_numpy()), "pos": events["pos"].to_numpy(), "to": to})
    return out[events["takes"].to_numpy().astype(bool)]


def _follow(events: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": _ids(events), "granted": _granted(_local(events), np.flatnonzero(events["entered"].to_numpy()))})


def _stepped(slim: DataFrame, ttl: int, holders: bool) -> DataFrame:
    """Events with their place in their key (pos) and the place of the event that is granted next if they are (step)."""
    rows = cut_lineage(rank_rows(slim, "key", ["ts", "id"]))
    # Each event looks for the first one at the end of its hold or later; among equal times, the looks come before.
    takes = F.when(F.col("takes"), F.col("pos"))
    looks = rows.filter("takes").select("key", (F.col("ts") + ttl).alias("time"), F.lit(0).alias("turn"), "pos", F.lit(None).cast("bigint").alias("take"))
    seen = rows.select("key", F.col("ts").alias("time"), F.lit(1).alias("turn"), "pos", takes.alias("take"))
    ahead = next_values(looks.unionByName(seen), "key", ["time", "turn", "pos"], ["take"])
    rows = rows.join(ahead.filter("turn = 0").select("key", "pos", F.col("next_take").alias("later")), ["key", "pos"], "left")
    if not holders:
        return rows.withColumnRenamed("later", "step")
    rows = rows.join(ahead.filter("turn = 1").select("key", "pos", F.col("next_take").alias("after")), ["key", "pos"])
    place = F.struct("pos", "ts", "after")
    marked = rows.withColumns(
        {
            "release": F.when(~F.col("takes"), place),
            "forced": F.when(~F.col("takes") & (F.col("holder") == ""), place),
            "again": F.when(F.col("takes"), place),
            "owner": F.concat_ws("\u0001", "key", "holder"),
        }
    )
    own = next_values(marked, "owner", ["pos"], ["release", "again"]).drop("release", "again", "owner")
    found = next_values(own, "key", ["pos"], ["forced"])
    end = F.col("ts") + ttl
    freed = F.least("next_release", "next_forced")  # by place
    renewed = (F.col("next_again.ts") < end) & (freed.isNull() | (F.col("next_again.pos") < freed["pos"]))
    step = F.when(renewed, F.col("next_again.pos")).when(freed["ts"] < end, freed["after"]).otherwise(F.col("later"))
    return found.withColumn("step", F.when(F.col("takes"), step)).select(*slim.columns, "pos", "step")


def _path(exits: DataFrame, heads: DataFrame) -> DataFrame:
    """The entries (key, pos) on the path from the heads along exits(key, pos, to)."""
    entries = exits.filter("to >= 0").select("key", F.col("to").alias("pos")).union(heads).distinct()
    jumps, levels = cut_lineage(exits.filter("to >= 0").join(entries, ["key", "pos"])), []
    while not jumps.isEmpty():
        levels.append(jumps)
        further = jumps.select("key", F.col("pos").alias("to"), F.col("to").alias("end"))
        jumps = cut_lineage(jumps.join(further, ["key", "to"]).select("key", "pos", F.col("end").alias("to")))
    # From jumps over 2 ** k pieces to jumps over one.
    reached = heads
    for jumps in reversed(levels):
        reached = cut_lineage(reached.union(reached.join(jumps, ["key", "pos"]).select("key", F.col("to").alias("pos"))))
    return reached


def _replay_pieces(slim: DataFrame, ttl: int, holders: bool, rows: int, schema: str) -> DataFrame:
    stepped = _stepped(slim, ttl, holders).withColumns({"piece": F.expr(f"pos div {rows}"), "has_step": F.col("step").isNotNull(), "step": F.coalesce("step", F.lit(-1))})
    stepped = cut_lineage(stepped.drop("ts", "holder"))

    def by_piece(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], out: str) -> DataFrame:
        return df.repartition("key", "piece").sortWithinPartitions("key", "piece", "pos").mapInPandas(_whole_groups(run, ["key", "piece"]), out)

    exits = cut_lineage(by_piece(stepped, _leave, "key string, pos bigint, `to` bigint"))
    heads = stepped.filter("takes").groupBy("key").agg(F.min("pos").alias("pos"))
    entered = _path(exits, heads).withColumn("entered", F.lit(True))
    return by_piece(stepped.join(entered, ["key", "pos"], "left").fillna(False, ["entered"]), _follow, schema)


def replay_holds(
    events: DataFrame,
    keys: list[Column],
    ts: Column,
    event_id: Column,
    ttl_seconds: float,
    holder: Column | None = None,
    takes: Column | None = None,
    piece_rows: int = PIECE_ROWS,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """(id, granted) of every event. Equal times are ordered by id. Rows with ``takes`` false release the holder's hold
    (an empty holder releases anyone's). ``crowd``, where events are dear to compute, is a table that they come from: it
    has the columns of the first key and as many rows for it or more."""
    ttl = int(ttl_seconds * 1_000_000)
    holders = holder is not None
    slim = events.select(
        F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0002")) for k in keys]).alias("key"),
        F.unix_micros(ts).alias("ts"),
        event_id.alias("id"),
        (F.coalesce(holder, F.lit("")) if holders else F.lit("")).alias("holder"),
        (F.coalesce(takes, F.lit(True)) if takes is not None else F.lit(True)).alias("takes"),
    )
    schema = f"id {dict(slim.dtypes)['id']}, granted boolean"
    # Keys may be dear to compute: none is large if no group by the first of them is.
    crowded = [(events if crowd is None else crowd).select(keys[0].alias("key")), slim]
    large = None
    for rows in crowded:
        large = rows.groupBy("key").count().filter(F.col("count") > piece_rows).select("key")
        if large.isEmpty():
            large = None
            break

    def whole(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(_whole_groups(_replay(ttl, holders), ["key"]), schema)

    if large is None:
        return whole(slim)
    # Fewer keys than events by piece_rows.
    large, slim = cut_lineage(large), cut_lineage(slim)
    pieces = _replay_pieces(slim.join(large, "key", "left_semi"), ttl, holders, piece_rows, schema)
    return whole(slim.join(large, "key", "left_anti")).unionByName(pieces)


def dedup_window(events: DataFrame, keys: list[str], ts: str, event_id: str, seconds: float = 300, crowd: DataFrame | None = None) -> DataFrame:
    """Add ``is_duplicate``: true within ``seconds`` of the first event of a run of its key; repeats do not extend the run."""
    verdict = replay_holds(events, [F.col(k) for k in keys], F.col(ts), F.col(event_id), seconds, crowd=crowd)
    return events.join(verdict.select(F.col("id").alias(event_id), (~F.col("granted")).alias("is_duplicate")), event_id)


def replay_leases(log: DataFrame, ttl_seconds: float = 600, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Replay ``log(event_id, action_id, holder_id, ts[, op])`` -> (decisions, leases live at ``as_of``).

    ``op`` is ``acquire`` (default) or ``release``; only acquires get a decision.
    """
    if "op" not in log.columns:
        log = log.withColumn("op", F.lit("acquire"))
    valid = log.filter((F.coalesce("action_id", F.lit("")) != "") & ((F.col("op") == "release") | (F.coalesce("holder_id", F.lit("")) != "")))
    if as_of is not None:
        valid = valid.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    verdict = replay_holds(
        valid, [F.col("action_id")], F.col("ts"), F.col("event_id"), ttl_seconds, F.col("holder_id"), F.col("op") == "acquire"
    )
    decisions = valid.filter("op = 'acquire'").join(verdict.withColumnRenamed("id", "event_id"), "event_id")
    place = F.struct("ts", "event_id")
    last = decisions.filter("granted").groupBy("action_id").agg(F.max(F.struct("ts", "event_id", "holder_id")).alias("g"))
    last = last.select(
        "action_id", F.col("g.holder_id").alias("holder_id"), F.col("g.ts").alias("granted_at"), F.struct("g.ts", "g.event_id").alias("at"),
        F.timestamp_micros(F.unix_micros("g.ts") + int(ttl_seconds * 1_000_000)).alias("expires_at"),
    )
    released = valid.filter("op = 'release'").groupBy("action_id", F.coalesce("holder_id", F.lit("")).alias("by")).agg(F.max(place).alias("rel"))
    own = released.select("action_id", F.col("by").alias("holder_id"), "rel")
    forced = released.filter("by = ''").select("action_id", F.col("rel").alias("forced"))
    live = (
        last.join(own, ["action_id", "holder_id"], "left").join(forced, "action_id", "left")
        .filter(~F.coalesce(F.col("rel") > F.col("at"), F.lit(False)) & ~F.coalesce(F.col("forced") > F.col("at"), F.lit(False)))
    )
    if as_of is not None:
        live = live.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp"))
    return decisions, live.select("action_id", "holder_id", "granted_at", "expires_at")
