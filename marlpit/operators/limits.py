"""Rate limits and stage moves, which depend on the order of events."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered, shared_table

#: Rows of a range, which a task holds at once.
RANGE_ROWS = 200_000
# Hits an hour for an address on one form, an address, and a form.
TIERS = [("ip_form", ["subject", "form"], 5), ("ip", ["subject"], 20), ("form", ["form"], 200)]


def rate_limit_verdicts(hits: DataFrame, window_seconds: int = 3600, tiers: list = TIERS) -> DataFrame:
    """Hits (id, subject, form, ts) with rejected_by: the first tier whose bucket was full, or null.

    A rejected hit counts in the tier that rejected it and is not seen by later ones. A bucket is a fixed hour. Each
    tier is one running count; where it is not of one subject it is counted by minute first, so that a busy form's
    hour does not meet in one task.
    """
    open_hits = hits.withColumn("bucket", F.floor(F.unix_timestamp("ts") / window_seconds))
    out = None
    for name, keys, most in tiers:
        if "subject" in keys:
            ranked = open_hits.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("ts", "id")))
        else:
            minutes = open_hits.withColumn("minute ", F.floor(F.unix_timestamp("ts") / 60))
            ranked = numbered(minutes, [*keys, "bucket"], ["ts", "id"], "minute ").withColumnRenamed("n", "place").drop("minute ")
        full = ranked.where(F.col("place") > most).select(*hits.columns, F.lit(name).alias("rejected_by"))
        out = full if out is None else out.unionByName(full)
        open_hits = ranked.where(F.col("place") <= most).drop("place")
    return out.unionByName(open_hits.select(*hits.columns, F.lit(None).cast("string").alias("rejected_by")))


def sliding_log(times: list[float], most: int, window_s: float, log: deque[float] | None = None) -> list[tuple[bool, int, float]]:
    """(allowed, remaining, retry after) of each time; only allowed ones are logged. log: the times logged before, moved on."""
    log = deque() if log is None else log
    out = []
    for t in times:
        while log and log[0] <= t - window_s:
            log.popleft()
        allowed = len(log) < most
        if allowed:
            log.append(t)
        out.append((allowed, most - len(log), 0.0 if allowed else log[0] + window_s - t))
    return out


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with `key ` and `range `, written: ranges of rows sorted by key and order, of about equal size; a large key goes over many.

    A range is held whole by a task, so without `ranges` there are as many as give each about RANGE_ROWS.
    """
    keyed = rows.withColumn("key ", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    ranges = ranges or max(1, -(-rows.count() // RANGE_ROWS))
    return shared_table(keyed.repartitionByRange(ranges, "key ", *order).withColumn("range ", F.spark_partition_id()))


def by_key(group: pd.DataFrame, order: list[str]) -> Iterator[tuple[str, pd.DataFrame]]:
    """The keys of one range and their rows, in the order of in_ranges."""
    group = group.sort_values(["key ", *order], na_position="first", kind="stable")
    names = group["key "].to_numpy()
    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
    for first, last in zip(cuts, cuts[1:]):
        yield names[first], group.iloc[first:last]


def limited(hits: DataFrame, keys: list[str], most: int, window_s: float, ranges: int | None = None) -> DataFrame:
    """hits (id, ts, keys) with allowed, remaining and retry_after of a sliding log for each key, in the order of ts, then id.

    Rows lie in ranges sorted by key and time, so that no key is one task's work. Ranges are replayed at once, each
    as if the log were empty where it begins; then the log that a range leaves, at most `most` times, goes to the
    next one of its key, and those ranges whose beginning it changes are replayed again, until none is. Where a
    key pauses for a window, or is not limited for two, nothing of the start is left, so two rounds are usual; a
    key that is over its limit without a pause takes a round for each of its ranges. Hits without a time are
    allowed and don't count; null keys are a key.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(float("-inf")))
    placed = in_ranges(hits.select("id", *keys, at.alias("at")), keys, ["at", "id"], ranges)
    carried: dict[int, list[float]] = {}

    def leaves(only: list[int] | None) -> dict[int, tuple]:
        known = dict(carried)

        def run(group: pd.DataFrame) -> pd.DataFrame:
            place, first = int(group["range "].iloc[0]), None
            for key, rows in by_key(group, ["at", "id"]):
                times = rows["at"].tolist()
                log = deque(known.get(place, ()) if first is None else ())
                first = first or (key, times[0])
                sliding_log(times, most, window_s, log)
            return pd.DataFrame([(place, first[0], first[1], key, [*log])], columns=["range", "first", "begin", "last", "log"])

        # One row a range.
        some = placed if only is None else placed.where(F.col("range ").isin(only))
        found = some.groupBy("range ").applyInPandas(run, "range int, first string, begin double, last string, log array<double>").collect()
        return {r.range: (r.first, r.begin, r.last, list(r.log)) for r in found}

    left = leaves(None)
    while True:
        again = []
        for before, place in zip(sorted(left), sorted(left)[1:]):
            first, begin, last, _ = left[place]
            given = [t for t in left[before][3] if t > begin - window_s] if left[before][2] == first else []
            if given != carried.get(place, []):
                carried[place] = given
                # Only a range of one key passes on what it was given.
                again += [place] if first == last else []
        if not again:
            break
        left |= leaves(again)
    known = dict(carried)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        place, parts, log = int(group["range "].iloc[0]), [], None
        for _, rows in by_key(group, ["at", "id"]):
            log = deque(known.get(place, ()) if log is None else ())
            allowed, remaining, wait = zip(*sliding_log(rows["at"].tolist(), most, window_s, log))
            parts.append(rows[["id", *keys]].assign(allowed=allowed, remaining=remaining, retry_after=wait))
        return pd.concat(parts)

    kinds = ", ".join(f"`{k}` {hits.schema[k].dataType.simpleString()}" for k in ["id", *keys])
    return placed.groupBy("range ").applyInPandas(judge, f"{kinds}, allowed boolean, remaining long, retry_after double")


def burst_verdicts(hits: DataFrame, most: int = 5, window_s: float = 10.0, keys: tuple[str, ...] = ("subject", "form"), ranges: int | None = None) -> DataFrame:
    """(id, allowed) by a sliding log for each key; rejected hits are not logged."""
    return limited(hits, [*keys], most, window_s, ranges).select("id", "allowed")


def attempt_limits(attempts: DataFrame, most: int, window_s: float, key: str = "subject", ranges: int | None = None) -> DataFrame:
    """As W7, with what remains and the seconds to wait."""
    return limited(attempts, [key], most, window_s, ranges).select("id", "allowed", "remaining", "retry_after")


def stage_path(moves: DataFrame) -> DataFrame:
    """W9 without expectations: moves (deal, stage, ts, id) with the stage before; moves to the same stage are dropped."""
    order = Window.partitionBy("deal").orderBy("ts", "id")
    return moves.withColumn("previous", F.lag("stage").over(order)).where("previous is null or previous <> stage")


def compose(moves: Iterable[tuple[str, str | None]]) -> tuple[dict[str, str], str | None]:
    """What moves (target, expected) do to any stage, as a table and a constant: a stage in the table ends there, another stays, unless the constant says where all end.

    A move that expects nothing ends the table: whatever the stage was, it is the target then. Until then only stages that some move expects can change.
    """
    ends: dict[str, str] = {}
    moves = iter(moves)
    for target, expected in moves:
        if expected is None:
            at = target
            for to, asked in moves:
                at = to if asked is None or asked == at else at
            return {}, at
        ends.setdefault(expected, expected)
        ends = {start: target if at == expected else at for start, at in ends.items()}
    return ends, None


def apply_stage_moves(deals: DataFrame, moves: DataFrame, terminal: dict[str, str], ranges: int | None = None) -> DataFrame:
    """(deal, move_id, result, stage, closed): each move of deals (deal, stage) in order; a move whose expected stage is stale is rejected, one to the same stage is a no-op.

    Moves lie in ranges sorted by deal and time, so that no deal is one task's work. A range tells what its moves do
    to any stage that its first deal may come with (compose); these are composed in the order of the ranges, a row
    a range; then every range is replayed from the stage it begins with.
    """
    order = ["ts", "move_id"]
    placed = in_ranges(moves.join(deals.select("deal", "stage"), "deal").select("deal", "stage", "move_id", "to_stage", "expected_stage", "ts"), ["deal"], order, ranges)
    pairs = lambda rows: ((t, e if isinstance(e, str) else None) for t, e in zip(rows["to_stage"], rows["expected_stage"]))

    def effect(group: pd.DataFrame) -> pd.DataFrame:
        first = last = None
        for key, rows in by_key(group, order):
            ends, at = compose(pairs(rows))
            first, last = first or (key, rows["stage"].iloc[0], ends, at), (key, at if at is not None else ends.get(rows["stage"].iloc[0], rows["stage"].iloc[0]))
        return pd.DataFrame([(int(group["range "].iloc[0]), *first[:2], json.dumps(first[2]), first[3], *last)], columns=["range", "first", "stage", "ends", "constant", "last", "leaves"])

    told = placed.groupBy("range ").applyInPandas(effect, "range int, first string, stage string, ends string, constant string, last string, leaves string").collect()
    begins, before = {}, None
    for r in sorted(told, key=lambda r: r.range):
        at = before[1] if before and before[0] == r.first else r.stage
        begins[r.range] = at
        # Where the first deal is the last as well, the range leaves what it makes of the stage it was given.
        before = (r.last, (r.constant if r.constant is not None else json.loads(r.ends).get(at, at)) if r.first == r.last else r.leaves)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, stage = [], None
        for _, rows in by_key(group, order):
            stage = begins[int(group["range "].iloc[0])] if stage is None else rows["stage"].iloc[0]
            for deal, move, (target, expected) in zip(rows["deal"], rows["move_id"], pairs(rows)):
                if expected is not None and expected != stage:
                    result = "rejected"
                elif target == stage:
                    result = "no_op"
                else:
                    stage, result = target, terminal.get(target, "stage_changed")
                out.append((deal, move, result, stage, stage in terminal))
        return pd.DataFrame(out, columns=["deal", "move_id", "result", "stage", "closed"])

    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in ("deal", "move_id"))
    return placed.groupBy("range ").applyInPandas(run, f"{kinds}, result string, stage string, closed boolean")
