"""Removal of repeated byte strings with sharded suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere
else, in the same text or another; all is judged on the input.

Which strings can meet is settled first. Every LENGTH-byte window names one of
its GRAM-byte substrings, the leftmost of least hash, so equal windows name equal
substrings (anchors) at equal places. An anchor that occurs once drops out.
Occurrences with the same surroundings, all that such windows can cover, are
repeated as a whole: that settles the inside of long passages. Where an anchor has
several surroundings, one occurrence of each goes on.

Its windows lie at most LENGTH - GRAM bytes before the anchor. They are taken in
ranges of WIDTH places. All windows of a range share a core around the anchor, so
only occurrences with the same core can meet, and the core becomes one symbol
between the few bytes before and after it. Shards are runs of whole groups of a
core: their strings form one text whose suffix array is built by induced sorting,
and permuted common prefixes of WIDTH symbols mark the windows that occur twice.

Exact copies are one text with a count: if it is long enough, all of it goes. A
batch sends an anchor with the same surroundings once however often it has it,
and a group of more than `hot` members counts its windows one by one in a grouped
aggregation, so no group has to meet in one place.

Null and empty texts remove nothing. Texts may have up to a gigabyte less one byte,
longer ones raise an error; memory follows the longest. Repeated rows are copies of each other. Extra columns are not
carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_text, map_batches
from .suffix_array import common_prefixes, suffix_array
from .textkernel import BYTE_VALUE, mix, powers, steps

LENGTH, GRAM = 200, 48
#: Places of a window before its anchor that are looked at together.
WIDTH = 17
#: Members of a group that a shard takes; members of a shard.
HOT, SHARD = 50_000, 20_000
POSITION_BITS = 30
#: Kinds of places: repeated as a whole; the only occurrence with its surroundings; the first of several with the same.
WHOLE, ALONE, SHOWN, TEXT = 0, 1, 2, 3
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_INVERSE_POWERS = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _INVERSE_POWERS
    while len(_INVERSE_POWERS) < n:
        _INVERSE_POWERS = np.concatenate([_INVERSE_POWERS, _INVERSE_POWERS * _INVERSE_POWERS[-1] * INVERSE])
    return _INVERSE_POWERS


class Hasher:
    """64-bit hashes of any substrings of some bytes, from sums of byte values times powers."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[raw] * powers(len(raw))[: len(raw)], dtype=np.uint64)])
        self.inverse = inverse_powers(len(raw) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    level, width = values, 1
    while 2 * width <= size:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    rest = size - width
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, hash of the surroundings) of the substrings that the windows of each text name."""
    none, nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < length:
        return none, none, nothing, nothing
    if len(raw) >> POSITION_BITS:
        raise ValueError(f"texts of {len(raw)} bytes at once: places have {POSITION_BITS} bits")
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    hasher, every = Hasher(raw), np.arange(len(raw) - GRAM + 1)
    hashes = hasher.of(every, every + GRAM)
    keyed = (hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | every.astype(np.uint64)
    named = sliding_min(keyed, length - GRAM + 1) & np.uint64((1 << POSITION_BITS) - 1)
    whole = np.zeros(len(named) + 1, np.int64)
    # Windows that lie inside one text begin before its last `length` bytes.
    long = ends - begins >= length
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - length + 1, -1)
    at = named[np.cumsum(whole[:-1]) > 0].astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    text = np.searchsorted(ends, at, side="right")
    start, stop = np.maximum(begins[text], at - (length - GRAM)), np.minimum(ends[text], at + length)
    return text, at - begins[text], hashes[at], mix(hasher.of(start, stop) + (at - start).astype(np.uint64))


def find_places(texts: DataFrame, length: int) -> DataFrame:
    """(kind, row, at, anchor, key) of texts (key, text): TEXT rows tie a row to its key, all others are places that are repeated or may be in part."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        names = ["deal", "anchor", "around", "kind", "row", "at", "key"]
        for batch in batches:
            for first, parts in steps(batch):
                rows = np.arange(row, row + len(parts))
                row += len(parts)
                text, at, anchor, around = anchors(parts, length)
                _, one, which, many = np.unique(np.stack([anchor, around]), axis=1, return_index=True, return_inverse=True, return_counts=True)
                which = which.ravel()
                # Of several with the same surroundings the first stands for all, and all are repeated.
                again = many[which] > 1
                sent = np.zeros(len(at), bool)
                sent[one] = True
                kind = np.where(again & sent, SHOWN, ALONE)[sent].astype(np.int8)
                # Between two that are near each other all is repeated: the first and the last of every GRAM bytes will do.
                twins = np.flatnonzero(again)
                bucket = text[twins] << 32 | at[twins] // GRAM
                edge = np.diff(bucket, prepend=-1) != 0
                again = np.zeros(len(at), bool)
                again[twins[edge | np.append(edge[1:], True)[: len(edge)]]] = True
                deal = [anchor[sent], mix(anchor[again] + rows[text[again]].astype(np.uint64)), mix(rows.astype(np.uint64))]
                none = [np.zeros(int(again.sum()), np.uint64), np.zeros(len(parts), np.uint64)]
                columns = [
                    np.concatenate(deal).view(np.int64),
                    np.concatenate([anchor[sent], *none]).view(np.int64),
                    np.concatenate([around[sent], *none]).view(np.int64),
                    np.concatenate([kind, np.full(int(again.sum()), WHOLE, np.int8), np.full(len(parts), TEXT, np.int8)]),
                    np.concatenate([rows[text[sent]], rows[text[again]], rows]),
                    np.concatenate([at[sent], at[again], np.zeros(len(parts), np.int64)]).astype(np.int32),
                ]
                keys = pa.concat_arrays([pa.nulls(len(columns[0]) - len(parts), pa.binary()), batch.column(0).slice(first, len(parts)).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), keys], names)

    schema = "deal long, anchor long, around long, kind byte, row long, at int, key binary"
    dealt = map_batches(texts.select("key", "text"), find, schema).repartition("deal").sortWithinPartitions("anchor", "around", "row", "at")
    return cut(map_batches(dealt.select("anchor", "around", "kind", "row", "at", "key"), judged, "kind byte, row long, at int, anchor long, key binary"))


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the order of anchor and surroundings, a class being those that have both in common. The last class of a batch waits for the next batch."""
    held, before = None, None

    def judge(rows: list[np.ndarray], after: int | None) -> pa.RecordBatch:
        """Whole classes; before and after are the anchors next to them."""
        anchor, around, kind, row, at = rows
        new_anchor = np.diff(anchor, prepend=anchor[:1] - 1) != 0
        new_class = new_anchor | (np.diff(around, prepend=around[:1]) != 0)
        new_class[:1] = new_anchor[:1] = True
        of_class, of_anchor = np.cumsum(new_class) - 1, np.cumsum(new_anchor) - 1
        again = (np.bincount(of_class) > 1) | (np.bincount(of_class, kind == SHOWN) > 0)
        several = np.bincount(of_anchor[new_class]) > 1
        several[0] |= before == anchor[0]
        several[-1] |= after == anchor[-1]
        # A place that stands for others of its batch was sent as repeated already.
        whole, shown = again[of_class] & (kind != SHOWN), new_class & several[of_anchor]
        kinds = np.concatenate([np.full(int(whole.sum()), WHOLE), np.where(again[of_class], SHOWN, ALONE)[shown]]).astype(np.int8)
        return places(kinds, *(np.concatenate([x[whole], x[shown]]) for x in (row, at, anchor)), None)

    def places(kind: np.ndarray, row: np.ndarray, at: np.ndarray, anchor: np.ndarray, key: pa.Array | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (kind, row, at, anchor)), pa.nulls(len(kind), pa.binary()) if key is None else key], ["kind", "row", "at", "anchor", "key"])

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(5)]
        settled = (columns[2] == WHOLE) | (columns[2] == TEXT)
        if settled.any():
            kind, row, at, anchor = (columns[k][settled] for k in (2, 3, 4, 0))
            yield places(kind, row, at, anchor, batch.column(5).filter(pa.array(settled)).cast(pa.binary()))
        columns = [x[~settled] for x in columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([h, x]) for h, x in zip(held, columns)]
        anchor, around = columns[:2]
        first = np.flatnonzero((anchor != anchor[-1]) | (around != around[-1]))
        cut_at = int(first[-1]) + 1 if len(first) else 0
        if cut_at:
            yield judge([x[:cut_at] for x in columns], anchor[-1])
            before = anchor[cut_at - 1]
        held = [x[cut_at:] for x in columns]
        if len(held[0]) > 2:
            # All of one class: those but the first are repeated, and the first stands for all.
            known = held[2] != SHOWN
            yield places(np.full(int(known.sum()), WHOLE, np.int8), *(x[known] for x in (held[3], held[4], held[0])), None)
            held = [x[:1] for x in held]
            held[2] = np.array([SHOWN], np.int8)
    if held is not None:
        yield judge(held, None)


def named_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, text, places array<struct<kind, at, anchor>>) of the texts that have any, once for each key. Of exact copies only the places that others are compared with count."""
    rows = found.where(F.col("kind") == TEXT).select("row", "key")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    one = rows.join(copies, "key").select("row", "key", (F.col("copies") > 1).alias("copied"))
    place = F.struct(F.when(F.col("copied"), SHOWN).otherwise(F.col("kind")).cast("byte").alias("kind"), "at", "anchor")
    asked = found.where(F.col("kind") != TEXT).drop("key").join(one, "row").where((F.col("kind") != WHOLE) | ~F.col("copied"))
    by_key = asked.groupBy("key").agg(F.collect_set(place).alias("places"))
    return cut(texts.select("key", "text").dropDuplicates(["key"]).join(by_key, "key"))


MEMBERS = "deal long, anchor long, core long, around long, key binary, at int, reach int, low int, left int, alone boolean, extra binary"


def range_members(named: DataFrame, length: int) -> DataFrame:
    """MEMBERS of every range of windows that each compared place can have.

    core is a hash of the bytes that all windows of the range share, around of all that they cover; extra holds
    what is covered before the core (left bytes) and after it. low is the first place of a window before the anchor, reach the last.
    """
    lows = np.arange(0, length - GRAM + 1, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, parts in steps(batch):
                ends = np.cumsum([len(t) for t in parts])
                listed = batch.column(2).slice(first, len(parts))
                offsets = listed.offsets.to_numpy()
                kind, at, anchor = (listed.values.field(k).to_numpy()[offsets[0] : offsets[-1]] for k in range(3))
                text = np.repeat(np.arange(len(parts)), np.diff(offsets))
                asked = np.flatnonzero(kind != WHOLE)
                if not asked.size:
                    continue
                text, place, alone, anchor = text[asked], at[asked].astype(np.int64), kind[asked] == ALONE, anchor[asked]
                begins = ends[text] - np.array([len(t) for t in parts])[text]
                raw = np.frombuffer(b"".join(parts), np.uint8)
                hasher, here, after = Hasher(raw), begins + place, ends[text] - begins - place
                for low in lows.tolist():
                    high = min(low + WIDTH - 1, length - GRAM)
                    least, most = np.maximum(low, length - after), np.minimum(high, place)
                    ok = np.flatnonzero((most >= low) & (least <= high) & (least <= most))
                    a, lo, hi = here[ok], least[ok], most[ok]
                    core = mix(hasher.of(a - low, a + length - high) + np.uint64(low))
                    start, stop = a - hi, a + length - lo
                    around = mix(hasher.of(start, stop) + (hi - low).astype(np.uint64))
                    left, right = hi - low, high - lo
                    size = left + right
                    upto = np.cumsum(size)
                    inner = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size)
                    from_left = inner < np.repeat(left, size)
                    bytes_at = np.where(from_left, np.repeat(start, size) + inner, np.repeat(a + length - high - left, size) + inner)
                    extra = pa.Array.from_buffers(pa.binary(), len(ok), [None, pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32).tobytes()), pa.py_buffer(raw[bytes_at].tobytes())])
                    deal = mix(anchor[ok].view(np.uint64) ^ core)
                    numbers = [deal.view(np.int64), anchor[ok], core.view(np.int64), around.view(np.int64)]
                    small = [place[ok].astype(np.int32), hi.astype(np.int32), np.full(len(ok), low, np.int32), left.astype(np.int32)]
                    keys = batch.column(0).slice(first, len(parts)).take(pa.array(text[ok])).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), keys, *map(pa.array, small), pa.array(alone[ok]), extra], [c.split()[0] for c in MEMBERS.split(", ")])

    return map_batches(named, run, MEMBERS)


class Shard:
    """Members in the order of their groups (anchor and core); equal members, which have the same around, count as repeated."""

    def __init__(self, rows: pa.RecordBatch, length: int):
        self.rows, self.length = rows, length
        anchor, core, around = (rows.column(k).to_numpy() for k in (1, 2, 3))
        new = lambda *xs: np.any([np.diff(x, prepend=x[:1]) != 0 for x in xs], axis=0) | (np.arange(len(anchor)) == 0)
        self.group = np.cumsum(new(anchor, core)) - 1
        fresh = new(anchor, core, around)
        self.of_class = np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)
        self.alone = rows.column(9).to_numpy(zero_copy_only=False)
        extra = rows.column(10).to_pylist()
        self.extra = np.frombuffer(b"".join(extra), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in extra])]).astype(np.int64)

    def compared(self) -> np.ndarray:
        """One member of each class in the groups that have several classes, one of which is alone."""
        group = self.group[self.first]
        many = np.bincount(group) > 1
        return self.first[many[group]]

    def spans(self) -> pa.RecordBatch:
        """(key, start, stop) of what is repeated of members that are alone."""
        at, high, low, left = (self.rows.column(k).to_numpy() for k in (5, 6, 7, 8))
        right = np.diff(self.offsets) - left
        width = np.minimum(low + WIDTH - 1, self.length - GRAM) - low
        # A class of several members is repeated as a whole.
        least, most = np.full(len(at), -1), np.full(len(at), -1)
        twice = np.bincount(self.of_class)[self.of_class] > 1
        least[twice], most[twice] = (low + width - right)[twice], high[twice]
        chosen = self.compared()
        for w in np.unique(width[chosen]):
            own = chosen[width[chosen] == w]
            member, nearest, furthest = self.repeated(own, int(w), left)
            fresh = ~twice[member]
            least[member[fresh]], most[member[fresh]] = nearest[fresh], furthest[fresh]
        hit = np.flatnonzero((most >= 0) & self.alone)
        start, stop = at[hit] - most[hit], at[hit] - least[hit] + self.length
        return pa.RecordBatch.from_arrays([self.rows.column(4).take(pa.array(hit)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["key", "start", "stop"])

    def repeated(self, chosen: np.ndarray, width: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, nearest and furthest place before the anchor) of the windows that another member has, from one suffix array of all chosen."""
        begin, size, before = self.offsets[chosen], np.diff(self.offsets)[chosen], left[chosen].astype(np.int64)
        # 0 ends a member, bytes come after it, then a symbol for each core.
        names = np.cumsum(np.diff(self.group[chosen], prepend=-1) != 0) + 256
        whole = size + 2
        ends = np.cumsum(whole)
        within = np.arange(ends[-1]) - np.repeat(ends - whole, whole)
        member = np.repeat(np.arange(len(chosen)), whole)
        core = within == before[member]
        closing = within == whole[member] - 1
        text = np.zeros(ends[-1], np.int64)
        text[core] = names
        source = np.flatnonzero(~core & ~closing)
        text[source] = self.extra[begin[member[source]] + within[source] - (within[source] > before[member[source]])].astype(np.int64) + 1
        order = suffix_array(text)
        remaining = whole[member] - 1 - within
        prefix = common_prefixes(text, order, remaining)
        run = np.cumsum(prefix < width + 1)
        fits = (remaining[order] > width) & (within[order] <= before[member[order]])
        found, run = order[fits], run[fits]
        many = np.bincount(run)[run] > 1
        found = found[many]
        owner, place = member[found], before[member[found]] - within[found]
        sort = np.lexsort((place, owner))
        owner, place = owner[sort], place[sort]
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(edge[1:], len(owner)) - 1
        low = self.rows.column(7).to_numpy()[chosen[owner[edge]]] if len(edge) else np.zeros(0, np.int64)
        return chosen[owner[edge]] if len(edge) else np.zeros(0, np.int64), low + (place[edge] if len(edge) else 0), low + (place[last] if len(edge) else 0)

    def windows(self) -> pa.RecordBatch:
        """(anchor, core, window, key, at, place, alone): every window of every member by a hash of what it has besides the core."""
        low, high, left = (self.rows.column(k).to_numpy().astype(np.int64) for k in (7, 6, 8))
        hasher, right = Hasher(self.extra), np.diff(self.offsets) - left
        width = np.minimum(low + WIDTH - 1, self.length - GRAM) - low
        out: list[list[np.ndarray]] = [[], [], []]
        for k in range(WIDTH):
            # A window of place low + k has k bytes before the core and width - k after it.
            ok = np.flatnonzero((k <= left) & (width - k <= right) & (k <= width))
            middle = self.offsets[ok] + left[ok]
            out[0].append(ok)
            out[1].append(mix(hasher.of(middle - k, middle) + mix(hasher.of(middle, middle + width[ok] - k) + np.uint64(k))))
            out[2].append(low[ok] + k)
        ok, window, place = map(np.concatenate, out)
        taken = [self.rows.column(k).take(pa.array(ok)) for k in (1, 2, 4, 5, 9)]
        return pa.RecordBatch.from_arrays([taken[0], taken[1], pa.array(window.view(np.int64)), taken[2], taken[3], pa.array(place.astype(np.int32)), taken[4]], ["anchor", "core", "window", "key", "at", "place", "alone"])


FOUND = "key binary, start int, stop int, anchor long, core long, window long, at int, place int, alone boolean"


def shard_spans(members: DataFrame, length: int, hot: int, shard: int) -> DataFrame:
    """(key, start, stop) of repeated parts: from the suffix array of each shard, and by counting the windows of groups of more than `hot` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, overfull = 0, None

        def rows_of(found: pa.RecordBatch) -> pa.RecordBatch:
            own = {n: found.column(k) for k, n in enumerate(found.schema.names)}
            schema = pa.schema([("key", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("anchor", pa.int64()), ("core", pa.int64()), ("window", pa.int64()), ("at", pa.int32()), ("place", pa.int32()), ("alone", pa.bool_())])
            return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(found.num_rows, f.type) for f in schema], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < shard:
                continue
            rows = pa.concat_batches(held)
            anchor, core = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            if overfull is not None:
                own = (anchor == overfull[0]) & (core == overfull[1])
                upto = int(own.sum())
                if upto:
                    yield rows_of(Shard(rows.slice(0, upto), length).windows())
                    rows, anchor, core = rows.slice(upto), anchor[upto:], core[upto:]
                if not rows.num_rows:
                    held, size = [], 0
                    continue
                overfull = None
            others = np.flatnonzero((anchor != anchor[-1]) | (core != core[-1]))
            cut_at = int(others[-1]) + 1 if len(others) else 0
            if cut_at:
                yield rows_of(Shard(rows.slice(0, cut_at), length).spans())
                rows = rows.slice(cut_at)
            if rows.num_rows > hot:
                overfull = (anchor[-1], core[-1])
                yield rows_of(Shard(rows, length).windows())
                rows = rows.slice(rows.num_rows)
            held, size = ([rows], rows.num_rows) if rows.num_rows else ([], 0)
        if held:
            rows = pa.concat_batches(held)
            if overfull is not None:
                own = (rows.column(1).to_numpy() == overfull[0]) & (rows.column(2).to_numpy() == overfull[1])
                upto = int(own.sum())
                if upto:
                    yield rows_of(Shard(rows.slice(0, upto), length).windows())
                rows = rows.slice(upto)
            if rows.num_rows:
                yield rows_of(Shard(rows, length).spans())

    dealt = members.repartition("deal").sortWithinPartitions("anchor", "core", "around")
    found = cut(map_batches(dealt, run, FOUND))
    same = ["anchor", "core", "window"]
    windows = found.where("place is not null")
    many = windows.groupBy(*same).agg(F.count("*").alias("many")).where("many > 1").drop("many")
    counted = windows.where("alone").join(many, same, "left_semi").select("key", (F.col("at") - F.col("place")).alias("start"), (F.col("at") - F.col("place") + length).alias("stop"))
    return found.where("place is null").select("key", "start", "stop").unionByName(counted)


def remove_spans(texts: DataFrame, length: int) -> DataFrame:
    """(key, n_removed, n_spans, kept) of (key, text, places, spans); spans may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, many, kept = [], [], []
            for text, places, spans in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw, at, parts, runs, last = text.encode(), 0, [], 0, -1
                whole = [(max(0, p["at"] - (length - GRAM)), min(len(raw), p["at"] + length)) for p in places if p["kind"] == WHOLE]
                for start, stop in sorted(whole + [(s["start"], s["stop"]) for s in spans or []]):
                    runs += start > last
                    if start > at:
                        parts.append(raw[at:start])
                    at, last = max(at, stop), max(last, stop)
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                removed.append(len(raw) - len(kept[-1]))
                many.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept"])

    return map_batches(texts, run, "key binary, n_removed long, n_spans long, kept binary")


def text_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): a text's identity is half its SHA-256."""
    texts = keyed_text(docs)
    return texts.select("doc_id", F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("key"), "text")


def repeated_parts(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(texts (doc_id, key, text), parts (key, n_removed, n_spans, kept)): parts holds the texts that lose bytes and are not exact copies."""
    texts = text_keys(docs)
    named = named_texts(texts, find_places(texts, length))
    spans = shard_spans(range_members(named, length), length, hot, shard)
    gathered = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return texts, remove_spans(named.join(gathered, "key", "left"), length)


def removal_report(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    texts, parts = repeated_parts(docs, length, hot, shard)
    lost = parts.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    size = F.octet_length("text").cast("long")
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))
    judged_keys = copies.where("copies > 1").join(lost, "key", "full")
    rows = texts.select("doc_id", "key", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")).join(judged_keys, "key", "left")
    gone = F.coalesce(F.col("copies") > 1, F.lit(False)) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
