"""Trie of conversation prefixes: a splitter skeleton over range-partitioned shards.

Every conversation is a path of turns; every distinct beginning is a node. Paths
are range-partitioned by (path, conv_id) between splitters. A node whose members
may lie in two shards is a beginning of a splitter's path: the trie of those
paths, the skeleton, is broadcast. Each shard sorts its own paths and finishes
every node outside the skeleton; for the skeleton's nodes it gives partial
aggregates, which a reduction combines. Since splitters hold conv_id too, copies
of one conversation are spread over as many shards as they need.

Only digests of turns move, never texts. Turns are numbered in blocks of BLOCK
turn numbers, and paths are cut into pieces of HOP turns. The pieces that follow
one beginning are a trie of their own under the digest of that beginning, with
one turn more than they emit, so that children are counted where their parent is;
what deeper pieces add to subtrees is carried up by conversation. So no row grows
with a conversation's length, no group with the number of its copies.

Null roles and texts are empty. Rows with a null conv_id belong to no
conversation. Rows of one turn (repeats included) follow by role, then by the
digest of role and text. Null turns come first. A conversation whose rebuilt path
has no turns is a member of the root alone. Extra columns are left behind; an
empty table has no nodes. Turns are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Bytes of a turn's digest, turns of one piece of a path, turn numbers that are counted together.
UNIT, HOP, BLOCK = 16, 64, 1024
#: Turns of one shard, and sampled paths for each splitter. The sample sets only the balance of shards.
SHARD_TURNS, OVERSAMPLE = 1 << 17, 16
#: Most turns that a conversation takes from another one.
MOST_GIVEN = 5

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = f"{NODE}, node binary, parent binary, shard int, ends string, chars long, piece long, own_leaf long, own_saved long"
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, block, inner, unit, chars): turns as digests, numbered from 1 within their block."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    unit = F.substring(F.unhex(F.sha2(said, 256)), 1, UNIT)
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**62)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), unit.alias("unit"), F.length(text).cast("long").alias("chars"), block.alias("block"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "unit")).cast("long")
    return cut(rows.select("conv_id", "block", inner.alias("inner"), "unit", "chars"))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, unit, chars): the first h turns of conversation c - c%100, then c's own after its first h; place counts from 1.

    h is crc32(c as text) % 6. Every conversation also has a row of place 0, without a turn.
    """
    numbered = numbered_turns(turns)
    order = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(numbered.groupBy("conv_id", "block").agg(F.count("*").alias("size")).select("conv_id", "block", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before")))
    asked = blocks.where("before = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_GIVEN + 1)).alias("h"))
    heads = numbered.where((F.col("conv_id") % 100 == 0) & (F.col("inner") <= MOST_GIVEN)).join(blocks.where(F.col("before") < MOST_GIVEN), ["conv_id", "block"])
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("before") + F.col("inner")).alias("place"), "unit", "chars")
    given = cut(asked.where("h > 0").join(heads, "base").where("place <= h").select("conv_id", "place", "unit", "chars"))
    taken = given.groupBy("conv_id").agg(F.max("place").alias("given"))
    moved = blocks.join(asked.select("conv_id", "h").join(taken, "conv_id", "left"), "conv_id").select("conv_id", "block", (F.col("before") - F.col("h")).alias("lead"), F.coalesce("given", F.lit(0)).alias("given"))
    own = numbered.join(moved, ["conv_id", "block"]).withColumn("past", F.col("inner") + F.col("lead")).where("past > 0").select("conv_id", (F.col("past") + F.col("given")).alias("place"), "unit", "chars")
    return given.unionByName(own).unionByName(asked.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("unit"), F.lit(None).cast("long").alias("chars")))


def pieces_of(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, piece, path, chars, size): pieces of HOP turns and the one that follows; path begins with the digest of all pieces before.

    A conversation that ends with a piece has an empty one after it, so that every member of a piece's last node is there again.
    """
    at = F.when(F.col("place") > 0, F.floor((F.col("place") - 1) / HOP)).otherwise(0).cast("long")
    ahead = (F.col("place") > 1) & ((F.col("place") - 1) % HOP == 0)
    turn = F.when(F.col("unit").isNotNull(), F.struct("place", "unit", "chars"))
    grouped = rebuilt.withColumn("piece", F.explode(F.when(ahead, F.array(at, at - 1)).otherwise(F.array(at)))).groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = grouped.select("conv_id", "piece", F.unhex(F.array_join(F.transform("turns.unit", F.hex), "")).alias("units"), F.col("turns.chars").alias("chars"), F.size("turns").alias("size"))
    ended = F.when(F.col("size") == HOP, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    here = F.col("after") == 0
    pieces = cut(
        whole.withColumn("after", F.explode(ended)).select(
            "conv_id", (F.col("piece") + F.col("after")).alias("piece"), F.when(here, F.col("units")).otherwise(F.lit(b"")).alias("units"), F.when(here, F.col("chars")).otherwise(F.array().cast("array<bigint>")).alias("chars"), F.when(here, F.col("size")).otherwise(0).alias("size")
        )
    )
    full = pieces.where(F.col("size") >= HOP).select("conv_id", "piece", F.sha2(F.substring("units", 1, HOP * UNIT), 256).alias("digest"))
    before = Window.partitionBy("conv_id").orderBy("piece")
    halves = [F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(k), "piece", "digest")).over(before)), 16, "0") for k in range(UNIT // 8)]
    prefix = full.select("conv_id", (F.col("piece") + 1).alias("piece"), F.unhex(F.concat(*halves)).alias("prefix"))
    first = pieces.where("piece = 0").withColumn("prefix", F.lit(bytes(UNIT)))
    later = pieces.where("piece > 0").join(prefix, ["conv_id", "piece"])
    return cut(first.unionByName(later).select("conv_id", "piece", F.concat("prefix", "units").alias("path"), "chars", "size"))


def choose_splitters(pieces: DataFrame) -> list[tuple[bytes, int]]:
    """Sorted (path, conv_id) that cut the pieces into shards of about SHARD_TURNS turns; at most one path of HOP + 2 digests a shard."""
    n, turns = pieces.agg(F.count("*"), F.coalesce(F.sum(F.col("size") + 1), F.lit(0))).first()
    shards = max(2 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / SHARD_TURNS))
    sample = pieces.select("path", "conv_id").sample(min(1.0, OVERSAMPLE * shards / max(n, 1)), seed=1).collect()
    keys = sorted((bytes(r.path), r.conv_id) for r in sample)
    return sorted({keys[len(keys) * k // shards] for k in range(1, shards)}) if keys else []


def skeleton_of(splitters: list[tuple[bytes, int]]) -> set[bytes]:
    """Every beginning of a splitter's path: the nodes that may have members on both sides of a splitter."""
    return {path[:k] for path, _ in splitters for k in range(UNIT, len(path) + 1, UNIT)}


def finish_shard(table: pa.Table, skeleton: set[bytes], shard: int) -> pa.Table:
    """The nodes of one shard: whole ones outside the skeleton, parts of those in it."""
    conv = table.column("conv_id").to_numpy()
    paths = table.column("path").to_pylist()
    order = sorted(range(len(paths)), key=lambda k: (paths[k], conv[k]))
    paths, conv = [paths[k] for k in order], conv[order]
    lengths = np.array([len(p) for p in paths]) // UNIT
    piece = table.column("piece").to_numpy()[order]
    said = table.column("chars").to_pylist()
    said = [said[k] for k in order]
    leaves, saved = (table.column(c).to_numpy()[order].copy() for c in ("leaves", "saved"))
    n, width = len(paths), int(lengths.max())
    units = np.frombuffer(b"".join(p.ljust(width * UNIT, b"\0") for p in paths), np.uint64).reshape(n, width, UNIT // 8)
    chars = np.zeros((n, width + 1), np.int64)
    for k, x in enumerate(said):
        chars[k, 1 : len(x) + 1] = x
    alike = (units[1:] == units[:-1]).all(2) & (np.arange(width) < np.minimum(lengths[1:], lengths[:-1])[:, None])
    common = np.concatenate([[0], np.where(alike.all(1), width, np.argmin(alike, 1))]) if n > 1 else np.zeros(1, int)
    shared = np.zeros(n, int)  # leading units of each path that are in the skeleton
    for k, p in enumerate(paths):
        if k and common[k] > shared[k - 1]:
            shared[k] = shared[k - 1]
            continue
        while shared[k] < lengths[k] and p[: (shared[k] + 1) * UNIT] in skeleton:
            shared[k] += 1
    levels, below, local_below = [], np.zeros(0, int), np.zeros(0, int)
    for t in range(width, 0, -1):
        cuts = np.flatnonzero(common < t)
        ends = np.append(cuts[1:], n)
        least = np.minimum.reduceat(conv, cuts)
        is_node = lengths[cuts] >= t
        start, end = cuts[is_node], ends[is_node]
        kids, local_kids = (np.searchsorted(x, end) - np.searchsorted(x, start) for x in (below, local_below))
        inside = shared[start] >= t
        given = (piece[start] == 0) if t == 1 else np.full(len(start), t <= HOP + 1)
        own_leaf = (given & ~inside & (kids == 0)).astype(np.int64)
        own_saved = np.where(given & ~inside, (end - start - 1) * chars[start, t - 1], 0)
        leaves[start] += own_leaf
        saved[start] += own_saved
        finished = np.searchsorted(cuts, start)
        sums = [np.add.reduceat(x, cuts)[finished] for x in (leaves, saved)]
        enders = np.add.reduceat((lengths == t).astype(int), cuts)[finished]
        levels.append((t, cuts, least, start, end, kids, local_kids, inside, given, own_leaf, own_saved, *sums, enders, least[finished]))
        below, local_below = start, start[~inside]
    out: dict[str, list] = {c.split()[0]: [] for c in PART.split(", ")}
    for at, (t, _, _, start, end, kids, local_kids, inside, given, own_leaf, own_saved, n_leaves, n_saved, enders, least) in enumerate(levels):
        # Nodes past a piece's end are there to be counted; those of the skeleton go on, because other shards count them too.
        for k in np.flatnonzero(given | inside):
            s, skeletal = start[k], bool(inside[k])
            names = ",".join(map(str, conv[s : s + enders[k]]))
            parent = parent_conv = None
            if t > 1 and shared[s] >= t - 1:
                parent = paths[s][: (t - 1) * UNIT]
            elif t > 1:
                _, cuts, least_above = levels[at + 1][:3]
                parent_conv = int(least_above[np.searchsorted(cuts, s, "right") - 1])
            row = (least[k], piece[s] * HOP + t - 1, parent_conv, end[k] - s, local_kids[k] if skeletal else kids[k], n_leaves[k], n_saved[k], None if skeletal else hashlib.sha256(names.encode()).hexdigest() if names else NOBODY)
            row += (paths[s][: t * UNIT] if skeletal else None, parent, shard, names if skeletal else None, chars[s, t - 1], piece[s], own_leaf[k], own_saved[k])
            for column, value in zip(out.values(), row):
                column.append(value)
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.table([pa.array(out[c], kinds[kind]) for c, kind in (x.split() for x in PART.split(", "))], list(out))


def joined_digests(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of chunks (node, shard, ends): SHA-256 of a node's chunks in the order of their shards, comma-joined, one chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    placed = chunks.where("ends <> ''").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")
    return map_batches(placed, run, "node binary, ends_sha256 string")


def combine_skeleton(parts: DataFrame) -> DataFrame:
    """The skeleton's nodes, whole, from the parts that shards gave: parts are summed by node, then every node adds its own share to its ancestors."""
    summed = parts.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("local_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.first("chars").alias("chars"), F.first("piece").alias("piece")
    )
    summed = cut(summed)
    kids = summed.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    past = F.col("depth") - F.col("piece") * HOP
    counted = summed.join(kids, "node", "left").withColumn("n_children", F.col("local_children") + F.coalesce("kids", F.lit(0))).withColumn("given", ((past > 0) & (past <= HOP)) | (F.col("depth") == 0))
    own = counted.withColumn("own_leaf", F.when(F.col("given") & (F.col("n_children") == 0), 1).otherwise(0).cast("long")).withColumn("own_saved", F.when(F.col("given"), (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).cast("long"))
    own = cut(own)
    ancestors = F.transform(F.sequence(F.lit(1), (F.octet_length("node") / UNIT).cast("int")), lambda k: F.substr("node", F.lit(1), k * UNIT))
    shares = own.where("own_leaf > 0 or own_saved > 0").select(F.explode(ancestors).alias("node"), "own_leaf", "own_saved").groupBy("node").agg(F.sum("own_leaf").alias("add_leaves"), F.sum("own_saved").alias("add_saved"))
    least = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = own.join(shares, "node", "left").join(joined_digests(parts), "node", "left").join(least, "parent", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("add_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("add_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"), "node", "piece", "given", "own_leaf", "own_saved",
    )


def build(pieces: DataFrame) -> DataFrame:
    """Every node below the pieces (conv_id, piece, path, chars, size, leaves, saved); leaves and saved are what a conversation's later pieces own."""
    splitters = choose_splitters(pieces)
    shipped = pieces.sparkSession.sparkContext.broadcast(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(2).to_pylist(), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(shipped.value, k) for k in keys], pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    kept = {}

    def finish(table: pa.Table) -> pa.Table:
        if "skeleton" not in kept:
            kept["skeleton"] = skeleton_of(shipped.value)
        return finish_shard(table, kept["skeleton"], table.column("shard")[0].as_py())

    columns = "conv_id long, piece long, path binary, chars array<bigint>, leaves long, saved long"
    rows = pieces.select("conv_id", "piece", "path", "chars", "leaves", "saved")
    parts = cut(map_batches(rows, deal, f"shard int, {columns}").groupBy("shard").applyInArrow(finish, PART))
    skeleton = cut(combine_skeleton(parts.where("node is not null")))
    # As many rows as the splitters' paths have turns, at most.
    above = F.broadcast(skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    local = parts.where("node is null")
    tops = local.where("parent is not null").join(above, "parent").withColumn("parent_conv_id", F.col("above"))
    names = [c.split()[0] for c in NODE.split(", ")] + ["piece", "own_leaf", "own_saved"]
    return local.where("parent is null").select(names).unionByName(tops.select(names)).unionByName(skeleton.where("given").select(names))


def carried(pieces: DataFrame) -> DataFrame:
    """pieces with leaves and saved: what the nodes of each conversation's later pieces add to the subtrees above them, counted at their smallest member."""
    none = F.lit(0).cast("long")
    later = pieces.where("piece > 0")
    if later.isEmpty():
        return pieces.withColumns({"leaves": none, "saved": none})
    owned = build(later.withColumns({"leaves": none, "saved": none})).groupBy("conv_id", "piece").agg(F.sum("own_leaf").alias("own_leaf"), F.sum("own_saved").alias("own_saved"))
    long = pieces.select("conv_id", "piece").join(later.select("conv_id").distinct(), "conv_id", "left_semi")
    after = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    sums = long.join(owned, ["conv_id", "piece"], "left").select("conv_id", "piece", F.sum("own_leaf").over(after).alias("leaves"), F.sum("own_saved").over(after).alias("saved"))
    return cut(pieces.join(sums, ["conv_id", "piece"], "left").na.fill(0, ["leaves", "saved"]))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations of turns (conv_id, turn, role, text).

    (conv_id: smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    nodes = build(carried(pieces_of(rebuilt_turns(turns))))
    return nodes.select([c.split()[0] for c in NODE.split(", ")])
