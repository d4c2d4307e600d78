"""Hard negatives by best-first search of cover trees over norm-augmented vectors.

An inner product is a distance once every candidate x has one more component,
sqrt(M^2 - |x|^2), M the largest norm: all candidates then have norm M, a query q
gets 0, and 2<q, x> = |q|^2 + M^2 - distance^2. So a tree node's centre and
covering radius bound the scores of all rows below it, from both sides.

- Cells, the upper level, are centres that a farthest-first walk takes from at
  most SAMPLE rows (this bound is documented, and sets only the balance of cells);
  every row goes to its nearest centre, and a cell's covering radius is that of
  all its rows. Cells with more than SHARD_ROWS rows are split.
- Each shard has a cover tree of its own: at every level a net of separated
  centres, radii shrinking by BASE, whose nodes keep the radius they really
  cover. Shards are rows of a written table.
- Anchors go in blocks of neighbours to the shards whose cells their windows
  reach: first to the cell each lies in, which raises the least score that still
  matters, then to the others. In a shard, levels drop the nodes that lie outside
  an anchor's windows, and the leaves left are taken from the highest bound down,
  STEP at a time, until no bound reaches the scores found. Leaves are scored
  exactly.

Every bound holds for all rows, so results are those of a comparison with every
row. Rows of one label and one vector score alike everywhere, and ties go to the
smaller vec_id, so none but the first MOST + 1 of such a group can be returned;
the others are anchors at most, which spreads any number of copies.

Rows with a null label or vector, or with a null or non-finite component, take no
part. Repeated rows (same id, label and vector) count once; rows that share an id
otherwise are different rows. A null vec_id (2^63-1 counts as one) is never an
anchor and comes last among ties. Shorter vectors lack only zeros. Scores are
exact; they must fit in 64 bits. Anchors without another row of their label, and
positives with a negative score, have no rows. Empty tables give none; extra
columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Positives of an anchor and negatives of a positive.
MOST = 5
#: Rows of a shard, anchors of a block, sampled rows and centres at most.
SHARD_ROWS, BLOCK_ANCHORS, SAMPLE, MOST_CELLS = 2048, 1024, 16_384, 4096
#: What radii shrink by from level to level, rows of a leaf that needs no further level, leaves taken at once.
BASE, LEAF_ROWS, STEP = 1.3, 32, 8
#: Scores up to this are exact as doubles.
EXACT = 2**53
NO_ID = 2**63 - 1

ASSIGNED = "vec_id long, label long, vector binary, cell int, distance double"
INDEX = "cell int, salt int, ids binary, labels binary, vectors binary, nodes binary"
PACKED = ["anchor", "ids", "labels", "vectors", "of", "lo", "hi", "window"]
FOUND = "anchor long, window int, vec_id long, score long"
#: Of a tree's nodes, level by level: rows [first, last) below it, its centre's row, its radius, its parent's place in the level above.
NODES = np.dtype([("level", "<i4"), ("first", "<i4"), ("last", "<i4"), ("centre", "<i4"), ("parent", "<i4"), ("radius", "<f8")])


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, quantised and distinct."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), moved.alias("label"), whole.alias("vector"))
    return cut(rows.distinct())


def without_copies(rows: DataFrame) -> DataFrame:
    """rows without the copies that can't be returned; Spark drops them before it shuffles."""
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= MOST + 1).drop("place")


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """Rows of squared norm `most`, each with one more component."""
    return np.column_stack([vectors, np.sqrt(np.maximum(0.0, most - (vectors**2).sum(1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Places of up to n points, each the farthest from those before it; none is repeated."""
    chosen, away = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): rows in the order of the tree's leaves, and its nodes (NODES), level by level from the root.

    A level's centres stay centres below, are more than the level's radius apart, and every point is within that radius of one.
    It ends where nodes are small, or where more than half of the points would be centres.
    """
    n, away = len(points), distances(points, points)
    centres = [0]
    owners = [np.zeros(n, int)]  # of each level: the place of every point's centre
    parents, chosen = [np.array([-1])], [np.array([0])]
    near, owner = away[0].copy(), np.zeros(n, int)
    while np.bincount(owner).max() > LEAF_ROWS and near.max() > 0:
        # Points are closer than the radius already, often much.
        radius = near.max() / BASE
        more, above = centres.copy(), owner.copy()
        wider, held = near.copy(), owner.copy()
        while (far := int(wider.argmax()), wider[far])[1] > radius and len(more) <= n // 2:
            closer = away[far] < wider
            wider[closer], held[closer] = away[far][closer], len(more)
            more.append(far)
        if len(more) > n // 2:
            break
        up = np.concatenate([np.arange(len(centres)), above[more[len(centres) :]]])
        centres, near, owner = more, wider, held
        owners.append(held), parents.append(up), chosen.append(np.array(more))
    # A point's ancestors are those of its lowest centre.
    path = [owner]
    for up in parents[:0:-1]:
        path.append(up[path[-1]])
    path = path[::-1]
    order = np.lexsort(path[::-1])
    nodes = []
    for level, (own, up, rows) in enumerate(zip(path, parents, chosen)):
        sorted_own = own[order]
        cuts = np.flatnonzero(np.r_[True, sorted_own[1:] != sorted_own[:-1]])
        which = sorted_own[cuts]
        made = np.zeros(len(cuts), NODES)
        made["level"], made["first"], made["last"], made["parent"] = level, cuts, np.append(cuts[1:], n), up[which]
        made["radius"] = np.maximum.reduceat(away[rows[own[order]], order], cuts)
        made["centre"] = np.argsort(order)[rows[which]]
        if level:
            # Parents are named by their place in the level above.
            place = {int(k): at for at, k in enumerate(last_which)}
            made["parent"] = [place[int(k)] for k in made["parent"]]
        last_which = which
        nodes.append(made)
    return order, np.concatenate(nodes)


def exact_scores(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """Integer inner products. plain: doubles hold them all."""
    return (a @ b.T if plain else np.dot(a.astype(object), b.T.astype(object))).astype(np.int64)


def reach(anchors: dict) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that any window of each anchor takes."""
    least, largest = np.full(len(anchors["ids"]), NO_ID), np.full(len(anchors["ids"]), -NO_ID)
    np.minimum.at(least, anchors["of"], anchors["lo"])
    np.maximum.at(largest, anchors["of"], anchors["hi"])
    return least, largest


def bounds(vectors: np.ndarray, centres: np.ndarray, radii: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score that rows within the radii of the centres can have with the vectors, with room for rounding."""
    sizes = (vectors**2).sum(1)[:, None] + most
    away, slack = np.sqrt(np.maximum(0.0, sizes - 2 * (vectors @ centres.T))), 1e-9 * most + 1e-6
    return (sizes - (away + radii) ** 2) / 2 - slack, (sizes - np.maximum(0.0, away - radii) ** 2) / 2 + slack


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the MOST highest scores of every query, ties by id."""
    order = np.lexsort((ids[row], -score, query))
    sorted_query = query[order]
    starts = np.r_[0, np.flatnonzero(sorted_query[1:] != sorted_query[:-1]) + 1] if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < MOST]


def search_shard(shard: dict, anchors: dict, most: float, same: bool) -> tuple[np.ndarray, ...]:
    """(query, row, score): up to MOST rows of the shard for each query (anchor, lo, hi): of the anchor's label, itself excepted, or of others."""
    ids, labels, vectors, nodes = shard["ids"], shard["labels"], shard["vectors"], shard["nodes"]
    q, own, own_ids = anchors["vectors"], anchors["labels"], anchors["ids"]
    of, lo, hi = anchors["of"], anchors["lo"].copy(), anchors["hi"]
    plain = most < EXACT
    least, largest = reach(anchors)
    alive = None
    for level in range(nodes["level"][-1] + 1):
        at = nodes[nodes["level"] == level]
        lower, upper = bounds(q, vectors[at["centre"]], at["radius"], most)
        inside = (upper >= least[:, None]) & (lower <= largest[:, None])
        alive = inside if alive is None else inside & alive[:, at["parent"]]
    query, row, score = (np.zeros(0, int) for _ in range(3))
    order = np.argsort(np.where(alive, -upper, np.inf), axis=1, kind="stable")
    left = alive.sum(1)
    for step in range(0, int(left.max(initial=0)), STEP):
        turn = order[:, step : step + STEP]
        valid = (np.arange(step, step + turn.shape[1]) < left[:, None]) & (np.take_along_axis(upper, turn, 1) >= least[:, None])
        if not valid.any():
            break
        who, leaf = np.repeat(np.arange(len(q)), turn.shape[1])[valid.ravel()], turn.ravel()[valid.ravel()]
        found = []
        for k in np.unique(leaf):
            some, first, last = who[leaf == k], at["first"][k], at["last"][k]
            scores = exact_scores(q[some], vectors[first:last], plain)
            fits = (labels[first:last][None] == own[some][:, None]) == same
            if same:
                x, y = np.nonzero(fits & (ids[first:last][None] == own_ids[some][:, None]))
                fits[x, y] = (vectors[first + y] != q[some[x]]).any(1)
            fits &= (scores >= least[some][:, None]) & (scores <= largest[some][:, None])
            x, y = np.nonzero(fits)
            found.append((some[x], first + y, scores[x, y]))
        anchor, rows, values = (np.concatenate(x) for x in zip(*found))
        # Every window of the anchor sees the row.
        sorted_anchor = np.argsort(anchor, kind="stable")
        anchor, rows, values = anchor[sorted_anchor], rows[sorted_anchor], values[sorted_anchor]
        begin, end = np.searchsorted(anchor, of, "left"), np.searchsorted(anchor, of, "right")
        many = end - begin
        asked = np.repeat(np.arange(len(of)), many)
        place = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        fits = (values[place] >= lo[asked]) & (values[place] <= hi[asked])
        asked, place = asked[fits], place[fits]
        query, row, score = np.r_[query, asked], np.r_[row, rows[place]], np.r_[score, values[place]]
        kept = best(query, row, score, ids)
        query, row, score = query[kept], row[kept], score[kept]
        # A query with all its rows looks for none below the last of them.
        count = np.bincount(query, minlength=len(of))
        last = np.full(len(of), NO_ID)
        np.minimum.at(last, query, score)
        lo = np.where(count >= MOST, np.maximum(lo, last), lo)
        least[:] = NO_ID
        np.minimum.at(least, of, lo)
    return query, row, score


def unpack_shard(row: dict, width: int) -> dict:
    ids, labels = (np.frombuffer(row[f"row_{c}"], "<i8") for c in ("ids", "labels"))
    return {"ids": ids, "labels": labels, "vectors": np.frombuffer(row["row_vectors"], "<f8").reshape(len(ids), width), "nodes": np.frombuffer(row["nodes"], NODES)}


def read_block(row: dict, width: int) -> dict:
    """The anchors of a block as arrays; their windows in a row, `of` naming the anchor of each."""
    windows = row["windows"]
    flat = lambda c: np.array([x[c] for w in windows for x in w], np.int64)
    of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    return {c: np.array(row[c], np.int64) for c in ("anchor", "ids", "labels", "home")} | {"vectors": np.frombuffer(b"".join(row["vectors"]), "<f8").reshape(-1, width), "of": of} | {c: flat(c) for c in ("lo", "hi", "window")}


def some_anchors(anchors: dict, mask: np.ndarray) -> dict:
    """The anchors of the mask, and their windows."""
    kept = mask[anchors["of"]]
    return {c: anchors[c][mask] for c in ("anchor", "ids", "labels", "vectors")} | {c: anchors[c][kept] for c in ("lo", "hi", "window")} | {"of": (np.cumsum(mask) - 1)[anchors["of"][kept]]}


class Index:
    """The candidates of a table of vectors as cells and shards."""

    def __init__(self, vectors: DataFrame) -> None:
        """vectors: (vec_id, label, vector array<double>), as valid_vectors gives them."""
        spark = vectors.sparkSession
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        n, self.most, width = vectors.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        self.width = max(width, 1)
        sample = vectors.orderBy(F.xxhash64("vec_id", "vector")).limit(min(SAMPLE, MOST_CELLS * 4)).select("vector").collect()
        points = np.zeros((max(1, len(sample)), self.width))
        for k, r in enumerate(sample):
            points[k, : len(r.vector)] = r.vector
        points = augmented(points, self.most)
        centres = points[farthest_first(points, min(MOST_CELLS, math.ceil(n / SHARD_ROWS)))]
        shipped, most, width = spark.sparkContext.broadcast(centres), self.most, self.width

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                x = np.zeros((batch.num_rows, width))
                x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                away = distances(augmented(x, most), shipped.value)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])], [c.split()[0] for c in ASSIGNED.split(", ")])

        rows = cut(map_batches(without_copies(vectors), assign, ASSIGNED))
        # At most MOST_CELLS rows.
        stats = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
        self.cells = {r.cell: (math.ceil(r.n / SHARD_ROWS), r.radius) for r in stats}
        self.asked = map_batches(vectors.where(is_anchor()), assign, ASSIGNED)
        self.centres = centres

        def grow(table: pa.Table) -> pa.Table:
            x = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8").reshape(table.num_rows, width)
            order, nodes = cover_tree(augmented(x, most))
            ids, labels = (table.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("vec_id", "label"))
            return pa.table([table.column("cell")[:1], table.column("salt")[:1], pa.array([ids]), pa.array([labels]), pa.array([x[order].tobytes()]), pa.array([nodes.tobytes()])], [c.split()[0] for c in INDEX.split(", ")])

        salts = spark.createDataFrame([(c, s) for c, (s, _) in self.cells.items()], "cell int, salts int")
        dealt = rows.join(F.broadcast(salts), "cell").select("vec_id", "label", "vector", "cell", F.pmod(F.xxhash64("vec_id", "vector"), F.col("salts")).cast("int").alias("salt"))
        self.shards = cut(dealt.groupBy("cell", "salt").applyInArrow(grow, INDEX))

    def anchors(self) -> DataFrame:
        """(anchor, block, vec_id, label, vector, cell): the anchors, dealt to blocks of neighbours."""
        asked, placed, before = cut(self.asked), [], 0
        for cell, n in sorted(asked.groupBy("cell").count().collect()):
            placed.append((cell, before // BLOCK_ANCHORS, math.ceil(n / BLOCK_ANCHORS)))
            before += n
        blocks = asked.sparkSession.createDataFrame(placed, "cell int, base int, parts int")
        block = F.col("base") + F.pmod(F.xxhash64("vec_id", "vector", F.lit("block")), F.col("parts")).cast("int")
        return cut(asked.join(F.broadcast(blocks), "cell").select(F.monotonically_increasing_id().alias("anchor"), block.alias("block"), "vec_id", "label", "vector", "cell"))

    def search(self, anchors: DataFrame, same: bool, home: bool) -> DataFrame:
        """(anchor, window, vec_id, score): up to MOST rows of each shard for each window of anchors (.., windows array<struct<window, lo, hi>>).

        home: of the anchor's own cell, or of all others.
        """
        names = {"anchor": "anchor", "ids": "vec_id", "labels": "label", "vectors": "vector", "home": "cell", "windows": "windows"}
        listed = anchors.groupBy("block").agg(F.collect_list(F.struct(*[F.col(c).alias(k) for k, c in names.items()])).alias("a")).select(*[F.col(f"a.{k}").alias(k) for k in names])
        used, width, most = sorted(self.cells), self.width, self.most
        shipped = anchors.sparkSession.sparkContext.broadcast((np.array(used, int), self.centres[used, :width], np.array([self.cells[c][1] for c in used]), [self.cells[c][0] for c in used]))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres, radii, salts = shipped.value
            for batch in batches:
                for k in range(batch.num_rows):
                    block = read_block(batch.slice(k, 1).to_pylist()[0], width)
                    lower, upper = bounds(block["vectors"], centres, radii, most)
                    least, largest = reach(block)
                    meets = (upper >= least[:, None]) & (lower <= largest[:, None]) & ((block["home"][:, None] == cells[None]) == home)
                    for at in np.flatnonzero(meets.any(0)):
                        part = some_anchors(block, meets[:, at])
                        packed = [pa.array([np.ascontiguousarray(part[c]).tobytes()], pa.binary()) for c in PACKED]
                        for salt in range(salts[at]):
                            yield pa.RecordBatch.from_arrays([pa.array([cells[at]], pa.int32()), pa.array([salt], pa.int32()), *packed], ["cell", "salt", *PACKED])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    part = {c: np.frombuffer(row[c], "<f8" if c == "vectors" else "<i8") for c in PACKED}
                    part["vectors"] = part["vectors"].reshape(-1, width)
                    shard = unpack_shard(row, width)
                    query, place, score = search_shard(shard, part, most, same)
                    yield pa.RecordBatch.from_arrays([pa.array(part["anchor"][part["of"][query]]), pa.array(part["window"][query].astype(np.int32)), pa.array(shard["ids"][place]), pa.array(score.astype(np.int64))], [c.split()[0] for c in FOUND.split(", ")])

        routed = map_batches(listed, route, "cell int, salt int, " + ", ".join(f"{c} binary" for c in PACKED))
        shards = self.shards.select("cell", "salt", *[F.col(c).alias(f"row_{c}") for c in ("ids", "labels", "vectors")], "nodes")
        # Spark takes what route makes for as small as what it reads, and would broadcast it.
        return map_batches(routed.hint("merge").join(shards, ["cell", "salt"]), look, FOUND)

    def nearest(self, anchors: DataFrame, same: bool) -> DataFrame:
        """(anchor, window, vec_id, score, rank): the first MOST rows of all for each window of anchors."""
        rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id"))
        first = cut(self.search(anchors, same, True).withColumn("rank", rank).where(F.col("rank") <= MOST))
        reached = first.groupBy("anchor", F.col("window").alias("at")).agg(F.count("*").alias("n"), F.min("score").alias("last")).where(F.col("n") >= MOST)
        bounds = reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("at", "last"))).alias("bounds"))
        raised = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), F.greatest(w["lo"], F.try_element_at("bounds", w["window"])).alias("lo"), w["hi"].alias("hi")))
        others = self.search(anchors.join(bounds, "anchor", "left").withColumn("windows", raised).drop("bounds"), same, False)
        return first.drop("rank").unionByName(others).withColumn("rank", rank).where(F.col("rank") <= MOST)


def is_anchor():
    return (F.col("vec_id") % 100 == 0) & (F.col("vec_id") != NO_ID)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings (vec_id, embedding, label).

    For every anchor and each of its first MOST positives: the first MOST rows of other labels that score between 80 and 100 percent of the positive.
    """
    index = Index(valid_vectors(embeddings))
    anchors = index.anchors()
    window = lambda at, lo, hi: F.struct(at.cast("int").alias("window"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    whole = F.array(window(F.lit(0), F.lit(-(2**62)), F.lit(2**62)))
    positives = cut(index.nearest(anchors.withColumn("windows", whole), same=True).select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    least = F.expr("(positive_score * 4 + 4) div 5")
    asked = positives.where(score >= 0).groupBy("anchor").agg(F.collect_list(window(F.col("window"), least, score)).alias("windows"))
    negatives = index.nearest(anchors.join(asked, "anchor"), same=False).select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return negatives.join(positives, ["anchor", "window"]).join(named, "anchor").select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
