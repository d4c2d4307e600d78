"""Near-duplicate groups by b-bit MinHash over word shingles.

One pass over the texts takes each document's set of distinct 5-word shingles
and its minima under BANDS * BAND_ROWS hash functions. Documents of equal sets
form one class, and one document stands for each. Whole minima make the bands
that bring candidates together; the low two bits of each minimum, packed into
words of 64 bits, estimate a candidate pair's similarity by counting equal
lanes, corrected for lanes that agree by chance. Pairs whose estimate is not six
standard deviations below the threshold are confirmed on the full sets.

A bucket's documents are not paired with each other: first each is compared with
the bucket's smallest id; documents of buckets that then still hold different
components are compared further, in blocks whose pairs stay inside a task. At the threshold a linked pair shares no band with probability
(1 - t**BAND_ROWS)**BANDS: 7e-9 for 0.85 and 3e-6 for 0.8.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A text of fewer words than a
shingle is one shingle; a null or empty text, or one without words, has none and
is linked with nothing. Ids name documents: rows that repeat an id have one text.
A null id is its own, never kept group. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_text, map_batches
from .components import label_components
from .textkernel import SPACED, hash_words, mix, shingle_hashes, steps

SHINGLE_WORDS, BANDS, BAND_ROWS, BITS = 5, 32, 5, 2
HASHES = BANDS * BAND_ROWS
LANES = 64 // BITS
MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
ADDENDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
#: Standard deviations an estimate may fall short of the threshold.
SLACK = 6
#: Bits of the filter that finds the rows of named documents at the scan: 2 MB however many are named.
FILTER_BITS = 1 << 24
#: Bits of one of Spark's bitmaps; the filter reaches the driver as FILTER_BITS / BITMAP_BITS rows of them.
BITMAP_BITS = 1 << 15
#: Documents of one block; two blocks are compared in one task.
BLOCK = 256
#: Shared shingles of two blocks that are compared at once.
COLUMNS = 1 << 13


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of every text, one after another, and their offsets."""
    runs, offsets = shingle_hashes(*hash_words(texts, SPACED), n)
    sets = [np.unique(runs[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.concatenate(sets) if sets else runs, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minima(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of HASHES minima (32 bits) for each set that is not empty."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((shingles * MULTIPLIERS[k] + ADDENDS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def pack_bits(rows: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, LANES to a word."""
    low = (rows & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(rows), HASHES // LANES, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number mixed in."""
    grouped = rows.astype(np.uint64).reshape(len(rows), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS)).copy()
    for k in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return keys


def profile(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bits, bands); the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch):
                shingles, offsets = shingle_sets(texts, n)
                sizes = np.diff(offsets)
                raw = shingles.tobytes()
                keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                rows = minima(shingles, offsets)
                bits, bands = iter(pack_bits(rows).view(np.int64).tolist()), iter(band_keys(rows).view(np.int64).tolist())
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([next(bits) if s else None for s in sizes], pa.list_(pa.int64())),
                    pa.array([next(bands) if s else None for s in sizes], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "bits", "bands"])

    texts = keyed_text(docs)
    return map_batches(texts, run, f"doc_id {texts.dtypes[0][1]}, n_shingles long, set_key binary, bits array<bigint>, bands array<bigint>")


def likely(a: str, b: str, threshold: float) -> Column:
    """Whether the corrected estimate of two columns of packed bits may come from a similarity of the threshold."""
    odd = F.lit(int(sum(1 << (BITS * k) for k in range(LANES))))
    unequal = F.lit(0)
    for k in range(HASHES // LANES):
        x = F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unequal = unequal + F.bit_count(folded.bitwiseAND(odd))
    chance = 1 / 2**BITS
    agree = threshold + (1 - threshold) * chance
    spread = (agree * (1 - agree) / HASHES) ** 0.5
    return (F.lit(1.0) - unequal / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance) >= F.lit(threshold - SLACK * spread / (1 - chance))


def membership_bits(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits, whatever the number of ids (doc_id): false positives are possible, false negatives are not."""
    place = F.col("at") + 1  # Spark's bitmaps number their bits from 1, and their own places from 0
    found = ids.select(bit_place("doc_id").alias("at")).groupBy(F.bitmap_bucket_number(place).alias("bitmap")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((FILTER_BITS // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for row in found.collect():
        out[row["bitmap"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1).view("<u8")


def bit_place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FILTER_BITS))


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles) of the documents named in ids (doc_id); no text is shuffled, a bit filter picks rows at the scan."""
    shipped = docs.sparkSession.sparkContext.broadcast(membership_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            chosen = batch.filter(pa.array(keep.astype(bool)))
            for first, texts in steps(chosen):
                shingles, offsets = shingle_sets(texts, n)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(first, len(texts)), sets], ["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    likely_rows = map_batches(docs.where("doc_id is not null").select("doc_id", "text", bit_place("doc_id").alias("at")), run, f"doc_id {kind}, shingles array<bigint>")
    return cut(likely_rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("ours")), "a")
    full = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("theirs")), "b")
    return map_batches(full.select("a", "b", "ours", "theirs"), compare, f"a {kind}, b {kind}")


def links_across(nodes: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components of nodes (doc_id, component), enough to join all that are linked.

    A document too much of whose set no other node shares can link with none. The others are gathered by
    shared bands (band, doc_id); a gathering is cut into blocks of BLOCK documents, and each pair of blocks
    is one small group whose sets are compared by a matrix product. Only a spanning forest of the links
    leaves a group, never its pairs.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1")
    able = each.join(shared, "shingle").groupBy("doc_id").agg(F.count("*").alias("common"), F.first("n").alias("n")).where(100 * F.col("common") >= percent * F.col("n"))
    kept = cut(nodes.join(able.select("doc_id"), "doc_id", "left_semi"))
    near = bands.join(kept, "doc_id", "left_semi")
    heads = near.groupBy("band").agg(F.min("doc_id").alias("a"))
    gathered = label_components(near.join(heads, "band").select("a", F.col("doc_id").alias("b")).distinct())
    grouped = kept.join(gathered.select(F.col("node").alias("doc_id"), F.col("component").alias("found")), "doc_id", "left").withColumn("group", F.coalesce("found", "doc_id")).drop("found")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), blocks)
    placed = grouped.join(sizes, "group").select("group", "doc_id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("other"))
    keyed = placed.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component").join(sets, "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        ids, component = table.column("doc_id").to_pylist(), np.array(table.column("component").to_pylist())
        lists = [np.asarray(x, np.int64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in lists])
        names, column, many = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        row, common = np.repeat(np.arange(len(n)), n), many[column] > 1
        # Shared shingles are taken COLUMNS at a time, so that the matrix is bounded whatever the length of the texts.
        row, at = row[common], (np.cumsum(many > 1) - 1)[column[common]]
        order = np.argsort(at, kind="stable")
        row, at, both = row[order], at[order], np.zeros((len(n), len(n)), np.float64)
        for start in range(0, int((many > 1).sum()), COLUMNS):
            a, b = np.searchsorted(at, [start, start + COLUMNS])
            marks = np.zeros((len(n), COLUMNS), np.float32)
            marks[row[a:b], at[a:b] - start] = 1
            both += marks @ marks.T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (n[:, None] + n[None] - both)) & (both > 0)
        label, out = np.unique(component, return_inverse=True)[1], []
        for x, y in zip(*np.nonzero(np.triu(linked, 1))):
            if label[x] != label[y]:
                out.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([o[0] for o in out], table.schema.field("doc_id").type), "b": pa.array([o[1] for o in out], table.schema.field("doc_id").type)})

    return keyed.groupBy("group", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at 100 * intersection >= percent * union, closed transitively."""
    docs = keyed_text(docs, id_col, text_col)
    profiles = cut(profile(docs, n))
    own = profiles.where("set_key is not null and doc_id is not null")
    classes = cut(own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    spread = classes.select(F.explode("bands").alias("band"), "rep")
    hubs = spread.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    crowded = cut(spread.join(hubs, "band"))
    words = classes.select("rep", F.struct(*[F.col("bits")[k].alias(f"w{k}") for k in range(HASHES // LANES)]).alias("bits"))
    stars = crowded.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(words.select(F.col("rep").alias("a"), F.col("bits").alias("x")), "a").join(words.select(F.col("rep").alias("b"), F.col("bits").alias("y")), "b")
    stars = cut(stars.where(likely("x", "y", percent / 100)).select("a", "b"))
    links = cut(confirm(stars, sets_of(docs, ends_of(stars), n), percent))
    labels = label_components(links)
    labelled = crowded.select("band", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    still = cut(labelled.join(mixed, "band", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct())
    if not still.isEmpty():
        near_bands = crowded.select("band", F.col("rep").alias("doc_id")).join(mixed, "band", "left_semi")
        more = cut(links_across(still, near_bands, sets_of(docs, still, n), percent))
        # What links join, labels join too.
        labels = label_components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    found = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = profiles.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
