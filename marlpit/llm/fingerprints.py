"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line that is not blank) hashes to a wide vector: 4 equality lanes
modulo 2**64, and 128 likeness lanes modulo 2**16 that hold a signed sketch of
the paragraph's runs of three words. A text's fingerprint is the sum of its
paragraphs' vectors, lane by lane, so paragraph order does not count, and a
paragraph is inserted or deleted by adding or subtracting its vector. Equal
multisets of paragraphs have equal fingerprints; unequal ones differ but for
hash collisions of 256 bits.

Likeness of two fingerprints is the cosine of their likeness lanes, clipped to
0..1; equal fingerprints have 1, and an empty text has 0 with any other.

Null and empty texts have the fingerprint of no paragraphs (all lanes zero).
Texts may be of any length. Repeated rows give repeated results; extra columns
are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, map_batches
from .textkernel import BASE, SPACED, hash_words, mix, shingle_hashes

EQUALITY_LANES, LIKENESS_LANES, RUN_WORDS = 4, 128, 3
LANE_KEYS = mix(np.arange(1, EQUALITY_LANES + 1, dtype=np.uint64) * BASE)
LINE = np.ones(256, bool)
LINE[[10, 13]] = False


def fingerprint_many(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(equality lanes uint64, likeness lanes int16), a row for each text.

    Paragraph hashes are case-sensitive and exact: they come from a keyed digest of the paragraph's bytes.
    """
    equality = np.zeros((len(texts), EQUALITY_LANES), np.uint64)
    parts, owner = [], []
    for k, text in enumerate(texts):
        lines = [x for x in text.splitlines() if x.strip()]
        parts += lines
        owner += [k] * len(lines)
    if parts:
        digests = b"".join(hashlib.blake2b(x, digest_size=8 * EQUALITY_LANES).digest() for x in parts)
        np.add.at(equality, np.array(owner), np.frombuffer(digests, "<u8").reshape(-1, EQUALITY_LANES))
    runs, offsets = shingle_hashes(*hash_words(parts, SPACED), RUN_WORDS) if parts else (np.zeros(0, np.uint64), np.zeros(1, int))
    text_of_run = np.repeat(np.array(owner, np.int64), np.diff(offsets)) if parts else np.zeros(0, np.int64)
    lane = text_of_run * LIKENESS_LANES + (runs & np.uint64(LIKENESS_LANES - 1)).astype(np.int64)
    sign = np.where(runs >> np.uint64(63), 1.0, -1.0)
    sums = np.bincount(lane, sign, len(texts) * LIKENESS_LANES).astype(np.int64)
    return equality, sums.astype(np.int16).reshape(len(texts), LIKENESS_LANES)


def pack(equality: np.ndarray, likeness: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal strings."""
    rows = np.concatenate([equality.astype("<u8").view(np.uint8), likeness.astype("<i2").view(np.uint8)], axis=1)
    data, width = rows.tobytes().hex(), 2 * rows.shape[1]
    return [data[k : k + width] for k in range(0, len(data), width)]


def unpack(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    cut = 8 * EQUALITY_LANES
    return rows[:, :cut].copy().view("<u8"), rows[:, cut:].copy().view("<i2")


def combine(prints: list[str], others: list[str], sign: int = 1) -> list[str]:
    """Fingerprints with the others' paragraphs inserted (sign 1) or deleted (sign -1)."""
    (a, x), (b, y) = unpack(prints), unpack(others)
    return pack(a + b if sign > 0 else a - b, x + y if sign > 0 else x - y)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1.0), 0.0, 1.0))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(*fingerprint_many(texts)), pa.string())], ["doc_id", "fingerprint"])

    texts = keyed_text(df, id_col, text_col)
    return map_batches(texts, run, f"doc_id {texts.dtypes[0][1]}, fingerprint string")


#: Rows a range of ids should have, and the most ranges: what bounds the driver's share.
RANGE_ROWS, MOST_RANGES = 2000, 20_000


def keys_of_partitions(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n hash partitions a number that repartition() deals to it."""
    dealt = spark.range(40 * n + 1000).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("partition"))
    found = {r[0]: r[1] for r in dealt.groupBy("partition").agg(F.min("id")).collect()}
    return np.array([found.get(k, k) for k in range(n)], np.int64)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, doc_id, text, only_next) such that, within a bucket, descending doc_id, each text is followed by the next document's.

    Ids are cut into ranges at quantiles; only their bounds reach the driver. Every range is a partition. The
    row after a range's last is sent to that range too, marked only_next; after the smallest id comes the
    largest. Each text moves once. Null ids count as smaller than all others, and stand in the order of a
    hash of their text; rows of one id keep together, in that order too.
    """
    texts = keyed_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    without = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64("text"), 8)
    at, spark = F.coalesce(F.col("doc_id"), without), df.sparkSession
    parts = min(MOST_RANGES, max(64, texts.count() // RANGE_ROWS))
    cuts = texts.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    bounds = spark.sparkContext.broadcast(np.array(sorted({*(cuts or [])}), np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, ids.to_numpy(), side="left").astype(np.int32))

    tops = {r[0]: r[1] for r in texts.select(range_of(at).alias("bucket"), at.alias("at")).groupBy("bucket").agg(F.max("at")).collect()}
    filled = sorted(tops)
    keys = dict(zip(filled, keys_of_partitions(spark, max(1, len(filled))).tolist()))
    follows = spark.sparkContext.broadcast((keys, {tops[b]: keys[filled[(k + 1) % len(filled)]] for k, b in enumerate(filled)}))

    @F.pandas_udf("array<struct<bucket:bigint,only_next:boolean>>")
    def homes_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds.value, ids.to_numpy(), side="left").tolist()
        keys, also = follows.value
        return pd.Series([[(keys[b], False), (also[i], True)] if i in also else [(keys[b], False)] for b, i in zip(own, ids.tolist())])

    spread = texts.select("doc_id", "text", at.alias("at"), F.explode(homes_of(at)).alias("home")).select("home.bucket", "doc_id", "text", "home.only_next", "at")
    dealt = spread.repartition(max(1, len(filled)), "bucket").sortWithinPartitions("bucket", "only_next", F.desc("at"), F.xxhash64("text"))
    return dealt.select("bucket", "doc_id", "text", "only_next")


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside itself with its last third overwritten by the start of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A lone
    document is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            buckets, ids, texts, marks = (batch.column(k).to_pylist() for k in range(4))
            pairs = []
            for row in zip(buckets, ids, texts, marks):
                if held and held[0] == row[0] and not held[3]:
                    pairs.append((held[1], held[2], row[2]))
                held = row
            if pairs:
                yield from report(pairs)

    def report(pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(pairs), 200):
            ids, texts, following = zip(*pairs[k : k + 200])
            edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, following)]
            raw, line, own_at, next_at = [t.encode() for t in edited], [], [], []
            for t, n in zip(texts, following):  # a next text is mostly the following row's own
                if not line or line[-1] is not t:
                    line.append(t)
                own_at.append(len(line) - 1)
                line.append(n)
                next_at.append(len(line) - 1)
            new, both = fingerprint_many(raw), fingerprint_many([t.encode() for t in line])
            own, after = ([lanes[at] for lanes in both] for at in (own_at, next_at))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                pa.array(pack(*own)),
                pa.array(pack(*new)),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, after)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(with_next(df, id_col, text_col), run, schema)
