"""Scans and sinks over Parquet, CSV and text tables."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Only a session of one machine may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where it has fewer: a table of a few splits is dealt anew, a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few_at_once(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bounds the batches that Python workers are handed from now on, by rows and by bytes; whole pages are too large for Spark's 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Hand the memory that a Python worker has freed back to the machine; workers live on, and otherwise keep the most that any task of theirs held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def load(spark: SparkSession, directory: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One model table; a declared schema wins over the file's."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{directory}/{name}.parquet")


def read_contacts_csv(spark: SparkSession, path: str, max_columns: int = 60, max_field: int = 4000, max_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rows, report). Headers are trimmed, required and unique case-insensitively; short rows are padded with '' and blank lines skipped.

    Limits are reported, never applied: the report counts rows, over-long fields, surplus columns and the rows that a reader with a limit would cut off.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if any(not n or n.startswith("_c") for n in names):
        raise ValueError("a header is empty")
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a header repeats")
    rows = raw.toDF(*names).na.fill("")
    rows = rows.where(F.greatest(*[F.length(F.trim(f"`{n}`")) for n in names], F.lit(0)) > 0)
    long_fields = sum((F.when(F.length(f"`{n}`") > max_field, 1).otherwise(0) for n in names), F.lit(0))
    report = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(long_fields), F.lit(0)).alias("long_fields")).withColumn("surplus_columns", F.lit(max(0, len(names) - max_columns))).withColumn("truncated", F.greatest(F.col("n_rows") - max_rows, F.lit(0)))
    return rows, report


def numbered(rows: DataFrame, keys: list[str], order: list[str], buckets: str) -> DataFrame:
    """rows with n, their place within keys in the order of `buckets`, then of the rest of `order`.

    Rows are counted by bucket first, and those counts, few, are summed; so only a bucket's rows meet, never all of a key.
    """
    sizes = rows.groupBy(*keys, buckets).agg(F.count("*").alias("size "))
    before = F.coalesce(F.sum("size ").over(Window.partitionBy(*keys).orderBy(buckets).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy(*keys, buckets).orderBy(*order))
    return rows.withColumn("inner ", inner).join(sizes.select(*keys, buckets, before.alias("before ")), [*keys, buckets]).withColumn("n", F.col("inner ") + F.col("before ")).drop("inner ", "before ")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """rows with `name`, their place from 1 within keys in the order of `order`: a sort by sampled range cuts, and offsets from the rows of each key in the ranges before.

    No key's rows meet in one task. Only rows that agree in keys and order stand in one range; null keys are a key.
    """
    sorting = [F.asc_nulls_first(k) for k in keys] + order
    placed = shared_table(rows.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("own ", F.monotonically_increasing_id()))
    # monotonically_increasing_id holds the range in its upper bits; a range's rows of one key follow each other.
    in_range = placed.withColumn("range ", F.shiftright("own ", 33))
    counts = in_range.groupBy(*keys, "range ").agg(F.count("*").alias("size "), F.min("own ").alias("least "))
    before = F.coalesce(F.sum("size ").over(Window.partitionBy(*keys).orderBy("range ").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"of {k}") for k in keys], F.col("range ").alias("of range "), (before - F.col("least ") + 1).alias("add "))
    same = F.col("range ") == F.col("of range ")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of {k}"))
    return in_range.join(offsets, same).withColumn(name, F.col("own ") + F.col("add ")).select(*[f"`{c}`" for c in rows.columns], name)


def json_col(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column read by a schema; text that does not parse becomes null."""
    return df.withColumn(column, F.from_json(column, schema))


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows to append: the first of each key that target lacks."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*(order or rows.columns)))
    return rows.withColumn("rank ", first).where("`rank ` = 1").drop("rank ").join(target.select(*key), key, "left_anti").select(rows.columns)


def upsert(target: DataFrame, rows: DataFrame, key: list[str], set_cols: list[str]) -> DataFrame:
    """The new snapshot: set_cols come from rows where the key is there, else from target. One row a key on either side."""
    new = rows.select(*key, *[F.col(c).alias(f"new {c}") for c in set_cols], F.lit(True).alias("new "))
    joined = target.join(new, key, "full")
    return joined.select(*[F.when(F.col("new "), F.col(f"new {c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c) for c in target.columns])


@dataclass(frozen=True)
class KeyedTable:
    """S6, S7, S8 as a sink: a table of Parquet folders by bucket of its key, of which a batch reads and writes only those it touches.

    bucket: whole numbers that rows of one key share, an expression; by default a hash of the key by `buckets`. A batch is first
    merged with its buckets into a written table (merged), then those are swapped for it (swap, Spark's dynamic partition overwrite);
    a swap that was cut short is repeated from what was written, and changes nothing else.
    """

    path: str
    schema: str
    key: tuple[str, ...]
    bucket: str = ""
    buckets: int = 64

    def bucketed(self, rows: DataFrame) -> DataFrame:
        own = F.expr(self.bucket) if self.bucket else F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets))
        return rows.withColumn("bucket", own.cast("long"))

    def columns(self, rows: DataFrame) -> list[Column]:
        """The table's columns of rows, those that rows lack null."""
        kinds = T.StructType.fromDDL(self.schema)
        return [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The whole table, or some of its buckets; a table that nothing was written to is empty."""
        spark.createDataFrame([], f"{self.schema}, bucket long").write.mode("ignore").parquet(self.path)
        rows = spark.read.schema(f"{self.schema}, bucket long").parquet(self.path)
        return rows.where("bucket is not null") if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows; there are no more of them than the table has."""
        return [r.bucket for r in self.bucketed(rows).select("bucket").distinct().collect()]

    def merged(self, rows: DataFrame, set_cols: list[str] | None = None) -> DataFrame:
        """The touched buckets, whole, after rows came in: new keys are inserted, the first of each; known ones stay (S6), or have set_cols changed."""
        new = self.bucketed(rows.select(self.columns(rows)))
        old = self.read(rows.sparkSession, self.touched(rows))
        if set_cols is None:
            return old.unionByName(insert_ignore(old, new, [*self.key]))
        known = old.select(*self.key)
        changed = upsert(old, new.join(known, [*self.key], "left_semi"), [*self.key], set_cols)
        return changed.unionByName(new.join(known, [*self.key], "left_anti").select(old.columns))

    def swap(self, merged: DataFrame) -> None:
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def commit_batch(spark: SparkSession, folder: str, number: int, make: Callable[[], dict[str, DataFrame]], tables: dict[str, KeyedTable]) -> None:
    """Several tables changed under one batch number, all or none of them in the end.

    make gives the merged buckets of each table, and is asked only if this batch has not been written whole yet: first all are
    written beside the tables, then a mark that they are, then they are swapped in. A batch that is run again after a
    failure before the mark begins anew, with no table changed; after it, it repeats the swaps from what was written.
    """
    beside, schema = f"{folder}/batch-{number}", "number long"
    marks = f"{folder}/written"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(marks)
    if spark.read.schema(schema).parquet(marks).where(F.col("number") == number).isEmpty():
        for name, merged in make().items():
            merged.write.mode("overwrite").parquet(f"{beside}/{name}")
        spark.createDataFrame([(number,)], schema).coalesce(1).write.mode("append").parquet(marks)
    for name, table in tables.items():
        table.swap(spark.read.schema(f"{table.schema}, bucket long").parquet(f"{beside}/{name}"))


def append(path: str, rows: DataFrame) -> None:
    """Rows added to an append-only table."""
    rows.write.mode("append").parquet(path)


# Fixed value: white space as scripts of the web know it.
BLANK = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def parse_robots(documents: DataFrame, max_bytes: int = 512_000, max_lines: int = 100_000, max_rules: int = 2_000, max_pattern: int = 2_048) -> tuple[DataFrame, DataFrame]:
    """(rules (origin, group, agent, line, kind, pattern), sitemaps (origin, line, url)) of documents (origin, body).

    Characters beyond the bound are cut with their partial last line, whatever ends lines; a byte order mark is no part of
    the first field; comments and unknown fields are ignored; agents that follow each other open one group; longer
    patterns are cut at max_pattern, longer sitemap addresses left out.
    """
    blank = "[" + BLANK + "]"
    bare = lambda c: F.regexp_replace(c, f"^{blank}++|{blank}++$", "")
    kept = F.substring("body", 1, max_bytes)
    # Up to the last line end; no line is whole without one.
    ended = F.regexp_extract(kept, r"(?s)^(.*)[\r\n]", 1)
    cut_at = F.regexp_replace(F.when(F.length("body") > max_bytes, ended).otherwise(F.col("body")), "^\ufeff", "")
    lines = documents.select("origin", F.posexplode(F.split(cut_at, r"\r\n|\r|\n")).alias("line", "text")).where(F.col("line") < max_lines)
    plain = lines.withColumn("text", bare(F.substring_index("text", "#", 1)))
    has = F.col("text").contains(":")
    spaced = f"^([^{BLANK}]++){blank}++([^{BLANK}]++)$"
    field = F.lower(bare(F.when(has, F.substring_index("text", ":", 1)).otherwise(F.regexp_extract("text", spaced, 1))))
    value = F.when(has, bare(F.substr("text", F.instr("text", ":") + 1))).otherwise(F.regexp_extract("text", spaced, 2))
    known = plain.select("origin", "line", F.when(field == "useragent", F.lit("user-agent")).otherwise(field).alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))
    order = Window.partitionBy("origin").orderBy("line")
    grouped = known.where("field <> 'sitemap'").withColumn("before", F.lag("field").over(order))
    opens = F.when((F.col("field") == "user-agent") & (F.coalesce("before", F.lit("")) != "user-agent"), 1).otherwise(0)
    grouped = grouped.withColumn("group", F.sum(opens).over(order))
    agents = grouped.where("field = 'user-agent' and value <> ''").select("origin", "group", F.lower("value").alias("agent"))
    # Delays are not counted among the rules.
    rules = grouped.where("field <> 'user-agent' and `group` > 0").withColumn("place", F.sum(F.when(F.col("field") == "crawl-delay", 0).otherwise(1)).over(order)).where((F.col("place") <= max_rules) | (F.col("field") == "crawl-delay"))
    pattern = F.when(F.col("field") == "crawl-delay", F.col("value")).otherwise(F.substring("value", 1, max_pattern))
    out = agents.join(rules.select("origin", "group", "line", F.col("field").alias("kind"), pattern.alias("pattern")), ["origin", "group"])
    return out, known.where((F.col("field") == "sitemap") & F.length("value").between(1, max_pattern)).select("origin", "line", F.col("value").alias("url"))


SITEMAP = "sitemap array<struct<loc:string>>, url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"


def parse_sitemaps(documents: DataFrame, max_entries: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: (entries, children, rejects) of documents (url, body); namespace prefixes are ignored and a loc that is no http address counts as skipped."""
    plain = F.regexp_replace(F.regexp_replace("body", r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    kind = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty").when(plain.rlike(r"<urlset[\s>]"), "urlset").when(plain.rlike(r"<sitemapindex[\s>]"), "sitemapindex").otherwise("not_a_sitemap")
    read = documents.select("url", kind.alias("kind"), F.from_xml(F.when(kind.isin("urlset", "sitemapindex"), plain), SITEMAP, {"mode": "PERMISSIVE"}).alias("doc"))
    good = F.trim(F.col("item.loc")).rlike(r"^https?://\S+$")
    entries = read.where("kind = 'urlset'").select("url", F.posexplode("doc.url").alias("place", "item")).where(F.col("place") < max_entries)
    children = read.where("kind = 'sitemapindex'").select("url", F.posexplode("doc.sitemap").alias("place", "item")).where(good)
    rejects = read.where("kind in ('empty', 'not_a_sitemap')").select("url", F.col("kind").alias("reason")).unionByName(entries.where(~F.coalesce(good, F.lit(False))).select("url", F.lit("skipped").alias("reason")))
    listed = entries.where(good).select("url", "place", F.trim("item.loc").alias("loc"), "item.lastmod", "item.changefreq", "item.priority")
    return listed, children.select("url", F.trim("item.loc").alias("child")), rejects


def walk_sitemaps(children: DataFrame, starts: DataFrame, max_depth: int = 3, max_docs: int = 50) -> DataFrame:
    """(start, url, depth) of the sitemap documents reached breadth-first from starts (start, url), at most max_docs for each start.

    Levels are few and bounded by max_depth; a document already seen from a start is not visited again.
    """
    seen = starts.select("start", "url", F.lit(0).alias("depth")).distinct()
    level = seen
    for depth in range(1, max_depth + 1):
        found = level.join(children.select("url", "child"), "url").select("start", F.col("child").alias("url")).distinct()
        level = found.join(seen.select("start", "url"), ["start", "url"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(level)
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "url"))
    return seen.withColumn("place", place).where(F.col("place") <= max_docs).drop("place")


def walk_report(children: DataFrame, starts: DataFrame, max_depth: int = 3, max_docs: int = 50) -> DataFrame:
    """(start, documents, depth, stopped_by) of the walks from starts: document_limit, depth_limit or exhausted."""
    beyond = walk_sitemaps(children, starts, max_depth + 1, 2**31 - 1)
    counted = beyond.groupBy("start").agg(F.count_if(F.col("depth") <= max_depth).alias("found"), F.max(F.when(F.col("depth") <= max_depth, F.col("depth"))).alias("depth"), F.bool_or(F.col("depth") > max_depth).alias("deeper"))
    stopped = F.when(F.col("found") > max_docs, "document_limit").when(F.col("deeper"), "depth_limit").otherwise("exhausted")
    return counted.select("start", F.least("found", F.lit(max_docs)).alias("documents"), "depth", stopped.alias("stopped_by"))


def like_literal(columns: list[str], term: str) -> Column:
    """a case-insensitive search for a literal term in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(term))), F.lit(False))
    return found
