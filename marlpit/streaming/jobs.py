"""Structured Streaming versions of the event operators. Each takes a streaming frame and returns one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import ingest
from ..operators.limits import sliding_log
from ..sources.tables import KeyedTable, commit_batch, insert_ignore, shared_table

LATE = "1 hour"


def window_hits(hits: DataFrame, width: str = "1 hour") -> DataFrame:
    """R2: hits of each subject in fixed windows; the buckets are those of the batch limiter."""
    return hits.withWatermark("ts", LATE).groupBy(F.window("ts", width), "subject").agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "subject", "hits")


def funnel(submissions: DataFrame) -> DataFrame:
    """Captured and rejected submissions a day."""
    day = submissions.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day"))
    return day.agg(F.count_if(F.col("outcome") == "accepted").alias("captured"), F.count_if(F.col("outcome") == "rejected").alias("rejected")).select(F.col("window.start").alias("start"), "captured", "rejected")


def event_counts(events: DataFrame) -> DataFrame:
    """Events by name and workspace an hour."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), "name", "workspace_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "name", "workspace_id", "n")


def current_stage(changes: DataFrame) -> DataFrame:
    """The latest stage of each deal, for update mode."""
    return changes.groupBy("deal").agg(F.max_by("stage", F.struct("ts", "id")).alias("stage"))


def new_submissions(submissions: DataFrame) -> DataFrame:
    """Submissions without the repeats of a key within the watermark; the receipts table settles the rest in each batch."""
    return submissions.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["external_key"])


def ingest_stream(submissions: DataFrame, receipts_path: str, checkpoint: str, schema: str = "external_key string, id long") -> StreamingQuery:
    """Submissions (external_key, id, ...) written once for each key: a batch drops what the receipts table has, and appends the rest to it.

    A batch that is run again after a failure finds its own receipts, so it adds nothing.
    """

    def settle(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(receipts_path)
        # A batch writes to a folder of its own, over what a failed attempt may have left.
        others = known.where(~F.col("_metadata.file_path").contains(f"/batch-{number}/"))
        insert_ignore(others.select("external_key"), batch.select("external_key", "id"), ["external_key"], ["id"]).write.mode("overwrite").parquet(f"{receipts_path}/batch-{number}")

    submissions.sparkSession.createDataFrame([], schema).write.mode("append").parquet(f"{receipts_path}/none")
    return new_submissions(submissions).writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CONTEXT = "source_type string, source_platform string, confidence string, utm_source string, utm_medium string, utm_campaign string, gclid string, fbclid string, referrer string, landing_path string, captured_at timestamp"


def submission_tables(folder: str, buckets: int = 64) -> dict[str, KeyedTable]:
    """The tables that submissions change, by name; owners has the contact of every identity key, hits what counts against the limits, an hour a bucket."""
    of = lambda name, schema, *key, bucket="": KeyedTable(f"{folder}/{name}", schema, key or ("id",), bucket, buckets)
    return {
        "submissions": of("submissions", "id long, form_id string, outcome string, rejection_reason string, contact_id long"),
        "contacts": of("contacts", "id long, workspace_id long, first_name string, last_name string, email string, phone string, company_name string, region string"),
        "touches": of("touches", f"id long, workspace_id long, contact_id long, {CONTEXT}"),
        "opportunities": of("opportunities", "id long, workspace_id long, contact_id long, touch_id long, title string, value_minor long, pipeline_id string, status string, stage_id string"),
        "activities": of("activities", "id string, contact_id long, type string, summary string"),
        "receipts": of("receipts", "workspace_id long, source_system string, external_key string, digest string, contact_id long, touch_id long, opportunity_id long", "workspace_id", "source_system", "external_key"),
        "owners": of("owners", "key string, stored long", "key"),
        "hits": of("hits", "id long, subject string, form string, ts timestamp", "id", bucket="floor(unix_timestamp(ts) / 3600)"),
    }


def submission_stream(submissions: DataFrame, forms: DataFrame, fields: DataFrame, folder: str, checkpoint: str, app_url: str, tiers: list | None = None, buckets: int = 64) -> StreamingQuery:
    """Every batch of submissions through all gates, matched, and written to submission_tables(folder/tables), all of them under the batch's number.

    A batch reads only what its own keys and hours may meet: the buckets of its receipts and identity keys, and the hits
    of its hours, so its cost follows the batch and not the history. A batch that failed anywhere is run again and adds
    nothing twice (commit_batch). A new contact has the id of its submission, so older contacts have smaller ids.
    """
    tables = submission_tables(f"{folder}/tables", buckets)

    def settle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def make() -> dict[str, DataFrame]:
            rows = shared_table(batch)
            now = rows.select("id", F.col("ip").cast("string").alias("subject"), F.col("form_id").alias("form"), "ts")
            earlier = tables["hits"].read(spark, tables["hits"].touched(now)).select("id", "subject", "form", "ts")

            def owners(leads: DataFrame) -> DataFrame:
                asked = shared_table(ingest.identity_keys(leads).select(ingest.key_name().alias("key")).distinct())
                return tables["owners"].read(spark, tables["owners"].touched(asked)).join(asked, "key", "left_semi").select("key", "stored")

            def receipts(leads: DataFrame) -> DataFrame:
                return tables["receipts"].read(spark, tables["receipts"].touched(leads)).drop("bucket")

            made = ingest.process_submissions(rows.withColumn("ip", F.col("ip").cast("string")), forms, fields, None, None, app_url, tiers, earlier, owners, receipts)
            taken = made["leads"].join(made["outcomes"].where(F.col("outcome").isin("created", "matched")).select("id", "contact_id"), "id")
            keyed = ingest.identity_keys(taken).join(taken.select("id", "contact_id"), "id").groupBy(ingest.key_name().alias("key")).agg(F.min_by("contact_id", "id").alias("stored"))
            lasting = {"contacts": ["id"], "owners": ["stored"]}
            out = {}
            for name, table in tables.items():
                df = keyed if name == "owners" else made[name]
                ids = lasting.get(name, [c for c in ("contact_id",) if c in df.columns])
                out[name] = table.merged(df.withColumns({c: F.abs(c) for c in ids}))
            return out

        commit_batch(spark, f"{folder}/commits", number, make, tables)

    return submissions.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Burst(StatefulProcessor):
    """The times of a key's allowed hits."""

    def __init__(self, most: int, window_s: float):
        self.most, self.window_s = most, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        old = [x[0] for x in self.log.get()]
        hits = pd.concat(rows).sort_values(["at", "id"])
        verdicts = sliding_log([*old, *hits["at"]], self.most, self.window_s)[len(old) :]
        allowed = [v[0] for v in verdicts]
        times = [*old, *[t for t, ok in zip(hits["at"], allowed) if ok]]
        self.log.put([(t,) for t in times if t > hits["at"].max() - self.window_s])
        yield pd.DataFrame({"id": hits["id"], "allowed": allowed})

    def close(self) -> None:
        pass


def burst_stream(hits: DataFrame, most: int = 5, window_s: float = 10.0) -> DataFrame:
    """(id, allowed) of hits in order of arrival. Needs the RocksDB state store."""
    timed = hits.select("id", "subject", "form", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("subject", "form").transformWithStateInPandas(Burst(most, window_s), "id long, allowed boolean", "Append", "none")


class FirstTouch(StatefulProcessor):
    """Whether a contact has been seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        touches = pd.concat(rows).sort_values(["at", "id"])
        first = [not self.seen.exists()] + [False] * (len(touches) - 1)
        self.seen.update((True,))
        yield pd.DataFrame({"id": touches["id"], "is_first_touch": first})

    def close(self) -> None:
        pass


def first_touch_stream(touches: DataFrame) -> DataFrame:
    """(id, is_first_touch) in order of arrival. Needs the RocksDB state store."""
    timed = touches.select("id", "contact_id", (F.unix_micros(F.col("captured_at").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("contact_id").transformWithStateInPandas(FirstTouch(), "id long, is_first_touch boolean", "Append", "none")
