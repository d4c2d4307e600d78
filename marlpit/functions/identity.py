"""Identity keys, coercion, digests and redaction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Country code, trunk prefix and national number pattern of each region that is understood.
PHONE_REGIONS = [("AU", "61", "0", "[2-478][0-9]{8}"), ("NZ", "64", "0", "[2-9][0-9]{7,9}"), ("US", "1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"), ("CA", "1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"), ("GB", "44", "0", "[1-9][0-9]{8,9}")]


def normalise_email(email: Column) -> Column:
    """Trimmed and lower-cased; empty is null."""
    return F.nullif(F.lower(F.trim(email)), F.lit(""))


def phone_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHONE_REGIONS, "region string, code string, trunk string, pattern string")


def normalise_phone(df: DataFrame, phone: str, region: str, rules: DataFrame) -> DataFrame:
    """Df with phone_e164, null where the number is not one of its region. rules is a fixed list of a few regions."""
    joined = df.join(F.broadcast(rules.withColumnRenamed("region", "region ")), F.col(region) == F.col("region "), "left")
    digits = F.regexp_replace(F.trim(F.col(phone)), r"[\s().\-]", "")
    national = F.when(digits.startswith(F.concat(F.lit("+"), F.col("code"))), F.substr(digits, F.length("code") + 2)).when(digits.startswith("+"), None).otherwise(
        F.when(digits.startswith(F.col("trunk")), F.substr(digits, F.length("trunk") + 1)).otherwise(digits)
    )
    valid = F.rlike(national, F.concat(F.lit("^"), F.col("pattern"), F.lit("$")))
    return joined.withColumn("phone_e164", F.when(valid, F.concat(F.lit("+"), F.col("code"), national))).drop("region ", "code", "trunk", "pattern")


#: The region of a workspace that names none.
DEFAULT_REGION = "AU"


def phone_region(columns: list[str]) -> Column:
    """The region that a row's telephone number is read by. columns: those that the table has."""
    return F.coalesce(F.col("region"), F.lit(DEFAULT_REGION)) if "region" in columns else F.lit(DEFAULT_REGION)


def phone_e164(phone: Column, region: Column) -> Column:
    """C16 as an expression: the E.164 form of a number read by a region of PHONE_REGIONS, null where it is none of it."""
    digits, out = F.regexp_replace(F.trim(phone), r"[\s().\-]", ""), F.lit(None).cast("string")
    for name, code, trunk, pattern in PHONE_REGIONS:
        own = F.when(digits.startswith("+" + code), F.substr(digits, F.lit(len(code) + 2))).when(digits.startswith("+"), None).when(digits.startswith(trunk), F.substr(digits, F.lit(len(trunk) + 1))).otherwise(digits)
        out = F.when((region == name) & own.rlike(f"^{pattern}$"), F.concat(F.lit("+" + code), own)).otherwise(out)
    return out


def tag_slug(name: Column) -> Column:
    """C17: trimmed, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def coerce_fields(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(contact_id, field_id, kind, value_text, value_number, value_boolean, value_date, error) of values (contact_id, field_id, value) by definitions (field_id, kind, options)."""
    joined = values.join(definitions, "field_id")
    value, kind = F.trim("value"), F.col("kind")
    number = value.try_cast("double")
    date = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
    truth = F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    error = (
        F.when((kind == "text") & (F.length(value) > 2000), "too_long")
        .when((kind == "number") & ~F.coalesce(finite, F.lit(False)), "not_a_number")
        .when((kind == "boolean") & truth.isNull(), "not_a_boolean")
        .when((kind == "date") & date.isNull(), "not_a_date")
        .when((kind == "select") & ~F.coalesce(F.array_contains("options", value), F.lit(False)), "not_an_option")
    )
    ok = error.isNull()
    return joined.select(
        "contact_id", "field_id", "kind",
        F.when(ok & kind.isin("text", "select"), value).alias("value_text"), F.when(ok & (kind == "number"), number).alias("value_number"),
        F.when(ok & (kind == "boolean"), truth).alias("value_boolean"), F.when(ok & (kind == "date"), date).alias("value_date"), error.alias("error"),
    )


#: What a request digest covers, in order.
DIGEST_FIELDS = ["email", "phone", "first_name", "last_name", "source_type", "source_platform", "confidence", "utm_source", "utm_medium", "utm_campaign"]


def request_digest(columns: list[str]) -> Column:
    """C20: SHA-256 of a lead's normalised e-mail and E.164 telephone number, trimmed lower-case names (null: empty), provenance and campaign, nulls kept. columns: those that the table has; the others are null."""
    of = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    name = lambda c: F.lower(F.trim(F.coalesce(of(c), F.lit(""))))
    first = [normalise_email(of("email")), phone_e164(of("phone"), phone_region(columns)), name("first_name"), name("last_name")]
    return F.sha2(F.to_json(F.array(*first, *[of(c) for c in DIGEST_FIELDS[4:]])).cast("binary"), 256)


def subject_hash(scope: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(scope + ":"), value).cast("binary"), 256)


def abuse_signals(trap: Column, elapsed_ms: Column, min_seconds: Column) -> Column:
    """Honeypot if the trap field is filled, too_fast below the least time, else null."""
    return F.when(F.trim(F.coalesce(trap, F.lit(""))) != "", "honeypot").when(elapsed_ms < min_seconds * 1000, "too_fast")


# Parts of key names whose values are never stored.
REDACTED_KEYS = ["password", "token", "secret", "credential", "authorization", "cookie", "apikey", "api_key", "privatekey", "private_key", "session", "hash"]


@F.pandas_udf(StringType())
def _redact(documents: pd.Series) -> pd.Series:
    def walk(x, depth):
        if depth > 4:
            return "[redacted]"
        if isinstance(x, dict):
            return {k: "[redacted]" if k != "sessionId" and any(p in k.lower() for p in REDACTED_KEYS) else walk(v, depth + 1) for k, v in x.items()}
        return [walk(v, depth + 1) for v in x] if isinstance(x, list) else x

    def one(text):
        try:
            return None if text is None else json.dumps(walk(json.loads(text), 0), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return documents.map(one, na_action=None)


def redact_json(df: DataFrame, column: str) -> DataFrame:
    """Nested metadata with sensitive keys and what lies deeper than four levels redacted; what is not JSON becomes null."""
    return df.withColumn(column, _redact(column))
