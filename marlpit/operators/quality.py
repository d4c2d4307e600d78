"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q1, Q2: how many rows break each rule; a rule that is null counts as kept."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Q3: the keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_tenant_refs(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Q4: children whose parent is in another workspace, by pair of workspaces."""
    up = parent.select(F.col("id").alias(key), F.col("workspace_id").alias("parent_workspace"))
    return child.join(up, key).where("workspace_id <> parent_workspace").groupBy("workspace_id", "parent_workspace").agg(F.count("*").alias("n"))


def attribution_violations(events: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, violation) of events (id, output_id, outcome, contact_id) whose output is missing or unpublished, or whose outcome lacks its contact."""
    known = outputs.select(F.col("id").alias("output_id"), "published")
    joined = events.join(known, "output_id", "left")
    violation = F.when(F.col("published").isNull(), "missing_output").when(~F.col("published"), "unpublished_output").when((F.col("outcome") == "lead") & F.col("contact_id").isNull(), "outcome_without_contact")
    return joined.select("id", violation.alias("violation")).where("violation is not null")


def outcome_violations(events: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, violation) of events (id, output_id, outcome, contact_id, acquisition_id, opportunity_id): those of attribution_violations, and outcomes that name another record than their own, or more than it, or that are unknown."""
    own = {"contact_created": "contact_id", "acquisition_recorded": "acquisition_id", "opportunity_created": "opportunity_id", "opportunity_stage_changed": "opportunity_id", "opportunity_won": "opportunity_id"}
    named = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in ("contact_id", "acquisition_id", "opportunity_id")]))
    right = F.lit(False)
    for outcome, column in own.items():
        right = F.when(F.col("outcome") == outcome, named == F.array(F.lit(column))).otherwise(right)
    unpublished = attribution_violations(events.withColumn("outcome", F.lit(None).cast("string")), outputs)
    return unpublished.unionByName(events.where(~right).select("id", F.lit("target_contradicts_outcome").alias("violation")))


def immutability_violations(before: DataFrame, after: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """(key, field) of protected fields that differ between two snapshots; a vanished row is '(row)'."""
    later = after.select(F.col(key), *[F.col(c).alias(f"after {c}") for c in protected], F.lit(True).alias("there"))
    joined = before.join(later, key, "left")
    changed = F.array_compact(F.array(F.when(F.col("there").isNull(), "(row)"), *[F.when(F.col("there") & ~F.col(c).eqNullSafe(F.col(f"after {c}")), c) for c in protected]))
    return joined.select(key, F.explode(changed).alias("field"))


def archive_blockers(contacts: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Contacts that hold open deals."""
    return contacts.join(opportunities.where("status = 'open'").select(F.col("contact_id").alias("id")), "id", "left_semi")


def stage_blockers(stages: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Stages (workspace_id, stage) that still hold deals, with how many."""
    held = opportunities.groupBy("workspace_id", "stage").agg(F.count("*").alias("deals"))
    return stages.join(held, ["workspace_id", "stage"])


def crawl_rules() -> dict[str, Column]:
    """Q1: crawls (status, started_at, completed_at, failure_category, page_limit, max_depth and six counters)."""
    status, ended = F.col("status"), F.col("completed_at").isNotNull()
    counters = [F.col(c) >= 0 for c in ("pages_discovered", "pages_fetched", "pages_failed", "pages_skipped", "bytes_downloaded", "sitemap_url_count")]
    return {
        "budget_out_of_bounds": F.col("page_limit").between(1, 10_000) & F.col("max_depth").between(1, 20),
        "ended_without_completed_at": (status.isin("completed", "failed", "cancelled") & ended) | status.isin("queued", "running"),
        "running_without_started_at": (status == "queued") | F.col("started_at").isNotNull(),
        "failed_without_category": (status != "failed") | F.col("failure_category").isNotNull(),
        "counter_below_zero": all_of(counters),
    }


def frontier_rules() -> dict[str, Column]:
    """Q1: frontier rows (state, skip_reason, depth, attempts): a skipped row has a reason and no other has one."""
    return {"skip_reason_contradicts_state": (F.col("state") == "skipped") == F.col("skip_reason").isNotNull(), "depth_or_attempts_out_of_bounds": F.col("depth").between(0, 20) & F.col("attempts").between(0, 10)}


def crawl_page_rules() -> dict[str, Column]:
    """Q1: observed pages (outcome, failure_category, http_status, normalised_url, title, meta_description, h1_text, canonical_url)."""
    bounds = {"title": 1000, "meta_description": 2000, "h1_text": 1000, "canonical_url": 2048, "normalised_url": 2048}
    bounded = [F.col(c).isNull() | (F.length(c) <= most) for c, most in bounds.items()]
    return {
        "failure_without_category": ~F.col("outcome").isin("blocked", "failed") | F.col("failure_category").isNotNull(),
        "http_status_implausible": F.col("http_status").isNull() | F.col("http_status").between(100, 599),
        "text_out_of_bounds": all_of([*bounded, F.col("normalised_url") != ""]),
    }


def crawl_site_rules() -> dict[str, Column]:
    """Q1: sites (verification_state, verified_at, verification_method and the four limits of a crawl)."""
    verified, at = F.col("verification_state") == "verified", F.col("verified_at").isNotNull()
    limits = {"crawl_page_limit": (1, 10_000), "crawl_max_depth": (1, 20), "crawl_concurrency": (1, 4), "crawl_delay_ms": (0, 60_000)}
    return {"verification_contradicts_state": (verified & at & F.col("verification_method").isNotNull()) | (~verified & ~at), "crawl_budget_out_of_bounds": all_of([F.col(c).between(*b) for c, b in limits.items()])}


def link_rules() -> dict[str, Column]:
    """Q1: the words of a link have 300 characters at most."""
    return {"anchor_text_too_long": F.length("anchor_text") <= 300}


def site_page_rules() -> dict[str, Column]:
    """Q1: lasting pages (normalised_url, first_seen_at, last_seen_at)."""
    return {"page_url_out_of_bounds": (F.col("normalised_url") != "") & (F.length("normalised_url") <= 2048), "seen_range_reversed": F.col("last_seen_at") >= F.col("first_seen_at")}


def all_of(rules: list[Column]) -> Column:
    out = F.lit(True)
    for rule in rules:
        out = out & rule
    return out


def contact_rules() -> dict[str, Column]:
    """Q2: contacts (id, merged_at, merged_into)."""
    return {"merge_incomplete": F.col("merged_at").isNull() == F.col("merged_into").isNull(), "merged_into_itself": F.col("merged_into") != F.col("id")}


def field_value_rules() -> dict[str, Column]:
    """Q2: exactly one typed value."""
    given = sum(F.col(c).isNotNull().cast("int") for c in ("value_text", "value_number", "value_boolean", "value_date"))
    return {"not_one_value": given == 1}


def submission_rules() -> dict[str, Column]:
    """Q2: a rejected submission names no records, any other names a contact and a touch."""
    none, both = F.col("contact_id").isNull() & F.col("touch_id").isNull(), F.col("contact_id").isNotNull() & F.col("touch_id").isNotNull()
    return {"outcome_contradicts_records": F.when(F.col("outcome") == "rejected", none).otherwise(both)}


def site_rules() -> dict[str, Column]:
    """Q2: an origin is scheme, host and port; a public key is 32 hexadecimal digits."""
    return {"origin_is_none": F.col("origin").rlike(r"^https?://[a-z0-9.-]+(:[0-9]{1,5})?$"), "key_is_weak": F.col("public_key").rlike("^[0-9a-f]{32}$")}


def finding_rules() -> dict[str, Column]:
    """Q2: evidence is a JSON object with something in it, of 4096 bytes at most."""
    keys = F.json_object_keys("evidence")
    return {"evidence_is_no_object": F.coalesce(F.size(keys) > 0, F.lit(False)), "evidence_too_long": F.octet_length("evidence") <= 4096}


def publish_violations(fields: DataFrame) -> DataFrame:
    """(form_id, violation) of form versions by their fields (form_id, key, target)."""
    grouped = fields.groupBy("form_id").agg(
        F.bool_or(F.col("target").isin("email", "phone")).alias("reachable"), F.bool_or(F.col("target") == "first_name").alias("named"),
        F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.count("target").alias("mapped"), F.countDistinct("target").alias("targets"),
    )
    found = F.array_compact(F.array(F.when(~F.col("reachable"), "no_identity"), F.when(~F.col("named"), "no_first_name"), F.when(F.col("mapped") > F.col("targets"), "target_mapped_twice"), F.when(F.col("n") > F.col("keys"), "key_repeats")))
    return grouped.select("form_id", F.explode(found).alias("violation"))
