"""Idempotent ingestion, imports, merges, erasures and retention as table jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attribution import classify_source
from ..functions.identity import DEFAULT_REGION, abuse_signals, normalise_email, request_digest
from ..functions.urls import normalise_origin, origin_allowed
from ..sources.tables import shared_table
from .crm import entry_stage, identity_keys, import_match_count, live_contacts, rows_reached
from .limits import TIERS, rate_limit_verdicts


def oldest_reached(links: DataFrame) -> DataFrame:
    """(id, best) of links (id, parent, best): the least best on the way from each id over parents to its end; a null parent ends it.

    A hop doubles each round, so rounds grow with the logarithm of the longest way; each is written.
    """
    hops = shared_table(links)
    while not hops.where("parent is not null").isEmpty():
        above = hops.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("best").alias("theirs"))
        hops = shared_table(hops.join(above, "parent", "left").select("id", F.col("next").alias("parent"), F.least("best", "theirs").alias("best")))
    return hops.select("id", "best")


def stored_keys(contacts: DataFrame) -> DataFrame:
    """(key, stored): the oldest live contact of each identity key."""
    return identity_keys(live_contacts(contacts)).groupBy(key_name().alias("key")).agg(F.min("id").alias("stored"))


def key_name() -> Column:
    """One text for a key of identity_keys."""
    return F.concat_ws("|", F.col("workspace_id").cast("string"), "kind", "key")


def place_leads(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, outcome, contact_id) of leads taken in the order of their ids, each to the oldest contact, stored or of this batch, that owns one of its keys.

    A key's owner is the contact of the first lead that has it, so a lead's contact is the oldest on the ways from it over
    first leads: what those have stored (key, stored), and they themselves. A first lead has at most one other key, so it has at most
    one way on, and the first leads are a forest, whose ways are walked in doubling hops. No component meets in a task.
    """
    keys = shared_table(identity_keys(fresh).select("id", key_name().alias("key")))
    firsts = keys.groupBy("key").agg(F.min("id").alias("first"))
    led = shared_table(keys.join(firsts, "key").join(stored, "key", "left"))
    # Stored contacts are older than those of the batch; of either kind the smaller id is.
    age = lambda new, k: F.struct(F.lit(new).alias("new"), k.alias("k"))
    own = led.groupBy("id").agg(F.min("stored").alias("stored"), F.max(F.col("first") == F.col("id")).alias("leads"), F.min(F.when(F.col("first") < F.col("id"), F.col("first"))).alias("parent"))
    base = F.when(F.col("stored").isNotNull(), age(1, F.col("stored"))).otherwise(age(2, F.col("id")))
    bases = shared_table(own.select("id", "leads", "parent", base.alias("best")))
    reached = oldest_reached(bases.where("leads").select("id", "parent", "best"))
    through = led.select("id", "first").join(reached.select(F.col("id").alias("first"), F.col("best").alias("theirs")), "first").groupBy("id").agg(F.min("theirs").alias("theirs"))
    found = bases.join(through, "id").select("id", F.least("best", "theirs").alias("best"))
    judged = fresh.select("id").join(found, "id", "left").withColumn("best", F.coalesce("best", age(2, F.col("id"))))
    contact = F.when(F.col("best.new") == 1, F.col("best.k")).otherwise(-F.col("best.k"))
    return judged.select("id", F.when(contact == -F.col("id"), "created").otherwise("matched").alias("outcome"), contact.alias("contact_id"))


def ingest_leads(leads: DataFrame, receipts: DataFrame, contacts: DataFrame | None, always_create: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """L1, L2: (id, outcome, contact_id, digest) of leads (id, workspace_id, source_system, external_key, email, phone, ...).

    A key seen before is a duplicate with its contact, or a conflict if its content differs. Other leads
    are taken in the order of their ids: each joins the oldest contact, stored or of this batch, that has
    its e-mail or telephone number, or else is one itself (place_leads). Ids are above 0; contact ids of new contacts
    are the negated id of their lead. stored (key, stored) may stand for contacts, as stored_keys gives it.
    """
    digested = leads.withColumn("digest", request_digest(leads.columns))
    key = ["workspace_id", "source_system", "external_key"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    known = receipts.select(*key, F.col("digest").alias("old_digest"), F.col("contact_id").alias("old_contact"))
    seen = digested.join(known, key, "left").withColumn("place", first)
    replayed = seen.where("old_digest is not null").select("id", F.when(F.col("digest") == F.col("old_digest"), "duplicate").otherwise("conflict").alias("outcome"), F.when(F.col("digest") == F.col("old_digest"), F.col("old_contact")).alias("contact_id"), "digest")
    fresh = seen.where("old_digest is null and place = 1")
    if always_create:
        placed = fresh.select("id", F.lit("created").alias("outcome"), (-F.col("id")).alias("contact_id"), "digest")
    else:
        placed = fresh.select("id", "digest").join(place_leads(fresh, stored_keys(contacts) if stored is None else stored), "id").select("id", "outcome", "contact_id", "digest")
    firsts = placed.join(seen.where("old_digest is null and place = 1").select("id", *key), "id").select(*key, F.col("contact_id").alias("own"), F.col("digest").alias("first_digest"))
    later = seen.where("old_digest is null and place > 1").join(firsts, key)
    same = F.col("digest") == F.col("first_digest")
    repeats = later.select("id", F.when(same, "duplicate").otherwise("conflict").alias("outcome"), F.when(same, F.col("own")).alias("contact_id"), "digest")
    return replayed.unionByName(placed).unionByName(repeats)


def ingest_batch(leads: DataFrame, receipts: DataFrame, contacts: DataFrame | None, stages: DataFrame | None = None, always_create: bool = False, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """L1: outcomes of leads (see ingest_leads) with the new rows of every table.

    Leads may carry provenance columns, captured_at, and for a deal opportunity_title, value_minor and pipeline_id. Taken leads
    make a touch, a receipt and, with a title, a deal at the entry stage of their pipeline (stages: pipeline_id, stage_id, position,
    category, archived); created ones make a contact. New rows have the id of their lead, contacts its negative.
    """
    outcomes = shared_table(ingest_leads(leads, receipts, contacts, always_create, stored))
    taken = leads.join(outcomes.where(F.col("outcome").isin("created", "matched")).select("id", "outcome", "contact_id", "digest"), "id")
    has = lambda c: F.col(c) if c in leads.columns else F.lit(None).cast("string")
    people = ["first_name", "last_name", "email", "phone", "company_name", *(["region"] if "region" in leads.columns else [])]
    source = ["source_type", "source_platform", "confidence", "utm_source", "utm_medium", "utm_campaign", "gclid", "fbclid", "referrer", "landing_path", "captured_at"]
    new_contacts = taken.where("outcome = 'created'").select(F.col("contact_id").alias("id"), "workspace_id", *[has(c).alias(c) for c in people])
    touches = taken.select("id", "workspace_id", "contact_id", *[has(c).alias(c) for c in source])
    written = taken.select("workspace_id", "source_system", "external_key", "digest", "contact_id", F.col("id").alias("touch_id"), F.when(has("opportunity_title").isNotNull(), F.col("id")).alias("opportunity_id"))
    asked = taken.where(has("opportunity_title").isNotNull()).select("id", "workspace_id", "contact_id", F.col("id").alias("touch_id"), has("opportunity_title").alias("title"), has("value_minor").cast("long").alias("value_minor"), has("pipeline_id").alias("pipeline_id"), F.lit("open").alias("status"))
    deals = asked.withColumn("stage_id", F.lit(None).cast("string")) if stages is None else asked.join(entry_stage(stages).select("pipeline_id", "stage_id"), "pipeline_id", "left")
    said = lambda rows, kind, detail, place: rows.select((F.col("id").cast("string") if place else F.abs("id").cast("string")).alias("lead"), "contact_id", F.lit(kind).alias("kind"), detail.alias("detail"))
    nothing = F.lit(None).cast("string")
    changes = said(new_contacts.withColumn("contact_id", F.col("id")), "contact_created", nothing, False)
    changes = changes.unionByName(said(touches, "touch_captured", F.col("source_type"), True)).unionByName(said(deals, "deal_created", F.col("title"), True))
    activities = derive_activities(changes.select(F.concat_ws(":", "kind", "lead").alias("id"), "contact_id", "kind", "detail"))
    return {"outcomes": outcomes, "contacts": new_contacts, "touches": touches, "opportunities": deals, "receipts": written, "activities": activities}


def submission_gate(submissions: DataFrame) -> DataFrame:
    """L3: submissions with rejection_reason, the first of: not accepting, origin, rate, honeypot or too fast, challenge, missing values, no identity."""
    signal = abuse_signals(F.col("trap"), F.col("elapsed_ms"), F.col("min_seconds"))
    reason = (
        F.when(~F.col("accepting"), "form_not_accepting").when(~F.col("origin_ok"), "origin_not_allowed").when(F.col("rate_rejected"), "rate_limited")
        .when(signal.isNotNull(), signal).when(~F.col("challenge_ok"), "challenge_failed").when(F.col("missing_required") > 0, "validation_failed")
        .when(normalise_email(F.col("email")).isNull() & F.nullif(F.trim("phone"), F.lit("")).isNull(), "identity_missing")
    )
    return submissions.withColumn("rejection_reason", reason)


def map_form_values(submissions: DataFrame, fields: DataFrame) -> DataFrame:
    """L4: (id, first_name, last_name, email, phone, company_name, note, custom, missing) of submissions (id, form_id, values map) by fields (form_id, key, label, target, position, max_length, kind, required, options).

    Values are trimmed and cut; a checked box is 'Yes'; a required field without a value, and a choice that is not offered, are missing. Targets 'custom:x' make
    the map custom; notes become 'label: value' in order, 255 characters at most.
    """
    raw = F.substr(F.trim(F.coalesce(F.col("values")[F.col("key")], F.lit(""))), F.lit(1), F.col("max_length"))
    shown = F.when(F.col("kind") == "checkbox", F.when(F.lower(raw).isin("true", "on", "yes"), "Yes").otherwise("")).otherwise(raw)
    each = submissions.join(fields, "form_id").select("id", "key", "target", "position", "label", "required", "kind", "options", shown.alias("value"))
    odd = (F.col("kind") == "select") & (F.col("value") != "") & ~F.coalesce(F.array_contains("options", F.col("value")), F.lit(True))
    absent = (F.col("required") & (F.col("value") == "")) | odd
    marked = each.withColumn("missing ", absent).withColumn("given ", F.when(~absent & (F.col("value") != ""), F.col("value")))
    # Of two fields with one target the later one counts.
    of = lambda t: F.max(F.when((F.col("target") == t) & F.col("given ").isNotNull(), F.struct("position", F.col("given ").alias("value"))))["value"].alias(t)
    note = F.when((F.col("target") == "note") & F.col("given ").isNotNull(), F.struct("position", F.concat_ws(": ", "label", "given ").alias("text")))
    custom = F.when(F.col("target").startswith("custom:") & F.col("given ").isNotNull(), F.struct(F.substr("target", F.lit(8)).alias("key"), F.col("given ").alias("value")))
    return marked.groupBy("id").agg(
        *[of(t) for t in ("first_name", "last_name", "email", "phone", "company_name")],
        F.nullif(F.substring(F.array_join(F.array_sort(F.collect_list(note))["text"], " · "), 1, 255), F.lit("")).alias("note"),
        F.map_from_entries(F.array_sort(F.collect_list(custom))).alias("custom"),
        F.array_sort(F.collect_list(F.when(F.col("missing "), F.col("key")))).alias("missing"),
    )


def deal_title(template: Column, contact: Column, form: Column, company: Column) -> Column:
    """L4: a deal's title from its template, 200 characters at most; without a name 'Website visitor', without anything 'Website enquiry'."""
    named = F.replace(template, F.lit("{contact}"), F.coalesce(F.nullif(contact, F.lit("")), F.lit("Website visitor")))
    filled = F.replace(F.replace(named, F.lit("{form}"), form), F.lit("{company}"), F.coalesce(company, F.lit("")))
    return F.coalesce(F.nullif(F.substring(F.trim(filled), 1, 200), F.lit("")), F.lit("Website enquiry"))


def process_submissions(submissions: DataFrame, forms: DataFrame, fields: DataFrame, receipts: DataFrame, contacts: DataFrame | None, app_url: str, tiers: list | None = None, earlier: DataFrame | None = None, stored: Callable[[DataFrame], DataFrame] | None = None, settled: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """L3: public submissions (id, form_id, submission_id, origin, ip, ts, trap, elapsed_ms, challenge_ok, values, and the context columns of C11) run through every gate, mapped and ingested.

    forms: (form_id, workspace_id, name, status, allowed_origins, honeypot, min_seconds, title_template or null for no deal, pipeline_id, value_minor). Besides what
    ingest_batch returns, 'submissions' has a row for every submission: outcome (created, matched, duplicate or rejected), rejection_reason and contact_id.
    A key that comes back with other content is rejected as validation_failed. earlier: hits (id, subject, form, ts) that count against
    the limits before these; 'hits' has those of this batch, 'leads' what has passed the gates. stored and settled may stand for contacts and receipts: given
    the leads, they find the owners of their keys (key, stored), and their receipts.
    """
    known = submissions.join(forms, "form_id").withColumn("accepting", F.col("status") == "active")
    own = normalise_origin(F.lit(app_url)).eqNullSafe(normalise_origin(F.col("origin")))
    known = known.withColumn("origin_ok", own | origin_allowed(F.col("origin"), F.col("allowed_origins")))
    # Only what has come this far counts against the limits.
    hits = known.where("accepting and origin_ok").select("id", F.col("ip").alias("subject"), F.col("form_id").alias("form"), "ts")
    counted = hits if earlier is None else hits.unionByName(earlier.join(hits.select("id"), "id", "left_anti").select(hits.columns))
    limited = rate_limit_verdicts(counted, tiers=tiers or TIERS).where("rejected_by is not null").select("id", F.lit(True).alias("rate_rejected"))
    mapped = map_form_values(known.select("id", "form_id", "values"), fields)
    full = known.drop("values").join(limited, "id", "left").join(mapped, "id", "left").na.fill(False, ["rate_rejected"])
    full = full.withColumn("trap", F.when(F.col("honeypot"), F.col("trap"))).withColumn("missing_required", F.coalesce(F.size("missing"), F.lit(0)))
    judged = shared_table(classify_source(submission_gate(full)))
    name = F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit("")))
    leads = judged.where("rejection_reason is null").select(
        "id", "workspace_id", F.lit("public_form").alias("source_system"), F.concat_ws(":", "form_id", "submission_id").alias("external_key"),
        F.coalesce("first_name", F.lit("Website enquiry")).alias("first_name"), "last_name", "email", "phone", "company_name", *(["region"] if "region" in judged.columns else []),
        "source_type", "source_platform", "confidence", "utm_source", "utm_medium", "utm_campaign", "gclid", "fbclid", "referrer", F.col("ts").alias("captured_at"),
        F.when(F.col("title_template").isNotNull(), deal_title(F.col("title_template"), name, F.col("name"), F.col("company_name"))).alias("opportunity_title"), "pipeline_id", "value_minor",
    )
    out = ingest_batch(leads, receipts if settled is None else settled(leads), contacts, stored=None if stored is None else stored(leads))
    out |= {"hits": hits, "leads": leads}
    done = judged.select("id", "form_id", "rejection_reason").join(out["outcomes"].select("id", F.col("outcome").alias("taken"), "contact_id"), "id", "left")
    refused = F.col("rejection_reason").isNotNull() | (F.col("taken") == "conflict")
    out["submissions"] = done.select("id", "form_id", F.when(refused, "rejected").otherwise(F.col("taken")).alias("outcome"), F.coalesce("rejection_reason", F.when(F.col("taken") == "conflict", "validation_failed")).alias("rejection_reason"), "contact_id")
    return out


def prepare_import(rows: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid, issues (row_number, rule)) of imported rows with row_number; the first header of each field counts, 'ignore' is dropped, values never appear in issues."""
    first: dict[str, str] = {}
    for header, field in mapping.items():
        if field != "ignore":
            first.setdefault(field, header)
    named = rows.select("row_number", *[F.nullif(F.trim(f"`{h}`"), F.lit("")).alias(f) for f, h in first.items()])
    for field in ("first_name", "email", "phone"):
        if field not in named.columns:
            named = named.withColumn(field, F.lit(None).cast("string"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("first_name").isNull(), "first_name_missing"), F.when(F.col("email").isNull() & F.col("phone").isNull(), "identity_missing"),
            F.when(F.col("email").isNotNull() & ~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email_invalid"),
        )
    )
    judged = named.withColumn("rules", rules).withColumn("source_type", F.lit("import")).withColumn("confidence", F.lit("manual"))
    return judged.where(F.size("rules") == 0).drop("rules"), judged.select("row_number", F.explode("rules").alias("rule"))


def validate_import(rows: DataFrame, mapping: dict[str, str], contacts: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """Total, valid, issues and known keys of an import, nothing written."""
    valid, issues = prepare_import(rows, mapping)
    of_one = {"workspace_id": F.lit(0), "region": F.lit(region)}
    known = import_match_count(valid.withColumns({"id": F.col("row_number")} | of_one), contacts.withColumns(of_one))
    parts = [rows.agg(F.count("*").alias("n")).withColumn("what", F.lit("total")), valid.agg(F.count("*").alias("n")).withColumn("what", F.lit("valid")), issues.agg(F.count("*").alias("n")).withColumn("what", F.lit("issues")), known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("what", F.lit("matches"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def run_import(rows: DataFrame, mapping: dict[str, str], receipts: DataFrame, contacts: DataFrame, workspace: int, batch: str, region: str = DEFAULT_REGION) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(status (batch, imported, matched, failed, status), new rows) of an import: sound rows are ingested under the key import:<batch>:<row>, so a repeated run adds nothing; a row with issues, or a conflict, has failed."""
    valid, issues = prepare_import(rows, mapping)
    leads = valid.withColumnRenamed("row_number", "id").withColumn("workspace_id", F.lit(workspace)).withColumn("region", F.lit(region)).withColumn("source_system", F.lit("import")).withColumn("external_key", F.concat_ws(":", F.lit("import"), F.lit(batch), F.col("id").cast("string")))
    made = ingest_batch(leads, receipts, contacts)
    outcomes = made["outcomes"].select(F.lit(batch).alias("batch"), "outcome").unionByName(issues.select("row_number").distinct().select(F.lit(batch).alias("batch"), F.lit("failed").alias("outcome")))
    return import_status(outcomes), made


def import_status(outcomes: DataFrame) -> DataFrame:
    """Imported, matched and failed rows of each batch and its status."""
    counted = outcomes.groupBy("batch").agg(F.count_if(F.col("outcome") == "created").alias("imported"), F.count_if(F.col("outcome").isin("matched", "duplicate")).alias("matched"), F.count_if(F.col("outcome").isin("failed", "conflict")).alias("failed"))
    return counted.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("imported") + F.col("matched") > 0, "partial").otherwise("failed"))


def merge_field_diff(pairs: DataFrame, contacts: DataFrame, fields: list[str]) -> DataFrame:
    """(survivor, duplicate, field, kind): conflicts where both have different values, fills where only the duplicate has one."""
    left = contacts.select(F.col("id").alias("survivor"), *[F.col(f).alias(f"own {f}") for f in fields])
    right = contacts.select(F.col("id").alias("duplicate"), *[F.col(f).alias(f"their {f}") for f in fields])
    joined = pairs.join(left, "survivor").join(right, "duplicate")
    kinds = [F.struct(F.lit(f).alias("field"), F.when(F.col(f"their {f}").isNotNull() & F.col(f"own {f}").isNull(), "fill").when(F.col(f"own {f}") != F.col(f"their {f}"), "conflict").alias("kind")) for f in fields]
    return joined.select("survivor", "duplicate", F.explode(F.array(*kinds)).alias("x")).select("survivor", "duplicate", "x.field", "x.kind").where("kind is not null")


def apply_merges(contacts: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], requests: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Snapshots after merging requests (survivor, duplicate); children name their unique columns (besides contact_id), where the survivor's own row wins.

    Requests for contacts that are merged or erased already, or for a contact itself, are left out.
    """
    live = live_contacts(contacts).select("id")
    sound = requests.where("survivor <> duplicate").join(live.withColumnRenamed("id", "survivor"), "survivor", "left_semi").join(live.withColumnRenamed("id", "duplicate"), "duplicate", "left_semi")
    place = F.row_number().over(Window.partitionBy("duplicate").orderBy("survivor"))
    moves = sound.withColumn("place", place).where("place = 1").select(F.col("duplicate").alias("from_id"), F.col("survivor").alias("to_id"))
    joined = contacts.join(moves, F.col("id") == F.col("from_id"), "left")
    after = joined.withColumn("merged_into", F.coalesce("to_id", "merged_into")).withColumn("is_merged", F.col("is_merged") | F.col("to_id").isNotNull()).select(contacts.columns)
    out = {}
    for name, (df, unique) in children.items():
        moved = df.join(moves, F.col("contact_id") == F.col("from_id"), "left").withColumn("moved", F.col("to_id").isNotNull()).withColumn("contact_id", F.coalesce("to_id", "contact_id"))
        if unique:
            rank = F.row_number().over(Window.partitionBy("contact_id", *unique).orderBy("moved", "from_id"))
            moved = moved.withColumn("rank", rank).where("rank = 1")
        out[name] = moved.select(df.columns)
    return after, out


def merge_blockers(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """(survivor, duplicate, blocker) of requests that cannot be carried out: the contact itself, an unknown contact, another workspace, or one that is archived, merged or erased."""
    of = lambda side: contacts.select(F.col("id").alias(side), F.struct("workspace_id", "is_deleted", "is_merged", "is_erased").alias(f"{side} row"))
    joined = requests.join(of("survivor"), "survivor", "left").join(of("duplicate"), "duplicate", "left")
    a, b = F.col("survivor row"), F.col("duplicate row")
    either = lambda c: F.coalesce(a[c], F.lit(False)) | F.coalesce(b[c], F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(F.col("survivor") == F.col("duplicate"), "same_contact"), F.when(a.isNull() | b.isNull(), "not_found"), F.when(a["workspace_id"] != b["workspace_id"], "other_workspace"),
            F.when(either("is_erased"), "erased"), F.when(either("is_merged"), "merged"), F.when(F.coalesce(a["is_deleted"], F.lit(False)), "survivor_archived"),
        )
    )
    return joined.select("survivor", "duplicate", F.explode(found).alias("blocker"))


def apply_erasures(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, log) after erasing requests (id); contacts that are unknown, erased or merged already are left out.

    tables: contacts, and any of touches, opportunities, tasks, activities, fields, tags. Names become 'Erased contact', identifiers and click ids null; a touch
    keeps its channel; deals, tasks and activities lose their words, the last two also where only the contact's deal, or for activities its touch, is named; field
    values and tags go. The log has a row for each contact with how many rows of each table it touched.
    """
    contacts = tables["contacts"]
    wanted = requests.select(F.col("id").alias("gone")).distinct().join(contacts.where("not is_erased and not is_merged").select(F.col("id").alias("gone")), "gone", "left_semi")
    wanted = shared_table(wanted)
    out, counted = {}, [wanted.select("gone", F.lit(None).cast("string").alias("table "))]
    opportunities, touches = tables.get("opportunities"), tables.get("touches")
    words = {
        "touches": dict.fromkeys(["gclid", "fbclid", "referrer", "channel_detail", "metadata"]), "opportunities": {"title": "Erased opportunity"},
        "tasks": {"title": "Erased task", "description": None}, "activities": {"summary": "Details erased", "detail": None, "metadata": None},
    }
    marked = contacts.join(wanted, F.col("id") == F.col("gone"), "left")
    hit = F.col("gone").isNotNull()
    erased = {"first_name": "Erased contact" if "last_name" not in contacts.columns else "Erased", "last_name": "contact", "email": None, "phone": None}
    out["contacts"] = marked.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in erased.items() if c in contacts.columns} | {"is_erased": F.col("is_erased") | hit}).select(contacts.columns)
    for name, df in tables.items():
        if name == "contacts":
            continue
        if name in ("tasks", "activities") and opportunities is not None:
            reached = rows_reached(df, wanted, opportunities, touches if name == "activities" and "touch_id" in df.columns else None)
        elif name in ("fields", "tags"):
            reached = df.select(F.col("contact_id").alias("gone")).join(wanted, "gone", "left_semi")
            out[name] = df.join(wanted, F.col("contact_id") == F.col("gone"), "left_anti")
        else:
            reached = df.select("id", F.col("contact_id").alias("gone")).join(wanted, "gone", "left_semi")
        if name in words:
            changed = df.join(reached.select("id", F.lit(True).alias("hit ")).distinct(), "id", "left")
            out[name] = changed.withColumns({c: F.when(F.col("hit ").isNull(), F.col(c)).otherwise(F.lit(v)) for c, v in words[name].items() if c in df.columns}).select(df.columns)
        counted.append(reached.select("gone", F.lit(name).alias("table ")))
    # All tables are counted in one aggregate, so that a task holds one row for each of its contacts instead of a sort and a join for each table.
    log = reduce(DataFrame.unionAll, counted).groupBy(F.col("gone").alias("id")).agg(F.count("*").alias("all "), *[F.count_if(F.col("table ") == name).alias(name) for name in tables if name != "contacts"])
    return out, log.drop("all ")


def retention_rules(now: str) -> dict[str, Column]:
    """What has expired: sessions past their idle or absolute end, reset tokens that have ended or were used more than their own lifetime ago, rate windows that began over 24 hours ago."""
    at = F.lit(now).cast("timestamp")
    lifetime = F.col("expires_at") - F.col("created_at")
    return {
        "sessions": (F.col("idle_expires_at") <= at) | (F.col("absolute_expires_at") <= at),
        "reset_tokens": (F.col("expires_at") <= at) | F.coalesce(F.col("used_at") + lifetime < at, F.lit(False)),
        "rate_windows": F.col("window_start") < at - F.expr("interval 24 hours"),
    }


def apply_retention(df: DataFrame, expired: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, count of dropped rows) under one of retention_rules; a condition that is null keeps its row."""
    gone = F.coalesce(expired, F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("dropped"))


def derive_activities(changes: DataFrame) -> DataFrame:
    """A timeline row (id, contact_id, type, summary) for every change (id, contact_id, kind, detail)."""
    kinds = {"contact_created": "Contact created", "stage_changed": "Moved to ", "won": "Deal won", "lost": "Deal lost", "merged": "Merged", "touch_captured": "Captured from ", "deal_created": "Deal opened: "}
    summary = F.coalesce(*[F.when(F.col("kind") == k, F.concat(F.lit(v), F.when(F.lit(v).endswith(" "), F.coalesce("detail", F.lit("unknown"))).otherwise(""))) for k, v in kinds.items()], F.col("kind"))
    return changes.select("id", "contact_id", F.col("kind").alias("type"), summary.alias("summary"))
