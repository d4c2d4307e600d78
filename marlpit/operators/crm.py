"""Contact, deal, task and form reports over every workspace at once."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import normalise_email, phone_e164, phone_region, tag_slug
from ..sources.tables import like_literal, shared_table


def contains_search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """rows with the literal term in any column, ignoring case."""
    return df.where(like_literal(columns, term))


def apply_filters(df: DataFrame, due_before: str | None = None, **equal) -> DataFrame:
    """every filter that is given must hold."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.where(F.col("due_at") < F.lit(due_before).cast("timestamp")) if due_before else df


def filter_first_touch_source(contacts: DataFrame, classified: DataFrame, source_type: str) -> DataFrame:
    """contacts with a touch of the type among their earliest touches; ties count."""
    first = classified.groupBy("contact_id").agg(F.min("captured_at").alias("captured_at"))
    hits = classified.where(F.col("source_type") == source_type).join(first, ["contact_id", "captured_at"], "left_semi").select(F.col("contact_id").alias("id"))
    return contacts.join(hits, "id", "left_semi")


def overdue(tasks: DataFrame, now: str) -> DataFrame:
    """open tasks whose due date has passed."""
    return tasks.where(is_overdue(now))


def is_overdue(now: str) -> Column:
    return (F.col("status") == "open") & F.coalesce(F.col("due_at") < F.lit(now).cast("timestamp"), F.lit(False))


def live_contacts(contacts: DataFrame) -> DataFrame:
    """neither archived, merged nor erased."""
    return contacts.where("not is_deleted and not is_merged and not is_erased")


def tenant_scope(df: DataFrame, workspace) -> DataFrame:
    """rows of one workspace; a null workspace has none."""
    return df.where(F.col("workspace_id") == F.lit(workspace))


def contact_view(contacts: DataFrame) -> DataFrame:
    """the display name of each contact."""
    return contacts.select("id", "workspace_id", F.concat_ws(" ", F.trim("first_name"), F.concat(F.lit("("), F.col("company"), F.lit(")"))).alias("display_name"))


def task_view(tasks: DataFrame, now: str) -> DataFrame:
    """tasks as they are listed: state, priority, due day and whether it has passed."""
    return tasks.select("id", "contact_id", "opportunity_id", "status", "priority", F.to_date("due_at").cast("string").alias("due_on"), is_overdue(now).alias("is_overdue"))


def opportunity_view(opportunities: DataFrame) -> DataFrame:
    """deals with their value in whole units and whether they are closed."""
    return opportunities.select("id", "contact_id", "stage", "status", "value_minor", F.floor(F.col("value_minor") / 100).alias("value"), (F.col("status") != "open").alias("is_closed"))


def tag_view(tags: DataFrame) -> DataFrame:
    """tags with the slug they are told apart by."""
    return tags.select("tag_id", F.trim("name").alias("name"), tag_slug(F.col("name")).alias("slug"))


def first_touch(touches: DataFrame) -> DataFrame:
    """The earliest touch of each contact, ties to the smaller id."""
    return flag_first_touch(touches).where("is_first_touch").drop("is_first_touch")


def flag_first_touch(touches: DataFrame) -> DataFrame:
    """is_first_touch on every touch."""
    place = F.row_number().over(Window.partitionBy("contact_id").orderBy("captured_at", "id"))
    return touches.withColumn("is_first_touch", place == 1)


def touch_history(touches: DataFrame, column: str) -> DataFrame:
    """(contact_id, history): a column's values in the order of capture."""
    ordered = F.array_sort(F.collect_list(F.struct("captured_at", "id", F.col(column).alias("value"))))
    return touches.groupBy("contact_id").agg(F.transform(ordered, lambda t: F.coalesce(t["value"].cast("string"), F.lit("-"))).alias("history"))


def entry_stage(stages: DataFrame) -> DataFrame:
    """The first open, unarchived stage of each pipeline by position."""
    place = F.row_number().over(Window.partitionBy("pipeline_id").orderBy("position", "stage_id"))
    return stages.where("category = 'open' and not archived").withColumn("place", place).where("place = 1").drop("place")


def form_version_state(versions: DataFrame) -> DataFrame:
    """(form_id, newest, published, next_version) of versions (form_id, version, is_published)."""
    return versions.groupBy("form_id").agg(F.max("version").alias("newest"), F.max(F.when(F.col("is_published"), F.col("version"))).alias("published"), (F.max("version") + 1).alias("next_version"))


def stage_totals(opportunities: DataFrame) -> DataFrame:
    """A1: deals and value of each stage of each workspace, whatever their status."""
    return opportunities.groupBy("workspace_id", "stage").agg(F.count("*").alias("deals"), F.coalesce(F.sum("value_minor"), F.lit(0)).alias("value_minor"))


def pipeline_board(stages: DataFrame, opportunities: DataFrame) -> DataFrame:
    """A2: every stage (workspace_id, stage, position) in its place, with zeros where it is empty."""
    joined = stages.join(stage_totals(opportunities), ["workspace_id", "stage"], "left")
    return joined.select("workspace_id", "stage", "position", F.coalesce("deals", F.lit(0)).alias("deals"), F.coalesce("value_minor", F.lit(0)).alias("value_minor"))


def pipeline_summary(opportunities: DataFrame) -> DataFrame:
    """A3: open deals and their value, and all deals, of each workspace."""
    is_open = F.col("status") == "open"
    return opportunities.groupBy("workspace_id").agg(F.count_if(is_open).alias("open_deals"), F.coalesce(F.sum(F.when(is_open, F.col("value_minor"))), F.lit(0)).alias("open_value_minor"), F.count("*").alias("deals"))


def pipeline_stage_rows(opportunities: DataFrame, stages: DataFrame) -> DataFrame:
    """A3: (workspace_id, stage, category, deals, value_minor, open_deals, open_value_minor): every stage (workspace_id, stage, category), zeros kept; the last two are summed over the workspace's stages of the open category."""
    rows = stages.join(stage_totals(opportunities), ["workspace_id", "stage"], "left").na.fill(0, ["deals", "value_minor"])
    whole, is_open = Window.partitionBy("workspace_id"), F.col("category") == "open"
    summed = lambda c: F.coalesce(F.sum(F.when(is_open, F.col(c))).over(whole), F.lit(0))
    return rows.select("workspace_id", "stage", "category", "deals", "value_minor", summed("deals").alias("open_deals"), summed("value_minor").alias("open_value_minor"))


def open_value_by_source(opportunities: DataFrame, first: DataFrame) -> DataFrame:
    """A4: open value by the source of the contact's first touch; without one, 'Not recorded'."""
    open_deals = opportunities.where("status = 'open'").select("contact_id", "value_minor")
    joined = open_deals.join(first.select("contact_id", "source_type"), "contact_id", "left")
    return joined.groupBy(F.coalesce("source_type", F.lit("Not recorded")).alias("source")).agg(F.count("*").alias("deals"), F.sum("value_minor").alias("value_minor"))


def growth_snapshot(contacts: DataFrame, opportunities: DataFrame, tasks: DataFrame, touches: DataFrame, now: str, days: int = 30) -> DataFrame:
    """A5: new contacts (created_at) and qualified leads (captured_at of touches with qualified_at) of the last days, open deals and value, open and overdue tasks of each workspace, zeros kept."""
    since = F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval({days})")
    homes = contacts.select(F.col("id").alias("contact_id"), "workspace_id")
    people = contacts.groupBy("workspace_id").agg(F.count_if(F.col("created_at") >= since).alias("new_contacts"))
    leads = touches.where(F.col("qualified_at").isNotNull() & (F.col("captured_at") >= since)).groupBy("contact_id").agg(F.count("*").alias("qualified_leads"))
    leads = leads.join(homes, "contact_id").groupBy("workspace_id").agg(F.sum("qualified_leads").alias("qualified_leads"))
    deals = pipeline_summary(opportunities).drop("deals")
    work = tasks.groupBy("contact_id").agg(F.count_if(F.col("status") == "open").alias("open_tasks"), F.count_if(is_overdue(now)).alias("overdue_tasks"))
    work = work.join(homes, "contact_id").groupBy("workspace_id").agg(F.sum("open_tasks").alias("open_tasks"), F.sum("overdue_tasks").alias("overdue_tasks"))
    out = people.join(leads, "workspace_id", "left").join(deals, "workspace_id", "left").join(work, "workspace_id", "left")
    return out.na.fill(0)


# Key, column of the snapshot, label, unit and polarity of each metric.
METRICS = [
    ("new_contacts", "new_contacts", "New contacts", "count", "higher_is_better"),
    ("qualified_leads", "qualified_leads", "Qualified leads", "count", "higher_is_better"),
    ("open_deals", "open_deals", "Open opportunities", "count", "higher_is_better"),
    ("pipeline_value", "open_value_minor", "Open pipeline value", "currency", "higher_is_better"),
    ("open_tasks", "open_tasks", "Open tasks", "count", "lower_is_better"),
]


def metric_rows(snapshot: DataFrame, fixtures: DataFrame | None = None) -> DataFrame:
    """A snapshot as (workspace_id, metric, label, value, formatted, unit, polarity, provenance, overall).

    fixtures are further rows (workspace_id, metric, label, value, unit, polarity) that are not measured; overall is 'live' only where every metric of the workspace is.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(label).alias("label"), F.col(c).cast("long").alias("value"), F.lit(unit).alias("unit"), F.lit(better).alias("polarity"), F.lit("live").alias("provenance")) for k, c, label, unit, better in METRICS])
    out = snapshot.select("workspace_id", F.inline(rows))
    if fixtures is not None:
        out = out.unionByName(fixtures.withColumn("provenance", F.lit("fixture")).select(out.columns))
    live = F.bool_and(F.col("provenance") == "live").over(Window.partitionBy("workspace_id"))
    shown = F.when(F.col("unit") == "currency", F.concat(F.lit("$"), F.format_number(F.round(F.col("value") / 100), 0))).otherwise(F.col("value").cast("string"))
    return out.withColumn("formatted", shown).withColumn("overall", F.when(live, "live").otherwise("fixture"))


def open_opp_counts(opportunities: DataFrame) -> DataFrame:
    """Open deals of each contact that has any."""
    return opportunities.where("status = 'open'").groupBy("contact_id").agg(F.count("*").alias("open_deals"))


def last_activity(activities: DataFrame) -> DataFrame:
    """The latest activity of each contact."""
    return activities.groupBy("contact_id").agg(F.max("occurred_at").alias("last_activity"))


def named(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of a table (id, name), to be joined."""
    return df.select(F.col("id").alias(key), F.col("name").alias(name))


def contact_list(contacts: DataFrame, first: DataFrame, opportunities: DataFrame, activities: DataFrame, companies: DataFrame, users: DataFrame) -> DataFrame:
    """Contacts (with company_id and owner_id) with the names of company and owner, their first source, open deals and last activity."""
    source = first.select(F.col("contact_id").alias("id"), F.col("source_type").alias("first_source"))
    deals = open_opp_counts(opportunities).withColumnRenamed("contact_id", "id")
    seen = last_activity(activities).withColumnRenamed("contact_id", "id")
    out = contacts.where("not is_deleted").select("id", "workspace_id", "first_name", "company_id", "owner_id")
    out = out.join(named(companies, "company_id", "company_name"), "company_id", "left").join(named(users, "owner_id", "owner_name"), "owner_id", "left")
    out = out.join(source, "id", "left").join(deals, "id", "left").join(seen, "id", "left").drop("company_id", "owner_id")
    return out.withColumn("open_deals", F.coalesce("open_deals", F.lit(0)))


def opportunities_enriched(opportunities: DataFrame, contacts: DataFrame, stages: DataFrame, companies: DataFrame, users: DataFrame, touches: DataFrame) -> DataFrame:
    """Deals (contact_id, stage, company_id, owner_id, touch_id) with contact and stage (stage, stage_name, category), and company, owner and acquisition where they have one."""
    people = contacts.select(F.col("id").alias("contact_id"), F.col("first_name").alias("contact_name"))
    source = touches.select(F.col("id").alias("touch_id"), F.col("source_type").alias("acquisition_source"), F.col("captured_at").alias("acquired_at"))
    out = opportunities.join(people, "contact_id").join(stages.select("stage", "stage_name", "category"), "stage")
    return out.join(named(companies, "company_id", "company_name"), "company_id", "left").join(named(users, "owner_id", "owner_name"), "owner_id", "left").join(source, "touch_id", "left")


def task_list(tasks: DataFrame, contacts: DataFrame, opportunities: DataFrame, users: DataFrame) -> DataFrame:
    """Tasks with assignee, contact and deal, kept where any is missing."""
    people = contacts.select(F.col("id").alias("contact_id"), F.col("first_name").alias("contact_name"))
    deals = opportunities.select(F.col("id").alias("opportunity_id"), F.col("stage").alias("deal_stage"))
    return tasks.join(people, "contact_id", "left").join(deals, "opportunity_id", "left").join(named(users, "assignee_id", "assignee_name"), "assignee_id", "left")


def activity_feed(activities: DataFrame, contacts: DataFrame, users: DataFrame, n: int, by: str = "contact_id") -> DataFrame:
    """The newest n activities of each contact, deal or workspace (by) with the contact's and the actor's name."""
    top = newest(activities.where(F.col(by).isNotNull()), "occurred_at", n, by)
    people = contacts.select(F.col("id").alias("contact_id"), F.col("first_name").alias("contact_name"))
    return top.join(people, "contact_id", "left").join(named(users, "actor_id", "actor_name"), "actor_id", "left")


def newest(df: DataFrame, ts: str, n: int, by: str | None = None, tie: str = "id") -> DataFrame:
    """K3: the newest n rows, of each `by` if given, ties to the larger id."""
    if by is None:
        return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts), F.desc(tie)))
    return df.withColumn("place ", place).where(F.col("place ") <= n).drop("place ")


def lead_funnel(submissions: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Captured and rejected submissions of the last days, by form; forms without any in that time are left out."""
    at = F.lit(now).cast("timestamp")
    recent = submissions.where((F.col("ts") >= at - F.expr(f"make_dt_interval({days})")) & (F.col("ts") <= at))
    return recent.groupBy("form").agg(F.count_if(F.col("outcome") == "accepted").alias("captured"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))


def form_summary(submissions: DataFrame, forms: DataFrame) -> DataFrame:
    """A10: submissions, leads and last submission of every form, zeros and nulls kept."""
    grouped = submissions.groupBy("form").agg(F.count("*").alias("submissions"), F.count_if(F.col("outcome") == "accepted").alias("leads"), F.max("ts").alias("last_submission"))
    return forms.join(grouped, "form", "left").na.fill(0, ["submissions", "leads"])


def rejections_by_reason(submissions: DataFrame) -> DataFrame:
    """Rejected submissions by form and reason."""
    return submissions.where("outcome = 'rejected'").groupBy("form", "rejection_reason").agg(F.count("*").alias("n"))


def counts_kept_zero(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Children of each parent, zero kept; children are counted before the join."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])


def ingested_counts(receipts: DataFrame) -> DataFrame:
    """Receipts by source system."""
    return receipts.groupBy("source_system").agg(F.count("*").alias("n"))


def task_load(tasks: DataFrame, now: str) -> DataFrame:
    """Open and overdue tasks by priority."""
    return tasks.groupBy("priority").agg(F.count_if(F.col("status") == "open").alias("open_tasks"), F.count_if(is_overdue(now)).alias("overdue_tasks"))


def output_outcomes(events: DataFrame, outputs: DataFrame, outcomes: list[str]) -> DataFrame:
    """Outcomes of each published output, a column each."""
    return outputs.where("published").select("id").join(events, F.col("id") == F.col("output_id")).groupBy("id").pivot("outcome", outcomes).count().na.fill(0)


def published_forms(forms: DataFrame, versions: DataFrame) -> DataFrame:
    """Forms that are not archived with their published version; an unpublished form resolves to nothing."""
    return forms.where("not archived").join(versions.where("is_published"), "form_id")


def submission_receipts(submissions: DataFrame, contacts: DataFrame, versions: DataFrame, n: int) -> DataFrame:
    """The newest n submissions of each form with the contact's name and the form version (version_id, version) they were made with."""
    people = contacts.select(F.col("id").alias("subject"), F.col("first_name").alias("contact_name"))
    return newest(submissions, "ts", n, "form").join(people, "subject", "left").join(versions.select("version_id", F.col("version").alias("form_version")), "version_id", "left")


def identity_keys(contacts: DataFrame) -> DataFrame:
    """(id, workspace_id, kind, key): the identity keys of contacts, one row each: the normalised e-mail, and the telephone number in E.164 by the row's region. A number that is none of its region is no key."""
    keys = F.array(F.struct(F.lit("email").alias("kind"), normalise_email(F.col("email")).alias("key")), F.struct(F.lit("phone").alias("kind"), phone_e164(F.col("phone"), phone_region(contacts.columns)).alias("key")))
    return contacts.select("id", "workspace_id", F.explode(keys).alias("k")).select("id", "workspace_id", "k.kind", "k.key").where("key is not null")


def duplicate_candidates(new: DataFrame, contacts: DataFrame) -> DataFrame:
    """The oldest contact that shares an e-mail, else a telephone number, with each new row; says which matched."""
    first = identity_keys(contacts.where("not is_deleted")).groupBy("workspace_id", "kind", "key").agg(F.min("id").alias("match_id"))
    hits = identity_keys(new).join(first, ["workspace_id", "kind", "key"]).select("id", "match_id", "kind")
    place = F.row_number().over(Window.partitionBy("id").orderBy("kind", "match_id"))
    return hits.withColumn("place", place).where("place = 1").select("id", "match_id", F.col("kind").alias("matched_on"))


def merge_candidates(contacts: DataFrame, per_contact: int = 10) -> DataFrame:
    """(id, other_id): up to per_contact live others, smallest ids first, that share a key.

    Each key offers only its smallest per_contact + 1 ids, so a key in a third of all rows costs no more
    than its rows: a larger id could not be among the first of anyone.
    """
    keys = identity_keys(live_contacts(contacts))
    place = F.row_number().over(Window.partitionBy("workspace_id", "kind", "key").orderBy("id"))
    offered = keys.withColumn("place", place).where(F.col("place") <= per_contact + 1).groupBy("workspace_id", "kind", "key").agg(F.collect_list("id").alias("others"))
    pairs = keys.join(offered, ["workspace_id", "kind", "key"]).select("id", F.explode("others").alias("other_id")).where("id <> other_id").distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= per_contact).drop("rank")


def match_leads(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """The oldest live contact that shares a key with each lead."""
    first = identity_keys(live_contacts(contacts)).groupBy("workspace_id", "kind", "key").agg(F.min("id").alias("contact_id"))
    return identity_keys(leads).join(first, ["workspace_id", "kind", "key"]).groupBy("id").agg(F.min("contact_id").alias("contact_id"))


def resolve_companies(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, company_id) of leads by lower-cased company name; the oldest company wins, null means new."""
    known = companies.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("company_id").alias("company_id"))
    return leads.select("id", F.lower(F.trim("company")).alias("name")).join(known, "name", "left").select("id", "company_id")


def import_match_count(rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """How many distinct keys of an import are already known to live contacts."""
    keys = identity_keys(rows).select("workspace_id", "kind", "key").distinct()
    known = identity_keys(live_contacts(contacts)).select("workspace_id", "kind", "key")
    return keys.join(known, ["workspace_id", "kind", "key"], "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


def tags_for_contacts(contact_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Each contact's tag names in order, archived ones too."""
    return contact_tags.join(tags, "tag_id").groupBy("contact_id").agg(F.sort_array(F.collect_list("name")).alias("tags"))


def custom_field_matrix(definitions: DataFrame, values: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every live definition of a workspace for every contact of it, with its value or null. Definitions are gathered to one array a workspace."""
    listed = definitions.where("not archived").groupBy("workspace_id").agg(F.collect_set("field_id").alias("fields"))
    grid = contacts.select("id", "workspace_id").join(listed, "workspace_id").select(F.col("id").alias("contact_id"), F.explode("fields").alias("field_id"))
    return grid.join(values, ["contact_id", "field_id"], "left")


def merge_redirects(contacts: DataFrame) -> DataFrame:
    """(id, survivor) of merged contacts; chains end at the first contact that is not merged.

    A hop doubles each round, and each round is written, until none changes: at most as many rounds as the number
    of merged contacts has binary digits. Contacts that merge in a circle, or into one, have no survivor: null.
    """
    merged = contacts.where("merged_into is not null").select("id", F.col("merged_into").alias("survivor"))
    hops = shared_table(merged)
    for _ in range(hops.count().bit_length() + 1):
        further = hops.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"))
        hops = shared_table(hops.select("id", "survivor").join(further, "survivor", "left").select("id", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved")))
        if hops.where("moved").isEmpty():
            break
    circles = merged.select(F.col("id").alias("survivor"), F.lit(True).alias("merged"))
    return hops.select("id", "survivor").join(circles, "survivor", "left").select("id", F.when(F.col("merged").isNull(), F.col("survivor")).alias("survivor"))


def keyset_page(df: DataFrame, sort: str, limit: int, cursor: str | None = None, tie: str = "id", descending: bool = False) -> DataFrame:
    """K1: one page in (sort, id) order strictly after a cursor, with one row more to tell whether another follows. Null sort values come last (K2)."""
    if cursor:
        value, ident = json.loads(base64.b64decode(cursor))
        after = F.col(tie) < ident if descending else F.col(tie) > ident
        if value is None:
            df = df.where(F.col(sort).isNull() & after)
        else:
            at = F.lit(value).cast(df.schema[sort].dataType)
            further = F.col(sort) < at if descending else F.col(sort) > at
            df = df.where(further | ((F.col(sort) == at) & after) | F.col(sort).isNull())
    order = [F.desc_nulls_last(sort), F.desc(tie)] if descending else [F.asc_nulls_last(sort), F.asc(tie)]
    return df.orderBy(*order).limit(limit + 1)


def cursor_of(value, ident) -> str:
    return base64.b64encode(json.dumps([value if value is None else str(value), ident]).encode()).decode()


def recent_corpus(outputs: DataFrame, n: int) -> DataFrame:
    """K4: the newest n published outputs of each workspace with the total, so that truncation shows."""
    published = outputs.where("published")
    total = published.groupBy("workspace_id").agg(F.count("*").alias("total"))
    return newest(published, "id", n, "workspace_id").join(total, "workspace_id")


def count_traces(tables: dict[str, tuple[DataFrame, list[str]]], term: str) -> DataFrame:
    """How many rows of each table mention a term, JSON text included, and of all tables together (table_name 'all')."""
    parts = [df.agg(F.count_if(like_literal(columns, term)).alias("n")).withColumn("table_name", F.lit(name)) for name, (df, columns) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("n", F.explode(F.array("table_name", F.lit("all"))).alias("table_name")).groupBy("table_name").agg(F.sum("n").alias("n"))


def merge_preview_counts(requests: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Rows that each merge (survivor, duplicate) would move, a column for each child table (contact_id)."""
    out = requests
    for name, df in children.items():
        out = out.join(df.groupBy(F.col("contact_id").alias("duplicate")).agg(F.count("*").alias(name)), "duplicate", "left").na.fill(0, [name])
    return out


def rows_reached(rows: DataFrame, wanted: DataFrame, opportunities: DataFrame, touches: DataFrame | None = None) -> DataFrame:
    """(gone, id): rows of contacts to be erased, wanted (gone): their own, those of their deals and, if touches are given, of their touches; each once for a contact."""
    own = rows.select("id", F.col("contact_id").alias("gone"))
    deals = opportunities.select(F.col("id").alias("opportunity_id"), F.col("contact_id").alias("gone"))
    reached = own.unionByName(rows.select("id", "opportunity_id").join(deals, "opportunity_id").select("id", "gone"))
    if touches is not None:
        of_touch = touches.select(F.col("id").alias("touch_id"), F.col("contact_id").alias("gone"))
        reached = reached.unionByName(rows.select("id", "touch_id").join(of_touch, "touch_id").select("id", "gone"))
    return reached.join(wanted, "gone", "left_semi").distinct()


def erasure_preview_counts(requests: DataFrame, touches: DataFrame, opportunities: DataFrame, tasks: DataFrame, activities: DataFrame, fields: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows that erasing each contact of requests (id) would change or delete, a column for each table; tasks and activities also through the contact's deals and touches."""
    wanted = requests.select(F.col("id").alias("gone")).distinct()
    of = lambda df: df.select(F.col("contact_id").alias("gone"))
    reached = {"touches": of(touches), "opportunities": of(opportunities), "tasks": rows_reached(tasks, wanted, opportunities), "activities": rows_reached(activities, wanted, opportunities, touches), "fields": of(fields), "tags": of(tags)}
    out = wanted
    for name, rows in reached.items():
        out = out.join(rows.groupBy("gone").agg(F.count("*").alias(name)), "gone", "left").na.fill(0, [name])
    return out.withColumnRenamed("gone", "id")


def removed_options(old: Column, new: Column) -> Column:
    """U4: select options that a new list lacks; a change is sound only if there are none."""
    return F.array_except(old, F.coalesce(new, F.array().cast("array<string>")))
