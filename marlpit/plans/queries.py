"""The registered queries of the acquisition operators, each beside its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attribution, identity, urls
from ..operators import access, crawl, crm, ingest, limits, network, quality, search, similarity
from ..sources import tables
from .adapters import NOW, views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *model: str):
    """Register a query over the named model tables (or, without any, over the session and directory)."""

    def register(fn):
        QUERIES[name] = (lambda spark, sf_dir: fn(*views(spark, sf_dir, *model))) if model else fn
        if sql:
            ORACLE_SQL[name] = with_views(sql, *model) if model else sql
        return fn

    return register


LIVE = "NOT is_deleted AND NOT is_merged AND NOT is_erased"

# --- scans, filters, projections


@query("f1_indexed_search", with_views("""SELECT term, count(*) AS n, min(id) AS first_id FROM (SELECT right(s_name, 5) AS term FROM supplier UNION SELECT lower(substr(c_mktsegment, 1, 2)) FROM customer UNION SELECT concat('user', s_suppkey) FROM supplier) t
    JOIN contacts ON contains(lower(first_name), term) OR contains(lower(coalesce(email, '')), term) OR contains(coalesce(phone, ''), term) GROUP BY 1""", "contacts"))  # fmt: skip
def _(spark, sf_dir):
    [contacts], suppliers = views(spark, sf_dir, "contacts"), tables.load(spark, sf_dir, "supplier")
    columns = ["first_name", "email", "phone"]
    terms = suppliers.select(F.right("s_name", F.lit(5)).alias("term")).unionByName(suppliers.select(F.concat(F.lit("USER"), "s_suppkey").alias("term"))).unionByName(contacts.select(F.substring("company", 1, 2).alias("term")))
    index = tables.shared_table(search.gram_index(contacts, "id", columns))
    return search.search_terms(contacts, index, "id", columns, terms).groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("f1_contains_search", "SELECT id, workspace_id FROM contacts WHERE contains(lower(first_name), '#0000001') OR contains(lower(coalesce(email, '')), 'user1')", "contacts")
def _(contacts):
    return crm.contains_search(contacts, ["first_name", "email"], "USER1").unionByName(crm.contains_search(contacts, ["first_name"], "#0000001")).select("id", "workspace_id").distinct()


@query("f2_filters", "SELECT id, priority FROM tasks WHERE status = 'open' AND priority = '1-URGENT' AND due_at < TIMESTAMP '1997-01-01'", "tasks")
def _(tasks):
    return crm.apply_filters(tasks, "1997-01-01", status="open", priority="1-URGENT", contact_id=None).select("id", "priority")


CLASSIFIED = """
    classified AS (
        SELECT *, CASE rule WHEN 0 THEN 'paid_search' WHEN 1 THEN 'social' WHEN 2 THEN CASE WHEN source IN ('google', 'bing') THEN 'paid_search' ELSE 'social' END
                WHEN 3 THEN 'email' WHEN 4 THEN 'social' WHEN 5 THEN 'organic_search' WHEN 6 THEN 'social' WHEN 7 THEN 'referral' WHEN 8 THEN 'unknown' ELSE 'direct' END AS source_type,
            CASE WHEN rule IN (0, 5) AND (rule = 0 OR host LIKE '%google.com') THEN 'google' WHEN rule IN (1, 6) THEN 'facebook'
                WHEN rule IN (2, 4, 8) AND source IN ('google', 'facebook') THEN source ELSE 'unknown' END AS source_platform,
            CASE WHEN rule < 2 THEN 'declared' WHEN rule < 9 THEN 'derived' ELSE 'inferred' END AS confidence
        FROM (SELECT *, CASE WHEN gclid IS NOT NULL THEN 0 WHEN fbclid IS NOT NULL THEN 1 WHEN medium = 'cpc' THEN 2 WHEN medium = 'email' OR source = 'newsletter' THEN 3
                WHEN medium = 'social' THEN 4 WHEN host IN ('google.com', 'duckduckgo.com') THEN 5 WHEN host = 'm.facebook.com' THEN 6 WHEN host IS NOT NULL THEN 7
                WHEN source IS NOT NULL OR utm_campaign IS NOT NULL THEN 8 ELSE 9 END AS rule
            FROM (SELECT *, lower(utm_medium) AS medium, lower(utm_source) AS source,
                    CASE WHEN referrer LIKE '/%' THEN NULL ELSE regexp_replace(regexp_replace(referrer, '^https://(www[.])?', ''), '/$', '') END AS host FROM touches) a) b)"""


@query("f3_first_touch_source", f"""WITH {CLASSIFIED}, firsts AS (SELECT contact_id, min(captured_at) AS captured_at FROM classified GROUP BY 1)
    SELECT id FROM contacts WHERE id IN (SELECT c.contact_id FROM classified c JOIN firsts f ON c.contact_id = f.contact_id AND c.captured_at = f.captured_at WHERE source_type = 'referral')""", "contacts", "touches")  # fmt: skip
def _(contacts, touches):
    return crm.filter_first_touch_source(contacts, attribution.classify_source(touches), "referral").select("id")


@query("f4_overdue", f"SELECT id FROM tasks WHERE status = 'open' AND due_at < TIMESTAMP '1998-01-01 00:00:00'", "tasks")
def _(tasks):
    return crm.overdue(tasks, "1998-01-01 00:00:00").select("id")


@query("f5_live_contacts", f"SELECT id FROM contacts WHERE {LIVE}", "contacts")
def _(contacts):
    return crm.live_contacts(contacts).select("id")


@query("f6_contact_view", "SELECT id, workspace_id, first_name || ' (' || company || ')' AS display_name FROM contacts", "contacts")
def _(contacts):
    return crm.contact_view(contacts)


@query("f6_task_view", "SELECT id, contact_id, opportunity_id, status, priority, CAST(CAST(due_at AS DATE) AS VARCHAR) AS due_on, coalesce(status = 'open' AND due_at < TIMESTAMP '1998-01-01', false) AS is_overdue FROM tasks", "tasks")
def _(tasks):
    return crm.task_view(tasks, "1998-01-01 00:00:00")


@query("f6_opportunity_view", "SELECT id, contact_id, stage, status, value_minor, value_minor // 100 AS value, status <> 'open' AS is_closed FROM opportunities", "opportunities")
def _(opportunities):
    return crm.opportunity_view(opportunities)


@query("f6_tag_view", "SELECT DISTINCT stage AS tag_id, stage AS name, lower(stage) AS slug FROM opportunities", "opportunities")
def _(opportunities):
    return crm.tag_view(opportunities.select(F.col("stage").alias("tag_id"), F.concat(F.lit(" "), F.col("stage")).alias("name")).distinct())


@query("f8_crawlable_sites", "SELECT s_suppkey AS site_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal >= 0")
def _(spark, sf_dir):
    sites = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.when(F.col("s_suppkey") % 3 == 0, "verified").when(F.col("s_suppkey") % 3 == 1, "pending").alias("verification_state"), F.when(F.col("s_acctbal") >= 0, "active").otherwise("archived").alias("status"))
    return crawl.crawlable_sites(sites).select("site_id")


@query("f7_retrieved_pages", "SELECT page_id FROM graph_pages WHERE outcome IN ('fetched', 'unchanged')", "graph_pages")
def _(pages):
    return crawl.retrieved(pages).select("page_id")


@query("f9_tenant_scope", "SELECT id FROM contacts WHERE workspace_id = 7", "contacts")
def _(contacts):
    return crm.tenant_scope(contacts, 7).select("id")


# --- joins

ORPHANS = """
    own AS (SELECT * FROM graph_pages WHERE outcome IN ('fetched', 'unchanged')),
    alone AS (SELECT crawl_id, page_id FROM own p WHERE NOT EXISTS (
        SELECT 1 FROM graph_links l WHERE l.crawl_id = p.crawl_id AND l.target_url = p.url AND l.scope = 'internal' AND l.source_page_id <> p.page_id))"""


@query("j1_orphan_pages", f"WITH {ORPHANS} SELECT crawl_id, page_id, (SELECT count(*) FROM own) AS population FROM alone", "graph_pages", "graph_links")
def _(pages, links):
    return crawl.orphan_pages(pages, links).select("crawl_id", "page_id", "population")


@query("j2_orphan_findings", f"""WITH {ORPHANS} SELECT crawl_id, page_id, 'orphan_page' AS rule,
    '{{"internalInboundLinks":0,"pagesConsidered":' || (SELECT count(*) FROM own) || '}}' AS evidence FROM alone WHERE page_id % 5 <> 0""", "graph_pages", "graph_links")  # fmt: skip
def _(pages, links):
    known = pages.where("page_id % 5 = 0").select("crawl_id", "page_id", F.lit("orphan_page").alias("rule"))
    return crawl.orphan_findings(pages, links, known)


PEOPLE = """
    users AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0), companies AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 3)"""


def people(any_table: DataFrame, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(companies, users) as (id, name), each without some that other rows name."""
    spark = any_table.sparkSession
    users = tables.load(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.load(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), users


def person(column: str):
    return F.col(column) % 20


@query("j3_opportunities_enriched", with_views(f"""WITH {PEOPLE} SELECT o.id, c.first_name AS contact_name, upper(o.stage) AS stage_name, CASE WHEN o.stage < '4' THEN 'open' ELSE 'closed' END AS category, k.name AS company_name, u.name AS owner_name, t.utm_source AS acquisition_source
    FROM opportunities o JOIN contacts c ON c.id = o.contact_id LEFT JOIN companies k ON k.id = o.workspace_id LEFT JOIN users u ON u.id = o.id % 20 LEFT JOIN touches t ON t.id = o.id % 5000 WHERE o.stage <> '5-LOW'""", "contacts", "opportunities", "touches"))  # fmt: skip
def _(spark, sf_dir):
    contacts, opportunities, touches = views(spark, sf_dir, "contacts", "opportunities", "touches")
    companies, users = people(contacts, sf_dir)
    stages = opportunities.where("stage <> '5-LOW'").select("stage", F.upper("stage").alias("stage_name"), F.when(F.col("stage") < "4", "open").otherwise("closed").alias("category")).distinct()
    deals = opportunities.select("id", "contact_id", "stage", F.col("workspace_id").alias("company_id"), person("id").alias("owner_id"), (F.col("id") % 5000).alias("touch_id"))
    out = crm.opportunities_enriched(deals, contacts, stages, companies, users, touches.withColumnRenamed("utm_source", "source_type"))
    return out.select("id", "contact_name", "stage_name", "category", "company_name", "owner_name", "acquisition_source")


@query("j4_contact_list", with_views(f"""WITH {CLASSIFIED}, {PEOPLE}, firsts AS (SELECT contact_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY captured_at, id) AS n FROM classified) x WHERE n = 1),
    deals AS (SELECT contact_id, count(*) AS open_deals FROM opportunities WHERE status = 'open' GROUP BY 1), seen AS (SELECT contact_id, max(captured_at) AS last_activity FROM touches GROUP BY 1)
    SELECT c.id, c.workspace_id, c.first_name, k.name AS company_name, u.name AS owner_name, f.source_type AS first_source, coalesce(d.open_deals, 0) AS open_deals, s.last_activity
    FROM contacts c LEFT JOIN firsts f ON f.contact_id = c.id LEFT JOIN deals d ON d.contact_id = c.id LEFT JOIN seen s ON s.contact_id = c.id LEFT JOIN companies k ON k.id = c.workspace_id LEFT JOIN users u ON u.id = c.id % 20 WHERE NOT is_deleted""", "contacts", "opportunities", "touches"))  # fmt: skip
def _(spark, sf_dir):
    contacts, opportunities, touches = views(spark, sf_dir, "contacts", "opportunities", "touches")
    # The first touch is picked before it is classified.
    first = attribution.classify_source(crm.first_touch(touches))
    listed = contacts.withColumns({"company_id": F.col("workspace_id"), "owner_id": person("id")})
    return crm.contact_list(listed, first, opportunities, touches.withColumnRenamed("captured_at", "occurred_at"), *people(contacts, sf_dir))


@query("j5_task_list", with_views(f"""WITH {PEOPLE} SELECT t.id, t.status, c.first_name AS contact_name, o.stage AS deal_stage, u.name AS assignee_name FROM tasks t
    LEFT JOIN contacts c ON c.id = t.contact_id LEFT JOIN opportunities o ON o.id = t.opportunity_id LEFT JOIN users u ON u.id = t.id % 20""", "contacts", "opportunities", "tasks"))  # fmt: skip
def _(spark, sf_dir):
    contacts, opportunities, work = views(spark, sf_dir, "contacts", "opportunities", "tasks")
    return crm.task_list(work.withColumn("assignee_id", person("id")), contacts, opportunities, people(contacts, sf_dir)[1]).select("id", "status", "contact_name", "deal_stage", "assignee_name")


FEED = """SELECT a.id, a.{by}, c.first_name AS contact_name, u.name AS actor_name FROM (
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY captured_at DESC, id DESC) AS n FROM (SELECT *, CASE WHEN id % 3 = 0 THEN id % 50 END AS opportunity_id, id % 11 AS workspace_id FROM touches) y WHERE {by} IS NOT NULL) a
    LEFT JOIN contacts c ON c.id = a.contact_id LEFT JOIN users u ON u.id = a.id % 20 WHERE n <= {n}"""


def feed(spark: SparkSession, sf_dir: str, by: str, n: int) -> DataFrame:
    contacts, touches = views(spark, sf_dir, "contacts", "touches")
    activities = touches.select("id", "contact_id", F.col("captured_at").alias("occurred_at"), person("id").alias("actor_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("opportunity_id"), (F.col("id") % 11).alias("workspace_id"))
    return crm.activity_feed(activities, contacts, people(contacts, sf_dir)[1], n, by).select("id", by, "contact_name", "actor_name")


@query("j6_activity_feed", with_views(f"WITH {PEOPLE} {FEED.format(by='contact_id', n=3)}", "contacts", "touches"))
def _(spark, sf_dir):
    return feed(spark, sf_dir, "contact_id", 3)


@query("j6_deal_feed", with_views(f"WITH {PEOPLE} {FEED.format(by='opportunity_id', n=5)}", "contacts", "touches"))
def _(spark, sf_dir):
    return feed(spark, sf_dir, "opportunity_id", 5)


@query("j6_workspace_feed", with_views(f"WITH {PEOPLE} {FEED.format(by='workspace_id', n=25)}", "contacts", "touches"))
def _(spark, sf_dir):
    return feed(spark, sf_dir, "workspace_id", 25)


@query("j7_submission_receipts", """SELECT s.id, s.form, c.first_name AS contact_name, CASE WHEN s.id % 9 < 7 THEN s.id % 9 + 1 END AS form_version FROM (
    SELECT *, row_number() OVER (PARTITION BY form ORDER BY ts DESC, id DESC) AS n FROM submissions) s LEFT JOIN contacts c ON c.id = s.subject WHERE n <= 20""", "contacts", "submissions")  # fmt: skip
def _(contacts, submissions):
    versioned = submissions.withColumn("version_id", F.col("id") % 9)
    versions = versioned.where("version_id < 7").select("version_id", (F.col("version_id") + 1).alias("version")).distinct()
    return crm.submission_receipts(versioned, contacts, versions, 20).select("id", "form", "contact_name", "form_version")


FORMS = "forms AS (SELECT DISTINCT form AS form_id, form = 'error' AS archived FROM submissions), versions AS (SELECT DISTINCT form AS form_id, CAST(id % 4 AS INTEGER) AS version, id % 4 = 2 AND form <> 'view' AS is_published FROM submissions)"


def form_tables(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    forms = submissions.select(F.col("form").alias("form_id"), (F.col("form") == "error").alias("archived")).distinct()
    version = (F.col("id") % 4).cast("int")
    return forms, submissions.select(F.col("form").alias("form_id"), version.alias("version"), ((version == 2) & (F.col("form") != "view")).alias("is_published")).distinct()


@query("j8_published_forms", f"WITH {FORMS} SELECT f.form_id, v.version FROM forms f JOIN versions v ON f.form_id = v.form_id WHERE NOT archived AND is_published", "submissions")
def _(submissions):
    return crm.published_forms(*form_tables(submissions)).select("form_id", "version")


KEYS = """
    keyed AS (SELECT id, workspace_id, is_deleted, is_merged, is_erased, 'email' AS kind, lower(trim(email)) AS k FROM contacts WHERE email IS NOT NULL
        UNION ALL SELECT id, workspace_id, is_deleted, is_merged, is_erased, 'phone', '+61' || substr(phone, 2) FROM contacts WHERE phone IS NOT NULL AND region = 'AU')"""


@query("j9_duplicate_candidates", f"""WITH {KEYS}, hits AS (SELECT n.id, min(o.id) AS match_id, n.kind FROM keyed n JOIN keyed o ON n.workspace_id = o.workspace_id AND n.kind = o.kind AND n.k = o.k
        WHERE n.id % 3 = 0 AND NOT o.is_deleted GROUP BY n.id, n.kind)
    SELECT id, match_id, kind AS matched_on FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, match_id) AS n FROM hits) x WHERE n = 1""", "contacts")  # fmt: skip
def _(contacts):
    return crm.duplicate_candidates(contacts.where("id % 3 = 0"), contacts)


@query("j10_merge_candidates", f"""WITH {KEYS}, pairs AS (SELECT DISTINCT a.id, b.id AS other_id FROM keyed a JOIN keyed b ON a.workspace_id = b.workspace_id AND a.kind = b.kind AND a.k = b.k AND a.id <> b.id
        WHERE NOT (a.is_deleted OR a.is_merged OR a.is_erased OR b.is_deleted OR b.is_merged OR b.is_erased))
    SELECT id, other_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other_id) AS n FROM pairs) x WHERE n <= 10""", "contacts")  # fmt: skip
def _(contacts):
    return crm.merge_candidates(contacts)


@query("j11_match_leads", f"""WITH {KEYS} SELECT n.id, min(o.id) AS contact_id FROM keyed n JOIN keyed o ON n.workspace_id = o.workspace_id AND n.kind = o.kind AND n.k = o.k
    WHERE n.id % 2 = 1 AND NOT (o.is_deleted OR o.is_merged OR o.is_erased) GROUP BY n.id""", "contacts")  # fmt: skip
def _(contacts):
    return crm.match_leads(contacts.where("id % 2 = 1"), contacts)


@query("j12_resolve_companies", """WITH known AS (SELECT lower(company) AS name, min(id) AS company_id FROM contacts WHERE company <> 'MACHINERY' GROUP BY 1)
    SELECT c.id, k.company_id FROM contacts c LEFT JOIN known k ON lower(c.company) = k.name""", "contacts")  # fmt: skip
def _(contacts):
    companies = contacts.where("company <> 'MACHINERY'").select(F.col("company").alias("name"), F.col("id").alias("company_id"))
    return crm.resolve_companies(contacts, companies)


@query("j13_import_match_count", f"""WITH {KEYS}, live AS (SELECT DISTINCT workspace_id, kind, k FROM keyed WHERE NOT (is_deleted OR is_merged OR is_erased)),
    asked AS (SELECT DISTINCT workspace_id, kind, k FROM keyed WHERE id % 7 = 0) SELECT kind, count(*) AS n FROM asked JOIN live USING (workspace_id, kind, k) GROUP BY kind""", "contacts")  # fmt: skip
def _(contacts):
    return crm.import_match_count(contacts.where("id % 7 = 0"), contacts)


@query("j14_contact_tags", """WITH pairs AS (SELECT DISTINCT contact_id, stage FROM opportunities)
    SELECT contact_id, string_agg(stage, ',' ORDER BY stage) AS tags FROM pairs GROUP BY 1""", "opportunities")  # fmt: skip
def _(opportunities):
    tags = opportunities.select(F.col("stage").alias("tag_id"), F.col("stage").alias("name")).distinct()
    held = opportunities.select("contact_id", F.col("stage").alias("tag_id")).distinct()
    return crm.tags_for_contacts(held, tags).select("contact_id", F.array_join("tags", ",").alias("tags"))


@query("j15_custom_field_matrix", """WITH defs AS (SELECT DISTINCT c.workspace_id, o.stage AS field_id FROM opportunities o JOIN contacts c ON c.id = o.contact_id WHERE o.stage <> '5-LOW'),
        held AS (SELECT contact_id, stage AS field_id, max(value_minor) AS value FROM opportunities GROUP BY 1, 2)
    SELECT c.id AS contact_id, d.field_id, h.value FROM contacts c JOIN defs d ON c.workspace_id = d.workspace_id LEFT JOIN held h ON h.contact_id = c.id AND h.field_id = d.field_id""", "contacts", "opportunities")  # fmt: skip
def _(contacts, opportunities):
    definitions = opportunities.select("workspace_id", F.col("stage").alias("field_id"), (F.col("stage") == "5-LOW").alias("archived")).distinct()
    values = opportunities.groupBy("contact_id", F.col("stage").alias("field_id")).agg(F.max("value_minor").alias("value"))
    return crm.custom_field_matrix(definitions, values, contacts).select("contact_id", "field_id", "value")


@query("j16_robots_verdicts", r"""WITH said AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS path FROM pages),
    judged AS (SELECT page_id, path LIKE '/en/1%' AS en1, path LIKE '/en/%' AS en, path LIKE '/de/%' AS de, path LIKE '%page=1%' AS paged, path LIKE '/es/%.html' AS es FROM said)
    SELECT page_id, CASE WHEN en1 THEN true WHEN es THEN true WHEN paged THEN false WHEN de THEN true WHEN en THEN false ELSE true END AS allowed,
        CASE WHEN en1 THEN '/en/1' WHEN es THEN '/es/*.html$' WHEN paged THEN '/*page=1' WHEN de THEN '/de/' WHEN en THEN '/en/' END AS pattern,
        CASE WHEN en1 OR es OR paged THEN 'longest_match' WHEN de THEN 'allow_wins_tie' WHEN en THEN 'longest_match' ELSE 'no_rule_matched' END AS reason, 7.5 AS crawl_delay FROM judged""")  # fmt: skip
def _(spark, sf_dir):
    pages = tables.load(spark, sf_dir, "pages")
    body = "User-agent: *\nAllow: /de/\nDisallow: /de/\nDisallow: /*page=1\nCrawl-delay: 2\n\nUser-agent: other\nUser-agent: *\nDisallow: /en/ # all but some\nAllow: /en/1\nAllow: /es/*.html$\nCrawl-delay: 7.5\nCrawl-delay: soon\nSitemap: https://x.test/s.xml\n"
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    rules, _ = tables.parse_robots(pages.select(origin.alias("origin"), F.lit(body).alias("body")).distinct())
    verdicts = crawl.robots_verdicts(pages.select(origin.alias("origin"), F.col("page_id").alias("url"), path.alias("path")), rules, "marlpit")
    return verdicts.withColumnRenamed("url", "page_id")


@query("j17_address_ranges", """WITH numbered AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS n FROM events)
    SELECT range_name, count(*) AS n FROM (SELECT CASE
        WHEN n >> 8 = 12582912 THEN 'ietf-protocol' WHEN n >> 8 = 12582914 THEN 'test-net-1' WHEN n >> 8 = 3325256704 >> 8 THEN 'test-net-2' WHEN n >> 8 = 3405803776 >> 8 THEN 'test-net-3'
        WHEN n >> 8 = 3227017984 >> 8 THEN '6to4-relay' WHEN n = 4294967295 THEN 'broadcast' WHEN n >> 16 = 43518 THEN 'link-local' WHEN n >> 16 = 49320 THEN 'private-c' WHEN n >> 17 = 25353 THEN 'benchmarking'
        WHEN n >> 20 = 2753 THEN 'private-b' WHEN n >> 22 = 401 THEN 'cgnat' WHEN n >> 24 = 127 THEN 'loopback' WHEN n >> 24 = 10 THEN 'private-a' WHEN n >> 24 = 0 THEN 'this-network'
        WHEN n >> 28 = 14 THEN 'multicast' WHEN n >> 28 = 15 THEN 'reserved' WHEN event_id % 5 < 2 THEN 'embedded-ipv4' ELSE 'public' END AS range_name FROM numbered) x GROUP BY 1""")  # fmt: skip
def _(spark, sf_dir):
    n = F.col("event_id") * 2654435761 % 4294967296
    octets = [F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    # One in five is written as a mapped address, and one in five for NAT64 with hexadecimal digits.
    words = [F.lpad(F.lower(F.hex(F.shiftrightunsigned(n, s).bitwiseAND(0xFFFF))), 4, "0") for s in (16, 0)]
    dotted, k = F.concat_ws(".", *octets), F.col("event_id") % 5
    ip = F.when(k == 0, F.concat(F.lit("::FFFF:"), dotted)).when(k == 1, F.concat(F.lit("64:ff9b::"), *words[:1], F.lit(":"), words[1])).otherwise(dotted)
    events = tables.load(spark, sf_dir, "events").select(ip.alias("ip"))
    return network.classify_addresses(events, "ip").groupBy("range_name").agg(F.count("*").alias("n"))


ACCESS = """
    people AS (SELECT c_custkey AS user_id, c_custkey % 10 = 0 AS disabled FROM customer),
    spaces AS (SELECT n_nationkey AS workspace_id, n_regionkey AS agency_id FROM nation),
    direct AS (SELECT c_custkey AS user_id, c_nationkey AS workspace_id, CAST(c_custkey % 4 AS INTEGER) AS rank, 1 AS d FROM customer),
    agency AS (SELECT c_custkey AS user_id, workspace_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS rank, 0 AS d FROM customer JOIN spaces ON agency_id = c_custkey % 5 WHERE c_custkey % 7 = 0),
    paths AS (SELECT * FROM direct UNION ALL SELECT * FROM agency)"""


@query("j18_workspace_access", f"""WITH {ACCESS}
    SELECT user_id, workspace_id, CASE rank WHEN 0 THEN 'viewer' WHEN 1 THEN 'member' WHEN 2 THEN 'admin' ELSE 'owner' END AS role, CASE d WHEN 1 THEN 'direct' ELSE 'agency' END AS via
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, workspace_id ORDER BY rank DESC, d DESC) AS n FROM paths JOIN people USING (user_id) WHERE NOT disabled) x WHERE n = 1""")  # fmt: skip
def _(spark, sf_dir):
    customer, nation = tables.load(spark, sf_dir, "customer"), tables.load(spark, sf_dir, "nation")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    user = F.col("c_custkey").alias("user_id")
    users = customer.select(user, (F.col("c_custkey") % 10 == 0).alias("disabled"))
    members = customer.select(user, F.col("c_nationkey").alias("workspace_id"), pick(access.ROLES, F.col("c_custkey") % 4).alias("role"))
    agencies = customer.where("c_custkey % 7 = 0").select(user, (F.col("c_custkey") % 5).alias("agency_id"), pick(list(access.AGENCY_ROLES), F.col("c_custkey") % 3).alias("role"))
    spaces = nation.select(F.col("n_nationkey").alias("workspace_id"), F.col("n_regionkey").alias("agency_id"))
    return access.workspace_access(users, members, agencies, spaces)


@query("j20_attribution_violations", """SELECT id, CASE WHEN published IS NULL THEN 'missing_output' WHEN NOT published THEN 'unpublished_output' ELSE 'outcome_without_contact' END AS violation
    FROM (SELECT t.id, o.published, t.id % 3 = 0 AS is_lead, t.id % 2 = 0 AS lacks FROM touches t LEFT JOIN outputs o ON o.id = t.id * 7 % 1500) x
    WHERE published IS NULL OR NOT published OR (is_lead AND lacks)""", "touches", "outputs")  # fmt: skip
def _(touches, outputs):
    events = touches.select("id", (F.col("id") * 7 % 1500).alias("output_id"), F.when(F.col("id") % 3 == 0, "lead").otherwise("click").alias("outcome"), F.when(F.col("id") % 2 == 1, F.col("contact_id")).alias("contact_id"))
    return quality.attribution_violations(events, outputs)


@query("j20_outcome_violations", """SELECT id, CASE WHEN published IS NULL THEN 'missing_output' ELSE 'unpublished_output' END AS violation FROM (SELECT t.id, o.published FROM touches t LEFT JOIN outputs o ON o.id = t.id * 7 % 1500) x WHERE published IS NULL OR NOT published
    UNION ALL SELECT id, 'target_contradicts_outcome' FROM (SELECT id, id % 6 AS outcome, contact_id IS NOT NULL AND id % 3 = 0 AS by_contact, id % 4 = 1 AS by_acquisition, id % 5 < 2 AS by_deal FROM touches) x
    WHERE NOT CASE outcome WHEN 5 THEN false WHEN 0 THEN by_contact AND NOT by_acquisition AND NOT by_deal WHEN 1 THEN by_acquisition AND NOT by_contact AND NOT by_deal ELSE by_deal AND NOT by_contact AND NOT by_acquisition END""", "touches", "outputs")  # fmt: skip
def _(touches, outputs):
    k = F.col("id")
    names = F.array(*map(F.lit, ["contact_created", "acquisition_recorded", "opportunity_created", "opportunity_stage_changed", "opportunity_won", "click"]))
    events = touches.select("id", (k * 7 % 1500).alias("output_id"), F.get(names, (k % 6).cast("int")).alias("outcome"), F.when(k % 3 == 0, F.col("contact_id")).alias("contact_id"), F.when(k % 4 == 1, k).alias("acquisition_id"), F.when(k % 5 < 2, k).alias("opportunity_id"))
    return quality.outcome_violations(events, outputs)


@query("j21_merge_redirects", """WITH RECURSIVE hops AS (SELECT id, merged_into AS survivor FROM contacts WHERE merged_into IS NOT NULL
    UNION SELECT h.id, c.merged_into FROM hops h JOIN contacts c ON c.id = h.survivor WHERE c.merged_into IS NOT NULL) SELECT id, min(survivor) AS survivor FROM hops GROUP BY id""".replace("WITH RECURSIVE", "WITH"), "contacts")  # fmt: skip
def _(contacts):
    return crm.merge_redirects(contacts)


ORACLE_SQL["j21_merge_redirects"] = ORACLE_SQL["j21_merge_redirects"].replace("WITH", "WITH RECURSIVE", 1)

# --- aggregations


@query("a1_stage_totals", "SELECT workspace_id, stage, count(*) AS deals, CAST(sum(value_minor) AS BIGINT) AS value_minor FROM opportunities GROUP BY 1, 2", "opportunities")
def _(opportunities):
    return crm.stage_totals(opportunities)


@query("a2_pipeline_board", """WITH stages AS (SELECT DISTINCT workspace_id, stage, CAST(substr(stage, 1, 1) AS INTEGER) AS position FROM opportunities)
    SELECT s.workspace_id, s.stage, s.position, coalesce(count(o.id), 0) AS deals, CAST(coalesce(sum(o.value_minor), 0) AS BIGINT) AS value_minor
    FROM stages s LEFT JOIN opportunities o ON o.workspace_id = s.workspace_id AND o.stage = s.stage AND o.status <> 'lost' AND o.value_minor > 20000000 GROUP BY 1, 2, 3""", "opportunities")  # fmt: skip
def _(opportunities):
    stages = opportunities.select("workspace_id", "stage", F.substring("stage", 1, 1).cast("int").alias("position")).distinct()
    return crm.pipeline_board(stages, opportunities.where("status <> 'lost' and value_minor > 20000000"))


@query("a3_pipeline_stages", """WITH stages AS (SELECT DISTINCT workspace_id, stage, CASE WHEN stage < '4' THEN 'open' ELSE 'closed' END AS category FROM opportunities),
    counted AS (SELECT s.workspace_id, s.stage, category, count(o.id) AS deals, CAST(coalesce(sum(value_minor), 0) AS BIGINT) AS value_minor FROM stages s LEFT JOIN opportunities o ON o.workspace_id = s.workspace_id AND o.stage = s.stage AND o.value_minor > 20000000 GROUP BY 1, 2, 3)
    SELECT *, CAST(coalesce(sum(deals) FILTER (category = 'open') OVER (PARTITION BY workspace_id), 0) AS BIGINT) AS open_deals, CAST(coalesce(sum(value_minor) FILTER (category = 'open') OVER (PARTITION BY workspace_id), 0) AS BIGINT) AS open_value_minor FROM counted""", "opportunities")  # fmt: skip
def _(opportunities):
    stages = opportunities.select("workspace_id", "stage", F.when(F.col("stage") < "4", "open").otherwise("closed").alias("category")).distinct()
    return crm.pipeline_stage_rows(opportunities.where("value_minor > 20000000"), stages)


@query("a3_pipeline_summary", """SELECT workspace_id, count(*) FILTER (status = 'open') AS open_deals, CAST(coalesce(sum(value_minor) FILTER (status = 'open'), 0) AS BIGINT) AS open_value_minor, count(*) AS deals
    FROM opportunities GROUP BY 1""", "opportunities")  # fmt: skip
def _(opportunities):
    return crm.pipeline_summary(opportunities)


FIRSTS = f"{CLASSIFIED}, firsts AS (SELECT contact_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY captured_at, id) AS n FROM classified) x WHERE n = 1)"


@query("a4_open_value_by_source", f"""WITH {FIRSTS} SELECT coalesce(f.source_type, 'Not recorded') AS source, count(*) AS deals, CAST(sum(value_minor) AS BIGINT) AS value_minor
    FROM opportunities o LEFT JOIN firsts f ON f.contact_id = o.contact_id WHERE status = 'open' GROUP BY 1""", "opportunities", "touches")  # fmt: skip
def _(opportunities, touches):
    return crm.open_value_by_source(opportunities, attribution.classify_source(crm.first_touch(touches)))


SNAPSHOT = """
    people AS (SELECT workspace_id, count(*) FILTER (id % 90 <= 30) AS new_contacts FROM contacts GROUP BY 1),
    leads AS (SELECT workspace_id, count(*) AS qualified_leads FROM touches t JOIN contacts c ON c.id = t.contact_id WHERE t.id % 4 = 1 AND t.id % 50 <= 30 GROUP BY 1),
    deals AS (SELECT workspace_id, count(*) AS open_deals, CAST(sum(value_minor) AS BIGINT) AS open_value_minor FROM opportunities WHERE status = 'open' GROUP BY 1),
    work AS (SELECT workspace_id, count(*) FILTER (status = 'open') AS open_tasks, count(*) FILTER (status = 'open' AND due_at < TIMESTAMP '1998-01-01 00:00:00') AS overdue_tasks
        FROM tasks t JOIN contacts c ON c.id = t.contact_id GROUP BY 1),
    snapshot AS (SELECT workspace_id, new_contacts, coalesce(qualified_leads, 0) AS qualified_leads, coalesce(open_deals, 0) AS open_deals, coalesce(open_value_minor, 0) AS open_value_minor, coalesce(open_tasks, 0) AS open_tasks, coalesce(overdue_tasks, 0) AS overdue_tasks
        FROM people LEFT JOIN leads USING (workspace_id) LEFT JOIN deals USING (workspace_id) LEFT JOIN work USING (workspace_id))"""


def snapshot(contacts: DataFrame, opportunities: DataFrame, work: DataFrame, touches: DataFrame) -> DataFrame:
    """The dashboard of 1998-01-01; contacts were made up to 89 days before it, touches captured up to 49."""
    ago = lambda n: F.lit("1998-01-01").cast("timestamp") - F.make_dt_interval(n.cast("int"))
    made = contacts.withColumn("created_at", ago(F.col("id") % 90))
    seen = touches.select("contact_id", ago(F.col("id") % 50).alias("captured_at"), F.when(F.col("id") % 4 == 1, F.lit("1998-01-01").cast("timestamp")).alias("qualified_at"))
    return crm.growth_snapshot(made, opportunities, work, seen, "1998-01-01 00:00:00")


@query("a5_growth_snapshot", f"WITH {SNAPSHOT} SELECT * FROM snapshot", "contacts", "opportunities", "tasks", "touches")
def _(contacts, opportunities, work, touches):
    return snapshot(contacts, opportunities, work, touches)


@query("a6_metric_rows", f"""WITH {SNAPSHOT}, long AS (SELECT workspace_id, name, value FROM (UNPIVOT snapshot ON new_contacts, qualified_leads, open_deals, open_value_minor, open_tasks INTO NAME name VALUE value)),
    told AS (SELECT l.workspace_id, m.metric, m.label, l.value, m.unit, m.polarity, 'live' AS provenance FROM long l JOIN (VALUES ('new_contacts', 'new_contacts', 'New contacts', 'count', 'higher_is_better'), ('qualified_leads', 'qualified_leads', 'Qualified leads', 'count', 'higher_is_better'),
        ('open_deals', 'open_deals', 'Open opportunities', 'count', 'higher_is_better'), ('open_value_minor', 'pipeline_value', 'Open pipeline value', 'currency', 'higher_is_better'), ('open_tasks', 'open_tasks', 'Open tasks', 'count', 'lower_is_better')) m(name, metric, label, unit, polarity) ON m.name = l.name
        UNION ALL SELECT workspace_id, 'calls', 'Calls', open_tasks * 2, 'count', 'higher_is_better', 'fixture' FROM snapshot WHERE workspace_id % 2 = 0)
    SELECT *, CASE WHEN unit = 'currency' THEN '$' || format('{{:,}}', CAST(round(value / 100.0) AS BIGINT)) ELSE CAST(value AS VARCHAR) END AS formatted, CASE WHEN workspace_id % 2 = 0 THEN 'fixture' ELSE 'live' END AS overall FROM told""", "contacts", "opportunities", "tasks", "touches")  # fmt: skip
def _(contacts, opportunities, work, touches):
    now = snapshot(contacts, opportunities, work, touches)
    fixtures = now.where("workspace_id % 2 = 0").select("workspace_id", F.lit("calls").alias("metric"), F.lit("Calls").alias("label"), (F.col("open_tasks") * 2).alias("value"), F.lit("count").alias("unit"), F.lit("higher_is_better").alias("polarity"))
    return crm.metric_rows(now, fixtures)


@query("a7_open_opp_counts", "SELECT contact_id, count(*) AS open_deals FROM opportunities WHERE status = 'open' GROUP BY 1", "opportunities")
def _(opportunities):
    return crm.open_opp_counts(opportunities)


@query("a8_last_activity", "SELECT contact_id, max(captured_at) AS last_activity FROM touches GROUP BY 1", "touches")
def _(touches):
    return crm.last_activity(touches.withColumnRenamed("captured_at", "occurred_at"))


@query("a9_lead_funnel", f"SELECT form, count(*) FILTER (outcome = 'accepted') AS captured, count(*) FILTER (outcome = 'rejected') AS rejected FROM submissions WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY 1", "submissions")
def _(submissions):
    return crm.lead_funnel(submissions, NOW, 7)


@query("a10_form_summary", """WITH f AS (SELECT DISTINCT form FROM submissions UNION SELECT 'unused') SELECT f.form, count(s.id) AS submissions, count(s.id) FILTER (outcome = 'accepted') AS leads, max(ts) AS last_submission
    FROM f LEFT JOIN submissions s ON s.form = f.form GROUP BY 1""", "submissions")  # fmt: skip
def _(submissions):
    forms = submissions.select("form").union(submissions.select(F.lit("unused"))).distinct()
    return crm.form_summary(submissions, forms)


@query("a11_rejections_by_reason", "SELECT form, rejection_reason, count(*) AS n FROM submissions WHERE outcome = 'rejected' GROUP BY 1, 2", "submissions")
def _(submissions):
    return crm.rejections_by_reason(submissions)


@query("a12_company_contact_counts", "WITH c AS (SELECT DISTINCT company FROM contacts UNION SELECT 'NOBODY') SELECT c.company, count(k.id) AS contacts FROM c LEFT JOIN contacts k ON k.company = c.company AND NOT is_deleted GROUP BY 1", "contacts")
def _(contacts):
    companies = contacts.select("company").union(contacts.select(F.lit("NOBODY"))).distinct()
    return crm.counts_kept_zero(companies, contacts.where("not is_deleted"), "company", "contacts")


@query("a13_tag_usage", "WITH t AS (SELECT DISTINCT stage AS tag FROM opportunities UNION SELECT 'unused') SELECT tag, count(DISTINCT contact_id) AS uses FROM t LEFT JOIN opportunities o ON o.stage = t.tag GROUP BY 1", "opportunities")
def _(opportunities):
    tags = opportunities.select(F.col("stage").alias("tag")).union(opportunities.select(F.lit("unused"))).distinct()
    return crm.counts_kept_zero(tags, opportunities.select(F.col("stage").alias("tag"), "contact_id").distinct(), "tag", "uses")


@query("a14_site_form_counts", "WITH sites AS (SELECT DISTINCT subject % 50 AS site FROM submissions), f AS (SELECT DISTINCT subject % 50 AS site, form FROM submissions WHERE subject % 50 % 7 <> 0 AND form <> 'view') SELECT s.site, count(form) AS forms FROM sites s LEFT JOIN f ON f.site = s.site GROUP BY 1", "submissions")
def _(submissions):
    sited = submissions.select((F.col("subject") % 50).alias("site"), "form").distinct()
    return crm.counts_kept_zero(sited.select("site").distinct(), sited.where("site % 7 <> 0 and form <> 'view'"), "site", "forms")


STATE = "CASE outcome WHEN 'redirected' THEN 'queued' WHEN 'unchanged' THEN 'skipped' ELSE 'fetched' END"


@query("a15_frontier_counts", f"SELECT crawl_id, count(*) AS n_rows, count(*) FILTER ({STATE} IN ('queued', 'fetched')) AS fetchable, count(*) FILTER ({STATE} = 'queued') AS queued FROM graph_pages GROUP BY 1", "graph_pages")
def _(pages):
    return crawl.frontier_counts(pages.withColumn("state", F.expr(STATE)))


OBSERVED = "observed AS (SELECT page_id % 9 AS crawl_id, CASE WHEN page_id % 13 = 0 THEN 'server_error' WHEN page_id % 17 = 0 THEN 'blocked' ELSE outcome END AS outcome, page_id * 10 AS bytes, CASE WHEN page_id % 4 = 0 THEN 'sitemap' ELSE 'link' END AS source FROM graph_pages)"


def observed(pages: DataFrame) -> DataFrame:
    outcome = F.when(F.col("page_id") % 13 == 0, "server_error").when(F.col("page_id") % 17 == 0, "blocked").otherwise(F.col("outcome"))
    return pages.select((F.col("page_id") % 9).alias("crawl_id"), "url", outcome.alias("outcome"), (F.col("page_id") * 10).alias("bytes"), F.when(F.col("page_id") % 4 == 0, "sitemap").otherwise("link").alias("source"))


@query("a16_crawl_totals", f"WITH {OBSERVED} SELECT crawl_id, count(*) FILTER (outcome IN ('fetched', 'unchanged')) AS fetched, count(*) FILTER (outcome IN ('server_error', 'blocked')) AS failed, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (source = 'sitemap') AS sitemap_urls FROM observed GROUP BY 1", "graph_pages")
def _(pages):
    return crawl.crawl_totals(observed(pages))


@query("g6_finish_runs", f"WITH {OBSERVED} SELECT crawl_id, count(*) FILTER (outcome IN ('fetched', 'unchanged')) AS fetched, count(*) FILTER (outcome IN ('server_error', 'blocked')) AS failed, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (source = 'sitemap') AS sitemap_urls, count(*) FILTER (outcome IN ('redirected', 'unchanged')) AS skipped FROM observed GROUP BY 1", "graph_pages")
def _(pages):
    seen = observed(pages)
    frontier = seen.select("crawl_id", "url", F.when(F.col("outcome") == "redirected", "queued").when(F.col("outcome") == "unchanged", "fetching").otherwise("fetched").alias("state"), F.lit(None).cast("string").alias("skip_reason"))
    runs, closed = crawl.finish_runs(seen.select("crawl_id").distinct(), frontier, seen)
    # Both results are asked for: rows that stay open would not be counted.
    return runs.join(closed.where("skip_reason = 'cancelled'").select("crawl_id").distinct(), "crawl_id")


@query("a17_site_page_history", "SELECT event_type AS site, CAST(user_id AS VARCHAR) AS url, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    events = tables.load(spark, sf_dir, "events")
    return crawl.site_page_history(events.select(F.col("event_type").alias("site"), F.col("user_id").cast("string").alias("url"), F.col("ts").alias("seen_at")))


@query("a18_ingested_counts", "SELECT form AS source_system, count(*) AS n FROM submissions WHERE outcome = 'accepted' GROUP BY 1", "submissions")
def _(submissions):
    return crm.ingested_counts(submissions.where("outcome = 'accepted'").withColumnRenamed("form", "source_system"))


@query("a19_merge_preview_counts", """WITH r AS (SELECT id - 1 AS survivor, id AS duplicate FROM contacts WHERE id % 20 = 1),
    t AS (SELECT contact_id, count(*) AS n FROM touches GROUP BY 1), o AS (SELECT contact_id, count(*) AS n FROM opportunities GROUP BY 1)
    SELECT survivor, duplicate, coalesce(t.n, 0) AS touches, coalesce(o.n, 0) AS deals FROM r LEFT JOIN t ON t.contact_id = duplicate LEFT JOIN o ON o.contact_id = duplicate""", "contacts", "touches", "opportunities")  # fmt: skip
def _(contacts, touches, opportunities):
    requests = contacts.where("id % 20 = 1").select((F.col("id") - 1).alias("survivor"), F.col("id").alias("duplicate"))
    return crm.merge_preview_counts(requests, {"touches": touches, "deals": opportunities})


@query("a19_erasure_preview", """WITH r AS (SELECT id FROM contacts WHERE id % 20 = 1),
    acts AS (SELECT id, CASE WHEN id % 2 = 0 THEN contact_id END AS contact_id, CASE WHEN id % 3 = 0 THEN id % 4000 END AS opportunity_id, CASE WHEN id % 5 = 0 THEN id END AS touch_id FROM touches),
    reached_t AS (SELECT DISTINCT id, gone FROM (SELECT id, contact_id AS gone FROM tasks UNION ALL SELECT t.id, o.contact_id FROM tasks t JOIN opportunities o ON o.id = t.opportunity_id) x),
    reached_a AS (SELECT DISTINCT id, gone FROM (SELECT id, contact_id AS gone FROM acts UNION ALL SELECT a.id, o.contact_id FROM acts a JOIN opportunities o ON o.id = a.opportunity_id UNION ALL SELECT a.id, t.contact_id FROM acts a JOIN touches t ON t.id = a.touch_id) x)
    SELECT r.id, (SELECT count(*) FROM touches WHERE contact_id = r.id) AS touches, (SELECT count(*) FROM opportunities WHERE contact_id = r.id) AS opportunities, (SELECT count(*) FROM reached_t WHERE gone = r.id) AS tasks, (SELECT count(*) FROM reached_a WHERE gone = r.id) AS activities,
        (SELECT count(DISTINCT stage) FROM opportunities WHERE contact_id = r.id) AS fields, (SELECT count(DISTINCT status) FROM opportunities WHERE contact_id = r.id) AS tags FROM r""", "contacts", "touches", "opportunities", "tasks")  # fmt: skip
def _(contacts, touches, opportunities, work):
    fields, tags = opportunities.select("contact_id", "stage").distinct(), opportunities.select("contact_id", "status").distinct()
    return crm.erasure_preview_counts(contacts.where("id % 20 = 1").select("id"), touches, opportunities, work, activities_of(touches), fields, tags)


def activities_of(touches: DataFrame) -> DataFrame:
    """A timeline whose rows name a contact, a deal or a touch, or several of them."""
    return touches.select("id", F.when(F.col("id") % 2 == 0, F.col("contact_id")).alias("contact_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 4000).alias("opportunity_id"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("touch_id"), F.concat(F.lit("Seen "), F.coalesce("utm_source", F.lit("-"))).alias("summary"), F.col("gclid").alias("detail"))


@query("a20_trace_counts", """WITH counts AS (SELECT 'contacts' AS table_name, count(*) AS n FROM contacts WHERE contains(lower(coalesce(email, '')), 'user12') OR contains(lower(first_name), 'user12')
    UNION ALL SELECT 'touches', count(*) FROM touches WHERE contains(coalesce(gclid, ''), 'user12') OR contains(lower(coalesce(referrer, '')), 'user12')
    UNION ALL SELECT 'opportunities', count(*) FROM opportunities WHERE id % 1000 = 12 UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE id % 1000 = 12 UNION ALL SELECT 'activities', count(*) FROM touches WHERE id % 1000 = 12
    UNION ALL SELECT 'submissions', count(*) FROM submissions WHERE contains(CAST(subject AS VARCHAR), '12'))
    SELECT * FROM counts UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM counts""", "contacts", "touches", "opportunities", "tasks", "submissions")  # fmt: skip
def _(contacts, touches, opportunities, work, submissions):
    said = lambda df: df.withColumn("title", F.concat(F.lit("For USER"), (F.col("id") % 1000).cast("string"), F.lit("x"))).where("id % 1000 < 100 or id % 1000 >= 130")
    json = submissions.withColumn("payload", F.to_json(F.struct(F.concat(F.lit("user"), "subject").alias("name"), "form"))).withColumn("payload", F.regexp_replace("payload", "user([0-9]*12[0-9]*)", "user12"))
    return crm.count_traces({"contacts": (contacts, ["email", "first_name"]), "touches": (touches, ["gclid", "referrer"]), "opportunities": (said(opportunities), ["title"]), "tasks": (said(work), ["title"]), "activities": (said(touches), ["title"]), "submissions": (json, ["payload"])}, "User12")


@query("a21_task_load", "SELECT priority, count(*) FILTER (status = 'open') AS open_tasks, count(*) FILTER (status = 'open' AND due_at < TIMESTAMP '1998-01-01 00:00:00') AS overdue_tasks FROM tasks GROUP BY 1", "tasks")
def _(tasks):
    return crm.task_load(tasks, "1998-01-01 00:00:00")


@query("a22_output_outcomes", """SELECT o.id, count(*) FILTER (form = 'click') AS click, count(*) FILTER (form = 'purchase') AS purchase, count(*) FILTER (form = 'signup') AS signup
    FROM outputs o JOIN submissions s ON s.id % 1000 = o.id WHERE published AND form IN ('click', 'purchase', 'signup') GROUP BY 1""", "outputs", "submissions")  # fmt: skip
def _(outputs, submissions):
    events = submissions.where("form in ('click', 'purchase', 'signup')").select((F.col("id") % 1000).alias("output_id"), F.col("form").alias("outcome"))
    return crm.output_outcomes(events, outputs, ["click", "purchase", "signup"])


# --- windows, top-k, set operations


@query("w1_first_touch", "SELECT contact_id, id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY captured_at, id) AS n FROM touches) x WHERE n = 1", "touches")
def _(touches):
    return crm.first_touch(touches).select("contact_id", "id", "captured_at")


@query("w2_first_touch_flag", "SELECT id, row_number() OVER (PARTITION BY contact_id ORDER BY captured_at, id) = 1 AS is_first_touch FROM touches", "touches")
def _(touches):
    return crm.flag_first_touch(touches).select("id", "is_first_touch")


@query("w3_touch_history", "SELECT contact_id, string_agg(coalesce(utm_source, '-'), '>' ORDER BY captured_at, id) AS history FROM touches GROUP BY 1", "touches")
def _(touches):
    return crm.touch_history(touches, "utm_source").select("contact_id", F.array_join("history", ">").alias("history"))


@query("w4_entry_stage", """SELECT workspace_id AS pipeline_id, min(stage) AS stage_id FROM opportunities WHERE stage <> '1-URGENT' AND status = 'open' GROUP BY 1""", "opportunities")
def _(opportunities):
    stages = opportunities.where("status = 'open'").select(F.col("workspace_id").alias("pipeline_id"), F.col("stage").alias("stage_id"), F.substring("stage", 1, 1).cast("int").alias("position"), F.lit("open").alias("category"), (F.col("stage") == "1-URGENT").alias("archived")).distinct()
    return crm.entry_stage(stages).select("pipeline_id", "stage_id")


@query("w5_form_version_state", f"WITH {FORMS} SELECT form_id, max(version) AS newest, max(version) FILTER (is_published) AS published, max(version) + 1 AS next_version FROM versions GROUP BY 1", "submissions")
def _(submissions):
    return crm.form_version_state(form_tables(submissions)[1])


HITS = "hits AS (SELECT id, subject % 40 AS subject, form, ts, floor(epoch(ts) / 86400) AS bucket FROM submissions)"


@query("w6_rate_limit_verdicts", f"""WITH {HITS}, one AS (SELECT *, row_number() OVER (PARTITION BY subject, form, bucket ORDER BY ts, id) AS n FROM hits),
    two AS (SELECT *, row_number() OVER (PARTITION BY subject, bucket ORDER BY ts, id) AS m FROM one WHERE n <= 2),
    three AS (SELECT *, row_number() OVER (PARTITION BY form, bucket ORDER BY ts, id) AS k FROM two WHERE m <= 6)
    SELECT id, 'ip_form' AS rejected_by FROM one WHERE n > 2 UNION ALL SELECT id, 'ip' FROM two WHERE m > 6 UNION ALL SELECT id, CASE WHEN k > 30 THEN 'form' END FROM three""", "submissions")  # fmt: skip
def _(submissions):
    hits = submissions.select("id", (F.col("subject") % 40).alias("subject"), "form", "ts")
    return limits.rate_limit_verdicts(hits, 86400, [("ip_form", ["subject", "form"], 2), ("ip", ["subject"], 6), ("form", ["form"], 30)]).select("id", "rejected_by")


#: The sliding log of a key, hit by hit.
LOGGED = """WITH RECURSIVE hits AS (SELECT id, {key} AS key, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) AS n FROM submissions),
    replay AS (
        SELECT key, n, id, true AS allowed, [sec] AS log, sec FROM hits WHERE n = 1
        UNION ALL SELECT key, n, id, len(kept) < {most}, CASE WHEN len(kept) < {most} THEN list_append(kept, sec) ELSE kept END, sec
        FROM (SELECT h.*, list_filter(r.log, lambda t: t > h.sec - {window}) AS kept FROM replay r JOIN hits h ON h.key IS NOT DISTINCT FROM r.key AND h.n = r.n + 1) x)"""


@query("w7_burst_verdicts", LOGGED.format(key="(subject, form)", most=2, window=86400) + " SELECT id, allowed FROM replay", "submissions")
def _(submissions):
    return limits.burst_verdicts(submissions.select("id", "subject", "form", "ts"), 2, 86400.0)


@query("w8_attempt_limits", LOGGED.format(key="subject", most=3, window=86400) + " SELECT id, allowed, CAST(3 - len(log) AS BIGINT) AS remaining, CASE WHEN allowed THEN 0.0::DOUBLE ELSE log[1] + 86400 - sec END AS retry_after FROM replay", "submissions")
def _(submissions):
    return limits.attempt_limits(submissions.select("id", "subject", "ts"), 3, 86400.0)


@query("w9_stage_path", "SELECT id, stage, previous FROM (SELECT *, lag(stage) OVER (PARTITION BY contact_id ORDER BY created_at, id) AS previous FROM opportunities) x WHERE previous IS NULL OR previous <> stage", "opportunities")
def _(opportunities):
    moves = opportunities.select("id", F.col("contact_id").alias("deal"), "stage", F.col("created_at").alias("ts"))
    return limits.stage_path(moves).select("id", "stage", "previous")


@query("w9_stage_moves", """WITH RECURSIVE moves AS (
        SELECT contact_id AS deal, id AS move_id, stage AS target, CASE WHEN id % 3 = 0 THEN '2-HIGH' END AS expected, min(stage) OVER (PARTITION BY contact_id) AS start,
            row_number() OVER (PARTITION BY contact_id ORDER BY created_at, id) AS n FROM opportunities),
    replay AS (
        SELECT deal, 0 AS n, NULL::BIGINT AS move_id, '' AS result, start AS stage FROM moves WHERE n = 1
        UNION ALL SELECT m.deal, m.n, m.move_id, CASE WHEN expected <> r.stage THEN 'rejected' WHEN target = r.stage THEN 'no_op' WHEN target = '5-LOW' THEN 'lost' WHEN target = '4-NOT SPECIFIED' THEN 'won' ELSE 'stage_changed' END,
            CASE WHEN expected <> r.stage THEN r.stage ELSE target END
        FROM replay r JOIN moves m ON m.deal = r.deal AND m.n = r.n + 1)
    SELECT deal, move_id, result, stage, stage IN ('5-LOW', '4-NOT SPECIFIED') AS closed FROM replay WHERE n > 0""", "opportunities")
def _(opportunities):
    deals = opportunities.groupBy(F.col("contact_id").alias("deal")).agg(F.min("stage").alias("stage"))
    moves = opportunities.select(F.col("contact_id").alias("deal"), F.col("id").alias("move_id"), F.col("stage").alias("to_stage"), F.when(F.col("id") % 3 == 0, "2-HIGH").alias("expected_stage"), F.col("created_at").alias("ts"))
    return limits.apply_stage_moves(deals, moves, {"5-LOW": "lost", "4-NOT SPECIFIED": "won"})


@query("k1_keyset_page", "SELECT id, value_minor FROM opportunities WHERE value_minor > 5000000 OR (value_minor = 5000000 AND id > 10) ORDER BY value_minor, id LIMIT 51", "opportunities")
def _(opportunities):
    return crm.keyset_page(opportunities, "value_minor", 50, crm.cursor_of(5000000, 10)).select("id", "value_minor")


@query("k2_task_page", "SELECT id FROM tasks WHERE status = 'open' ORDER BY due_at NULLS LAST, id LIMIT 101", "tasks")
def _(tasks):
    return crm.keyset_page(tasks.where("status = 'open'"), "due_at", 100).select("id")


@query("k3_newest_per_form", "SELECT id, form FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY ts DESC, id DESC) AS n FROM submissions) x WHERE n <= 10", "submissions")
def _(submissions):
    return crm.newest(submissions, "ts", 10, "form").select("id", "form")


@query("k4_recent_corpus", """SELECT id, workspace_id, total FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY id DESC) AS n, count(*) OVER (PARTITION BY workspace_id) AS total
    FROM outputs WHERE published) x WHERE n <= 25""", "outputs")  # fmt: skip
def _(outputs):
    return crm.recent_corpus(outputs, 25).select("id", "workspace_id", "total")


@query("k5_next_batch", f"SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY depth, page_id, url) AS n FROM graph_pages WHERE {STATE} = 'queued') x WHERE n <= 40", "graph_pages")
def _(pages):
    return crawl.next_batch(pages.withColumn("state", F.expr(STATE)).withColumn("created_at", F.col("page_id")), 40).select("page_id")


@query("u3_new_candidates", """SELECT crawl_id, target_url AS url, min(source_page_id % 5) AS depth FROM graph_links l WHERE target_url NOT IN (SELECT url FROM graph_pages WHERE depth < 5) GROUP BY 1, 2""", "graph_pages", "graph_links")
def _(pages, links):
    candidates = links.select("crawl_id", F.col("target_url").alias("url"), (F.col("source_page_id") % 5).alias("depth"))
    return crawl.new_candidates(candidates, pages.where("depth < 5"))


@query("u4_removed_options", """WITH old AS (SELECT DISTINCT workspace_id, stage FROM opportunities), new AS (SELECT DISTINCT workspace_id, stage FROM opportunities WHERE workspace_id % 4 <> 3 AND stage > CAST(1 + workspace_id % 3 AS VARCHAR))
    SELECT workspace_id, string_agg(stage, ',' ORDER BY stage) AS removed FROM old WHERE (workspace_id, stage) NOT IN (SELECT workspace_id, stage FROM new) GROUP BY 1""", "opportunities")  # fmt: skip
def _(opportunities):
    kept = (F.col("workspace_id") % 4 != 3) & (F.col("stage") > (F.col("workspace_id") % 3 + 1).cast("string"))
    offered = opportunities.groupBy("workspace_id").agg(F.collect_set("stage").alias("old"), F.collect_set(F.when(kept, F.col("stage"))).alias("new"))
    return offered.select("workspace_id", F.array_join(F.array_sort(crm.removed_options(F.col("old"), F.col("new"))), ",").alias("removed")).where("removed <> ''")


@query("s6_insert_ignore", "SELECT url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM (SELECT target_url AS url, source_page_id AS page_id FROM graph_links) y) x WHERE n = 1 AND url NOT IN (SELECT url FROM graph_pages WHERE page_id % 2 = 0)", "graph_pages", "graph_links")
def _(pages, links):
    rows = links.select(F.col("target_url").alias("url"), F.col("source_page_id").alias("page_id"))
    return tables.insert_ignore(pages.where("page_id % 2 = 0").select("url"), rows, ["url"], ["page_id"])


@query("s7_upsert", """SELECT coalesce(p.page_id, n.page_id) AS page_id, CASE WHEN n.page_id IS NOT NULL THEN n.depth ELSE p.depth END AS depth
    FROM (SELECT page_id, depth FROM graph_pages WHERE page_id % 3 <> 0) p FULL JOIN (SELECT page_id, depth + 100 AS depth FROM graph_pages WHERE page_id % 2 = 0) n ON n.page_id = p.page_id""", "graph_pages")  # fmt: skip
def _(pages):
    target = pages.where("page_id % 3 <> 0").select("page_id", "depth")
    return tables.upsert(target, pages.where("page_id % 2 = 0").select("page_id", (F.col("depth") + 100).alias("depth")), ["page_id"], ["depth"])


# --- scalar work as table jobs

NORMAL = r"""
    parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
            CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path,
            list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'ref'))) AS pairs FROM pages),
    normal AS (SELECT page_id, host, path, scheme || '://' || host || path || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS normalised FROM parts)"""


@query("c1_url_identity_groups", f"""WITH {NORMAL} SELECT normalised, count(*) AS pages, min(page_id) AS first_page, CAST(len(list_filter(string_split(any_value(path), '/'), lambda s: s <> '')) AS INTEGER) AS depth FROM normal GROUP BY 1""")
def _(spark, sf_dir):
    named = urls.normalise_urls(tables.load(spark, sf_dir, "pages"), "url")
    return named.groupBy("normalised").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).withColumn("depth", urls.url_depth(F.col("normalised")))


@query("c3_scope_mix", r"""WITH said AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)
    SELECT CASE WHEN host = site AND scheme = 'http' THEN 'in_scope' WHEN host = site THEN 'scheme_upgrade' WHEN ends_with(host, '.' || site) OR ends_with(site, '.' || host) THEN 'other_subdomain' ELSE 'external' END AS scope, count(*) AS n
    FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN host WHEN page_id % 3 = 0 THEN regexp_replace(host, '^[^.]*[.]', '') ELSE 'other.test' END AS site FROM said) x GROUP BY 1""")  # fmt: skip
def _(spark, sf_dir):
    host = urls.host_of(F.col("url"))
    site = F.when(F.col("page_id") % 2 == 0, host).when(F.col("page_id") % 3 == 0, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise("other.test")
    scope = urls.classify_scope(F.col("url"), F.concat(F.lit("http://"), site))
    return tables.load(spark, sf_dir, "pages").groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))


@query("c4_fetch_outcome_mix", """SELECT outcome, coalesce(failure_category, '-') AS failure_category, count(*) AS n FROM (SELECT CASE WHEN f = 'ssrf_blocked' THEN 'blocked' WHEN f IS NOT NULL THEN 'failed' WHEN s = 304 THEN 'unchanged'
        WHEN s < 300 THEN 'fetched' WHEN s < 400 THEN 'redirected' WHEN s < 500 THEN 'client_error' ELSE 'server_error' END AS outcome,
        CASE WHEN f IS NOT NULL THEN f WHEN s BETWEEN 400 AND 499 THEN 'http_4xx' WHEN s >= 500 THEN 'http_5xx' END AS failure_category
    FROM (SELECT 200 + event_id % 320 AS s, CASE event_id % 9 WHEN 0 THEN 'ssrf_blocked' WHEN 1 THEN 'dns_failure' END AS f FROM events) x) y GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf_dir):
    failure = F.when(F.col("event_id") % 9 == 0, "ssrf_blocked").when(F.col("event_id") % 9 == 1, "dns_failure")
    rows = tables.load(spark, sf_dir, "events").select((F.col("event_id") % 320 + 200).alias("http_status"), failure.alias("failure"))
    return crawl.page_outcomes(rows).groupBy("outcome", F.coalesce("failure_category", F.lit("-")).alias("failure_category")).agg(F.count("*").alias("n"))


def pages_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "pages").withColumn("origin", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1))


@query("c5_link_table", r"SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script.*?</script>', '', 'gs'), '<a [^>]*href=')) AS BIGINT) AS links FROM pages WHERE regexp_matches(html, '<a [^>]*href=')")
def _(spark, sf_dir):
    return crawl.extract_links(pages_with_origin(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("links"))


@query("c5_link_report", r"""WITH p AS (
        SELECT page_id, regexp_replace(url, '#.*$', '') AS own, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
            regexp_extract_all(regexp_replace(html, '<!--.*?-->|<(script|style|noscript|template|svg)\b.*?</(script|style|noscript|template|svg)', '', 'gs'), '<a [^>]*href="[^"]*"[^>]*>') AS tags FROM pages),
    l AS (SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, origin, regexp_matches(tag, 'rel="[^"]*(nofollow|ugc|sponsored)') AS nofollow FROM p, unnest(tags) t(tag)),
    t AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END AS target, starts_with(href, '/') OR starts_with(href, origin || '/') AS internal, nofollow FROM l),
    o AS (SELECT page_id, count(*) AS links_out, count(*) FILTER (internal) AS internal_out, count(*) FILTER (nofollow) AS nofollow_out FROM t GROUP BY 1),
    i AS (SELECT p.page_id, count(*) AS links_in FROM p JOIN t ON t.target = p.own AND t.page_id <> p.page_id GROUP BY 1)
    SELECT page_id, coalesce(links_out, 0) AS links_out, coalesce(internal_out, 0) AS internal_out, coalesce(nofollow_out, 0) AS nofollow_out, coalesce(links_in, 0) AS links_in, coalesce(links_in, 0) = 0 AS is_orphan
    FROM p LEFT JOIN o USING (page_id) LEFT JOIN i USING (page_id)""")
def _(spark, sf_dir):
    pages = pages_with_origin(spark, sf_dir)
    return crawl.link_report(pages, tables.shared_table(crawl.extract_links(pages)))


@query("c7_verification_audit", """SELECT site, CASE WHEN bool_or(page_id % 8 = 0) THEN 'verified' WHEN bool_or(page_id % 8 = 1) THEN 'token_mismatch' ELSE 'token_absent' END AS state FROM (SELECT *, page_id // 3 AS site FROM pages) x GROUP BY 1""")
def _(spark, sf_dir):
    site, k = F.floor(F.col("page_id") / 3), F.col("page_id") % 8
    right, wrong = F.md5(site.cast("string").cast("binary")), F.md5(F.lit("other").cast("binary"))
    tag = lambda before, token, after: F.concat(F.lit(before), token, F.lit(after))
    head = (
        F.when(k == 0, tag("<META content='", F.upper(right), "' data-x=1 NAME = Site-Verification />")).when(k == 1, tag('<meta name="site-verification" content=" ', wrong, ' ">'))
        .when(k == 2, tag('<meta data-name="site-verification" content="', right, '">')).when(k == 3, tag('<meta name="site-verification" content="', right, '0">'))
        .when(k == 4, tag('<!-- <meta name="site-verification" content="', right, '"> -->')).when(k == 5, tag('<template><meta name="site-verification" content="', right, '"></template>')).otherwise(F.lit(""))
    )
    stray = F.when(k == 6, tag('<meta name="site-verification" content="', right, '">')).otherwise(F.lit(""))
    pages = tables.load(spark, sf_dir, "pages").select(site.alias("site"), F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), stray, F.col("html")).alias("html"))
    expected = pages.select("site").distinct().withColumn("token", F.md5(F.col("site").cast("string").cast("binary")))
    return crawl.verification_tags(pages, expected, "site-verification")


@query("c8_url_policy_mix", r"""SELECT coalesce(reason, 'admitted') AS reason, count(*) AS n FROM (SELECT CASE page_id % 9 WHEN 0 THEN 'scheme_not_allowed' WHEN 1 THEN 'credentials_present' WHEN 2 THEN 'port_not_allowed'
    WHEN 3 THEN 'sensitive_query' WHEN 4 THEN 'sensitive_query' WHEN 6 THEN 'unparseable' WHEN 7 THEN 'url_too_long' END AS reason FROM pages) x GROUP BY 1""")  # fmt: skip
def _(spark, sf_dir):
    rest = F.regexp_replace("url", r"^[a-z]+://([^/?#]*)", "")
    host, k = urls.host_of(F.col("url")), F.col("page_id") % 9
    said = [["ftp://", host, rest], ["http://me:pw@", host, rest], ["http://", host, ":8080", rest], ["https://", host, "/?user[auth_token]=1"], ["https://", host, "/?PHPSESSID=1"], ["https://@", host, ":443/?code=SPRING20&key=colour&design=1#?token"], ["https://", rest], ["https://", host, "/", "x" * 2048]]
    changed = F.col("url")
    for n, parts in enumerate(said):
        bare = F.lit("https://") if n == 6 else F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        changed = F.when(k == n, bare).otherwise(changed)
    return tables.load(spark, sf_dir, "pages").groupBy(F.coalesce(urls.url_policy(changed), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


@query("c9_bare_hosts", r"""SELECT host, count(*) AS n FROM (SELECT CASE page_id % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'real.test' ELSE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www[.]', '') END AS host FROM pages) x GROUP BY 1""")
def _(spark, sf_dir):
    host, k = urls.host_of(F.col("url")), F.col("page_id") % 6
    shown = F.when(k == 0, F.concat(host, F.lit("/about"))).when(k == 1, F.concat(F.lit("\tHTTPS:\\"), host)).when(k == 3, F.concat(F.lit("mailto:a@"), host)).when(k == 4, F.concat(host, F.lit(":3000"))).when(k == 5, F.concat(F.lit("https://"), host, F.lit("@WWW.real.test/x"))).otherwise(F.col("url"))
    return tables.load(spark, sf_dir, "pages").groupBy(urls.bare_host(shown).alias("host")).agg(F.count("*").alias("n"))


@query("c9_number_hosts", """SELECT page_id, CASE WHEN page_id % 5 = 3 THEN concat_ws('.', 10, n >> 16 & 255, n >> 8 & 255, n & 255) WHEN page_id % 5 < 4 THEN concat_ws('.', n >> 24 & 255, n >> 16 & 255, n >> 8 & 255, n & 255) END AS host FROM (SELECT page_id, page_id * 7919 % 4294967296 AS n FROM pages) x""")
def _(spark, sf_dir):
    # One IPv4 address as a decimal, hexadecimal and octal number, in two parts, and with a part too many.
    n, k = F.col("page_id") * 7919 % (1 << 32), F.col("page_id") % 5
    said = F.when(k == 0, n.cast("string")).when(k == 1, F.concat(F.lit("0x"), F.hex(n))).when(k == 2, F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8))).when(k == 3, F.concat(F.lit("012."), (n % (1 << 24)).cast("string"))).otherwise(F.concat(F.lit("1.2.3.4."), n.cast("string")))
    return tables.load(spark, sf_dir, "pages").select("page_id", urls.bare_host(F.concat(F.lit("http://"), said, F.lit(":8080/x"))).alias("host"))


@query("c10_origin_mix", """SELECT origin, count(*) AS n, coalesce(max(CASE WHEN origin LIKE 'https%' AND origin <> 'https://evil.test' THEN 1 ELSE 0 END), 0) = 1 AS allowed FROM (
    SELECT CASE page_id % 5 WHEN 0 THEN 'https://evil.test' WHEN 1 THEN 'https://' || host WHEN 2 THEN NULL ELSE said || host END AS origin
    FROM (SELECT page_id, regexp_extract(lower(url), '^([a-z]+://)', 1) AS said, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) x) y GROUP BY 1""")
def _(spark, sf_dir):
    host, k = urls.host_of(F.col("url")), F.col("page_id") % 5
    # A trusted name before the @, a bare host, a value too long, and addresses as they are.
    shown = F.when(k == 0, F.concat(F.lit("https://"), host, F.lit("@evil.test/"))).when(k == 1, F.concat(host, F.lit("/x"))).when(k == 2, F.concat(F.col("url"), F.lit("y" * 255))).otherwise(F.col("url"))
    pages = tables.load(spark, sf_dir, "pages").select(urls.normalise_origin(shown).alias("origin"))
    allow = F.array(F.when(F.col("origin").startswith("https") & (F.col("origin") != "https://evil.test"), F.col("origin")).otherwise(F.lit("https://nowhere.test")))
    return pages.groupBy("origin").agg(F.count("*").alias("n")).withColumn("allowed", urls.origin_allowed(F.col("origin"), allow))


@query("c11_channel_mix", f"WITH {CLASSIFIED} SELECT source_type, source_platform, confidence, count(*) AS n FROM classified GROUP BY 1, 2, 3", "touches")
def _(touches):
    return attribution.classify_source(touches).groupBy("source_type", "source_platform", "confidence").agg(F.count("*").alias("n"))


@query("c12_landing_mix", r"""SELECT nullif(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '') AS landing_path, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS landing_utm_source, count(*) AS n FROM pages GROUP BY 1, 2""")
def _(spark, sf_dir):
    return attribution.split_landing(tables.load(spark, sf_dir, "pages"), "url").groupBy("landing_path", "landing_utm_source").agg(F.count("*").alias("n"))


@query("c6_media_types", "SELECT media_type, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN NULL END AS media_type FROM events) x GROUP BY 1")
def _(spark, sf_dir):
    header = F.when(F.col("event_id") % 4 == 0, "Text/HTML; charset=utf-8").when(F.col("event_id") % 4 == 1, " application/json ").when(F.col("event_id") % 4 == 2, " ;x=1")
    return tables.load(spark, sf_dir, "events").groupBy(crawl.media_type(header).alias("media_type")).agg(F.count("*").alias("n"))


@query("c13_sanitised_contexts", r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/a b' ELSE '/p' END AS landing_path, CASE WHEN event_id % 3 = 0 THEN 'https://x.test' END AS referrer_origin, CASE WHEN event_id % 4 <> 1 THEN 's_' || event_id END AS session_id,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 0 WHEN event_id % 5 = 2 THEN 86400000 ELSE event_id % 1000 END AS elapsed_ms FROM events""")  # fmt: skip
def _(spark, sf_dir):
    k = F.col("event_id")
    said = tables.load(spark, sf_dir, "events").select("event_id", F.when(k % 2 == 0, "/a\tb?q=1").otherwise("/p#top").alias("landing_path"), F.when(k % 3 == 0, "https://x.test/path?q").when(k % 3 == 1, "nothing").alias("referrer_origin"), F.when(k % 4 == 1, "no spaces here").otherwise(F.concat(F.lit("s_"), k)).alias("session_id"), F.when(k % 5 == 0, None).when(k % 5 == 1, -5).when(k % 5 == 2, 10**9).otherwise(k % 1000).cast("long").alias("elapsed_ms"))
    return attribution.sanitise_context(said)


@query("s3_sitemap_entries", "SELECT page_id, count(*) AS entries FROM (SELECT page_id FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id FROM pages WHERE page_id % 3 = 1) x GROUP BY 1")
def _(spark, sf_dir):
    loc = F.concat(F.lit("<url><loc>https://x.test/"), F.col("page_id"), F.lit("</loc></url>"))
    body = F.when(F.col("page_id") % 3 == 0, "<html/>").otherwise(F.concat(F.lit("<urlset>"), loc, F.when(F.col("page_id") % 3 == 1, loc).otherwise("<url><loc>mailto:x</loc></url>"), F.lit("</urlset>")))
    entries, _, _ = tables.parse_sitemaps(tables.load(spark, sf_dir, "pages").select(F.col("page_id").alias("url"), body.alias("body")))
    return entries.groupBy(F.col("url").alias("page_id")).agg(F.count("*").alias("entries"))


@query("s5_json_props", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return tables.json_col(tables.load(spark, sf_dir, "events"), "props", "k long").select("event_id", "props.k")


@query("s9_sitemap_walks", """WITH RECURSIVE children AS (SELECT page_id AS url, page_id * 2 AS child FROM pages UNION ALL SELECT page_id, page_id * 2 + 1 FROM pages),
    walk AS (SELECT page_id AS start, page_id AS url, 0 AS depth FROM pages WHERE page_id BETWEEN 1 AND 40 UNION SELECT start, child, depth + 1 FROM walk JOIN children USING (url) WHERE depth < 4),
    seen AS (SELECT start, url, min(depth) AS depth FROM walk GROUP BY 1, 2)
    SELECT start, least(count(*) FILTER (depth <= 3), 12) AS documents, max(depth) FILTER (depth <= 3) AS depth, CASE WHEN count(*) FILTER (depth <= 3) > 12 THEN 'document_limit' WHEN bool_or(depth > 3) THEN 'depth_limit' ELSE 'exhausted' END AS stopped_by FROM seen GROUP BY 1""")  # fmt: skip
def _(spark, sf_dir):
    pages = tables.load(spark, sf_dir, "pages")
    children = pages.select(F.col("page_id").alias("url"), F.explode(F.array(F.col("page_id") * 2, F.col("page_id") * 2 + 1)).alias("child"))
    return tables.walk_report(children, pages.where("page_id between 1 and 40").select(F.col("page_id").alias("start"), F.col("page_id").alias("url")), 3, 12)


@query("c14_provenance_violations", f"""WITH {CLASSIFIED} SELECT violation, count(*) AS n FROM (
    SELECT 'query_without_declaration' AS violation FROM classified WHERE id % 4 = 0 AND confidence <> 'declared' UNION ALL SELECT 'click_id_on_organic' FROM classified WHERE id % 7 = 0 AND id % 14 = 0) x GROUP BY 1""", "touches")  # fmt: skip
def _(touches):
    claimed = attribution.classify_source(touches).withColumn("search_query", F.when(F.col("id") % 4 == 0, "shoes")).withColumn("source_type", F.when(F.col("id") % 14 == 0, "organic_search").otherwise(F.when(F.col("gclid").isNull(), F.col("source_type")).otherwise("paid_search")))
    return attribution.provenance_violations(claimed).groupBy("violation").agg(F.count("*").alias("n"))


@query("c15_match_key_coverage", "SELECT workspace_id, count(*) AS contacts, count(email) AS with_email, count(phone) FILTER (region = 'AU') AS with_phone FROM contacts GROUP BY 1", "contacts")
def _(contacts):
    spark = contacts.sparkSession
    keyed = identity.normalise_phone(contacts, "phone", "region", identity.phone_rules(spark))
    return keyed.groupBy("workspace_id").agg(F.count("*").alias("contacts"), F.count(identity.normalise_email(F.col("email"))).alias("with_email"), F.count("phone_e164").alias("with_phone"))


@query("c17_tag_slugs", "SELECT lower(company) AS slug, count(*) AS n FROM contacts GROUP BY 1", "contacts")
def _(contacts):
    return contacts.groupBy(identity.tag_slug(F.concat(F.lit("  "), F.col("company"), F.lit(" "))).alias("slug")).agg(F.count("*").alias("n"))


@query("c18_field_error_report", """SELECT kind, coalesce(error, 'ok') AS error, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'date' WHEN 2 THEN 'boolean' ELSE 'select' END AS kind,
    CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'not_a_number' END WHEN 1 THEN CASE WHEN event_id % 3 <> 1 THEN 'not_a_date' END
        WHEN 2 THEN CASE WHEN event_id % 3 <> 2 THEN 'not_a_boolean' END ELSE CASE WHEN event_id % 3 <> 2 THEN 'not_an_option' END END AS error FROM events) x GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("number", "date", "boolean", "select")])
    events = tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("contact_id"), (F.col("event_id") % 4).cast("int").alias("field_id"))
    k = F.col("contact_id") % 3
    shown = F.when(k == 0, "x1").when(k == 1, F.when(F.col("field_id") == 0, "1.5").otherwise("2024-02-29")).otherwise(F.when(F.col("field_id") == 0, "7").when(F.col("field_id") == 1, "2026-02-30").when(F.col("field_id") == 2, "TRUE").otherwise("b"))
    definitions = events.select("field_id").distinct().select("field_id", F.element_at(kinds, F.col("field_id") + 1).alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("options"))
    return identity.coerce_fields(events.withColumn("value", shown), definitions).groupBy("kind", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("c20_digest_conflicts", """SELECT k, count(*) AS versions FROM (SELECT DISTINCT subject AS k, id % 3 AS person, form, coalesce(rejection_reason, '-') AS campaign FROM submissions) x GROUP BY 1 HAVING count(*) > 1""", "submissions")
def _(submissions):
    # Case and blanks of addresses and names, which vary from row to row, make no other digest; source and campaign do.
    person, odd = (F.col("id") % 3).cast("string"), F.col("id") % 2 == 0
    said = lambda a, b: F.concat(F.when(odd, a).otherwise(b), person)
    leads = submissions.select(F.col("subject").alias("k"), said(F.lit(" Ann@E.test"), F.lit("ann@e.test")).alias("email"), said(F.lit("ANN "), F.lit("ann ")).alias("first_name"), F.when(odd, "").alias("last_name"), F.col("form").alias("source_type"), F.coalesce("rejection_reason", F.lit("-")).alias("utm_campaign"))
    digests = leads.select("k", identity.request_digest(leads.columns).alias("digest")).distinct()
    return digests.groupBy("k").agg(F.count("*").alias("versions")).where("versions > 1")


@query("c21_abuse_mix", "SELECT coalesce(CASE WHEN id % 13 = 0 THEN 'honeypot' WHEN id % 10 < 3 THEN 'too_fast' END, 'none') AS signal, count(*) AS n FROM submissions GROUP BY 1", "submissions")
def _(submissions):
    signal = identity.abuse_signals(F.when(F.col("id") % 13 == 0, "x").otherwise(" "), F.col("id") % 10 * 1000, F.lit(3))
    return submissions.groupBy(F.coalesce(signal, F.lit("none")).alias("signal")).agg(F.count("*").alias("n"))


@query("c23_redacted_audit", """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"apiToken":"[redacted]","sessionId":"s"}' AS props FROM events""")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    events = tables.load(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k": '), k, F.lit(', "apiToken": "t", "sessionId": "s"}')).alias("props"))
    return identity.redact_json(events, "props")


# --- text similarity

SETS = r"""
    worded AS (SELECT workspace_id, id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM outputs WHERE published),
    long AS (SELECT * FROM worded WHERE len(words) >= 40),
    runs AS (SELECT DISTINCT workspace_id, id, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS run FROM long, unnest(range(1, len(words) - 1)) t(p)),
    sizes AS (SELECT workspace_id, id, count(*) AS n, md5(string_agg(run, chr(10) ORDER BY run)) AS k FROM runs GROUP BY 1, 2),
    classes AS (SELECT *, min(id) OVER (PARTITION BY workspace_id, k) AS class_id, count(*) OVER (PARTITION BY workspace_id, k) AS copies FROM sizes),
    reps AS (SELECT * FROM classes WHERE id = class_id),
    meets AS (SELECT x.workspace_id, x.id AS a, y.id AS b, count(*) AS c FROM runs x JOIN runs y ON x.workspace_id = y.workspace_id AND x.run = y.run AND x.id < y.id
        WHERE x.id IN (SELECT id FROM reps) AND y.id IN (SELECT id FROM reps) GROUP BY 1, 2, 3),
    pairs AS (SELECT m.workspace_id, a, b, round(c / (r.n + s.n - c), 6) AS similarity FROM meets m JOIN reps r ON r.id = a JOIN reps s ON s.id = b WHERE c * 100 >= (r.n + s.n - c) * 30)"""


FOLDED = SETS.replace("lower(coalesce(text, ''))", "lower(strip_accents(coalesce(text, '')))")


@query("t1_text_of_json", """SELECT id, body || ' ' || lang || ' x' AS said FROM (SELECT id, replace(replace(left(text, 40), chr(10), ' '), '"', '') AS body, workspace_id AS lang FROM outputs) x""", "outputs")
def _(outputs):
    # Keys in order, nested arrays inside; numbers and nulls say nothing.
    said = F.to_json(F.struct(F.lit(None).cast("string").alias("none"), F.array(F.col("workspace_id"), F.lit("x")).alias("tags"), F.replace(F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")).alias("body"), F.lit(5).alias("number")))
    return outputs.select("id", similarity.extract_text(said).alias("said"))


@query("t2_folded_words", """SELECT id, array_to_string(list_filter(string_split(regexp_replace(lower(strip_accents(left(text, 200))), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS words FROM outputs""".replace("\\\\", "\\"), "outputs")
def _(outputs):
    return outputs.select("id", F.array_join(similarity.to_words(F.substring("text", 1, 200)), " ").alias("words"))


@query("t5_similar_pairs", f"WITH {FOLDED} SELECT workspace_id, a, b, similarity FROM pairs", "outputs")
def _(outputs):
    return similarity.similar_pairs(similarity.hashed_texts(outputs))


@query("t6_duplication_verdicts", f"""WITH {FOLDED.replace("* 30)", "* 0)")}, near AS (SELECT id, max(similarity) AS s, max(CASE WHEN similarity >= 0.3 THEN 1 ELSE 0 END) AS hit, count(*) FILTER (similarity >= 0.3) AS n FROM (SELECT a AS id, similarity FROM pairs UNION ALL SELECT b, similarity FROM pairs) x GROUP BY 1),
    judged AS (SELECT c.id, CASE WHEN copies > 1 THEN 1.0 ELSE coalesce(near.s, 0.0) END AS highest, CASE WHEN copies > 1 THEN 1 ELSE 0 END + coalesce(near.n, 0) AS matches FROM classes c LEFT JOIN near ON near.id = c.class_id)
    SELECT w.id, CASE WHEN j.id IS NULL THEN 'indeterminate' WHEN matches > 0 THEN 'fail' ELSE 'pass' END AS verdict, coalesce(CAST(highest AS DOUBLE), 0.0) AS highest, coalesce(matches, 0) AS matches FROM worded w LEFT JOIN judged j ON j.id = w.id""", "outputs")  # fmt: skip
def _(outputs):
    return similarity.duplication_verdicts(outputs).withColumn("matches", F.size("matches").cast("long"))


@query("t7_guardrail_report", f"""WITH {FOLDED}, near AS (SELECT DISTINCT id FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) x),
    judged AS (SELECT c.workspace_id, c.id, copies > 1 OR near.id IS NOT NULL AS hit FROM classes c LEFT JOIN near ON near.id = c.class_id)
    SELECT CASE WHEN bool_or(coalesce(hit, false)) THEN 'fail' WHEN bool_or(j.id IS NULL) THEN 'indeterminate' ELSE 'pass' END AS verdict, count(*) AS checked FROM worded w LEFT JOIN judged j ON j.id = w.id""", "outputs")  # fmt: skip
def _(outputs):
    return similarity.guardrail_report(similarity.duplication_verdicts(outputs, nearest=False))


# --- frontier, ingestion, lifecycle, quality


ASKED = """asked AS (SELECT *, CASE WHEN source_page_id % 11 = 0 THEN 'too_long' END AS refusal, CASE scope WHEN 'external' THEN 'external' ELSE 'in_scope' END AS kind, source_page_id % 6 AS depth, target_url NOT LIKE '%7' AS allowed, source_page_id % 2 AS crawl
        FROM (SELECT target_url, scope, min(source_page_id) AS source_page_id FROM graph_links GROUP BY 1, 2) y),
    early AS (SELECT *, CASE WHEN refusal = 'too_long' THEN 'url_too_long' WHEN kind = 'external' THEN 'external' WHEN depth > 4 THEN 'depth_limit' WHEN NOT allowed THEN 'robots_disallowed' END AS reason FROM asked),
    decided AS (SELECT crawl AS crawl_id, target_url AS url, depth, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY crawl, reason IS NULL ORDER BY depth, source_page_id, target_url) > 30 THEN 'page_limit' END AS skip_reason,
        row_number() OVER (PARTITION BY crawl ORDER BY depth, source_page_id, target_url) <= 500 AS recorded FROM early)"""


def decisions(links: DataFrame) -> DataFrame:
    asked = links.groupBy(F.col("target_url").alias("url"), F.col("scope").alias("raw")).agg(F.min("source_page_id").alias("place"))
    candidates = asked.select((F.col("place") % 2).alias("crawl_id"), "url", F.when(F.col("place") % 11 == 0, "too_long").alias("refusal"), F.when(F.col("raw") == "external", "external").otherwise("in_scope").alias("scope"), (~F.col("url").endswith("7")).alias("allowed"), (F.col("place") % 6).alias("depth"), "place")
    return crawl.decide_enqueue(candidates, 30, 4)


@query("g1_enqueue_decisions", f"WITH {ASKED} SELECT crawl_id, url, depth, skip_reason, recorded FROM decided", "graph_links")
def _(links):
    return decisions(links).select("crawl_id", "url", "depth", "skip_reason", "recorded")


@query("g3_termination", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'cancelled' WHEN page_id % 50 >= 25 THEN 'budget_exhausted' WHEN depth > 5 THEN 'depth_exhausted' ELSE 'frontier_empty' END AS reason FROM graph_pages""", "graph_pages")
def _(pages):
    return pages.select("page_id", crawl.termination(F.col("page_id") % 7 == 0, F.col("page_id") % 50, F.lit(25), F.greatest(F.col("depth") - 5, F.lit(0))).alias("reason"))


@query("g4_enqueue_summary", f"""WITH {ASKED}, known AS (SELECT *, url IN (SELECT url FROM graph_pages WHERE page_id % 5 = 0) AS known FROM decided)
    SELECT crawl_id, count(*) FILTER (NOT known AND recorded AND skip_reason IS NULL) AS queued, count(*) FILTER (NOT known AND recorded AND skip_reason IS NOT NULL) AS skipped, count(*) FILTER (known) AS duplicates, count(*) FILTER (NOT known AND NOT recorded) AS unrecorded,
        coalesce(bool_or(NOT known AND coalesce(skip_reason = 'depth_limit', false)), false) AS skipped_for_depth FROM known GROUP BY 1""", "graph_pages", "graph_links")  # fmt: skip
def _(pages, links):
    known = pages.where("page_id % 5 = 0").select("url", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("crawl_id"))
    return crawl.enqueue_summary(decisions(links), known)


@query("g5_reap_stale", """WITH runs AS (SELECT page_id AS crawl_id, CASE WHEN page_id % 3 = 0 THEN 'finished' ELSE 'running' END AS status, TIMESTAMP '2024-01-20' - INTERVAL (page_id % 200) MINUTE AS started_at, page_id % 100 AS page_limit FROM graph_pages)
    SELECT crawl_id, CASE WHEN dead THEN 'failed' ELSE status END AS status, CASE WHEN dead THEN 'skipped' ELSE 'queued' END AS state FROM (SELECT *, status = 'running' AND started_at + INTERVAL (page_limit * 30 + 1800) SECOND <= TIMESTAMP '2024-01-20' AS dead FROM runs) x""", "graph_pages")  # fmt: skip
def _(pages):
    started = F.lit("2024-01-20").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") % 200).cast("int"))
    runs = pages.select(F.col("page_id").alias("crawl_id"), F.when(F.col("page_id") % 3 == 0, "finished").otherwise("running").alias("status"), started.alias("started_at"), (F.col("page_id") % 100).cast("int").alias("page_limit"), F.lit(None).cast("string").alias("failure"))
    frontier = pages.select(F.col("page_id").alias("crawl_id"), "url", F.lit("queued").alias("state"), F.lit(None).cast("string").alias("skip_reason"))
    closed, rows = crawl.reap_stale(runs, frontier, NOW)
    return closed.select("crawl_id", "status").join(rows.select("crawl_id", "state"), "crawl_id")


FRONTIER = """edges AS (SELECT DISTINCT 'https://site.test/p/' || source_page_id AS s, target_url AS t FROM graph_links WHERE scope = 'internal'),
    seeds AS (SELECT 'https://site.test/p/' || p AS url FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) v(p)), mapped AS (SELECT url FROM graph_pages WHERE page_id % 97 = 4)"""


def frontier(pages: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    seeds = links.sparkSession.range(1, 9).select(F.lit(1).alias("crawl_id"), F.concat(F.lit("https://site.test/p/"), F.col("id")).alias("url"))
    edges = links.where("scope = 'internal'").select("crawl_id", F.concat(F.lit("https://site.test/p/"), F.col("source_page_id")).alias("source_url"), "target_url").distinct()
    return crawl.build_frontier(seeds, edges, 3, limit, pages.where("page_id % 97 = 4").select("crawl_id", "url"))


@query("g2_frontier", f"""WITH RECURSIVE {FRONTIER}, reach AS (SELECT url, 0 AS depth FROM seeds UNION SELECT url, 0 FROM mapped UNION SELECT t, depth + 1 FROM reach JOIN edges ON s = url WHERE depth < 3)
    SELECT r.url, min(depth) AS depth, CASE WHEN any_value(s.url) IS NOT NULL THEN 'seed' WHEN any_value(m.url) IS NOT NULL THEN 'sitemap' ELSE 'link' END AS source FROM reach r LEFT JOIN seeds s ON s.url = r.url LEFT JOIN mapped m ON m.url = r.url GROUP BY 1""".replace("WITH RECURSIVE", "WITH"), "graph_pages", "graph_links")  # fmt: skip
def _(pages, links):
    return frontier(pages, links, 10**9).select("url", "depth", "source")


@query("g2_limited_frontier", f"""WITH {FRONTIER}, zero AS (SELECT url, min(r) AS r FROM (SELECT url, 0 AS r FROM seeds UNION ALL SELECT url, 1 FROM mapped) x GROUP BY 1),
    taken AS (SELECT url, row_number() OVER (ORDER BY r, url) <= 20 AS accepted FROM zero), one AS (SELECT DISTINCT t AS url FROM edges JOIN taken ON s = url AND accepted WHERE t NOT IN (SELECT url FROM zero)),
    next AS (SELECT url, row_number() OVER (ORDER BY url) + (SELECT count(*) FROM taken WHERE accepted) <= 20 AS accepted FROM one),
    two AS (SELECT DISTINCT t AS url FROM edges JOIN next ON s = url AND accepted WHERE t NOT IN (SELECT url FROM zero) AND t NOT IN (SELECT url FROM one)),
    more AS (SELECT url, row_number() OVER (ORDER BY url) + (SELECT count(*) FROM taken WHERE accepted) + (SELECT count(*) FROM next WHERE accepted) <= 20 AS accepted FROM two)
    SELECT url, 0 AS depth, accepted FROM taken UNION ALL SELECT url, 1, accepted FROM next UNION ALL SELECT url, 2, accepted FROM more""", "graph_pages", "graph_links")  # fmt: skip
def _(pages, links):
    return frontier(pages, links, 20).where("depth < 3").select("url", "depth", "accepted")


ORACLE_SQL["g2_frontier"] = ORACLE_SQL["g2_frontier"].replace("WITH", "WITH RECURSIVE", 1)


@query("l1_ingest_leads", f"""WITH RECURSIVE {KEYS},
    leads AS (SELECT id, workspace_id, id // 6 AS x, sha256(CAST(json_array(lower(trim(email)), CASE WHEN region = 'AU' THEN '+61' || substr(phone, 2) END, lower(trim(first_name)), '', NULL, NULL, NULL, NULL, NULL, NULL) AS VARCHAR)) AS digest FROM contacts),
    receipts AS (SELECT workspace_id, x, digest AS old, id AS old_contact FROM leads WHERE id % 30 = 0),
    asked AS (SELECT l.*, old, old_contact, row_number() OVER (PARTITION BY l.workspace_id, l.x ORDER BY l.id) AS n FROM leads l LEFT JOIN receipts r ON r.workspace_id = l.workspace_id AND r.x = l.x WHERE l.id % 2 = 0),
    fresh AS (SELECT * FROM asked WHERE old IS NULL AND n = 1),
    theirs AS (SELECT k.id, k.workspace_id, kind, k FROM keyed k JOIN fresh f ON f.id = k.id),
    firsts AS (SELECT workspace_id, kind, k, min(id) AS first FROM theirs GROUP BY 1, 2, 3),
    stored AS (SELECT workspace_id, kind, k, min(id) AS stored FROM keyed WHERE id % 2 = 1 AND NOT (is_deleted OR is_merged OR is_erased) GROUP BY 1, 2, 3),
    steps AS (SELECT DISTINCT id, first FROM theirs JOIN firsts USING (workspace_id, kind, k)),
    reach AS (SELECT id, id AS point FROM fresh UNION SELECT reach.id, steps.first FROM reach JOIN steps ON steps.id = reach.point),
    placed AS (SELECT r.id, coalesce(min(stored), -min(r.point)) AS contact_id FROM reach r LEFT JOIN theirs t ON t.id = r.point LEFT JOIN stored s ON s.workspace_id = t.workspace_id AND s.kind = t.kind AND s.k = t.k GROUP BY 1)
    SELECT id, CASE WHEN contact_id = -id THEN 'created' ELSE 'matched' END AS outcome, contact_id, digest FROM fresh JOIN placed USING (id)
    UNION ALL SELECT id, CASE WHEN digest = old THEN 'duplicate' ELSE 'conflict' END, CASE WHEN digest = old THEN old_contact END, digest FROM asked WHERE old IS NOT NULL
    UNION ALL SELECT a.id, CASE WHEN a.digest = f.digest THEN 'duplicate' ELSE 'conflict' END, CASE WHEN a.digest = f.digest THEN p.contact_id END, a.digest
    FROM asked a JOIN fresh f ON f.workspace_id = a.workspace_id AND f.x = a.x JOIN placed p ON p.id = f.id WHERE a.old IS NULL AND a.n > 1""", "contacts")
def _(contacts):
    leads = contacts.where("id % 2 = 0").select("id", "workspace_id", "first_name", "email", "phone", "region", F.lit("web").alias("source_system"), F.concat(F.lit("k"), F.floor(F.col("id") / 6)).alias("external_key"))
    receipts = contacts.where("id % 30 = 0").select("workspace_id", F.lit("web").alias("source_system"), F.concat(F.lit("k"), F.floor(F.col("id") / 6)).alias("external_key"), identity.request_digest(["email", "phone", "first_name", "region"]).alias("digest"), F.col("id").alias("contact_id"))
    return ingest.ingest_leads(leads, receipts, contacts.where("id % 2 = 1"))


@query("l5_apply_merges", """WITH r AS (SELECT a.id + 1 AS dup, a.id AS surv FROM contacts a JOIN contacts b ON b.id = a.id + 1 WHERE a.id % 10 = 2 AND NOT (a.is_deleted OR a.is_merged OR a.is_erased OR b.is_deleted OR b.is_merged OR b.is_erased)),
    fields AS (SELECT DISTINCT contact_id, stage FROM opportunities)
    SELECT 'deals' AS child, coalesce(surv, contact_id) AS contact_id, count(*) AS n FROM opportunities LEFT JOIN r ON dup = contact_id GROUP BY 2
    UNION ALL SELECT 'touches', coalesce(surv, contact_id), count(*) FROM touches LEFT JOIN r ON dup = contact_id GROUP BY 2 UNION ALL SELECT 'tasks', coalesce(surv, contact_id), count(*) FROM tasks LEFT JOIN r ON dup = contact_id GROUP BY 2
    UNION ALL SELECT 'activities', coalesce(surv, contact_id), count(*) FROM (SELECT CASE WHEN id % 2 = 0 THEN contact_id END AS contact_id FROM touches) a LEFT JOIN r ON dup = contact_id WHERE contact_id IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'fields', coalesce(surv, contact_id), count(DISTINCT stage) FROM fields LEFT JOIN r ON dup = contact_id GROUP BY 2 UNION ALL SELECT 'tags', coalesce(surv, contact_id), count(DISTINCT status) FROM opportunities LEFT JOIN r ON dup = contact_id GROUP BY 2""", "contacts", "touches", "opportunities", "tasks")  # fmt: skip
def _(contacts, touches, opportunities, work):
    requests = contacts.where("id % 10 = 2").select(F.col("id").alias("survivor"), (F.col("id") + 1).alias("duplicate"))
    fields, tags = opportunities.select("contact_id", "stage").distinct(), opportunities.select("contact_id", "status").distinct()
    children = {"deals": (opportunities, []), "touches": (touches, []), "tasks": (work, []), "activities": (activities_of(touches).where("contact_id is not null"), []), "fields": (fields, ["stage"]), "tags": (tags, ["status"])}
    _, moved = ingest.apply_merges(contacts, children, requests)
    out = None
    for name, df in moved.items():
        part = df.groupBy("contact_id").agg(F.count("*").alias("n")).withColumn("child", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("l5_merge_blockers", """WITH r AS (SELECT id AS survivor, CASE WHEN id % 5 = 0 THEN id ELSE id * 7 % 1600 END AS duplicate FROM contacts),
    j AS (SELECT r.*, a.id AS a, b.id AS b, a.workspace_id AS wa, b.workspace_id AS wb, a.is_deleted AS d, coalesce(a.is_erased, false) OR coalesce(b.is_erased, false) AS e, coalesce(a.is_merged, false) OR coalesce(b.is_merged, false) AS m FROM r LEFT JOIN contacts a ON a.id = survivor LEFT JOIN contacts b ON b.id = duplicate)
    SELECT blocker, count(*) AS n FROM (SELECT 'same_contact' AS blocker FROM j WHERE survivor = duplicate UNION ALL SELECT 'not_found' FROM j WHERE a IS NULL OR b IS NULL UNION ALL SELECT 'other_workspace' FROM j WHERE wa <> wb
        UNION ALL SELECT 'erased' FROM j WHERE e UNION ALL SELECT 'merged' FROM j WHERE m UNION ALL SELECT 'survivor_archived' FROM j WHERE d) x GROUP BY 1""", "contacts")  # fmt: skip
def _(contacts):
    requests = contacts.select(F.col("id").alias("survivor"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.col("id") * 7 % 1600).alias("duplicate"))
    return ingest.merge_blockers(requests, contacts).groupBy("blocker").agg(F.count("*").alias("n"))


@query("l6_merge_field_diff", """SELECT kind, field, count(*) AS n FROM (
        SELECT 'email' AS field, CASE WHEN b.email IS NOT NULL AND a.email IS NULL THEN 'fill' WHEN a.email <> b.email THEN 'conflict' END AS kind FROM contacts a JOIN contacts b ON b.id = a.id + 1 WHERE a.id % 2 = 0
        UNION ALL SELECT 'phone', CASE WHEN b.phone IS NOT NULL AND a.phone IS NULL THEN 'fill' WHEN a.phone <> b.phone THEN 'conflict' END FROM contacts a JOIN contacts b ON b.id = a.id + 1 WHERE a.id % 2 = 0) x
    WHERE kind IS NOT NULL GROUP BY 1, 2""", "contacts")  # fmt: skip
def _(contacts):
    pairs = contacts.where("id % 2 = 0").select(F.col("id").alias("survivor"), (F.col("id") + 1).alias("duplicate"))
    return ingest.merge_field_diff(pairs, contacts, ["email", "phone"]).groupBy("kind", "field").agg(F.count("*").alias("n"))


@query("l7_apply_erasures", """WITH gone AS (SELECT id FROM contacts WHERE id % 9 = 0 AND NOT is_erased AND NOT is_merged),
    acts AS (SELECT id, CASE WHEN id % 2 = 0 THEN contact_id END AS contact_id, CASE WHEN id % 3 = 0 THEN id % 4000 END AS opportunity_id, CASE WHEN id % 5 = 0 THEN id END AS touch_id FROM touches),
    reached_t AS (SELECT DISTINCT id, gone FROM (SELECT id, contact_id AS gone FROM tasks UNION ALL SELECT t.id, o.contact_id FROM tasks t JOIN opportunities o ON o.id = t.opportunity_id) x),
    reached_a AS (SELECT DISTINCT id, gone FROM (SELECT id, contact_id AS gone FROM acts UNION ALL SELECT a.id, o.contact_id FROM acts a JOIN opportunities o ON o.id = a.opportunity_id UNION ALL SELECT a.id, t.contact_id FROM acts a JOIN touches t ON t.id = a.touch_id) x),
    u AS (SELECT contact_id, count(*) AS n FROM touches GROUP BY 1), o AS (SELECT contact_id, count(*) AS n, count(DISTINCT stage) AS fields, count(DISTINCT status) AS tags FROM opportunities GROUP BY 1), t AS (SELECT gone, count(*) AS n FROM reached_t GROUP BY 1), a AS (SELECT gone, count(*) AS n FROM reached_a GROUP BY 1)
    SELECT g.id, coalesce(u.n, 0) AS touches, coalesce(o.n, 0) AS opportunities, coalesce(t.n, 0) AS tasks, coalesce(a.n, 0) AS activities, coalesce(o.fields, 0) AS fields, coalesce(o.tags, 0) AS tags FROM gone g LEFT JOIN u ON u.contact_id = g.id LEFT JOIN o ON o.contact_id = g.id LEFT JOIN t ON t.gone = g.id LEFT JOIN a ON a.gone = g.id""", "contacts", "touches", "opportunities", "tasks")  # fmt: skip
def _(contacts, touches, opportunities, work):
    return erased(contacts, touches, opportunities, work)[1]


def erased(contacts: DataFrame, touches: DataFrame, opportunities: DataFrame, work: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    titled = lambda df, kind: df.withColumn("title", F.concat(F.lit(f"{kind} for "), F.col("contact_id")))
    tables_of = {"contacts": contacts, "touches": touches, "opportunities": titled(opportunities, "Deal"), "tasks": titled(work, "Call"), "activities": activities_of(touches)}
    tables_of |= {"fields": opportunities.select("contact_id", "stage").distinct(), "tags": opportunities.select("contact_id", "status").distinct()}
    return ingest.apply_erasures(tables_of, contacts.where("id % 9 = 0").select("id"))


@query("l7_erased_words", """WITH gone AS (SELECT id FROM contacts WHERE id % 9 = 0 AND NOT is_erased AND NOT is_merged), deals AS (SELECT id FROM opportunities WHERE contact_id IN (SELECT id FROM gone)),
    acts AS (SELECT id, CASE WHEN id % 2 = 0 THEN contact_id END AS contact_id, CASE WHEN id % 3 = 0 THEN id % 4000 END AS opportunity_id, CASE WHEN id % 5 = 0 THEN id END AS touch_id, contact_id AS owner FROM touches)
    SELECT 'tasks' AS child, count(*) FILTER (contact_id IN (SELECT id FROM gone) OR opportunity_id IN (SELECT id FROM deals)) AS erased, count(*) AS n FROM tasks
    UNION ALL SELECT 'activities', count(*) FILTER (coalesce(contact_id IN (SELECT id FROM gone), false) OR coalesce(opportunity_id IN (SELECT id FROM deals), false) OR (touch_id IS NOT NULL AND owner IN (SELECT id FROM gone))), count(*) FROM acts
    UNION ALL SELECT 'opportunities', count(*) FILTER (id IN (SELECT id FROM deals)), count(*) FROM opportunities
    UNION ALL SELECT 'fields', 0, count(DISTINCT (contact_id, stage)) FROM opportunities WHERE contact_id NOT IN (SELECT id FROM gone)""", "contacts", "touches", "opportunities", "tasks")  # fmt: skip
def _(contacts, touches, opportunities, work):
    after, _ = erased(contacts, touches, opportunities, work)
    count = lambda name, column, word: after[name].agg(F.count_if(F.col(column) == word).alias("erased"), F.count("*").alias("n")).withColumn("child", F.lit(name))
    out = count("tasks", "title", "Erased task").unionByName(count("activities", "summary", "Details erased"))
    return out.unionByName(count("opportunities", "title", "Erased opportunity")).unionByName(count("fields", "stage", "Erased"))


@query("l8_immutability_violations", "SELECT field, count(*) AS n FROM (SELECT '(row)' AS field FROM touches WHERE id % 19 = 0 UNION ALL SELECT 'gclid' FROM touches WHERE id % 19 <> 0 AND id % 5 = 0 AND gclid IS NOT NULL) x GROUP BY 1", "touches")
def _(touches):
    after = touches.where("id % 19 <> 0").withColumn("gclid", F.when(F.col("id") % 5 != 0, F.col("gclid")))
    return quality.immutability_violations(touches, after, "id", ["captured_at", "gclid"]).groupBy("field").agg(F.count("*").alias("n"))


@query("l9_retention", f"""WITH aged AS (SELECT id, ts, id % 100 AS h, id % 7 AS d FROM submissions)
    SELECT 'sessions' AS rule, count(*) FILTER (NOT (ts + INTERVAL (h) HOUR <= TIMESTAMP '{NOW}' OR ts + INTERVAL (d) DAY <= TIMESTAMP '{NOW}')) AS kept, count(*) FILTER (ts + INTERVAL (h) HOUR <= TIMESTAMP '{NOW}' OR ts + INTERVAL (d) DAY <= TIMESTAMP '{NOW}') AS dropped FROM aged
    UNION ALL SELECT 'reset_tokens', count(*) FILTER (NOT x), count(*) FILTER (x) FROM (SELECT ts + INTERVAL 10 DAY <= TIMESTAMP '{NOW}' OR coalesce(CASE WHEN d < 3 THEN ts + INTERVAL (h) HOUR END + INTERVAL 10 DAY < TIMESTAMP '{NOW}', false) AS x FROM aged) y
    UNION ALL SELECT 'rate_windows', count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR), count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) FROM aged""", "submissions")  # fmt: skip
def _(submissions):
    ts, h, d = F.col("ts"), (F.col("id") % 100).cast("int"), (F.col("id") % 7).cast("int")
    hours, zero = F.make_dt_interval(F.lit(0), h), F.lit(0)
    rows = {
        "sessions": submissions.select((ts + hours).alias("idle_expires_at"), (ts + F.make_dt_interval(d)).alias("absolute_expires_at")),
        "reset_tokens": submissions.select(ts.alias("created_at"), (ts + F.expr("interval 10 days")).alias("expires_at"), F.when(d < 3, ts + hours).alias("used_at")),
        "rate_windows": submissions.select(ts.alias("window_start")),
    }
    out, rules = None, ingest.retention_rules(NOW)
    for name, df in rows.items():
        kept, dropped = ingest.apply_retention(df, rules[name])
        part = kept.agg(F.count("*").alias("kept")).withColumn("rule", F.lit(name)).join(dropped.withColumn("rule", F.lit(name)), "rule")
        out = part if out is None else out.unionByName(part)
    return out


@query("l10_import_status", """SELECT batch, count(*) FILTER (o = 'created') AS imported, count(*) FILTER (o = 'matched') AS matched, count(*) FILTER (o = 'failed') AS failed,
    CASE WHEN count(*) FILTER (o = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (o <> 'failed') > 0 THEN 'partial' ELSE 'failed' END AS status
    FROM (SELECT subject AS batch, CASE form WHEN 'error' THEN 'failed' WHEN 'view' THEN 'matched' ELSE 'created' END AS o FROM submissions) x GROUP BY 1""", "submissions")  # fmt: skip
def _(submissions):
    outcome = F.when(F.col("form") == "error", "failed").when(F.col("form") == "view", "matched").otherwise("created")
    return ingest.import_status(submissions.select(F.col("subject").alias("batch"), outcome.alias("outcome")))


IMPORTED = """imported AS (SELECT id AS row_number, CASE WHEN id % 9 = 0 THEN '' ELSE first_name END AS name, CASE WHEN id % 8 = 1 THEN 'no address' ELSE coalesce(trim(email), '') END AS mail, coalesce(phone, '') AS phone FROM contacts),
    issues AS (SELECT row_number, 'first_name_missing' AS rule FROM imported WHERE name = '' UNION ALL SELECT row_number, 'identity_missing' FROM imported WHERE mail = '' AND phone = '' UNION ALL SELECT row_number, 'email_invalid' FROM imported WHERE mail = 'no address')"""


def imported(contacts: DataFrame) -> DataFrame:
    """A file of contacts with some rows that lack what they need."""
    k = F.col("id")
    return contacts.select(k.alias("row_number"), F.when(k % 9 == 0, "").otherwise(F.col("first_name")).alias("Name"), F.when(k % 8 == 1, "no address").otherwise(F.coalesce(F.trim("email"), F.lit(""))).alias("E-mail"), F.coalesce("phone", F.lit("")).alias("Tel"), F.lit("x").alias("Colour"))


MAPPING = {"Name": "first_name", "E-mail": "email", "Tel": "phone", "Colour": "ignore"}


@query("c19_import_issues", f"WITH {IMPORTED} SELECT rule, count(*) AS n FROM issues GROUP BY 1", "contacts")
def _(contacts):
    return ingest.prepare_import(imported(contacts), MAPPING)[1].groupBy("rule").agg(F.count("*").alias("n"))


@query("l10_run_import", f"""WITH {IMPORTED}, valid AS (SELECT * FROM imported WHERE row_number NOT IN (SELECT row_number FROM issues)) SELECT 'b1' AS batch, count(*) AS valid, (SELECT count(DISTINCT row_number) FROM issues) AS failed, 'partial' AS status FROM valid""", "contacts")
def _(contacts):
    status, _ = ingest.run_import(imported(contacts), MAPPING, no_receipts(contacts), contacts.where("id % 50 = 0"), 0, "b1")
    return status.select("batch", (F.col("imported") + F.col("matched")).alias("valid"), "failed", "status")


def no_receipts(any_table: DataFrame) -> DataFrame:
    return any_table.sparkSession.createDataFrame([], "workspace_id long, source_system string, external_key string, digest string, contact_id long")


@query("l11_validate_import", f"""WITH {IMPORTED}, valid AS (SELECT * FROM imported WHERE row_number NOT IN (SELECT row_number FROM issues)),
    keys AS (SELECT DISTINCT k FROM (SELECT lower(mail) AS k FROM valid WHERE mail <> '' UNION ALL SELECT phone FROM valid WHERE phone <> '') x),
    known AS (SELECT lower(trim(email)) AS k FROM contacts WHERE {LIVE} AND email IS NOT NULL UNION SELECT phone FROM contacts WHERE {LIVE} AND phone IS NOT NULL)
    SELECT 'total' AS what, count(*) AS n FROM imported UNION ALL SELECT 'valid', count(*) FROM valid UNION ALL SELECT 'issues', count(*) FROM issues UNION ALL SELECT 'matches', count(*) FROM keys WHERE k IN (SELECT k FROM known)""", "contacts")  # fmt: skip
def _(contacts):
    return ingest.validate_import(imported(contacts), MAPPING, contacts)


@query("l12_timeline", "SELECT type, summary, count(*) AS n FROM (SELECT CASE form WHEN 'click' THEN 'contact_created' WHEN 'view' THEN 'stage_changed' WHEN 'purchase' THEN 'won' WHEN 'signup' THEN 'touch_captured' ELSE 'merged' END AS type, CASE form WHEN 'click' THEN 'Contact created' WHEN 'view' THEN 'Moved to ' || (subject % 3) WHEN 'purchase' THEN 'Deal won' WHEN 'signup' THEN 'Captured from ' || CASE WHEN id % 2 = 0 THEN 'email' ELSE 'unknown' END ELSE 'Merged' END AS summary FROM submissions) x GROUP BY 1, 2", "submissions")
def _(submissions):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "contact_created", "view", "stage_changed", "purchase", "won", "signup", "touch_captured", "error", "merged")]), F.col("form"))
    detail = F.when(F.col("form") == "view", (F.col("subject") % 3).cast("string")).when((F.col("form") == "signup") & (F.col("id") % 2 == 0), "email")
    changes = submissions.select("id", F.col("subject").alias("contact_id"), kind.alias("kind"), detail.alias("detail"))
    return ingest.derive_activities(changes).groupBy("type", "summary").agg(F.count("*").alias("n"))


@query("l13_archive_blockers", "SELECT id FROM contacts WHERE id IN (SELECT contact_id FROM opportunities WHERE status = 'open')", "contacts", "opportunities")
def _(contacts, opportunities):
    return quality.archive_blockers(contacts, opportunities).select("id")


@query("l13_stage_blockers", "SELECT workspace_id, stage, count(*) AS deals FROM opportunities WHERE stage IN ('5-LOW', '2-HIGH') GROUP BY 1, 2", "opportunities")
def _(opportunities):
    stages = opportunities.where("stage in ('5-LOW', '2-HIGH')").select("workspace_id", "stage").distinct()
    return quality.stage_blockers(stages.unionByName(stages.withColumn("stage", F.lit("unused")).distinct()), opportunities)


@query("l14_publish_violations", """WITH fields AS (SELECT subject AS form_id, CASE id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'first_name' WHEN 2 THEN 'phone' END AS target, form AS key FROM submissions WHERE id % 11 < 4),
    g AS (SELECT form_id, coalesce(bool_or(target IN ('email', 'phone')), false) AS r, coalesce(bool_or(target = 'first_name'), false) AS f, count(*) AS n, count(DISTINCT key) AS k, count(target) AS m, count(DISTINCT target) AS t FROM fields GROUP BY 1)
    SELECT form_id, v AS violation FROM (SELECT form_id, 'no_identity' AS v FROM g WHERE NOT r UNION ALL SELECT form_id, 'no_first_name' FROM g WHERE NOT f UNION ALL SELECT form_id, 'target_mapped_twice' FROM g WHERE m > t UNION ALL SELECT form_id, 'key_repeats' FROM g WHERE n > k) x""", "submissions")  # fmt: skip
def _(submissions):
    target = F.when(F.col("id") % 4 == 0, "email").when(F.col("id") % 4 == 1, "first_name").when(F.col("id") % 4 == 2, "phone")
    return quality.publish_violations(submissions.where("id % 11 < 4").select(F.col("subject").alias("form_id"), target.alias("target"), F.col("form").alias("key")))


FIELDS = [
    ("name", "Name", "first_name", 0, 20, "text", True, None), ("mail", "E-mail", "email", 1, 60, "text", False, None), ("size", "Size", "custom:size", 2, 10, "select", False, ["S", "M"]),
    ("agree", "Agreed", "note", 3, 10, "checkbox", False, None), ("words", "Words", "note", 4, 8, "text", False, None), ("skip", "Skip", "none", 5, 8, "text", False, None),
]
ASKED_FIELDS = "key string, label string, target string, position int, max_length int, kind string, required boolean, options array<string>"


def posted(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions with the values of a form that every form_id has, and its fields."""
    spark, k = submissions.sparkSession, F.col("id")
    values = F.create_map(F.lit("name"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit(" Visitor "), k)), F.lit("mail"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("v"), k % 300, F.lit("@x.test"))), F.lit("size"), F.when(k % 7 == 0, "XL").when(k % 7 == 1, "M").otherwise(""), F.lit("agree"), F.when(k % 2 == 0, "on").otherwise("off"), F.lit("words"), F.lit(" Hello there"))
    fields = submissions.select(F.col("form").alias("form_id")).distinct().join(F.broadcast(spark.createDataFrame(FIELDS, ASKED_FIELDS)))
    return submissions.select("id", F.col("form").alias("form_id"), values.alias("values"), "ts", "subject"), fields


@query("l4_form_values", """SELECT id, CASE WHEN id % 6 <> 0 THEN left('Visitor ' || id, 20) END AS first_name, CASE WHEN id % 5 <> 0 THEN 'v' || (id % 300) || '@x.test' END AS email, CASE WHEN id % 2 = 0 THEN 'Agreed: Yes · ' ELSE '' END || 'Words: Hello th' AS note, CASE WHEN id % 7 = 1 THEN 'M' END AS size,
    array_to_string(list_filter([CASE WHEN id % 6 = 0 THEN 'name' END, CASE WHEN id % 7 = 0 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS missing FROM submissions""", "submissions")  # fmt: skip
def _(submissions):
    out = ingest.map_form_values(*posted(submissions))
    return out.select("id", "first_name", "email", "note", F.try_element_at("custom", F.lit("size")).alias("size"), F.array_join("missing", ",").alias("missing"))


@query("l3_submission_outcomes", """WITH gates AS (SELECT id, CASE WHEN form = 'error' THEN 'form_not_accepting' WHEN id % 17 = 0 THEN 'origin_not_allowed' WHEN id % 13 = 0 THEN 'honeypot' WHEN id % 10 < 2 THEN 'too_fast' WHEN id % 19 = 0 THEN 'challenge_failed' WHEN id % 6 = 0 OR id % 7 = 0 THEN 'validation_failed' WHEN id % 5 = 0 THEN 'identity_missing' END AS reason FROM submissions)
    SELECT coalesce(reason, 'accepted') AS verdict, count(*) AS n FROM gates GROUP BY 1""", "submissions")  # fmt: skip
def _(submissions):
    rows, fields = posted(submissions)
    k, nothing = F.col("id"), F.lit(None).cast("string")
    asked = rows.withColumns({"submission_id": k.cast("string"), "origin": F.when(k % 17 == 0, "https://site.test@evil.test").otherwise("https://SITE.test/page"), "ip": F.col("subject"), "trap": F.when(k % 13 == 0, "x"), "elapsed_ms": k % 10 * 1000, "challenge_ok": k % 19 != 0, "gclid": nothing, "fbclid": nothing, "utm_medium": nothing, "utm_source": F.lit("newsletter"), "utm_campaign": nothing, "referrer": nothing})
    forms = rows.select("form_id").distinct().select("form_id", F.lit(1).alias("workspace_id"), F.col("form_id").alias("name"), F.when(F.col("form_id") == "error", "closed").otherwise("active").alias("status"), F.array(F.lit("https://site.test")).alias("allowed_origins"), F.lit(True).alias("honeypot"), F.lit(2).alias("min_seconds"), F.lit("{contact} at {form}").alias("title_template"), F.lit("p").alias("pipeline_id"), F.lit(100).alias("value_minor"))
    nobody = submissions.sparkSession.createDataFrame([], "id long, workspace_id long, email string, phone string, is_deleted boolean, is_merged boolean, is_erased boolean")
    done = ingest.process_submissions(asked, forms, fields, no_receipts(submissions), nobody, "https://app.test", [("ip", ["subject"], 10**6)])
    return done["submissions"].groupBy(F.coalesce("rejection_reason", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


@query("l1_new_rows", """WITH picked AS (SELECT *, id // 6 AS k FROM contacts WHERE id % 2 = 0), firsts AS (SELECT min(id) AS id FROM picked GROUP BY workspace_id, k)
    SELECT 'touches' AS name, count(*) AS n FROM firsts UNION ALL SELECT 'receipts', count(*) FROM firsts UNION ALL SELECT 'opportunities', count(*) FROM firsts WHERE id % 3 = 0""", "contacts")  # fmt: skip
def _(contacts):
    leads = contacts.where("id % 2 = 0").select("id", "workspace_id", "first_name", "email", "phone", "region", F.lit("web").alias("source_system"), F.concat(F.lit("k"), F.floor(F.col("id") / 6)).alias("external_key"), F.lit("email").alias("source_type"), F.when(F.col("id") % 3 == 0, "A deal").alias("opportunity_title"), F.lit("p").alias("pipeline_id"))
    made = ingest.ingest_batch(leads, no_receipts(contacts), contacts.where("id % 2 = 1"))
    out = None
    for name in ("touches", "receipts", "opportunities"):
        part = made[name].agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("q1_row_violations", """SELECT rule, count(*) AS n FROM (SELECT 'depth_out_of_range' AS rule FROM graph_pages WHERE depth > 7 UNION ALL SELECT 'redirect_at_depth' FROM graph_pages WHERE outcome = 'redirected' AND depth >= 3) x GROUP BY 1""", "graph_pages")
def _(pages):
    return quality.check_rows(pages, {"depth_out_of_range": F.col("depth").between(0, 7), "redirect_at_depth": ~((F.col("outcome") == "redirected") & (F.col("depth") >= 3))})


@query("q1_crawl_constraints", """SELECT rule, count(*) AS n FROM (
    SELECT 'budget_out_of_bounds' AS rule FROM graph_pages WHERE page_id % 20 = 0 OR depth = 0 UNION ALL SELECT 'ended_without_completed_at' FROM graph_pages WHERE page_id % 5 > 1 AND page_id % 3 = 0
    UNION ALL SELECT 'running_without_started_at' FROM graph_pages WHERE page_id % 5 > 0 AND page_id % 7 = 0 UNION ALL SELECT 'failed_without_category' FROM graph_pages WHERE page_id % 5 = 3 AND page_id % 2 = 0 UNION ALL SELECT 'counter_below_zero' FROM graph_pages WHERE depth - page_id % 7 < 0
    UNION ALL SELECT 'skip_reason_contradicts_state' FROM graph_pages WHERE (page_id % 4 = 0) <> (page_id % 6 = 0) UNION ALL SELECT 'depth_or_attempts_out_of_bounds' FROM graph_pages WHERE depth * 3 > 20 OR page_id % 13 > 10
    UNION ALL SELECT 'failure_without_category' FROM graph_pages WHERE outcome = 'redirected' AND page_id % 2 = 0 UNION ALL SELECT 'http_status_implausible' FROM graph_pages WHERE page_id % 700 < 100 AND page_id % 11 > 0 OR page_id % 700 > 599 AND page_id % 11 > 0
    UNION ALL SELECT 'text_out_of_bounds' FROM graph_pages WHERE page_id % 9 = 0 OR page_id % 10 = 0 UNION ALL SELECT 'verification_contradicts_state' FROM graph_pages WHERE CASE WHEN page_id % 3 = 0 THEN page_id % 2 > 0 OR page_id % 5 = 0 ELSE page_id % 2 = 0 END
    UNION ALL SELECT 'crawl_budget_out_of_bounds' FROM graph_pages WHERE page_id % 6 NOT BETWEEN 1 AND 4 UNION ALL SELECT 'anchor_text_too_long' FROM graph_pages WHERE page_id % 8 = 0 UNION ALL SELECT 'page_url_out_of_bounds' FROM graph_pages WHERE page_id % 9 = 0
    UNION ALL SELECT 'seen_range_reversed' FROM graph_pages WHERE depth > 5) x GROUP BY 1""", "graph_pages")  # fmt: skip
def _(pages):
    k, depth, now = F.col("page_id"), F.col("depth"), F.lit(NOW).cast("timestamp")
    status = F.get(F.array(*map(F.lit, ["queued", "running", "completed", "failed", "cancelled"])), (k % 5).cast("int"))
    counters = [F.lit(1).alias(c) for c in ("pages_fetched", "pages_failed", "pages_skipped", "bytes_downloaded", "sitemap_url_count")]
    crawls = pages.select(status.alias("status"), F.when(k % 7 > 0, now).alias("started_at"), F.when(k % 3 > 0, now).alias("completed_at"), F.when(k % 2 > 0, "timeout").alias("failure_category"), F.when(k % 20 == 0, 20_000).otherwise(500).alias("page_limit"), depth.alias("max_depth"), (depth - k % 7).alias("pages_discovered"), *counters)
    frontier = pages.select(F.when(k % 4 == 0, "skipped").otherwise("queued").alias("state"), F.when(k % 6 == 0, "depth").alias("skip_reason"), (depth * 3).alias("depth"), (k % 13).alias("attempts"))
    long = F.when(k % 10 == 0, F.repeat(F.lit("t"), 1001)).otherwise("t")
    address = F.when(k % 9 == 0, "").otherwise(F.col("url"))
    seen = pages.select(F.when(F.col("outcome") == "redirected", "blocked").otherwise("fetched").alias("outcome"), F.when(k % 2 > 0, "robots").alias("failure_category"), F.when(k % 11 > 0, k % 700).alias("http_status"), address.alias("normalised_url"), long.alias("title"), long.alias("meta_description"), F.lit(None).cast("string").alias("h1_text"), F.col("url").alias("canonical_url"))
    sites = pages.select(F.when(k % 3 == 0, "verified").otherwise("pending").alias("verification_state"), F.when(k % 2 == 0, now).alias("verified_at"), F.when(k % 5 > 0, "meta").alias("verification_method"), F.lit(1).alias("crawl_page_limit"), F.lit(20).alias("crawl_max_depth"), (k % 6).alias("crawl_concurrency"), F.lit(0).alias("crawl_delay_ms"))
    links = pages.select(F.when(k % 8 == 0, F.repeat(F.lit("a"), 301)).when(k % 8 == 1, F.repeat(F.lit("a"), 300)).alias("anchor_text"))
    lasting = pages.select(address.alias("normalised_url"), F.lit(5).alias("last_seen_at"), depth.alias("first_seen_at"))
    checks = [(crawls, quality.crawl_rules()), (frontier, quality.frontier_rules()), (seen, quality.crawl_page_rules()), (sites, quality.crawl_site_rules()), (links, quality.link_rules()), (lasting, quality.site_page_rules())]
    out = None
    for df, rules in checks:
        part = quality.check_rows(df, rules)
        out = part if out is None else out.unionByName(part)
    return out


@query("q2_constraint_violations", """SELECT rule, count(*) AS n FROM (SELECT 'merge_incomplete' AS rule FROM contacts WHERE (id % 6 = 0) <> (merged_into IS NOT NULL) UNION ALL SELECT 'merged_into_itself' FROM contacts WHERE merged_into IS NOT NULL AND id % 2 = 0
    UNION ALL SELECT 'not_one_value' FROM submissions WHERE (id % 2 = 0)::INT + (id % 3 = 0)::INT <> 1 UNION ALL SELECT 'outcome_contradicts_records' FROM submissions WHERE CASE WHEN outcome = 'rejected' THEN id % 4 = 0 ELSE id % 7 = 0 END
    UNION ALL SELECT 'origin_is_none' FROM submissions WHERE id % 3 = 0 UNION ALL SELECT 'key_is_weak' FROM submissions WHERE id % 5 = 0 UNION ALL SELECT 'evidence_is_no_object' FROM submissions WHERE id % 4 IN (0, 1) UNION ALL SELECT 'evidence_too_long' FROM submissions WHERE id % 4 = 3) x GROUP BY 1""", "contacts", "submissions")  # fmt: skip
def _(contacts, submissions):
    k = F.col("id")
    merged = contacts.select("id", F.when(k % 6 == 0, F.lit(NOW)).alias("merged_at"), F.when(F.col("merged_into").isNotNull() & (k % 2 == 0), k).otherwise(F.col("merged_into")).alias("merged_into"))
    values = submissions.select(F.when(k % 2 == 0, "x").alias("value_text"), F.when(k % 3 == 0, 1.0).alias("value_number"), F.lit(None).cast("boolean").alias("value_boolean"), F.lit(None).cast("date").alias("value_date"))
    receipts = submissions.select("outcome", F.when(F.when(F.col("outcome") == "rejected", k % 4 == 0).otherwise(k % 7 != 0), k).alias("contact_id"), F.when(F.when(F.col("outcome") == "rejected", k % 4 == 0).otherwise(F.lit(True)), k).alias("touch_id"))
    sites = submissions.select(F.when(k % 3 == 0, "https://a.test/path").otherwise("http://a.test:8080").alias("origin"), F.when(k % 5 == 0, F.lit("secret")).otherwise(F.md5(k.cast("string").cast("binary"))).alias("public_key"))
    findings = submissions.select(F.when(k % 4 == 0, "{}").when(k % 4 == 1, "[1]").when(k % 4 == 2, '{"links":0}').otherwise(F.concat(F.lit('{"x":"'), F.repeat(F.lit("y"), 4100), F.lit('"}'))).alias("evidence"))
    checks = [(merged, quality.contact_rules()), (values, quality.field_value_rules()), (receipts, quality.submission_rules()), (sites, quality.site_rules()), (findings, quality.finding_rules())]
    out = None
    for df, rules in checks:
        part = quality.check_rows(df, rules)
        out = part if out is None else out.unionByName(part)
    return out


@query("q3_duplicate_keys", "SELECT crawl_id, target_url, count(*) AS n FROM graph_links GROUP BY 1, 2 HAVING count(*) > 1", "graph_links")
def _(links):
    return quality.check_unique(links, ["crawl_id", "target_url"])


@query("q4_tenant_refs", "SELECT k.workspace_id, c.workspace_id AS parent_workspace, count(*) AS n FROM (SELECT id, contact_id, CASE WHEN id % 8 = 0 THEN 0 ELSE workspace_id END AS workspace_id FROM opportunities) k JOIN contacts c ON c.id = k.contact_id WHERE k.workspace_id <> c.workspace_id GROUP BY 1, 2", "contacts", "opportunities")
def _(contacts, opportunities):
    moved = opportunities.withColumn("workspace_id", F.when(F.col("id") % 8 == 0, 0).otherwise(F.col("workspace_id")))
    return quality.check_tenant_refs(moved, contacts, "contact_id")
