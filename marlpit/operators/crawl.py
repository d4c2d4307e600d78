"""Links, robots verdicts, orphan pages and the frontier, over whole crawls."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import is_nofollow, scan_metas, walk_links
from ..functions.urls import classify_scope, normalise_urls
from ..sources.tables import few_at_once, ranked, shared_table

# Failures that are refusals by policy.
POLICY_REFUSALS = [
    "ssrf_blocked", "unsupported_content_type", "response_too_large", "redirect_refused", "scheme_not_allowed", "credentials_present",
    "port_not_allowed", "host_missing", "host_too_long", "url_too_long", "sensitive_query", "unparseable",
]


def retrieved(pages: DataFrame) -> DataFrame:
    """pages that were fetched or are unchanged."""
    return pages.where(F.col("outcome").isin("fetched", "unchanged"))


def crawlable_sites(sites: DataFrame) -> DataFrame:
    """F8: sites that are verified and active."""
    return sites.where("verification_state = 'verified' and status = 'active'")


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Retrieved pages that no other page links to internally, with the population of their crawl."""
    own = retrieved(pages)
    population = own.groupBy("crawl_id").agg(F.count("*").alias("population"))
    inbound = links.where("scope = 'internal'").select("crawl_id", F.col("target_url").alias("url"), "source_page_id")
    # A page is rescued by a link from any page but itself: its least or greatest source must be another.
    sources = inbound.groupBy("crawl_id", "url").agg(F.min("source_page_id").alias("low"), F.max("source_page_id").alias("high"))
    joined = own.join(sources, ["crawl_id", "url"], "left")
    alone = joined.where("low is null or (low = page_id and high = page_id)").drop("low", "high")
    return alone.join(population, "crawl_id")


def orphan_findings(pages: DataFrame, links: DataFrame, existing: DataFrame) -> DataFrame:
    """New findings (crawl_id, page_id, rule, evidence), once for each crawl, page and rule."""
    evidence = F.to_json(F.struct(F.lit(0).alias("internalInboundLinks"), F.col("population").alias("pagesConsidered")))
    found = orphan_pages(pages, links).select("crawl_id", "page_id", F.lit("orphan_page").alias("rule"), evidence.alias("evidence"))
    return found.join(existing.select("crawl_id", "page_id", "rule"), ["crawl_id", "page_id", "rule"], "left_anti")


def media_type(header: Column) -> Column:
    """The type of a content-type header without its parameters."""
    return F.nullif(F.lower(F.trim(F.split(header, ";")[0])), F.lit(""))


def page_outcomes(df: DataFrame) -> DataFrame:
    """C4: df with outcome and failure_category from http_status and failure."""
    status, failure = F.col("http_status"), F.col("failure")
    outcome = (
        F.when(failure.isin(*POLICY_REFUSALS), "blocked").when(failure.isNotNull(), "failed")
        .when(status == 304, "unchanged").when(status.between(200, 299), "fetched").when(status.between(300, 399), "redirected").when(status.between(400, 499), "client_error").otherwise("server_error")
    )
    category = F.when(failure.isNotNull(), failure).when(status.between(400, 499), "http_4xx").when(status >= 500, "http_5xx")
    return df.withColumn("outcome", outcome).withColumn("failure_category", category)


def resolved_base(url: str, base: str) -> str | None:
    """A base address resolved against the page's, if it is one of the web."""
    with contextlib.suppress(ValueError):
        if re.match(r"(?i)https?://[^/?#]", whole := urljoin(url, base.strip())):
            return whole
    return None


def link_batches(batches: Iterator[pd.DataFrame], most: int = 10_000) -> Iterator[pd.DataFrame]:
    """The links of pages as they stand, handed on whenever there are `most`, so that a worker holds few of them."""

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["page_id", "origin", "place", "base", "href", "anchor_text", "is_nofollow"])

    for batch in batches:
        rows = []
        for page, url, origin, body in zip(batch.page_id, batch.url, batch.origin, batch.html):
            # The first base of the web holds from where it stands; anchors before it resolve against the page's address.
            base, place = None, 0
            for tag, href, text, rel in walk_links(body or ""):
                if tag == "base":
                    base = base or resolved_base(url or "", href)
                    continue
                rows.append((page, origin, place, base or url, href.strip(), text, is_nofollow(rel)))
                place += 1
                if len(rows) == most:
                    yield framed(rows)
                    rows = []
        yield framed(rows)


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, target_url, refusal, scope, anchor_text, is_nofollow) of pages (page_id, url, html, origin); duplicates stay."""

    schema = "page_id long, origin string, place int, base string, href string, anchor_text string, is_nofollow boolean"
    few_at_once(pages.sparkSession)
    found = pages.select("page_id", "url", "origin", "html").mapInPandas(link_batches, schema)
    named = normalise_urls(found, "href", "base")
    scope = F.when(F.col("normalised").isNotNull(), classify_scope(F.col("normalised"), F.col("origin")))
    return named.select("page_id", "place", F.col("normalised").alias("target_url"), "refusal", scope.alias("scope"), "anchor_text", "is_nofollow")


def link_report(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links out of each page by scope, links into it from other pages, and whether nothing links to it."""
    out = links.groupBy("page_id").agg(F.count("*").alias("links_out"), F.count_if(F.col("scope") == "in_scope").alias("internal_out"), F.count_if("is_nofollow").alias("nofollow_out"))
    named = normalise_urls(pages.select("page_id", "url"), "url").select("page_id", F.col("normalised").alias("target_url"))
    inbound = links.where("target_url is not null").groupBy("target_url", F.col("page_id").alias("source")).count()
    into = inbound.join(named, "target_url").where("source <> page_id").groupBy("page_id").agg(F.sum("count").alias("links_in"))
    joined = named.join(out, "page_id", "left").join(into, "page_id", "left").na.fill(0, ["links_out", "internal_out", "nofollow_out", "links_in"])
    return joined.select("page_id", "links_out", "internal_out", "nofollow_out", "links_in", (F.col("links_in") == 0).alias("is_orphan"))


def verification_tags(pages: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """(site, state): token_absent, token_mismatch or verified, from the meta tags in the head of pages (site, html) against expected (site, token).

    Tags count inside <head> and outside comments, templates and drawings; a token is 32 hexadecimal digits and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [[t.lower() for t in scan_metas(body or "", name) if re.fullmatch("[0-9a-fA-F]{32}", t)] for body in batch.html]
            yield pd.DataFrame({"site": batch.site, "tokens": tokens})

    few_at_once(pages.sparkSession)
    read = pages.select("site", "html").mapInPandas(run, f"site {pages.schema['site'].dataType.simpleString()}, tokens array<string>")
    found = read.join(expected, "site", "left")
    state = F.when(F.size("tokens") == 0, 0).when(F.array_contains("tokens", F.coalesce(F.lower("token"), F.lit(""))), 2).otherwise(1)
    names = F.array(F.lit("token_absent"), F.lit("token_mismatch"), F.lit("verified"))
    return found.groupBy("site").agg(F.max(state).alias("rank")).select("site", F.element_at(names, F.col("rank") + 1).alias("state"))


def matches_pattern(path: Column, rule: Column) -> Column:
    """Whether a path begins with a robots pattern: rule.parts are its literal pieces between stars, rule.whole says that it must end there."""
    parts, whole = rule["parts"], rule["whole"]
    first, last = parts[0], F.element_at(parts, -1)
    # Each piece is found as far left as it may stand; 0 means that one was not.
    begin = F.when(path.startswith(first), F.length(first) + 1).otherwise(0)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.when(whole, 2).otherwise(1), F.lit(0)))

    def step(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, path, at)
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(piece))

    end = F.aggregate(inner, begin, step)
    closed = F.when(F.size(parts) == 1, path == first).otherwise(path.endswith(last) & (F.length(path) - F.length(last) + 1 >= end))
    return (end > 0) & (~whole | closed)


def robots_verdicts(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(url, allowed, pattern, reason, crawl_delay) of urls (origin, url, path) under parsed rules.

    The groups that name the agent count together, else those of '*'; the longest pattern that matches, a closing
    $ not counted, wins, allow before disallow at equal length; an empty disallow allows. The delay is the longest
    of those groups. Reasons: no_group_matched, no_rule_matched, empty_disallow, longest_match, allow_wins_tie.

    An origin's rules, which S4 bounds, are one array beside each of its URLs, so a large site is no single task.
    """
    names_us = rules.groupBy("origin").agg(F.max(F.col("agent") == agent.lower()).alias("ours"))
    chosen = rules.join(names_us, "origin").where(F.when(F.col("ours"), F.col("agent") == agent.lower()).otherwise(F.col("agent") == "*"))
    is_rule = F.col("kind").isin("allow", "disallow") & (F.col("pattern") != "")
    whole = F.col("pattern").endswith("$")
    body = F.regexp_replace(F.regexp_replace("pattern", r"\*+", "*"), r"\$$", "")
    rule = F.struct((-F.length(F.regexp_replace("pattern", r"\$$", ""))).alias("rank"), (F.col("kind") != "allow").alias("refuses"), "pattern", F.split(body, r"\*", -1).alias("parts"), whole.alias("whole"))
    delay = F.when(F.col("kind") == "crawl-delay", F.col("pattern").try_cast("double"))
    gathered = chosen.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.when(is_rule, rule))).alias("rules"),
        F.max(F.when(delay.between(0, 86_400), delay)).alias("crawl_delay"),
        F.bool_or((F.col("kind") == "disallow") & (F.col("pattern") == "")).alias("permissive"),
    )
    matched = urls.join(gathered, "origin", "left").withColumn("hits ", F.filter("rules", lambda r: matches_pattern(F.col("path"), r)))
    best = F.get("hits ", F.lit(0))
    tie = F.exists("hits ", lambda r: (r["rank"] == best["rank"]) & r["refuses"]) & ~best["refuses"]
    reason = F.when(F.col("rules").isNull(), "no_group_matched").when(best.isNull(), F.when(F.col("permissive"), "empty_disallow").otherwise("no_rule_matched")).when(tie, "allow_wins_tie").otherwise("longest_match")
    return matched.select("url", F.coalesce(~best["refuses"], F.lit(True)).alias("allowed"), best["pattern"].alias("pattern"), reason.alias("reason"), "crawl_delay")


def frontier_counts(frontier: DataFrame) -> DataFrame:
    """Rows, fetchable and queued rows of each crawl."""
    return frontier.groupBy("crawl_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("state").isin("queued", "fetching", "fetched")).alias("fetchable"), F.count_if(F.col("state") == "queued").alias("queued"))


def crawl_totals(observations: DataFrame) -> DataFrame:
    """Fetched and failed pages, bytes read and sitemap URLs of each crawl, of observations (crawl_id, outcome, bytes, source)."""
    return observations.groupBy("crawl_id").agg(
        F.count_if(F.col("outcome").isin("fetched", "unchanged")).alias("fetched"), F.count_if(F.col("outcome").isin("failed", "blocked", "client_error", "server_error")).alias("failed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("source") == "sitemap").alias("sitemap_urls"),
    )


def site_page_history(observations: DataFrame) -> DataFrame:
    """First and last sight of each page of a site."""
    return observations.groupBy("site", "url").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def new_candidates(candidates: DataFrame, frontier: DataFrame) -> DataFrame:
    """Candidate URLs that the frontier lacks, once each, at their least depth."""
    return candidates.groupBy("crawl_id", "url").agg(F.min("depth").alias("depth")).join(frontier.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")


def next_batch(frontier: DataFrame, n: int) -> DataFrame:
    """K5: the next n queued rows of each crawl by depth, then age."""
    place = F.row_number().over(Window.partitionBy("crawl_id").orderBy("depth", "created_at", "url"))
    return frontier.where("state = 'queued'").withColumn("place", place).where(F.col("place") <= n).drop("place")


#: Rows of a frontier for each page that may be fetched, and the least and the most of them.
ROWS_PER_PAGE, LEAST_ROWS, MOST_ROWS = 10, 500, 20_000


def row_ceiling(page_limit: int) -> int:
    return min(max(ROWS_PER_PAGE * page_limit, LEAST_ROWS), MOST_ROWS)


def decide_enqueue(candidates: DataFrame, page_limit: int, max_depth: int) -> DataFrame:
    """G1: candidates (crawl_id, url, refusal, scope, allowed, depth, place) with accept, skip_reason and recorded, decided in order.

    The page limit falls on the later of those that pass, and rows beyond the ceiling are not recorded, in the order of depth, place and URL.
    A crawl is ranked over sorted ranges (ranked), so no level of it meets in one task.
    """
    early = (
        F.when(F.col("refusal") == "too_long", "url_too_long").when(F.col("refusal").isNotNull(), "unsupported_scheme")
        .when(F.col("scope") == "external", "external").when(F.col("scope") == "other_subdomain", "other_subdomain")
        .when(F.col("depth") > max_depth, "depth_limit").when(~F.col("allowed"), "robots_disallowed")
    )
    marked = candidates.withColumn("early", early).withColumn("passes ", F.col("early").isNull())
    order = [F.col(c).asc_nulls_first() for c in ("depth", "place", "url")]
    every = ranked(ranked(marked, ["crawl_id", "passes "], order, "nth "), ["crawl_id"], order)
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("nth ") > page_limit, "page_limit")
    out = every.withColumn("skip_reason", reason).withColumn("accept", F.col("skip_reason").isNull()).withColumn("recorded", F.col("n") <= row_ceiling(page_limit))
    return out.drop("early", "passes ", "nth ", "n")


def build_frontier(seeds: DataFrame, links: DataFrame, max_depth: int, page_limit: int, sitemap: DataFrame | None = None) -> DataFrame:
    """(crawl_id, url, depth, source, accepted) reached level by level from seeds (crawl_id, url), then the sitemap's URLs at the same depth, along links (crawl_id, source_url, target_url).

    A URL keeps its first depth and source; past the page limit URLs stay in the frontier unaccepted and are not
    followed. Within a level seeds come first, then the sitemap, then links, each by URL.
    """
    start = seeds.select("crawl_id", "url", F.lit(0).alias("rank"))
    if sitemap is not None:
        start = start.unionByName(sitemap.select("crawl_id", "url", F.lit(1).alias("rank")))
    level = start.groupBy("crawl_id", "url").agg(F.min("rank").alias("rank"))
    seen, used = None, None
    for depth in range(max_depth + 1):
        placed = ranked(level, ["crawl_id"], [F.col("rank").asc(), F.col("url").asc()])
        counted = placed if used is None else placed.join(used, "crawl_id", "left")
        before = F.lit(0) if used is None else F.coalesce("used", F.lit(0))
        source = F.element_at(F.array(F.lit("seed"), F.lit("sitemap"), F.lit("link")), F.col("rank") + 1)
        level = shared_table(counted.select("crawl_id", "url", F.lit(depth).alias("depth"), source.alias("source"), (F.col("n") + before <= page_limit).alias("accepted")))
        seen = level if seen is None else seen.unionByName(level)
        used = shared_table(seen.groupBy("crawl_id").agg(F.count_if("accepted").alias("used")))
        found = level.where("accepted").join(links, (F.col("url") == F.col("source_url")) & (level["crawl_id"] == links["crawl_id"])).select(level["crawl_id"], F.col("target_url").alias("url")).distinct()
        level = found.join(seen.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").withColumn("rank", F.lit(2))
        if level.isEmpty():
            break
    return seen


def termination(cancelled: Column, fetched: Column, page_limit: Column, skipped_for_depth: Column) -> Column:
    """Why a crawl ended."""
    return F.when(cancelled, "cancelled").when(fetched >= page_limit, "budget_exhausted").when(skipped_for_depth > 0, "depth_exhausted").otherwise("frontier_empty")


def enqueue_summary(decisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates of each crawl that are queued, skipped, duplicates of known URLs (crawl_id, url), or not recorded, and whether depth stopped any."""
    marked = decisions.withColumn("known ", F.lit(False)) if known is None else decisions.join(known.select("crawl_id", "url", F.lit(True).alias("known ")).distinct(), ["crawl_id", "url"], "left").withColumn("known ", F.coalesce("known ", F.lit(False)))
    new = ~F.col("known ")
    return marked.groupBy("crawl_id").agg(
        F.count_if(new & F.col("recorded") & F.col("accept")).alias("queued"), F.count_if(new & F.col("recorded") & ~F.col("accept")).alias("skipped"),
        F.count_if("known ").alias("duplicates"), F.count_if(new & ~F.col("recorded")).alias("unrecorded"),
        F.coalesce(F.bool_or(new & F.col("skip_reason").eqNullSafe("depth_limit")), F.lit(False)).alias("skipped_for_depth"),
    )


def reap_stale(crawls: DataFrame, frontier: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(crawls, frontier) after running crawls past page_limit * 30 s + 30 min have failed and their open URLs are abandoned."""
    limit = F.expr("started_at + make_interval(0, 0, 0, 0, 0, 30, page_limit * 30)")
    stale = (F.col("status") == "running") & (limit <= F.lit(now).cast("timestamp"))
    dead = crawls.where(stale).select("crawl_id", F.lit(True).alias("dead"))
    closed = crawls.withColumn("failure", F.when(stale, "internal_error").otherwise(F.col("failure"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
    return closed, close_rows(frontier.join(dead, "crawl_id", "left"), F.coalesce("dead", F.lit(False)), "abandoned").drop("dead")


def close_rows(frontier: DataFrame, condition: Column, reason: str) -> DataFrame:
    """Open rows under a condition skipped for a reason."""
    hit = condition & F.col("state").isin("queued", "fetching")
    return frontier.withColumn("skip_reason", F.when(hit, reason).otherwise(F.col("skip_reason"))).withColumn("state", F.when(hit, "skipped").otherwise(F.col("state")))


def finish_runs(crawls: DataFrame, frontier: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crawls, frontier) after a run: what is still open is skipped as cancelled, and each crawl has its totals (A16) and how many rows were skipped."""
    closed = close_rows(frontier, F.lit(True), "cancelled")
    skipped = closed.groupBy("crawl_id").agg(F.count_if(F.col("state") == "skipped").alias("skipped"))
    counters = ["fetched", "failed", "bytes", "sitemap_urls", "skipped"]
    written = crawls.drop(*counters).join(crawl_totals(observations), "crawl_id", "left").join(skipped, "crawl_id", "left")
    return written.na.fill(0, counters), closed
