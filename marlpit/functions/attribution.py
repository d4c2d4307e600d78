"""Source classification and provenance of touchpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import bare_host, settled

# Hosts and the platform each stands for, and mediums that mark a paid campaign.
SEARCH_HOSTS = {
    "google.com": "google", "google.com.au": "google", "google.co.uk": "google", "google.ca": "google", "google.co.nz": "google", "bing.com": "bing",
    "duckduckgo.com": "unknown", "search.yahoo.com": "unknown", "ecosia.org": "unknown", "brave.com": "unknown",
}
SOCIAL_HOSTS = {
    "facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "t.co": "unknown", "x.com": "unknown",
    "reddit.com": "unknown", "youtube.com": "unknown", "pinterest.com": "unknown", "tiktok.com": "unknown",
}
PAID = ["cpc", "ppc", "paid", "paidsearch", "paid_search", "cpm", "display"]
UTM_PLATFORMS = {"google": "google", "bing": "bing", "facebook": "facebook", "meta": "facebook", "instagram": "instagram", "linkedin": "linkedin"}


# Why each rule decides; {} stands for the medium or the host.
RATIONALE = [
    "Arrived with a Google click identifier (gclid).",
    "Arrived with a Meta click identifier (fbclid).",
    "Campaign link marked utm_medium={}.",
    "Campaign link marked as email.",
    "Campaign link marked utm_medium={}.",
    "Referred by {}, with no paid campaign markers.",
    "Referred by {}.",
    "Referred by {}.",
    "Campaign parameters present, but the channel is not identifiable.",
    "No referrer and no campaign parameters. This may be a direct visit, or a referrer the browser withheld.",
]


def host_platform(host: Column, table: dict[str, str]) -> Column:
    """The platform of a host or of a subdomain of it, else null: its last labels are looked up in a constant map."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    labels = sorted({name.count(".") + 1 for name in table}, reverse=True)
    return F.coalesce(*[F.try_element_at(known, F.substring_index(host, ".", -k)) for k in labels])


def classify_source(df: DataFrame) -> DataFrame:
    """C11: source_type, source_platform, confidence and rationale of touches with gclid, fbclid, utm_medium, utm_source, utm_campaign and referrer; the first rule that fits decides.

    Host, medium, source and rule are settled in steps, so that none of them is worked out once for each place that asks for it.
    """
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    read = settled(df, **{"host ": bare_host(F.col("referrer")), "medium ": name("utm_medium"), "source ": name("utm_source")})
    host, medium, source = F.col("host "), F.col("medium "), F.col("source ")
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UTM_PLATFORMS.items() for x in pair]), source), F.lit("unknown"))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    search, social = host_platform(host, SEARCH_HOSTS), host_platform(host, SOCIAL_HOSTS)
    rules = [
        (given("gclid"), F.lit("paid_search"), F.lit("google"), "declared"),
        (given("fbclid"), F.lit("social"), F.lit("facebook"), "declared"),
        (medium.isin(*PAID), F.when(source.isin("google", "bing"), "paid_search").otherwise("social"), named, "derived"),
        ((medium == "email") | source.isin("email", "newsletter"), F.lit("email"), F.lit("unknown"), "derived"),
        (medium.isin("social", "organic_social"), F.lit("social"), named, "derived"),
        (search.isNotNull(), F.lit("organic_search"), search, "derived"),
        (social.isNotNull(), F.lit("social"), social, "derived"),
        (host.isNotNull(), F.lit("referral"), F.lit("unknown"), "derived"),
        (source.isNotNull() | given("utm_campaign"), F.lit("unknown"), named, "derived"),
        (F.lit(True), F.lit("direct"), F.lit("unknown"), "inferred"),
    ]
    said = F.when(F.lit(False), F.lit(None).cast("struct<source_type:string,source_platform:string,confidence:string,rationale:string>"))
    for (condition, kind, platform, confidence), why in zip(rules, RATIONALE):
        told = F.replace(F.lit(why), F.lit("{}"), medium if "medium" in why else host) if "{}" in why else F.lit(why)
        said = said.when(condition, F.struct(kind.alias("source_type"), platform.alias("source_platform"), F.lit(confidence).alias("confidence"), told.alias("rationale")))
    return read.select(*df.columns, F.inline(F.array(said)))


def split_landing(df: DataFrame, url: str, limit: int = 255) -> DataFrame:
    """landing_path and the campaign parameters of a landing URL; empty is null, long values are cut."""
    names = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    value = lambda n: F.try_url_decode(F.regexp_extract(query, f"(?:^|&){n}=([^&]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.col(url), r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    return df.select(*df.columns, F.nullif(F.substring(path, 1, limit), F.lit("")).alias("landing_path"), *[F.nullif(F.substring(value(n), 1, limit), F.lit("")).alias(f"landing_{n}") for n in names])


def sanitise_context(df: DataFrame) -> DataFrame:
    """landing_path, referrer_origin, session_id and elapsed_ms within their bounds; control characters become spaces."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "))
    path = F.substring(F.regexp_replace(clean("landing_path"), r"[?#].*$", ""), 1, 512)
    origin = F.substring(F.regexp_extract(clean("referrer_origin"), r"(?i)^(https?://[^/?#]+)", 1), 1, 255)
    session = F.when(F.col("session_id").rlike(r"^[A-Za-z0-9_\-]{1,64}$"), F.col("session_id"))
    elapsed = F.greatest(F.lit(0), F.least(F.lit(86_400_000), F.col("elapsed_ms")))
    return df.withColumns({"landing_path": path, "referrer_origin": F.nullif(origin, F.lit("")), "session_id": session, "elapsed_ms": F.when(F.col("elapsed_ms").isNotNull(), elapsed)})


def provenance_violations(df: DataFrame) -> DataFrame:
    """C14: rows (id, violation) that claim more than their evidence shows."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("search_query").isNotNull() & (F.col("confidence") != "declared"), "query_without_declaration"),
            F.when(F.col("gclid").isNotNull() & (F.col("source_type") == "organic_search"), "click_id_on_organic"),
        )
    )
    return df.select("id", F.explode(rules).alias("violation"))


def needs_caveat(confidence: Column) -> Column:
    return ~confidence.isin("declared", "manual")
