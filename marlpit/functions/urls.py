"""URL identity, scope and admission as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .hosts import ascii_host, browser_host, browser_hosts

MAX_URL = 2048

# Query parameters that never tell pages apart.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "gclid", "gclsrc", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "twclid", "ttclid", "li_fat_id", "igshid",
    "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsa_acc", "hsa_cam", "hsa_grp", "hsa_ad", "vero_id", "vero_conv", "mkt_tok", "oly_anon_id", "oly_enc_id",
    "ck_subscriber_id", "s_kwcid", "ef_id", "yclid", "ref", "referrer", "source",
]
SESSION = ["phpsessid", "jsessionid", "sessionid", "sid", "cfid", "cftoken", "zenid", "_ga", "_gl"]
SESSION_PREFIX = "aspsessionid"
# Query names that carry credentials, use up a link or hold personal data.
SENSITIVE = [
    "token", "auth", "authorization", "session", "sessionid", "jsessionid", "phpsessid", "sid", "password", "passwd", "pwd", "secret", "apikey", "signature", "sig",
    "reset", "invite", "confirm", "unsubscribe",
    "email", "phone",
]
SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*:"
# An http address as browsers read it: any number of slashes, backslashes included, and the host after the last @ of the authority.
HTTP = r"(?i)^(https?):[/\\]*(?:([^/\\?#]*)@)?(\[[0-9a-f:.]+\]|[^/\\?#@:\[\]]*)(?::([0-9]*))?(?=[/\\?#]|$)"
#: An http address whose host browsers change: outside ASCII, escaped, encoded, or of numbers.
ODD_HOST = r"(?i)^https?://(?:[^/?#@]*@)?(?:\[|[^/?#:]*(?:xn--|%)|(?:[^/?#:]*\.)?(?:0x[0-9a-f]*|[0-9]+)\.?(?:[:/?#]|$))"
#: What no host holds.
NOT_IN_HOST = r"[\x00-\x20<>^|%\x7F]"


@F.pandas_udf(StringType())
def _resolve(url: pd.Series, base: pd.Series) -> pd.Series:
    """Relative references and characters outside ASCII; nulls stay null."""

    def one(u, b):
        if u is None:
            return None
        try:
            parts = urlsplit(urljoin(b, u) if b else u)
            named = parts.hostname or ""
            host = ascii_host(f"[{named}]" if ":" in named else named) if parts.scheme in ("http", "https") else named
            port = f":{parts.port}" if parts.port is not None else ""
        except (ValueError, UnicodeError):
            return None
        if host is None:
            return None
        keep = "/%:@!$&'()*+,;=-._~"
        query = "?" + quote(parts.query, safe=keep + "?[]") if parts.query else ""
        return f"{parts.scheme}://{host}{port}{quote(parts.path, safe=keep)}{query}" if parts.scheme else None

    return pd.Series([one(u, b) for u, b in zip(url, base)])


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are worked out once each, however often later expressions name them: a generator stands between."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fold_escapes(text: Column) -> Column:
    """Escapes of unreserved characters decoded, the others in upper case."""

    def piece(p: Column, k: Column) -> Column:
        code = F.upper(F.substring(p, 1, 2))
        rest = F.substr(p, F.lit(3))
        char = F.char(F.conv(code, 16, 10).cast("long"))
        escaped = F.when((F.conv(code, 16, 10).cast("int") < 128) & char.rlike(r"^[A-Za-z0-9._~\-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), code, rest))
        return F.when(k == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), escaped).otherwise(F.concat(F.lit("%"), p))

    return F.array_join(F.transform(F.split(text, "%"), piece), "")


def normalise_query(query: Column) -> Column:
    """Without tracking and session parameters, sorted by name, always name=value; '' if nothing is left."""
    plain = fold_escapes(F.replace(query, F.lit("+"), F.lit("%20")))
    pairs = F.transform(F.filter(F.split(plain, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")).alias("value")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(*TRACKING, *SESSION) & ~F.lower(p["name"]).startswith(SESSION_PREFIX))
    # The comparator keeps equal names in their order.
    ordered = F.array_sort(kept, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    joined = F.array_join(F.transform(ordered, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def normalise_urls(df: DataFrame, url: str, base: str | None = None, fold: bool = False) -> DataFrame:
    """Df with normalised (null if refused) and refusal (too_long, not_a_resource or null)."""
    raw = F.trim(F.coalesce(F.col(url), F.lit("")))
    absolute = raw.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    odd = (~absolute & F.lit(base is not None)) | (raw.rlike("(?i)^https?:") & (raw.rlike(r"[^\x21-\x7E]|/\.\.?(/|$)") | raw.rlike(ODD_HOST)))
    refused_early = (F.length(raw) > MAX_URL) | (raw == "") | raw.startswith("#")
    asked = settled(df, **{"odd ": odd & ~refused_early, "plain ": F.when(~refused_early, raw)})
    whole = asked.withColumn("url ", F.when(F.col("odd "), _resolve(F.when(F.col("odd "), F.col("plain ")), F.col(base) if base else F.lit(None).cast("string"))).otherwise(F.col("plain ")))
    pattern = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    parts = settled(whole, **{f"{n} ": F.regexp_extract("url ", pattern, k) for k, n in enumerate(("scheme", "host", "port", "path", "query"), 1)})
    scheme, host, port, path, query = F.lower("scheme "), F.regexp_replace(F.lower("host "), r"([^.])\.$", "$1"), F.col("port "), F.col("path "), F.col("query ")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    full = F.when(path == "", F.lit("/")).otherwise(path)
    full = F.when((F.length(full) > 1) & full.endswith("/"), F.substr(full, F.lit(1), F.length(full) - 1)).otherwise(full) if fold else full
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), fold_escapes(full), F.when(query == "", "").otherwise(normalise_query(query)))
    built = settled(parts, **{"out ": F.when(F.col("scheme ") != "", out)})
    too_long = (F.length(F.trim(F.coalesce(F.col(url), F.lit("")))) > MAX_URL) | F.coalesce(F.length("out ") > MAX_URL, F.lit(False))
    refusal = F.when(too_long, "too_long").when(F.col("out ").isNull(), "not_a_resource")
    judged = settled(built, refusal=refusal, normalised=F.when(~too_long, F.col("out ")))
    return judged.drop("url ", "odd ", "plain ", "scheme ", "host ", "port ", "path ", "query ", "out ")


def url_depth(url: Column) -> Column:
    """How many path segments are not empty."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def classify_scope(url: Column, origin: Column, follow_upgrade: bool = True) -> Column:
    """in_scope, scheme_upgrade, other_subdomain or external; the registrable domain is never guessed."""
    whole = r"(?i)^([a-z][a-z0-9+.\-]*://[^/?#]*)"
    mine, base = F.lower(F.regexp_extract(url, whole, 1)), F.lower(F.regexp_extract(origin, whole, 1))
    host, site = host_of(url), host_of(origin)
    upgrade = (F.replace(mine, F.lit("https://"), F.lit("http://")) == base) & mine.startswith("https://") & base.startswith("http://")
    related = (host == site) | host.endswith(F.concat(F.lit("."), site)) | site.endswith(F.concat(F.lit("."), host))
    verdict = F.when((mine == "") | (base == ""), "external").when(mine == base, "in_scope")
    return verdict.when(F.lit(follow_upgrade) & upgrade, "scheme_upgrade").when(related, "other_subdomain").otherwise("external")


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is written out once, however often fn names it; fn holds no Python function."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def http_host(url: Column) -> Column:
    """The host of an absolute http address in lower case, as it is written."""
    return F.lower(F.regexp_extract(url, HTTP, 3))


def http_parts(url: Column, host: Column | None = None) -> Column:
    """A struct of scheme, login, host and port of an absolute http address, all in lower case and the default port empty; nulls where it is none.

    The host is as browsers keep it (hosts.browser_host), unless it is given.
    """

    def read(v: Column) -> Column:
        scheme, login, port = (F.lower(F.regexp_extract(v["url"], HTTP, k)) for k in (1, 2, 4))
        found = F.struct(scheme.alias("scheme"), login.alias("login"), v["host"].alias("host"), F.regexp_replace(port, "^0+(?=[0-9])", "").alias("port"))
        sound = v["url"].rlike(HTTP) & (v["host"] != "") & ~v["host"].rlike(NOT_IN_HOST)
        return bound(F.when(sound, found), judged)

    def judged(p: Column) -> Column:
        near = (p["port"] == "") | (F.coalesce(p["port"].try_cast("long"), F.lit(65536)) < 65536)
        default = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
        return F.when(near, F.struct(p["scheme"].alias("scheme"), p["login"].alias("login"), p["host"].alias("host"), F.when(default, "").otherwise(p["port"]).alias("port")))

    return bound(F.struct(url.alias("url"), (browser_host(http_host(url)) if host is None else host).alias("host")), read)


def without_breaks(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\t\r\n]", ""))


def http_address(value: Column) -> Column:
    """A value as an absolute http address: as it is if it has a scheme, else after https://; null if it is empty, has another scheme or begins with a slash."""
    return bound(without_breaks(value), lambda raw: F.when((raw == "") | raw.startswith("/"), None).when(raw.rlike(SCHEME), F.when(raw.rlike("(?i)^https?:"), raw)).otherwise(F.concat(F.lit("https://"), raw)))


def url_policy(url: Column) -> Column:
    """The first reason against fetching a URL, or null. An http address without a host is unparseable, as it is to a browser."""
    raw = without_breaks(url)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    parts = http_parts(raw)
    names = F.transform(F.split(F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))))
    sensitive = F.exists(names, lambda n: n.isin(*SENSITIVE) | F.exists(F.split(n, r"[-_.\[\]]+"), lambda w: w.isin(*SENSITIVE)))
    return (
        F.when(F.length(url) > MAX_URL, "url_too_long")
        .when(F.coalesce(scheme, F.lit("")) == "", "unparseable")
        .when(~scheme.isin("http", "https"), "scheme_not_allowed")
        .when(parts["host"].isNull(), "unparseable")
        .when(F.replace(parts["login"], F.lit(":")) != "", "credentials_present")
        .when(F.length(parts["host"]) > 253, "host_too_long")
        .when(~parts["port"].isin("", "80", "443"), "port_not_allowed")
        .when(sensitive, "sensitive_query")
    )


def bare_host(value: Column) -> Column:
    """The lower-cased host of an http address or of a bare host, without www.; null for paths, other schemes and host:port without a scheme."""
    return F.regexp_replace(http_parts(http_address(value))["host"], r"^www\.", "")


def normalise_origin(value: Column, host: Column | None = None) -> Column:
    """Scheme, host and port of an http address or of a bare host (then https), without a default port or login; null where there is none, for 'null' and beyond 255 characters. host: as in http_parts."""
    origin = bound(http_parts(http_address(value), host), lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"]))))
    return F.when((F.length(F.trim(value)) <= 255) & (F.trim(value) != "null"), origin)


def origin_allowed(origin: Column, allowed: Column) -> Column:
    """Whether an origin is in the list; an empty list allows every origin."""
    hosts = browser_hosts(F.transform(allowed, lambda a: http_host(http_address(a))))
    origins = F.zip_with(allowed, hosts, normalise_origin)
    return (F.coalesce(F.size(allowed), F.lit(0)) == 0) | F.coalesce(F.array_contains(origins, normalise_origin(origin)), F.lit(False))
