"""Transparent rule scoring: groups of rules become points, a score, a verdict and its reasons.

A record has the columns of `RECORD`; absent columns count as null. Each rule
is a column of its points, null where it doesn't hold, so that sums are plain
additions; reasons are worked out only where they are asked for.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.host import cross_registrable, inner_labels, subdomain_depth, tld, url_host
from decoyscope.functions.terms import (
    BAD_NAMESERVERS,
    BADGE_WORDS,
    BUDGET_REGISTRARS,
    BULLETPROOF,
    COUNTRY_POINTS,
    COUNTRY_TLDS,
    CREDENTIAL_PATHS,
    FREE_NAMESERVERS,
    GEO_TLDS,
    HOSTING_POINTS,
    KIT_FILES,
    KIT_PATHS,
    PARKING_MARKERS,
    PARKING_NAMESERVERS,
    PARKING_SERVERS,
    PARKING_URLS,
    PROTECTED_TLDS,
    QUERY_WORDS,
    RESIDENTIAL,
    RISKY_TLDS,
)
from decoyscope.functions.reference import let
from decoyscope.functions.text import first_in, strings
from decoyscope.functions.url import path_of, query_of

STRINGS = "array<string>"
#: Column -> type of a record that can be scored.
RECORD = {
    "fqdn": "string", "registrable": "string", "seed_registrable": "string", "is_original_seed": "boolean", "url": "string",
    "original_host": "string", "url_length": "int", "url_entropy": "double", "has_repeated_digits": "boolean", "is_idn": "boolean",
    "mixed_script": "boolean", "is_very_new": "boolean", "is_newly_registered": "boolean", "days_until_expiry": "long",
    "domain_age_days": "long", "registrar": "string", "whois_error": "string", "password_fields": "int", "email_fields": "int",
    "form_count": "int", "suspicious_form_count": "int", "forms_to_ip": "int", "forms_to_suspicious_tld": "int",
    "forms_to_private_ip": "int", "keyword_count": "int", "obfuscated_scripts": "int", "is_self_signed": "boolean",
    "has_domain_mismatch": "boolean", "cert_is_very_new": "boolean", "is_newly_issued": "boolean", "cert_risk_score": "int",
    "cert_age_days": "long", "cert_validity_days": "long", "cert_issuer": "string", "a": STRINGS, "mx": STRINGS, "ns": STRINGS,
    "ptr": STRINGS, "ttls": "map<string,int>", "country": "string", "asn_org": "string", "title": "string", "page_text": "string",
    "external_links": "int", "html_size": "int", "server": "string",
}
class Hit(NamedTuple):
    """What a rule gives: points, null where it doesn't hold, and its reason (an array of them if it may hold several times)."""

    category: str
    points: Column
    reason: Column
    many: bool = False


def complete(df: DataFrame) -> DataFrame:
    """Adds the columns of `RECORD` that are missing, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in RECORD.items() if c not in df.columns})


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _hit(test: Column, category: str, points, reason) -> Hit:
    return _ladder(category, (test, points, reason))


def _ladder(category: str, *steps: tuple) -> Hit:
    """The first step (test, points, reason) that holds."""
    chosen = lambda k: reduce(lambda w, s: w.when(s[0], _c(s[k])), steps[1:], F.when(steps[0][0], _c(steps[0][k])))
    return Hit(category, chosen(1).cast("int"), chosen(2).cast("string"))


def _each(items: Column, category: str, points: int, needles: list[str], reason) -> Hit:
    """Points for each of `items` that contains one of `needles`, whatever its case."""
    found = F.filter(_none(items), lambda x: _any(F.lower(x), needles))
    return Hit(category, F.nullif(F.size(found) * points, F.lit(0)), F.transform(found, lambda x: reason(first_in(F.lower(x), needles))), True)


def _any(text: Column, needles: list[str]) -> Column:
    """Whether `text` contains one of `needles`; null for null."""
    return text.rlike("|".join(re.escape(n) for n in needles))


def _held(text: Column, needles: list[str]) -> Column:
    """How many of `needles` `text` contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(n)).cast("int") for n in needles])


def _first(table: dict, test) -> Column:
    """The value of the first key that passes `test`, else null."""
    return reduce(lambda w, kv: w.when(test(F.lit(kv[0])), F.lit(kv[1])), list(table.items())[1:], F.when(test(F.lit(next(iter(table)))), F.lit(next(iter(table.values())))))


def _none(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(STRINGS))


def registration(c) -> list[Hit]:
    return [
        _ladder("whois", (c("is_very_new"), 25, "Domain <7d"), (c("is_newly_registered"), 12, "Domain <30d")),
        _hit(c("days_until_expiry") < 30, "whois", 5, "Registration expires soon"),
    ]


def url_shape(c) -> list[Hit]:
    depth = subdomain_depth(c("fqdn"))
    return [
        _hit(F.contains(c("fqdn"), F.lit("xn--")), "url", 15, "IDN/punycode"),
        _hit(c("is_idn"), "url", 10, "IDN (Unicode)"),
        _hit(c("mixed_script"), "url", 10, "Mixed scripts"),
        _ladder("url", (c("url_length") >= 130, 10, "Very long URL"), (c("url_length") >= 80, 5, "Long URL")),
        _ladder("url", (c("url_entropy") > 4.5, 15, "High URL entropy"), (c("url_entropy") > 4.0, 10, "Elevated URL entropy")),
        _ladder("url", (depth >= 8, 20, "Extreme subdomain depth (≥8)"), (depth >= 6, 15, "Very deep subdomains (≥6)"), (depth >= 5, 12, "Many subdomains (≥5)"), (depth >= 3, 8, "Multiple subdomains (≥3)")),
        _hit(c("has_repeated_digits"), "url", 6, "Repeated digits"),
        _hit(tld(c("fqdn")).isin(RISKY_TLDS), "domain", 6, F.concat(F.lit("Risky TLD ."), tld(c("fqdn")))),
    ]


def impersonation(c) -> list[Hit]:
    """A protected or country suffix among the inner labels: pairs of labels first, then single labels."""
    inner, actual = inner_labels(c("fqdn")), tld(c("fqdn"))
    pairs = F.filter(F.transform(inner, lambda x, i: F.concat_ws(".", x, F.get(inner, i + 1))), lambda p: p.isin(PROTECTED_TLDS) & F.contains(p, F.lit(".")))
    single = F.filter(inner, lambda x: x.isin(PROTECTED_TLDS + COUNTRY_TLDS) & (x != actual))
    found = F.coalesce(F.get(pairs, F.lit(0)), F.get(single, F.lit(0)))
    worth = let(found, lambda x: F.when(x.isin(PROTECTED_TLDS), 40).when(x.isNotNull(), 30))
    reason = let(found, lambda x: F.when(x.isin(PROTECTED_TLDS), F.concat(F.lit("TLD impersonation: "), x, F.lit(" in subdomain"))).otherwise(F.concat(F.lit("ccTLD in subdomain: "), x)))
    return [Hit("impersonation", worth, reason)]


def page_content(c) -> list[Hit]:
    return [
        _hit((c("password_fields") > 0) & (c("email_fields") > 0), "forms", 22, "Credential form"),
        _hit(c("suspicious_form_count") > 0, "forms", 18, "Suspicious forms"),
        _hit(c("forms_to_ip") > 0, "forms", 10, "Forms submit to IP"),
        _hit(c("forms_to_suspicious_tld") > 0, "forms", 10, "Forms submit to suspicious TLD"),
        _hit(c("forms_to_private_ip") > 0, "forms", 10, "Forms submit to private IP"),
        _ladder("content", (c("keyword_count") >= 8, 18, "Many phishing keywords"), (c("keyword_count") >= 3, 12, "Phishing keywords present"), (c("keyword_count") >= 1, 8, "Keyword hint")),
        _hit(c("obfuscated_scripts") > 0, "javascript", 15, "Obfuscated JavaScript detected"),
    ]


def certificate(c) -> list[Hit]:
    """The share of the certificate's own risk has points but no reason."""
    extra = F.least(F.lit(20), F.floor(F.coalesce(c("cert_risk_score"), F.lit(0)) * 0.2))
    return [
        _hit(c("is_self_signed"), "ssl", 40, "TLS self-signed"),
        _hit(c("has_domain_mismatch"), "ssl", 25, "TLS CN mismatch"),
        _ladder("ssl", (c("cert_is_very_new"), 12, "Cert very new (<7d)"), (c("is_newly_issued"), 8, "Cert new (<30d)")),
        _hit(extra > 0, "ssl", extra, F.lit(None).cast("string")),
    ]


def network(c) -> list[Hit]:
    fqdn = F.lower(c("fqdn"))
    bare = lambda h: F.rtrim(F.lower(h), F.lit("."))
    country = F.upper(c("country"))
    geo = [
        F.when(F.contains(F.concat(F.lit("."), fqdn, F.lit(".")), F.lit(f".{s}.")) & ~F.endswith(fqdn, F.lit(f".{s}")) & ~country.isin(ok), F.lit(s))
        for s, ok in GEO_TLDS.items()
    ]
    claimed = F.coalesce(*geo)
    dotted = cross_registrable(c("original_host"), url_host(c("url")))
    return [
        _hit(dotted, "http", 12, "Redirect crosses registrable"),
        _hit(F.exists(_none(c("mx")), lambda m: bare(m) == F.rtrim(fqdn, F.lit("."))), "dns", 10, "Self-referential MX record"),
        _hit(F.exists(F.map_values(c("ttls")), lambda t: (t >= 0) & (t < 60)), "dns", 8, "Suspiciously low TTL (fast-flux)"),
        _hit(F.contains(F.lower(c("whois_error")), F.lit("no output")), "dns", 5, "WHOIS data unavailable"),
        _each(c("ns"), "dns", 12, BAD_NAMESERVERS, lambda x: F.concat(F.lit("Suspicious nameserver ("), x, F.lit(")"))),
        _hit(country.isNotNull() & claimed.isNotNull(), "geo", 15, F.concat(F.lit("Geographic mismatch: claims "), claimed, F.lit(", hosted in "), c("country"))),
        _hit(
            (F.length(c("seed_registrable")) > 0) & ~F.coalesce(c("is_original_seed"), F.lit(False)) & ~c("seed_registrable").eqNullSafe(c("registrable")),
            "typosquat", 25, F.concat(F.lit("Potential typosquat of "), c("seed_registrable"))),
    ]


def temporal(c) -> list[Hit]:
    gap = F.abs(c("domain_age_days") - c("cert_age_days"))
    both = gap.isNotNull()
    return [
        _ladder("temporal", (gap <= 1, 35, "Domain and SSL cert created same day (automation)"), (gap <= 7, 20, F.concat(F.lit("Domain and cert created within "), gap.cast("string"), F.lit(" days"))), (gap <= 30, 10, "Domain and cert both new (<30 days)")),
        _hit(both & (c("domain_age_days") > 0) & (c("domain_age_days") < 7) & F.contains(F.lower(c("cert_issuer")), F.lit("let's encrypt")), "temporal", 15, "Let's Encrypt cert on very new domain"),
        _hit(both & (c("cert_validity_days") > 0) & (c("cert_validity_days") < 90), "temporal", 8, F.concat(F.lit("Short cert validity ("), c("cert_validity_days").cast("string"), F.lit(" days)"))),
    ]


def behaviour(c) -> list[Hit]:
    url = F.lower(c("url"))
    path, query = path_of(url), query_of(url)
    in_path, ends = lambda k: F.contains(path, k), lambda k: F.regexp_extract(path, r"([^/]*)$", 1) == k
    name = lambda table: {k: k for k in table}
    kit, file, params = _first(KIT_PATHS, in_path), _first(KIT_FILES, ends), _held(query, QUERY_WORDS)
    return [
        Hit("behavior", kit, F.concat(F.lit("Suspicious path pattern: "), _first(name(KIT_PATHS), in_path))),
        Hit("behavior", file, F.concat(F.lit("Suspicious file: "), _first(name(KIT_FILES), ends))),
        _hit(F.contains(url, F.lit("base64")) | url.rlike(r"[?&][a-z]=[a-z0-9+/]{20,}={0,2}"), "behavior", 18, "Possible base64 encoded payload in URL"),
        _ladder("behavior", (params >= 3, 15, F.concat(F.lit("Multiple suspicious parameters ("), params.cast("string"), F.lit(")"))), (params >= 2, 8, "Suspicious URL parameters")),
        _hit(path.rlike(r"\.\w{2,4}\.\w{2,4}$"), "behavior", 20, "Double file extension (masquerading)"),
        _hit(path.rlike(r"/[a-z0-9]{5,8}$") & (F.length(path) < 15), "behavior", 10, "URL shortener pattern detected"),
        _hit(_held(path, CREDENTIAL_PATHS) >= 2, "behavior", 15, "Multiple credential-related paths"),
        _hit(_any(path, [f"{x}{w}{x}" for w in BADGE_WORDS for x in "/-"]), "behavior", 12, "Fake security indicator in URL"),
    ]


def infrastructure(c) -> list[Hit]:
    org, registrar, country = F.lower(c("asn_org")), F.lower(c("registrar")), F.upper(c("country"))
    risk = F.nullif(_first(COUNTRY_POINTS, lambda k: country == k), F.lit(0))
    in_org = lambda k: F.contains(org, k)
    n_a = F.size(_none(c("a")))
    return [
        Hit("infrastructure", _first(HOSTING_POINTS, in_org), F.concat(F.lit("High-risk hosting: "), _first({k: k for k in HOSTING_POINTS}, in_org))),
        Hit("infrastructure", risk, F.when(risk > 0, F.concat(F.lit("Hosted in suspicious country: "), country))),
        _each(c("ns"), "infrastructure", 8, FREE_NAMESERVERS, lambda x: F.concat(F.lit("Suspicious nameserver: "), x)),
        _hit(_any(org, BULLETPROOF), "infrastructure", 25, "Bulletproof hosting detected"),
        _hit(_any(org, RESIDENTIAL), "infrastructure", 15, "Hosted on residential IP"),
        _hit(_any(registrar, BUDGET_REGISTRARS), "infrastructure", 5, F.concat(F.lit("Budget registrar: "), first_in(registrar, BUDGET_REGISTRARS))),
        _hit((n_a > 0) & (F.size(_none(c("ptr"))) == 0), "infrastructure", 8, "No reverse DNS configured"),
        _hit(n_a > 5, "infrastructure", 10, F.concat(F.lit("Unusual number of IPs ("), n_a.cast("string"), F.lit(")"))),
    ]


def parking(c) -> list[Hit]:
    """Signals of a parked domain; their points are the confidence."""
    text = F.concat(F.coalesce(F.lower(c("title")), F.lit("")), F.lit(" "), F.coalesce(F.lower(F.left(c("page_text"), F.lit(5000))), F.lit("")))
    weight = reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(k)), v).otherwise(0) for k, v in PARKING_MARKERS.items()])
    no_mx, n_a = F.size(_none(c("mx"))) == 0, F.size(_none(c("a")))
    paged, formless = c("html_size").isNotNull(), F.coalesce(c("form_count"), F.lit(0)) == 0
    url, server, left = F.lower(c("url")), F.lower(c("server")), c("days_until_expiry")
    return [
        _each(c("ns"), "parked", 40, PARKING_NAMESERVERS, lambda x: F.concat(F.lit("NS points to parking: "), x)),
        _hit(_any(url, PARKING_URLS), "parked", 35, F.concat(F.lit("Redirects to parking: "), first_in(url, PARKING_URLS))),
        Hit("parked", let(weight, lambda w: F.when(w >= 25, F.least(F.lit(30), w))), F.when(weight >= 25, F.concat(F.lit("Parking content detected ("), _held(text, list(PARKING_MARKERS)).cast("string"), F.lit(" markers)")))),
        _hit(no_mx, "parked", 10, "No MX records"),
        _hit(no_mx & (n_a == 1), "parked", 10, "Minimal DNS configuration"),
        _hit(paged & formless, "parked", 8, "No forms on page"),
        _hit((c("html_size") > 0) & (c("html_size") < 5000), "parked", 12, F.concat(F.lit("Minimal content ("), c("html_size").cast("string"), F.lit(" bytes)"))),
        _hit((c("external_links") > 5) & formless, "parked", 15, "Multiple external links, no forms"),
        _hit(c("is_newly_registered"), "parked", 5, "Recently registered"),
        _hit(left < 60, "parked", 8, F.concat(F.lit("Expires soon ("), left.cast("string"), F.lit(" days)"))),
        _hit(_any(server, PARKING_SERVERS), "parked", 30, F.concat(F.lit("Parking server: "), first_in(server, PARKING_SERVERS))),
    ]


GROUPS = {
    "registration": registration, "url": url_shape, "impersonation": impersonation, "content": page_content, "certificate": certificate,
    "network": network, "temporal": temporal, "behaviour": behaviour, "infrastructure": infrastructure,
}
#: Groups that count only if their points are above zero.
POSITIVE = {"temporal", "behaviour", "infrastructure"}


def points(hits: list[Hit]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(h.points, F.lit(0)) for h in hits])


def _reasons(hits: list[Hit]) -> Column:
    """The reasons of the rules that hold, in order."""
    one = lambda h: F.when(h.points.isNotNull(), h.reason if h.many else F.array(h.reason))
    return F.concat(*[F.coalesce(one(h), F.array().cast(STRINGS)) for h in hits])


def score(records: DataFrame, as_of: Column, monitor_days: int = 90) -> DataFrame:
    """Adds verdict, score, confidence, reasons, categories, monitor_until and monitor_reason.

    Parked domains are told first; others get the sum of their rules' points:
    phishing from 70, suspicious from 40. Suspicious ones, and parked ones
    registered lately, are watched for `monitor_days` from `as_of`.
    """
    df = complete(records)
    groups = {k: rule(F.col) for k, rule in GROUPS.items()} | {"parking": parking(F.col)}
    df = df.withColumns({f"_{k}{i}": h.points for k, hits in groups.items() for i, h in enumerate(hits)})
    groups = {k: [h._replace(points=F.col(f"_{k}{i}")) for i, h in enumerate(hits)] for k, hits in groups.items()}
    df = df.withColumns({f"_{k}": F.greatest(points(hits), F.lit(0)) if k in POSITIVE else points(hits) for k, hits in groups.items()})
    df = df.withColumns({"_sum": reduce(lambda a, b: a + b, [F.col(f"_{k}") for k in GROUPS]), "_sure": F.col("_parking")})
    parked = (F.col("_sure") >= 50) & ~F.coalesce(F.col("domain_age_days") > 365, F.lit(False))
    df = df.withColumn("verdict", F.when(parked, "parked").when(F.col("_sum") >= 70, "phishing").when(F.col("_sum") >= 40, "suspicious").otherwise("benign"))
    v, s = F.col("verdict"), F.col("_sum")
    confidence = (
        F.when(v == "parked", F.least(F.lit(0.95), 0.5 + F.col("_sure") / 200))
        .when(v == "phishing", F.least(F.lit(0.99), 0.9 + (s - 70) / 100))
        .when(v == "suspicious", 0.65 + (s - 40) / 200)
        .otherwise(0.5)
    )
    counts = lambda k: F.col(f"_{k}") > 0 if k in POSITIVE else F.lit(True)
    reasons = F.concat(*[F.when(counts(k), _reasons(groups[k])).otherwise(F.array().cast(STRINGS)) for k in GROUPS])
    kinds: dict[str, list[Hit]] = {}
    for k, hits in groups.items():
        for h in hits:
            here = (v == "parked") if k == "parking" else (v != "parked") & counts(k)
            kinds.setdefault(h.category, []).append(h._replace(points=F.when(here, h.points)))
    sums = [F.when(F.coalesce(*[h.points for h in hits]).isNotNull(), F.struct(F.lit(k).alias("key"), points(hits).alias("value"))) for k, hits in kinds.items()]
    watch = (v == "suspicious") | ((v == "parked") & F.coalesce(F.col("is_newly_registered"), F.lit(False)))
    df = df.withColumns({
        "score": F.when(v == "parked", F.col("_sure")).otherwise(s),
        "confidence": F.round(confidence, 3),
        "reasons": F.slice(F.array_compact(F.when(v == "parked", _reasons(groups["parking"])).otherwise(reasons)), 1, 20),
        "categories": F.map_from_entries(F.array_compact(F.array(*sums))),
        "monitor_until": F.when(watch, F.unix_timestamp(as_of) + monitor_days * 86400),
        "monitor_reason": F.when(watch, v),
    })
    return df.drop(*[f"_{k}{i}" for k, hits in groups.items() for i in range(len(hits))], *[f"_{k}" for k in groups], "_sure", "_sum")


def merged(scored: DataFrame, chain: Column, summary: Column, penalty: Column) -> DataFrame:
    """Adds the stage and, for chains that cross domains, how the score falls to the first and the final site."""
    base = F.greatest(F.col("score") - penalty, F.lit(0))
    first = F.floor(base / 2)
    return scored.withColumns({
        "stage": F.when(F.col("monitor_until").isNotNull(), "rules:monitor").otherwise(F.concat(F.lit("rules:"), F.col("verdict"))),
        "cross_domain": F.when(summary["crosses"], F.struct(
            penalty.alias("penalty"), first.alias("original_score"), (base - first).alias("final_score"),
            F.struct(summary["final"].alias("domain"), F.element_at(chain, -1).alias("url")).alias("final_site"))),
    })


def category_sums(scored: DataFrame, key: str) -> DataFrame:
    """(key, category, points), a row for each category of each record.

    A record without any is left out after the explosion: an inner one makes
    the optimizer put a filter on the categories below all rules, with these
    written out in it time and again.
    """
    return scored.select(key, F.explode_outer("categories").alias("category", "points")).where(F.col("category").isNotNull())


def category_columns(scored: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """A row per record and a column cat_<name> per category, null where a record has none.

    Without `names` the categories are those that occur; there are as many as
    kinds of rules, never as many as records.
    """
    rows = category_sums(scored, key)
    wide = rows.groupBy(key).pivot("category", names).agg(F.sum("points")) if names else rows.groupBy(key).pivot("category").agg(F.sum("points"))
    return wide.select(key, *[F.col(f"`{c}`").alias(f"cat_{c}") for c in wide.columns if c != key])
