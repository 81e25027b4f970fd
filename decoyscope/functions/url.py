"""Columns on urls: parts, normal form, structural features, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decoyscope.functions.host import inner_labels, strip_www, url_host
from decoyscope.functions.text import count_of, entropy

SPECIALS = "@&%$!#?=._-/"


def path_of(url: Column) -> Column:
    """Path of an absolute url; / where it is empty."""
    p = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment_of(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def normalize_url(u: Column) -> Column:
    """With a scheme, a host and a path, query and fragment kept; null if that can't be."""
    t = F.trim(u)
    full = F.when(F.lower(t).rlike(r"^https?://"), t).otherwise(F.concat(F.lit("http://"), t))
    head = F.regexp_extract(full, r"^(https?://[^/?#\s]+)", 1)
    head = F.when(head == "", F.regexp_extract(full, r"^([hH][tT][tT][pP][sS]?://[^/?#\s]+)", 1)).otherwise(head)
    rest = F.substr(full, F.length(head) + 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when((F.length(t) > 0) & (head != ""), F.concat(head, rest))


def is_valid_domain(d: Column) -> Column:
    return F.coalesce(d.rlike(r"^([a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"), F.lit(False))


def extract_domain(s: Column) -> Column:
    """Host of an http(s) url, else the trimmed, lower-cased input."""
    return F.when(F.lower(F.trim(s)).rlike(r"^https?://"), url_host(F.trim(s))).otherwise(F.lower(F.trim(s)))


def url_features(u: Column) -> dict[str, Column]:
    """Name -> column of the structural features of a url."""
    host, path = url_host(u), path_of(u)
    inner = inner_labels(host)
    glued = F.array_join(inner, "")
    n = F.size(inner)
    deep = count_of(host, ".") >= 2
    return {
        "url_length": F.length(u),
        "num_dots": count_of(u, "."),
        "has_repeated_digits": u.rlike(r"(\d)\1"),
        "num_special_chars": count_of(u, "@&%$!#?=_"),
        "num_hyphens": count_of(u, "-"),
        "num_slashes": count_of(u, "/"),
        "num_underscores": count_of(u, "_"),
        "num_question_marks": count_of(u, "?"),
        "num_equal_signs": count_of(u, "="),
        "num_dollar_signs": count_of(u, "$"),
        "num_exclamation_marks": count_of(u, "!"),
        "num_hashtags": count_of(u, "#"),
        "num_percent_signs": count_of(u, "%"),
        "domain_length": F.length(host),
        "domain_hyphens": count_of(host, "-"),
        "domain_has_special_chars": count_of(host, SPECIALS) > 0,
        "domain_num_special_chars": count_of(host, SPECIALS),
        "url_entropy": entropy(u),
        "domain_entropy": entropy(host),
        "num_subdomains": F.greatest(count_of(host, ".") - 1, F.lit(0)),
        "avg_subdomain_length": F.when(deep, F.length(glued) / F.greatest(n, F.lit(1))).otherwise(0.0),
        "subdomain_entropy": F.when(deep, entropy(glued)).otherwise(0.0),
        "subdomain_num_special_chars": F.when(deep, count_of(glued, SPECIALS)).otherwise(0),
        "subdomain_has_hyphen": deep & F.contains(glued, F.lit("-")),
        "subdomain_has_repeated_digits": deep & glued.rlike(r"(\d)\1"),
        "path_length": F.length(path),
        "path_has_query": query_of(u) != "",
        "path_has_fragment": fragment_of(u) != "",
        "url_has_anchor": F.contains(u, F.lit("#")),
    }


def safe_filename(cse_id: Column, registrable: Column, url: Column, fqdn: Column) -> Column:
    """Host-based name with 8 digits of the url's SHA-256; the whole hash where no name is known."""
    clean = lambda c: F.regexp_replace(c, r"[^a-zA-Z0-9.\-]", "_")
    full = F.sha2(url, 256)
    name = F.coalesce(
        clean(F.nullif(fqdn, F.lit(""))),
        clean(F.nullif(url_host(url), F.lit(""))),
        clean(F.nullif(registrable, F.lit(""))),
        F.regexp_replace(F.nullif(cse_id, F.lit("")), r"[:/\\]", "_"),
    )
    return F.when(name.isNotNull(), F.concat(name, F.lit("_"), F.left(full, F.lit(8)))).otherwise(full)


def stable_id(original: Column, url: Column, fqdn: Column, registrable: Column, record_json: Column) -> Column:
    """`domain:sha1[:16]` of the first known host, without www; else `rec-` and 24 digits of the record's hash."""
    none = F.lit("")
    host = strip_www(F.lower(F.coalesce(F.nullif(original, none), F.nullif(url_host(url), none), F.nullif(fqdn, none), F.nullif(registrable, none))))
    return F.when(host.isNotNull(), F.concat(host, F.lit(":"), F.left(F.sha1(host), F.lit(16)))).otherwise(
        F.concat(F.lit("rec-"), F.left(F.sha1(record_json), F.lit(24))))
