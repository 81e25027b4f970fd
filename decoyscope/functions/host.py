"""Columns on hosts: canonical form, labels, registrable domain, distances, redirects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.terms import FREE_HOSTS, HOSTING_SERVICES, SHORTENERS
from decoyscope.functions.text import any_in, entropy, strings


def _ascii(h: str | None) -> str | None:
    try:
        return h.encode("idna").decode("ascii")
    except (UnicodeError, AttributeError):
        return h


def _punycode(host: Column) -> Column:
    """IDNA form by Arrow batches; the host itself where there is none."""

    @F.pandas_udf("string")
    def encode(hosts: pd.Series) -> pd.Series:
        return hosts.map(_ascii)

    return encode(host)


def canonical_host(h: Column, idna: bool = True) -> Column:
    """Trimmed, lower-cased, without outer dots and wildcard label; ASCII form unless `idna` is off.

    Only hosts with other than ASCII characters reach Python.
    """
    plain = F.regexp_replace(F.btrim(F.lower(F.trim(h)), F.lit(".")), r"^\*\.", "")
    if not idna:
        return plain
    return F.when(plain.rlike(r"[^\x00-\x7F]"), _punycode(F.when(plain.rlike(r"[^\x00-\x7F]"), plain))).otherwise(plain)


def url_host(url: Column) -> Column:
    """Lower-cased host of an absolute url, else the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def labels(h: Column) -> Column:
    return F.split(h, r"\.")


def left_label(h: Column) -> Column:
    return F.get(labels(h), F.lit(0))


def tld(h: Column) -> Column:
    """Last label; empty where there is no dot."""
    return F.when(F.contains(h, F.lit(".")), F.lower(F.element_at(labels(h), -1))).otherwise("")


def inner_labels(h: Column) -> Column:
    """All labels but the last two."""
    parts = labels(F.lower(h))
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0)))


def subdomain_depth(h: Column) -> Column:
    return F.greatest(F.size(labels(F.coalesce(h, F.lit("")))) - 2, F.lit(0))


def strip_www(h: Column) -> Column:
    """Without a leading www. if a dot remains."""
    return F.when(h.rlike(r"^www\.[^.]*\..*"), F.substring(h, 5, 1 << 20)).otherwise(h)


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def cross_registrable(original: Column, final: Column) -> Column:
    """Whether two hosts differ behind their first label; false if either has no dot."""
    rest = lambda h: F.regexp_replace(F.lower(h), r"^[^.]*\.", "")
    dotted = F.contains(original, F.lit(".")) & F.contains(final, F.lit("."))
    return F.coalesce(dotted & (rest(original) != rest(final)), F.lit(False))


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """(tail, more, exception) of the rules of a public suffix list in `suffix`.

    `co.in` is a suffix itself. `*.ck` makes one of every label below ck, so
    it is looked up by `ck` and has one label more. `!www.ck` is an exception
    to that: its suffix has one label less. Blank lines and // comments, as
    the list has them, are left out.
    """
    s = F.lower(F.trim("suffix"))
    rules = suffixes.select(s.alias("s")).where((F.col("s") != "") & ~F.startswith("s", F.lit("//"))).distinct()
    star, bang = F.startswith("s", F.lit("*.")), F.startswith("s", F.lit("!"))
    more = F.when(star, 1).when(bang, -1).otherwise(0)
    tail = F.when(star, F.substr("s", F.lit(3))).when(bang, F.substr("s", F.lit(2))).otherwise(F.col("s"))
    return rules.select(tail.alias("tail"), more.alias("more"), bang.alias("exception"))


def with_registrable(hosts: DataFrame, suffixes: DataFrame, host: str = "host", private: bool = True, unknown: int | None = None) -> DataFrame:
    """Adds `registrable`: the public suffix of `host` and one more label.

    `suffixes` has a column `suffix` with the rules, and may have a boolean
    `private`; those marked so are left out unless `private`. An exception
    decides before all other rules, then the rule of most labels. Where none
    fits, the last `unknown` labels are taken, or the whole host. Each host's
    label tails meet the rules in an equi-join, once per distinct host.
    """
    if not private and "private" in suffixes.columns:
        suffixes = suffixes.where(~F.coalesce("private", F.lit(False)))
    tails = hosts.select(host).where(F.col(host).isNotNull()).distinct().withColumn("_p", labels(F.col(host)))
    tails = tails.select(host, F.size("_p").alias("_all"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_p", -n, n), ".").alias("tail")))).alias("_t"))
    met = tails.select(host, "_all", F.col("_t.n").alias("_n"), F.col("_t.tail").alias("tail")).join(suffix_rules(suffixes), "tail").where(F.col("_n") + F.col("more") <= F.col("_all"))
    best = met.groupBy(host).agg(F.max(F.struct("exception", (F.col("_n") + F.col("more")).alias("n")))["n"].alias("_n"))
    parts = labels(F.col(host))
    take = F.least(F.coalesce(F.col("_n") + 1, F.size(parts) if unknown is None else F.lit(unknown)), F.size(parts))
    return hosts.join(best, host, "left").withColumn("registrable", F.array_join(F.slice(parts, -take, take), ".")).drop("_n")


def idn_features(h: Column) -> Column:
    """struct(is_idn, mixed_script, confusable_count): other than ASCII characters, and both kinds together."""
    other = F.regexp_count(h, F.lit(r"[^\x00-\x7F]"))
    return F.struct((other > 0).alias("is_idn"), ((other > 0) & (other < F.length(h))).alias("mixed_script"), other.alias("confusable_count"))


def nameserver_features(ns: Column) -> Column:
    """struct(count, entropy of the joined list, mean length of first labels, share of first labels with a digit)."""
    ns = F.coalesce(ns, F.array().cast("array<string>"))
    first = F.transform(ns, left_label)
    n = F.size(ns)
    mean = F.when(n > 0, F.aggregate(first, F.lit(0.0), lambda a, x: a + F.length(x)) / n).otherwise(0.0)
    digits = F.when(n > 0, F.size(F.filter(first, lambda x: x.rlike(r"\d"))) / n).otherwise(0.0)
    return F.struct(n.alias("count"), entropy(F.array_join(ns, "")).alias("entropy"), mean.alias("mean_length"), digits.alias("digit_share"))


def redirect_summary(chain: Column) -> Column:
    """struct(redirect_count, original, final, domains, hops, crosses) of a list of urls, hosts without www."""
    hosts = F.filter(F.transform(chain, lambda u: strip_www(url_host(u))), lambda h: h != "")
    some = F.size(hosts) >= 2
    distinct = F.array_distinct(hosts)
    return F.struct(
        F.greatest(F.size(chain) - 1, F.lit(0)).alias("redirect_count"),
        F.when(some, F.get(hosts, F.lit(0))).alias("original"),
        F.when(some, F.element_at(hosts, -1)).alias("final"),
        F.when(some, distinct).otherwise(F.array().cast("array<string>")).alias("domains"),
        F.when(some, F.size(distinct) - 1).otherwise(0).alias("hops"),
        (some & (F.size(distinct) > 1)).alias("crosses"),
    )


def redirect_penalty(chain: Column, hops: Column) -> Column:
    """10 a hop, and for each middle url 15 if it is a shortener and 10 if a free host."""
    middle = F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 2, F.lit(0)))
    hosts = F.transform(middle, lambda u: strip_www(url_host(u)))
    point = lambda h: F.when(any_in(h, SHORTENERS), 15).otherwise(0) + F.when(any_in(h, FREE_HOSTS), 10).otherwise(0)
    return hops * 10 + F.aggregate(hosts, F.lit(0), lambda a, h: a + point(h))


def hosting_class(h: Column) -> Column:
    """struct(service, risk, type) of the first hosting service whose suffix ends the host, or whose part stands in it, else null."""
    found = None
    for name, suffixes, risk, kind in HOSTING_SERVICES:
        hit = F.exists(strings([s for s in suffixes if not s.endswith(".")]), lambda s: F.endswith(h, s)) | any_in(h, [s for s in suffixes if s.endswith(".")])
        value = F.struct(F.lit(name).alias("service"), F.lit(risk).alias("risk"), F.lit(kind).alias("type"))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found
