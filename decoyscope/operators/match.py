"""Matching hosts with protected seeds, brand tokens and brand assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.host import left_label
from decoyscope.functions.terms import GENERIC_TOKENS, NOISE_LABELS


def is_noise(host: Column) -> Column:
    """Infrastructure labels and long hexadecimal labels."""
    return left_label(host).isin(NOISE_LABELS) | left_label(host).rlike(r"(?i)^[a-f0-9]{16,}$")


def seed_match(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds cse_id and the reason `seed:registrable:eq` where registrable is a seed.

    hosts: registrable; seeds: seed_registrable, cse_id.
    """
    one = seeds.groupBy("seed_registrable").agg(F.min("cse_id").alias("cse_id"))
    return hosts.join(one, hosts["registrable"] == one["seed_registrable"], "left").withColumn(
        "reasons", F.when(F.col("seed_registrable").isNotNull(), F.array(F.lit("seed:registrable:eq"))).otherwise(F.array().cast("array<string>")))


def _deletions(c: Column) -> Column:
    """A string and all strings that lack one of its characters: strings within one edit share one of these."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.left(c, i - 1), F.substr(c, i + 1)))))


def token_match(hosts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(label, token, rule) for every label's best brand token.

    hosts: label; tokens: token. Rules: exact; one edit, for tokens of 5
    letters and more; a whole word between other characters than letters.
    Among a label's hits the smallest (token, rule) stays. Generic tokens and
    tokens of fewer than 3 letters never match. Instead of comparing all
    pairs, labels and tokens meet in equi-joins: exact and word hits on the
    label's letter runs, tokens that hold other characters on their own, edit
    hits on strings with one character left out.
    """
    toks = tokens.select("token").where((F.length("token") >= 3) & ~F.col("token").isin(GENERIC_TOKENS)).distinct()
    labs = hosts.select(F.lower(F.trim("label")).alias("label")).where(F.col("label") != "").distinct()
    # a token between other characters than letters: it begins where a run of letters begins or a non-letter stands
    runs = labs.select("label", F.explode(F.filter(F.split("label", "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("token")).distinct()
    word = runs.join(toks, "token").select("label", "token", F.when(F.col("label") == F.col("token"), 1).otherwise(3).alias("rule"))
    mixed = toks.where(F.col("token").rlike("[^a-z]"))
    spans = labs.where(F.col("label").rlike("[^a-z]")).select("label", F.explode(F.sequence(F.lit(3), F.greatest(F.length("label"), F.lit(3)))).alias("n")).select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("label") - F.col("n") + 1, F.lit(1))), lambda i: F.substr(F.col("label"), i, F.col("n")))).alias("token")).distinct()
    bounded = F.regexp_like(F.col("label"), F.concat(F.lit(r"(^|[^a-z])\Q"), F.col("token"), F.lit(r"\E([^a-z]|$)")))
    other = spans.join(mixed, "token").where(bounded).select("label", "token", F.when(F.col("label") == F.col("token"), 1).otherwise(3).alias("rule"))
    long = toks.where(F.length("token") >= 5)
    near = labs.select("label", F.explode(_deletions(F.col("label"))).alias("x")).join(long.select("token", F.explode(_deletions(F.col("token"))).alias("x")), "x").where(
        (F.levenshtein("label", "token", 1) >= 0) & (F.col("label") != F.col("token"))).select("label", "token", F.lit(2).alias("rule"))
    hits = word.unionByName(other).unionByName(near)
    best = hits.groupBy("label").agg(F.min(F.struct("token", "rule")).alias("m"))
    names = F.element_at(F.array(F.lit("token:exact"), F.lit("token:ld1"), F.lit("token:word")), F.col("m.rule"))
    return best.select("label", F.col("m.token").alias("token"), names.alias("rule"))


def unseen(rows: DataFrame, seen: DataFrame, key: str = "fqdn") -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def deny_suffixes(rows: DataFrame, deny: list[str], host: str = "fqdn") -> DataFrame:
    """Drops rows whose host ends with an entry, on a label border or not."""
    c = F.col(host)
    return rows.where(~F.coalesce(F.exists(F.array(*[F.lit(d) for d in deny]), lambda d: F.endswith(c, d)), F.lit(False))) if deny else rows


def registered_split(variants: DataFrame, observed: DataFrame, key: str = "fqdn") -> DataFrame:
    """Adds `registered`: whether the variant is among the observed hosts."""
    seen = observed.select(key).distinct().withColumn("registered", F.lit(True))
    return variants.join(seen, key, "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


def asset_match(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds matches_legit: whether a page's sha256 is its brand's; null if either is unknown."""
    known = assets.select("cse_id", F.col("sha256").alias("_legit"))
    return pages.join(known, "cse_id", "left").withColumn("matches_legit", F.col("sha256") == F.col("_legit")).drop("_legit")


def logo_match(pages: DataFrame, logos: DataFrame, most: int = 8) -> DataFrame:
    """(page_id, distance, detected): least Hamming distance of a page's phash to its brand's logos."""
    pairs = pages.join(logos.withColumnRenamed("phash", "_logo"), "cse_id")
    least = pairs.groupBy("page_id").agg(F.min(F.bit_count(F.col("phash").bitwiseXOR(F.col("_logo")))).alias("distance"))
    return least.withColumn("detected", F.col("distance") <= most)


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the lower-cased tokens of two texts, 4 places; 0 if either has none."""
    toks = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))
    both, all_ = F.size(F.array_intersect(toks(a), toks(b))), F.size(F.array_union(toks(a), toks(b)))
    return F.when((F.size(toks(a)) > 0) & (F.size(toks(b)) > 0), F.round(both / all_, 4)).otherwise(0.0)
