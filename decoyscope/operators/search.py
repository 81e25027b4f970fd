"""Predicates, pages, lookups and vector search over keyed collections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoyscope.functions.host import strip_www, url_host


def equal_all(filters: dict) -> Column:
    """All given (not None) columns equal their values."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None], F.lit(True))


def literal(text: str):
    """The value that `text` means: boolean, integer, float or string."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"[+-]?\d*\.\d+", text) else text


def where_pairs(pairs: list[str], ranges: dict[str, tuple] | None = None) -> Column:
    """AND of `key=value` with typed values, and of ranges (low, high), either end open."""
    tests = [F.col(k.strip()) == F.lit(literal(v.strip())) for k, _, v in (p.partition("=") for p in pairs)]
    for k, (low, high) in (ranges or {}).items():
        tests += [F.col(k) >= low] if low is not None else []
        tests += [F.col(k) <= high] if high is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


OPERATORS = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False)),
}


def where_tree(tree: dict) -> Column:
    """A predicate from {field: value}, {field: {"$gte": value}}, {"$and": [..]} and {"$or": [..]}."""
    tests = []
    for k, v in tree.items():
        if k in ("$and", "$or"):
            parts = [where_tree(x) for x in v]
            tests.append(reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), parts))
        elif isinstance(v, dict):
            tests += [OPERATORS[op](F.col(k), x) for op, x in v.items()]
        else:
            tests.append(F.col(k) == v)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def like(c: Column, needle: str) -> Column:
    """Contains, whatever the case; an empty needle matches all, null never does otherwise."""
    return F.lit(True) if not needle else F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def page(df: DataFrame, limit: int, offset: int, order: list, cap: int = 1000) -> DataFrame:
    """Rows offset .. offset + limit in a given order; filters belong before."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), cap))


def search(df: DataFrame, column: str, needle: str, order: list, most: int = 100) -> DataFrame:
    """Up to `most` matches of at least 2 characters, with how many there are in all."""
    if len(needle) < 2:
        return df.limit(0).withColumn("total", F.lit(0).cast("long"))
    hits = df.where(like(F.col(column), needle))
    return hits.orderBy(*order).limit(most).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


def filtered_top(df: DataFrame, order: list, test: Column, limit: int) -> DataFrame:
    """Looks at the newest 2 * limit rows and returns the first `limit` that pass."""
    return df.orderBy(*order).limit(2 * limit).where(test).orderBy(*order).limit(limit)


def cosine_top_k(vectors: DataFrame, query: Column, k: int, vec: str = "embedding", id_: str = "id", by: str | None = None) -> DataFrame:
    """The k nearest rows by cosine distance, per collection `by` if given: id, distance, similarity (4 places).

    `query` is an array literal. Distances are one pass; per-collection tops
    are taken in two steps, so that no task sorts a whole collection.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vec)
    cos = dot(v, query) / (F.sqrt(dot(v, v)) * F.sqrt(dot(query, query)))
    scored = vectors.withColumn("distance", 1 - cos).where(F.col("distance").isNotNull())
    k = min(k, 50)
    if by is None:
        return scored.orderBy("distance", id_).limit(k).withColumn("similarity", F.round(1 - F.col("distance"), 4))
    part = scored.withColumn("_p", F.spark_partition_id())
    for w in (Window.partitionBy(by, "_p"), Window.partitionBy(by)):
        part = part.withColumn("_n", F.row_number().over(w.orderBy("distance", id_))).where(F.col("_n") <= k)
    return part.drop("_n", "_p").withColumn("similarity", F.round(1 - F.col("distance"), 4))


def domain_lookup(collections: DataFrame, domain: str) -> DataFrame:
    """The best match of a domain: originals first, then by id prefix, url host, registrable, seed.

    collections: id, url, registrable, seed_registrable, is_original.
    """
    d = domain.lower()
    host = strip_www(url_host(F.col("url")))
    rule = (
        F.when(F.startswith("id", F.lit(d + ":")), 1).when(host == d.removeprefix("www."), 2)
        .when(F.col("registrable") == d, 3).when(F.col("seed_registrable") == d, 4)
    )
    hits = collections.withColumn("rule", rule).where("rule is not null")
    return hits.orderBy(F.desc("is_original"), "rule", "id").limit(1)


def strategies(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows that each named predicate finds, with its name; a row may come under several."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
    return df.withColumn("strategy", F.explode(found))


def status_of(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every asked key with its row; found is false for a miss."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def monitoring_lookup(active: DataFrame, inactive: DataFrame, key: str = "domain") -> DataFrame:
    """One entry per domain, active before inactive."""
    both = active.withColumn("queue", F.lit("active")).unionByName(inactive.withColumn("queue", F.lit("inactive")))
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min(F.struct("queue", *[c for c in rest if c != "queue"])).alias("_r")).select(key, "_r.*")
