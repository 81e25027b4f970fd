"""Fusing the partial records of a domain, and classes of the fused record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.text import csv_list


def latest(rows: DataFrame, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest record of each key, whole; equal times are settled by `tie`."""
    order = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*rows.columns)


def merge(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest value of each column that isn't null."""
    rest = [c for c in rows.columns if c not in (key, ts)]
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in rest]
    return rows.groupBy(key).agg(F.max(ts).alias(ts), *newest).select(*rows.columns)


def fuse(parts: DataFrame, key: str, part: str, kinds: list[str], payload: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """One row per key with the newest payload of each kind of part as a struct column of its name.

    One shuffle: every kind's newest record is an aggregate of its own.
    """
    order = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    body = F.struct(*payload)
    return rows_of(parts, part, kinds).groupBy(key).agg(*[
        F.max_by(F.when(F.col(part) == k, body), F.when(F.col(part) == k, order)).alias(k) for k in kinds], F.max(ts).alias("updated"))


def rows_of(parts: DataFrame, part: str, kinds: list[str]) -> DataFrame:
    return parts.where(F.col(part).isin(kinds))


def fuse_all(domain: DataFrame, http: DataFrame, features: DataFrame, key: str = "fqdn") -> DataFrame:
    """Full outer join of three tables with one row per key."""
    return domain.join(http, key, "full_outer").join(features, key, "full_outer")


def record_type(domain: Column, features: Column, verdict: Column, inactive: Column) -> Column:
    """struct(record_type, enrichment_level) by which parts a record has."""
    kind = lambda name, level: F.struct(F.lit(name).alias("record_type"), F.lit(level).alias("enrichment_level"))
    return (
        F.when(verdict & features & domain, kind("fully_enriched", 3))
        .when(verdict & domain, kind("verdict_only", 2))
        .when(features & domain, kind("with_features", 2))
        .when(domain, kind("domain_only", 1))
        .when(features, kind("features_only", 1))
        .when(inactive, kind("inactive", 0))
        .otherwise(kind("partial", 0))
    )


def message_type(inactive: Column, failed: Column, verdict: Column, features: Column) -> Column:
    return F.when(inactive, "inactive").when(failed, "failed").when(verdict, "verdict").when(features, "features").otherwise("domain")


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns to scalars: list sizes as `<name>_count` and joined lists, struct fields as `<name>_<field>`, maps as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.typeName()
        if kind == "array" and f.dataType.elementType.typeName() == "string":
            out += [F.size(F.coalesce(c, F.array().cast("array<string>"))).alias(f"{f.name.lower()}_count"), F.array_join(c, ",").alias(f.name.lower())]
        elif kind == "struct":
            out += [c[g.name].alias(f"{f.name}_{g.name}") if g.dataType.typeName() not in ("array", "map", "struct") else F.to_json(c[g.name]).alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        elif kind in ("map", "array"):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def rehydrate(df: DataFrame, schemas: dict[str, str], lists: list[str]) -> DataFrame:
    """JSON strings back to nested columns, comma-separated strings to lists; what can't be read is null."""
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()} | {c: csv_list(F.col(c)) for c in lists})


def artifact_links(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Adds <column>_exists and <column>_name: whether a row's path is among `files` (path), and its base name."""
    path = F.when(F.col(column) != "None", F.col(column))
    there = files.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    joined = rows.withColumn("_p", path).join(there, F.col("_p") == F.col("_path"), "left")
    return joined.withColumns({f"{column}_exists": F.coalesce("_there", F.lit(False)), f"{column}_name": F.nullif(F.regexp_extract("_p", r"([^/]*)$", 1), F.lit(""))}).drop("_p", "_path", "_there")


def report(df: DataFrame) -> DataFrame:
    """Flat report rows of a fused table: first addresses and servers, risk, verdict, registration."""
    first = lambda c: F.get(F.col(c), F.lit(0))
    return df.select("fqdn", "seed_registrable", "fuzzer", first("a").alias("ip"), first("ns").alias("name_server"), first("mx").alias("mail_server"), "score", "verdict", "created", "registrar")


def document(df: DataFrame, sections: dict[str, list[str]]) -> Column:
    """A text of `sections` (title -> columns): a line per known value, a title only where it has lines."""
    parts = []
    for name, cols in sections.items():
        lines = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cols]))
        parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(f"[{name}]\n"), F.array_join(lines, "\n"))))
    return F.concat_ws("\n", *parts)
