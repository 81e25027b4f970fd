"""Columns on records of unknown shape, kept as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.text import strings


def record(text: Column) -> Column:
    """The JSON object in `text` as a variant; null if it can't be read or is no object."""
    v = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def _path(keys: tuple[str, ...]) -> str:
    return "$" + "".join(f".{k}" for k in keys)


def values_at(v: Column, paths: list[tuple[str, ...]]) -> Column:
    """The array of what stands at the paths, of any types, without those that hold nothing or a JSON null."""
    found = F.transform(strings([_path(p) for p in paths]), lambda p: F.try_variant_get(v, p, "variant"))
    return F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x))


def first_value(v: Column, *paths: tuple[str, ...]) -> Column:
    """The first value of any type at one of the paths, in order; null without one."""
    return F.get(values_at(v, list(paths)), F.lit(0))


def first_text(v: Column, *paths: tuple[str, ...]) -> Column:
    """The first string at one of the paths that isn't blank, trimmed; numbers and other types, which a cast would turn into text, don't count."""
    texts = F.filter(values_at(v, list(paths)), lambda x: F.schema_of_variant(x) == "STRING")
    return F.get(F.filter(F.transform(texts, lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda x: x != ""), F.lit(0))


def flag_at(v: Column, *path: str) -> Column:
    """The boolean at the path; null for other types, among them the strings true and false."""
    found = F.try_variant_get(v, _path(path), "variant")
    return F.when(F.schema_of_variant(found) == "BOOLEAN", F.try_variant_get(found, "$", "boolean"))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: filters and later expressions are not merged with them across a generator."""
    for name, value in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
    return df
