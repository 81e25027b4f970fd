"""Lookalike variants of seed domains, generated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.terms import COMMON_TLDS, REGIONAL_TLDS, RISK_WORDS
from decoyscope.functions.text import strings

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Vowels, characters that look alike, neighbours on a keyboard.
VOWELS = "aeiou"
HOMOGLYPHS = {"a": "4", "b": "d6", "c": "e", "d": "bc", "e": "3c", "g": "q9", "i": "1l", "l": "1i", "m": "n", "n": "mr", "o": "0", "q": "g", "s": "5", "u": "v", "v": "u", "z": "2"}
NEIGHBOURS = {"q": "wa", "w": "qe", "e": "wr", "r": "et", "t": "ry", "y": "tu", "u": "yi", "i": "uo", "o": "ip", "p": "ol", "a": "sq", "s": "ad", "d": "sf", "f": "dg", "g": "fh", "h": "gj", "j": "hk", "k": "jl", "l": "ko", "z": "xa", "x": "zc", "c": "xv", "v": "cb", "b": "vn", "n": "bm", "m": "nk"}
#: Pass -> (families, endings, words). Fixed values.
PASSES = {
    "PASS_A": ("addition bitsquatting homoglyph hyphenation insertion omission repetition replacement subdomain transposition vowel-swap dictionary tld-swap".split(), COMMON_TLDS, []),
    "PASS_B": ("homoglyph transposition insertion omission replacement addition dictionary tld-swap".split(), REGIONAL_TLDS, []),
    "PASS_C": ("dictionary tld-swap addition replacement".split(), COMMON_TLDS, RISK_WORDS),
}


def _at(c: Column, start: int, to) -> Column:
    """For each position i of `c` from `start`: to(text before i, character i, text behind)."""
    n = F.length(c)
    positions = F.when(n >= start, F.sequence(F.lit(start), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: to(F.left(c, i - 1), F.substr(c, i, F.lit(1)), F.substr(c, i + 1)))


def _swaps(c: Column, table: dict[str, str], keep: bool = False) -> Column:
    """Each character exchanged for each of its `table` entries, or preceded by it."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), strings(list(v)))])
    return F.flatten(_at(c, 1, lambda a, x, b: F.transform(F.coalesce(F.try_element_at(pairs, x), F.array().cast("array<string>")), lambda y: F.concat(a, y, x, b) if keep else F.concat(a, y, b))))


def families(label: Column, tld: Column, tlds: list[str], words: list[str]) -> dict[str, Column]:
    """Family -> array of host names that differ from label.tld by one step."""
    host = lambda names: F.transform(names, lambda x: F.concat(x, F.lit("."), tld))
    squat = {x: "".join(chr(ord(x) ^ 1 << b) for b in range(7) if chr(ord(x) ^ 1 << b) in LETTERS + "-") for x in LETTERS}
    letters = strings(list(LETTERS))
    return {
        "addition": host(F.transform(letters, lambda x: F.concat(label, x))),
        "bitsquatting": host(_swaps(label, squat)),
        "homoglyph": host(_swaps(label, HOMOGLYPHS)),
        "hyphenation": host(_at(label, 2, lambda a, x, b: F.concat(a, F.lit("-"), x, b))),
        "insertion": host(_swaps(label, NEIGHBOURS, keep=True)),
        "omission": host(_at(label, 1, lambda a, x, b: F.concat(a, b))),
        "repetition": host(_at(label, 1, lambda a, x, b: F.concat(a, x, x, b))),
        "replacement": host(_swaps(label, NEIGHBOURS)),
        "subdomain": host(_at(label, 2, lambda a, x, b: F.concat(a, F.lit("."), x, b))),
        "transposition": host(_at(label, 2, lambda a, x, b: F.concat(F.left(a, F.length(a) - 1), x, F.right(a, F.lit(1)), b))),
        "vowel-swap": host(_swaps(label, {v: VOWELS for v in VOWELS})),
        "dictionary": host(F.flatten(F.transform(strings(words), lambda w: F.array(F.concat(label, F.lit("-"), w), F.concat(label, w), F.concat(w, F.lit("-"), label), F.concat(w, label))))),
        "tld-swap": F.transform(strings(tlds), lambda t: F.concat(label, F.lit("."), t)),
    }


def _named(family: str, hosts: Column) -> Column:
    return F.transform(hosts, lambda v: F.struct(F.lit(family).alias("fuzzer"), v.alias("fqdn")))


def generate(seeds: DataFrame, passes: dict[str, tuple[list[str], list[str], list[str]]] = PASSES) -> DataFrame:
    """(seed, fqdn, fuzzer, pass) of all passes; a variant equal to its seed is left out.

    seeds: label, tld. passes: name -> (families, tlds, words). A variant may
    come from several families and passes; `first_pass` keeps one.
    """
    made = None
    for name, (wanted, tlds, words) in passes.items():
        all_ = families(F.col("label"), F.col("tld"), tlds, words)
        rows = seeds.select(
            F.concat("label", F.lit("."), "tld").alias("seed"),
            F.explode(F.concat(*[_named(k, all_[k]) for k in wanted])).alias("v"),
        ).select("seed", F.col("v.fqdn").alias("fqdn"), F.col("v.fuzzer").alias("fuzzer"), F.lit(name).alias("pass"))
        made = rows if made is None else made.unionByName(rows)
    return made.where((F.col("fqdn") != F.col("seed")) & ~F.col("fqdn").rlike(r"(^|\.)-|-(\.|$)|\.\.|^\.")).distinct()


def first_pass(variants: DataFrame) -> DataFrame:
    """One row per (seed, fqdn): the record of the earliest pass, with the reasons of all."""
    return variants.groupBy("seed", "fqdn").agg(
        F.min(F.struct("pass", "fuzzer")).alias("m"), F.array_sort(F.collect_set("pass")).alias("reasons")
    ).select("seed", "fqdn", F.col("m.fuzzer").alias("fuzzer"), F.col("m.pass").alias("pass"), "reasons")


def with_seeds(variants: DataFrame, seeds: DataFrame) -> DataFrame:
    """Variants and the seeds themselves, marked is_original_seed."""
    own = seeds.select(F.concat("label", F.lit("."), "tld").alias("seed")).select("seed", F.col("seed").alias("fqdn"), F.lit(True).alias("is_original_seed")).distinct()
    return variants.select("seed", "fqdn", F.lit(False).alias("is_original_seed")).unionByName(own)


def seed_stats(split: DataFrame) -> DataFrame:
    """Registered and unregistered variants of each seed, distinct over passes; `rows` counts repeats too."""
    return split.groupBy("seed").agg(
        F.count_distinct(F.when(F.col("registered"), F.col("fqdn"))).alias("registered"),
        F.count_distinct(F.when(~F.col("registered"), F.col("fqdn"))).alias("unregistered"),
        F.count("*").alias("rows"),
    )
