"""Search by the index against the scan."""

import pytest
from pyspark.sql import functions as F

from decoyscope.operators import search, trigrams

TEXTS = ["Hello World", "hell", "ΣΑΣ Όμηρος", "ñandú ÑANDÚ", "😀 smile 😀😀", "aaaa", "abab", None, "", "x", "İstanbul", "тест Тест", "日本語テキスト", "new\nline", "100% of_it"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('index')}"
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(100 + i, f"filler number {i}", "c") for i in range(200)], "id long, t string, run string")
    trigrams.build(at, rows, "id", "t")
    return at, rows


@pytest.mark.parametrize("needle", ["hell", "HELL", "lo wo", "he", "σα", "Ñand", "😀😀", "aaa", "aba", "x", "", "тес", "本語", "語テキ", "w\nl", "% o", "_i", "zz", "number 17", "absent text", "filler"])
def test_equals_the_scan(spark, index, needle):
    at, rows = index
    want = sorted(r.id for r in rows.where(search.like(F.col("t"), needle)).collect())
    assert sorted(r.id for r in trigrams.find(spark, at, "id", "t", needle).collect()) == want
    some = trigrams.candidates(spark, at, needle)
    assert some is None or set(want) <= {r.id for r in some.collect()}


def test_few_rows_are_read(spark, index):
    at, _ = index
    assert trigrams.candidates(spark, at, "number 17").count() <= 40 and trigrams.candidates(spark, at, "hell").count() == 2 and trigrams.candidates(spark, at, "qqq").count() == 0


def test_no_rows(spark, tmp_path):
    at = f"file://{tmp_path}"
    trigrams.build(at, spark.createDataFrame([], "id long, t string"), "id", "t")
    assert trigrams.find(spark, at, "id", "t", "abc").collect() == []
