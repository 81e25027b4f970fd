"""Chains of pages against the sorted table, with inserts between pages."""

import random

from decoyscope.operators import pages

SCHEMA = "ts long, id long, x string"


def test_a_chain_of_pages_is_the_sorted_table(spark, tmp_path):
    rng = random.Random(2)
    at = f"file://{tmp_path}/kept"
    first = [(rng.randrange(60), i, "a") for i in range(300)]
    pages.insert(at, spark.createDataFrame(first + [(None, 1, "n"), (5, None, "n")], SCHEMA), "ts", "id", 0, 8)
    second = [(rng.randrange(40), 1000 + i, "b") for i in range(60)]
    cursor, seen, wanted = None, [], sorted(first, reverse=True)
    for k in range(30):
        got = [tuple(r) for r in pages.page(spark, at, "ts", "id", 25, cursor).collect()]
        assert got == wanted[:25]
        if not got:
            break
        seen += got
        cursor = got[-1][:2]
        wanted = wanted[25:]
        if k == 3:  # rows that come later; those newer than the cursor are on no later page
            pages.insert(at, spark.createDataFrame(second, SCHEMA), "ts", "id", 1, 3)
            wanted = sorted(wanted + [r for r in second if r[:2] < cursor], reverse=True)
        if k == 5:  # a run that comes again changes nothing
            pages.insert(at, spark.createDataFrame(second, SCHEMA), "ts", "id", 1, 3)
    assert len(seen) == len(set(seen)) > 300 and seen == sorted(seen, reverse=True)
    assert [tuple(r) for r in pages.page(spark, at, "ts", "id", 10).collect()] == sorted(first + second, reverse=True)[:10]


def test_a_page_reads_few_files(spark, tmp_path):
    at = f"file://{tmp_path}/kept"
    pages.insert(at, spark.createDataFrame([(i, i, "x") for i in range(1000)], SCHEMA), "ts", "id", 0, 20)
    assert len(pages.files_of(spark, at, 10, None)) == 1
    assert 1 <= len(pages.files_of(spark, at, 10, (500, 500))) <= 3
    assert pages.files_of(spark, at, 10, (0, 0)) == [] and pages.page(spark, at, "ts", "id", 10, (0, 0)).collect() == []
