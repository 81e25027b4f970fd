"""Each stage of the pipeline on planted cases, with extra columns, nulls and repeats."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from decoyscope.llm import common, packing, tokens, toxicity
from tests.llm.test_corpus import brute_components, brute_fingerprint, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __x string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        t = words(rng, rng.randrange(30, 90)).split()
        if i % 5 == 0:
            t[3] = t[-1] = rng.choice(["vile", "rotten"])
        lines = [" ".join(t[: len(t) // 2]), " ".join(t[len(t) // 2 :])]
        if i % 4 == 0:
            lines.insert(rng.randrange(3), "Subscribe to our letter.")
        rows.append((i, "\n".join(lines), "en", f"s{i % 15}", len("\n".join(lines)), 0.5, "x"))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(400 + k, clean[k][1], *clean[k][2:]) for k in range(6)]  # exact copies
    items = [(k, words(rng, 25)) for k in range(5)]
    rows += [(500 + k, words(rng, 40) + " " + t + " " + words(rng, 40), "en", "s1", 9, 0.1, "x") for k, t in items]
    rows += [(600, None, None, None, None, None, None), (601, "", "en", "s1", 0, 0.2, "x"), (None, "quite different words stand here", None, "s2", 3, 0.1, None), (None, "and others of another kind over there", None, "s2", 3, 0.1, None), rows[1]]
    rows += [(7, "a second text under an id that is taken", "en", "s3", 5, 0.3, "x")]
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, spark.read.parquet(f"{at}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns(spark, made):
    at, docs = made
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, at).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), at).count() == 0


def test_toxic_documents_go(spark, made):
    at, docs = made
    assert rows(P.drop_toxic(spark, docs, at)) == rows(docs.where("doc_id is null or doc_id >= 300 or doc_id % 5 > 0 or text like '%taken'"))


def test_boilerplate_goes(spark, made):
    at, docs = made
    want = Counter()
    for r in docs.collect():
        d = r.asDict()
        if "Subscribe to our letter." in (r.text or ""):
            d["text"] = "\n".join(x for x in r.text.split("\n") if x != "Subscribe to our letter.")
            d["n_chars"] = len(d["text"])
        want[tuple(d.values())] += 1
    assert rows(P.drop_lines(spark, docs, at)) == want


def without(rows, gone):
    return Counter((i, "\n".join(x for x in t.split("\n") if x not in gone)) for i, t, *_ in rows)


def test_blocks_of_boilerplate_go_and_copies_stay(spark):
    rng = random.Random(13)
    head, foot = ["Home of the news", "Menu and search"], ["Read more of this", "All rights are kept", "Imprint and contact"]
    made = lambda i, lines: (i, "\n".join(lines), "en", f"s{i % 14}", 1, 0.1, "x")
    body = lambda n: [words(rng, 15) for _ in range(n)]
    rows = [made(i, [*head, *body(4 + i % 3), *foot]) for i in range(60)]
    text = body(8)
    for i in range(60):  # near copies, a word changed in each
        lines = list(text)
        k = rng.randrange(8)
        lines[k] = lines[k].replace(lines[k].split()[i % 15], f"changed{i}")
        rows.append(made(100 + i, lines))
    got = P.drop_lines(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == without(rows, {*head, *foot})


def test_boilerplate_goes_beside_a_hot_group_of_copies(spark):
    rng = random.Random(14)
    rows = [(i, "\n".join([words(rng, 20), words(rng, 20), "The footer of all"]), "en", f"s{i % 20}", 1, 0.1, "x") for i in range(50)]
    rows += [(100 + i, rows[0][1], *rows[0][2:]) for i in range(150)]
    got = P.drop_lines(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == without(rows, {"The footer of all"})


def test_one_of_each_group_stays(spark, made):
    at, docs = made
    got = P.drop_near_duplicates(spark, docs, at).collect()
    kinds = brute_components({brute_fingerprint(r.text) for r in docs.collect()}, 2)
    least = {}
    for r in docs.collect():
        k = kinds[brute_fingerprint(r.text)]
        key = (r.doc_id is None, r.doc_id or 0)
        least[k] = min(key, least.get(k, key))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values())
    assert len({kinds[brute_fingerprint(r.text)] for r in got}) == len(got)


def test_no_rows_of_the_groups_go_through_the_driver(spark, made, monkeypatch):
    """Which rows go is sent as 8 bytes of each, not as a broadcast of rows; above a number of rows they are joined."""
    at, docs = made
    groups = docs.select("doc_id", P.near_sets.identity(F.col("text")).alias("body")).withColumn("root", F.xxhash64("body"))
    monkeypatch.setattr(P.simhash, "similar_groups", lambda docs: groups)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.drop_near_duplicates(spark, docs, at)
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = rows(got)
        assert sum(want.values()) == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
        monkeypatch.setattr(common, "HASHES", 0)
        assert rows(P.drop_near_duplicates(spark, docs, at)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_seed_is_taken_that_tells_rows_apart(spark):
    each = spark.createDataFrame([(i, b"%d" % i, int(i == 3)) for i in range(6)], "doc_id long, body binary, kind int")
    clash = lambda id_, body, seed: id_ % (seed + 2)  # noqa: E731  1, 3 and 5 are one hash at first, 0 and 3 then
    assert P._telling(each, clash) == 2 and P._telling(each) == 0


def test_near_copies_of_similarity_0_8_go(spark):
    rng = random.Random(15)
    texts = []
    for _ in range(15):
        w = words(rng, rng.randrange(60, 90)).split()
        texts.append(" ".join(w))
        for far in (len(w) // 2, len(w) // 3):
            texts.append(" ".join([*w[:far], "changed", *w[far + 1 :]]))
        texts.append(" ".join(w[: len(w) * 7 // 10]))  # too far
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = [root[i] if r == root[j] else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s1", 1, 0.1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = P.drop_near_duplicates(spark, docs, "")
    want = {min(i for i in range(len(texts)) if root[i] == r) for r in root}
    assert 20 < len(want) < 40 and {r.doc_id for r in got.collect()} == want


def test_contaminated_go(spark, made):
    at, docs = made
    assert rows(P.drop_contaminated(spark, docs, at)) == rows(docs.where("doc_id is null or doc_id not between 500 and 504"))


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, tmp_path):
    rng = random.Random(12)
    item = words(rng, 25)
    w = item.split()
    texts = [(None, words(rng, 30) + " " + item), (None, "a clean text"), (8, item), (8, words(rng, 30)), (None, " ".join(w[:14])), (None, " ".join(w[10:]))]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s1", 1, 0.1, "x") for i, t in texts], SCHEMA).repartition(2)
    got = P.drop_contaminated(spark, docs, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(texts[k] for k in (1, 3, 4, 5))


def test_run_is_the_stages_in_order(spark, made):
    at, docs = made
    got = P.run(spark, at)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, at).checkpoint()
    left = Counter(r.doc_id for r in docs.collect())
    assert left and set(r.doc_id for r in got.collect()) == set(left)
    assert got.agg(F.sum("length")).first()[0] == P.pack(spark, docs, at).agg(F.sum("length")).first()[0]


def test_stages_bear_columns_named_like_their_own(spark, made):
    """Columns called like helpers of the stages, null ids and repeated rows come through."""
    at, _ = made
    names = ["row", "gone", "left", "body", "n_removed", "h", "key", "root", "whole", "fp"]
    kinds = ", ".join(f"{n} string" for n in names)
    text = "one two three four five six seven eight nine ten"
    rows = [(i, t, "en", "s1", 1, *names) for i, t in [(1, text), (None, None), (None, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)]]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.dtypes == docs.dtypes
        assert name == "simhash" or Counter(map(tuple, got.collect())) == Counter(rows)
    assert P.pack(spark, docs, at).select("doc_id").distinct().count() == 4


def test_packing_gets_a_bounded_number_of_texts_at_a_time(spark, monkeypatch):
    def bounded(batches, rows):
        for pdf in batches:
            assert len(pdf) <= 1000
            yield pdf

    monkeypatch.setattr(packing, "in_batches", bounded)
    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    assert packing.pack(docs).agg(F.count("*"), F.countDistinct("doc_id")).first()[:] == (2500, 2500)


def test_a_worker_drops_what_other_stages_have_kept(monkeypatch):
    monkeypatch.setattr(common, "_AT_WORK", [""])
    common.begins("toxicity")
    toxicity.features("some words to keep")
    tokens.word_ids("word_bpe_49k.json").texts(["some words"])
    assert toxicity._words.at and tokens.word_ids.cache_info().currsize
    common.begins("toxicity")  # the same stage goes on with what it has
    assert toxicity._words.at
    common.begins("tokens")
    assert not toxicity._words.at and not len(toxicity._words.numbers)
    tokens.word_ids("word_bpe_49k.json")
    common.begins("near_sets")
    assert not tokens.word_ids.cache_info().currsize
