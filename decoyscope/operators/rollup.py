"""Counters, progress and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_metrics(rows: DataFrame, host: str, reasons: str, emitted: Column) -> DataFrame:
    """One row: messages, emitted, distinct hosts, and the top 5 reasons with counts."""
    totals = rows.agg(F.count("*").alias("messages"), F.count_if(emitted).alias("emitted"), F.count_distinct(host).alias("unique_hosts"))
    top = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").count().orderBy(F.desc("count"), "reason").limit(5)
    packed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "reason"))).alias("t"))  # 5 rows
    return totals.crossJoin(F.broadcast(packed.select(F.array_join(F.transform("t", lambda x: F.concat(x["reason"], F.lit("="), (-x["n"]).cast("string"))), ",").alias("top_reasons"))))


def progress(events: DataFrame, totals: DataFrame, seed: str = "seed", url: str = "url", status: str = "status") -> DataFrame:
    """Per seed: distinct crawled and failed urls, total, pending, percentage, state.

    A seed without a total (direct flow) has one url to do.
    """
    once = events.where(F.col(status).isin("ok", "failed")).select(seed, url, status).distinct()
    counted = once.groupBy(seed).agg(F.count_if(F.col(status) == "ok").alias("crawled"), F.count_if(F.col(status) == "failed").alias("failed"))
    df = totals.select(seed, "total").join(counted, seed, "full_outer").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("crawled", "failed")} | {"total": F.coalesce("total", F.lit(1))})
    done = F.col("crawled") + F.col("failed")
    return df.withColumns({
        "pending": F.greatest(F.col("total") - done, F.lit(0)),
        "percentage": F.round(100.0 * F.col("crawled") / F.col("total"), 2),
        "state": F.when(done >= F.col("total"), "completed").otherwise("processing"),
    })


def probe_counters(events: DataFrame, seed: str, ok: Column) -> DataFrame:
    return events.groupBy(seed).agg(F.count_if(ok).alias("crawled"), F.count_if(~ok).alias("failed"))


def recent_sums(rows: DataFrame, order: list, n: int, columns: list[str]) -> DataFrame:
    """Sums over the `n` latest rows."""
    return rows.orderBy(*order).limit(n).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in columns])


def counts_by(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def image_rollup(images: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page: counts, bytes, mean sizes over positive values, first and last time, majority quality.

    Quality is the majority of good and poor images; a tie is `mixed`, none is `unknown`.
    """
    pos = lambda c: F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 2)
    good, poor = F.count_if(F.col("quality") == "high"), F.count_if(F.col("quality") == "low")
    return images.groupBy(page).agg(
        F.count("*").alias("images"), F.count_if("accessible").alias("accessible"), F.sum("size_bytes").alias("total_bytes"),
        pos("width").alias("avg_width"), pos("height").alias("avg_height"), pos("sharpness").alias("avg_sharpness"),
        F.min("taken_at").alias("first_taken"), F.max("taken_at").alias("last_taken"),
        F.when(good > poor, "high").when(poor > good, "low").when(good + poor > 0, "mixed").otherwise("unknown").alias("quality"),
    )


def image_text_rollup(images: DataFrame, brands: list[str], urgent: list[str], page: str = "page_id") -> DataFrame:
    from decoyscope.functions.text import any_in

    t = F.lower(F.col("text"))
    return images.groupBy(page).agg(
        F.count_if(F.length("text") > 0).alias("with_text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_length"),
        F.count_if(any_in(t, brands)).alias("brand_images"), F.count_if(any_in(t, urgent)).alias("urgent_images"))


#: Keys that several rows have are sent to all tasks up to this number of them.
BROADCAST_KEYS = 100_000


def top_words(docs: DataFrame, key: str, text: str, stop: list[str], n: int = 20) -> DataFrame:
    """(key, word, count, rank) of the `n` most frequent words of 3 letters or more; ties by first appearance.

    A row whose key no other row has is counted by itself, and nothing of it
    is shuffled but its key; rows that share a key are counted together.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?=[a-z])(?<![\p{L}\p{N}_])([a-z]{3,}+)(?![\p{L}\p{N}_])"), F.lit(1))
    rows = docs.select(F.col(key), words.alias("words"))
    several = docs.groupBy(F.col(key).alias("_k")).count().where("count > 1").select("_k")
    many = several.count()
    if not many:
        best = _counted_alone(rows, key, stop, n)
    else:
        several = F.broadcast(several) if many <= BROADCAST_KEYS else several
        shared = lambda how: rows.join(several, F.col(key).eqNullSafe(F.col("_k")), how)
        best = _counted_alone(shared("left_anti"), key, stop, n).unionByName(_counted_together(shared("left_semi"), key, stop, n))
    return best.select(key, F.posexplode("xs").alias("rank", "x")).select(key, "x.word", (-F.col("x.n")).alias("count"), (F.col("rank") + 1).alias("rank"))


def _counted_alone(rows: DataFrame, key: str, stop: list[str], n: int) -> DataFrame:
    """(key, xs) of each row: its sorted words lie in runs of equal ones, whose lengths are counts; its distinct words are in order of appearance."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array("words"), " "), F.lit(r"([a-z]+)(?: \1(?![a-z]))*+"), F.lit(0))
    placed = F.sort_array(F.transform(F.array_distinct("words"), lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    times = lambda w, run: ((F.length(run) + 1) / (F.length(w) + 1)).cast("long")
    each = F.zip_with(placed, runs, lambda w, run: F.struct((-times(w["word"], run)).alias("n"), w["at"].alias("at"), w["word"].alias("word")))
    return rows.select(key, F.slice(F.sort_array(F.filter(each, lambda x: ~x["word"].isin(stop))), 1, n).alias("xs"))


def _counted_together(rows: DataFrame, key: str, stop: list[str], n: int) -> DataFrame:
    """(key, xs) over all rows of a key; words are counted per row before they are shuffled."""
    each = rows.select(key, F.posexplode("words").alias("at", "word")).where(~F.col("word").isin(stop))
    counted = each.groupBy(key, "word").agg(F.count("*").alias("count"), F.min("at").alias("at"))
    return counted.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "at", "word"))), 1, n).alias("xs"))


def dashboard(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("scans"), F.count_if(F.col("verdict") == "phishing").alias("phishing"),
        F.count_distinct("cse_id").alias("brands"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def lookalike_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("lookalikes"), F.count_if(F.size(F.coalesce("mx", F.array().cast("array<string>"))) > 0).alias("with_mx"),
        F.count_if(F.col("verdict") != "parked").alias("active"), F.count_if(F.col("verdict") == "parked").alias("parked"))


def verdict_series(rows: DataFrame, ts: str, verdict: str, names: list[str]) -> DataFrame:
    """A row per day and a column per verdict."""
    day = F.date_trunc("day", F.col(ts)).cast("date")
    return rows.groupBy(day.alias("day")).agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in names])


def geo_counts(rows: DataFrame, country: str, city: str) -> DataFrame:
    """Counts per country and per city in one pass; city is null in country rows."""
    return rows.groupingSets([[country], [country, city]], country, city).agg(F.grouping(city).alias("whole"), F.count("*").alias("n"))


def risk_matrix(rows: DataFrame, sector: str, score: str) -> DataFrame:
    """Sector by risk band: below 40, below 70, from 70."""
    s = F.col(score)
    return rows.groupBy(sector).agg(F.count_if(s < 40).alias("low"), F.count_if((s >= 40) & (s < 70)).alias("medium"), F.count_if(s >= 70).alias("high"))


def category_shares(rows: DataFrame, category: str, member: str) -> DataFrame:
    """(category, n, share, member, member_n): percentage of each category, and a row for each of its members; all rows count, null members in n alone."""
    pairs = rows.groupBy(category, member).agg(F.count("*").alias("member_n"))
    per = pairs.groupBy(category).agg(F.sum("member_n").alias("n"))
    total = rows.agg(F.count("*").alias("_total"))  # one row
    shares = per.crossJoin(F.broadcast(total)).select(F.col(category).alias("_c"), "n", F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("share"))
    named = pairs.where(F.col(member).isNotNull()).select(F.col(category).alias("_o"), member, "member_n")
    return shares.join(named, F.col("_c").eqNullSafe(F.col("_o")), "left").select(F.col("_c").alias(category), "n", "share", member, "member_n")


def parked_insights(rows: DataFrame, domain: str, ts: str, verdict: str, tie: str) -> DataFrame:
    return rows.groupBy(domain).agg(
        F.min(F.when(F.col(verdict) == "parked", F.col(ts))).alias("first_parked"),
        F.max_by(verdict, F.struct(ts, tie)).alias("last_verdict"))


#: Relative ranges of the dashboards and their minutes.
RANGES = {"5m": 5, "30m": 30, "1h": 60, "24h": 1440}


def in_range(ts: Column, as_of: Column, name: str) -> Column:
    """Whether `ts` lies in the range `name` (5m, 30m, 1h, 24h) that ends with `as_of`."""
    return (ts > as_of - F.make_dt_interval(mins=F.lit(RANGES[name]))) & (ts <= as_of)


def range_counts(rows: DataFrame, ts: str, as_of: Column) -> DataFrame:
    """(range, n): rows in each relative range, counted in one pass."""
    counts = F.array(*[F.struct(F.lit(k).alias("range"), F.count_if(in_range(F.col(ts), as_of, k)).alias("n")) for k in RANGES])
    return rows.agg(counts.alias("xs")).select(F.explode("xs").alias("x")).select("x.*")
