import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.errors import DatasetError
from reviewlake.functions import dates, numeric
from reviewlake.operators import (
    businesses, evaluation, filters, profile, quality, quantiles, reviews, sales, sampling, silver, users, weekly,
)


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    data = [("hot", rng.choice([1.0, 2.5, rng.random() * 1e6])) for _ in range(30_000)]
    data += [("cold", float(k)) for k in range(7)] + [("hot", None), ("one", 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    got = {
        r["g"]: r for r in quantiles.exact_quantiles(
            df, "v", {"p1": (0.01, "linear"), "med": (0.5, "linear"), "p99": (0.99, "linear"), "near": (0.9, "nearest")},
            by=["g"], moments={"n": F.count},
        ).collect()
    }
    for g in ("hot", "cold", "one"):
        values = np.sort([v for k, v in data if k == g and v is not None])
        for name, q in (("p1", 0.01), ("med", 0.5), ("p99", 0.99)):
            assert math.isclose(got[g][name], np.quantile(values, q), rel_tol=1e-12)
        assert got[g]["near"] == values[int((len(values) - 1) * 0.9 + 0.5)]
        assert got[g]["n"] == len(values)


def test_quantiles_without_groups(spark):
    df = spark.range(20_001).select((F.col("id") * 1.0).alias("v"))
    row = quantiles.exact_quantiles(df, "v", {"m": (0.5, "linear"), "q": (0.25, "linear")}).first()
    assert (row["m"], row["q"]) == (10_000.0, 5_000.0)


def test_stratified_split_and_folds(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 100, "b").otherwise("c").alias("label"))
    totals = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    for r in sampling.stratified_split(df, "id", "label").where("is_test").groupBy("label").count().collect():
        assert abs(r["count"] - 0.2 * totals[r["label"]]) <= 1
    for r in sampling.stratified_folds(df, "id", "label").groupBy("label", "fold").count().collect():
        assert abs(r["count"] - totals[r["label"]] / 5) < 2  # both ends of a fold are rounded to a row


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    one = [r[0] for r in sampling.sample_rows(df.repartition(1), "id", 5).collect()]
    assert one == [r[0] for r in sampling.sample_rows(df.repartition(7), "id", 5).collect()]


def test_weeks(spark):
    df = spark.createDataFrame([(datetime(2018, 12, 30, 23, 59, 59),), (datetime(2018, 12, 31),)], "t timestamp_ntz")
    rows = df.select(dates.week_ending_sunday(F.col("t")), dates.iso_weekday(F.col("t")), F.weekofyear("t")).collect()
    assert [tuple(r) for r in rows] == [(date(2018, 12, 30), 7, 52), (date(2019, 1, 6), 1, 1)]


def test_lenient_dates(spark):
    df = spark.createDataFrame([("2020-02-30 00:00:00",), ("2020-02-28 01:02:03",), ("2020-02-28",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.parse_datetime(F.col("t"))).collect()] == [None, datetime(2020, 2, 28, 1, 2, 3), None, None]


def test_pearson_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.1, 5.0), (None, 9.0, 5.0)], "x double, y double, c double")
    row = df.agg(numeric.pearson(F.col("x"), F.col("y")), numeric.pearson(F.col("x"), F.col("c"))).first()
    assert row[0] == round(np.corrcoef([1, 2, 3], [2, 4, 6.1])[0, 1], 4) and row[1] == 0.0


@pytest.mark.parametrize("r, p", [(0.28388281430894036, 0.0026517609949631947), (0.8385603780515952, 2.9743421980000474e-30), (0.327712459918746, 0.0005358159083315313)])
def test_p_values(r, p):
    n = 108 if p == 0.0005358159083315313 else 110
    assert math.isclose(weekly.two_sided_p(r, n), p, rel_tol=1e-6)


def test_star_distribution(spark):
    df = spark.createDataFrame([(s,) for s in [1, 2, 3, 4, 5, 5, 5, 4, 4, 3]], "stars int")
    rows = {r["star"]: r for r in reviews.star_distribution(df).collect()}
    assert {k: r["count"] for k, r in rows.items()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    top = rows[1]
    assert (top["total"], top["mean"], top["std"], top["pct_positive"], top["pct_negative"], top["is_imbalanced"]) == (10, 3.6, 1.28, 60.0, 20.0, False)


def test_users(spark):
    base = {"user_id": "u", "name": "n", "review_count": 1, "yelping_since": "2010", "useful": 1, "funny": 2, "cool": 3, "fans": 1, "average_stars": 3.0}
    comp = {f"compliment_{c}": 1 for c in ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")}
    rows = [{**base, **comp, "friends": f, "elite": e} for f, e in (("None", ""), (" a , b,c ", "2010,2011,20"), ("", None))]
    got = silver.silver_users(spark.createDataFrame(rows)).select("friends_count", "elite_years_count", "is_elite", "total_votes_given", "total_compliments").collect()
    assert [tuple(r) for r in got] == [(0, 0, False, 6, 11), (3, 2, True, 6, 11), (0, 0, False, 6, 11)]


def test_capped_influence(spark):
    cols = "fans int, total_compliments int, review_count int, friends_count int, is_elite boolean"
    df = spark.createDataFrame([(10000, 10000, 5000, 5000, True), (0, 0, 0, 0, False), (10, 0, 0, 0, True), (10, 0, 0, 0, False)], cols)
    got = [r["influence_score"] for r in users.user_influence_capped(df).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] > got[3]


def test_undated_mapping(spark):
    df = spark.createDataFrame([("r", 3, " a  b ", "toys")], "review_id string, stars int, Review_Body string, product_category string")
    row = silver.silver_undated_reviews(df).first()
    assert (row["text"], row["text_length"], row["word_count"], row["category"], row["language"]) == ("a  b", 6, 5, "toys", "es")


def test_order_review_text(spark):
    df = spark.createDataFrame(
        [("1", "o", 3, "t", None), ("2", "o", 5, None, "m"), ("3", "o", 1, "t", ""), ("4", "o", 1, None, None)],
        "review_id string, order_id string, review_score int, review_comment_title string, review_comment_message string",
    ).withColumns({"review_creation_date": F.lit("x"), "review_answer_timestamp": F.lit("x")})
    got = [(r["text"], r["has_comment"]) for r in silver.silver_order_reviews(df).orderBy("review_id").collect()]
    assert got == [("t", False), ("m", True), ("t", False), (None, False)]


def test_fan_out_without_pairs(spark):
    """Scores per product equal the plain join, with a hot order holding many reviews and items."""
    rng = random.Random(1)
    orv = spark.createDataFrame([(rng.choice([0, 0, 0, k]), rng.randint(1, 5)) for k in range(60)], "order_id int, review_score int")
    items = spark.createDataFrame([(rng.choice([0, 0, k]), k % 5) for k in range(50)], "order_id int, product_id int")
    orders = spark.range(60).select(F.col("id").cast("int").alias("order_id"))
    plain = orv.join(orders, "order_id").join(items, "order_id", "left").groupBy("product_id").agg(F.sum("review_score"), F.count("review_score"))
    got = sales.product_review_scores(orv, orders, items)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_weekly_series_calendar(spark):
    orders = spark.createDataFrame(
        [("a", datetime(2020, 1, 6), 10.0, 1, "x"), ("b", datetime(2020, 1, 27), 5.0, 2, "x"), ("c", datetime(2020, 1, 20), 1.0, 1, "y")],
        "order_id string, purchase_date timestamp_ntz, order_total double, item_count int, state string",
    )
    rv = spark.createDataFrame(
        [("r", "2020-01-15 00:00:00", 4, "x"), ("s", "bad", 1, "x"), ("t", "2020-01-16 00:00:00", 2, "y")],
        "review_id string, review_answer_timestamp string, review_score int, state string",
    )
    rows = weekly.weekly_series(orders, rv).orderBy("week").collect()
    assert [r["week"].day for r in rows] == [12, 19, 26, 2]
    assert [r["order_count"] for r in rows] == [1, 0, 1, 1] and [r["review_count"] for r in rows] == [0, 2, 0, 0]
    assert [r["avg_review_score"] for r in rows] == [3.0] * 4
    grouped = weekly.weekly_series(orders, rv, ["state"]).collect()
    assert len(grouped) == 8 and len({(r["state"], r["week"]) for r in grouped}) == 8


def test_filters(spark):
    df = spark.createDataFrame([(1, 5, date(2020, 1, 1), "a, b"), (2, 3, date(2020, 2, 1), "c"), (3, 1, None, None)], "business_id int, stars int, date date, categories string")
    spec = lambda **k: [r["business_id"] for r in filters.apply_filters(df, filters.FilterSpec(**k)).orderBy("business_id").collect()]
    assert spec(date_start="2020-01-15") == [2] and spec(categories=("b",)) == [1] and spec(exclude_categories=("a",)) == [2, 3]
    assert spec(min_stars=3, limit=1) == [1] and spec(entity_ids=(2, 3)) == [2, 3]
    for bad in ({"date_start": "01/02/2020"}, {"min_stars": 0}, {"limit": 0}):
        with pytest.raises(ValueError):
            filters.FilterSpec(**bad)
    with pytest.raises(DatasetError):
        filters.apply_filters(df, filters.FilterSpec(language="en"))


def test_top_entities_and_errors(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("b", 1)], "user_id string, stars int")
    assert [r["user_id"] for r in reviews.top_entities(df, "user_id", n=1).collect()] == ["b"]
    assert [r["user_id"] for r in reviews.top_entities(df, "user_id", "avg_stars", ascending=True).collect()] == ["b", "a"]
    for call in (lambda: reviews.top_entities(df, "user_id", "total_revenue"), lambda: reviews.top_entities(df, "nope"), lambda: reviews.column_distribution(df, "nope")):
        with pytest.raises(DatasetError):
            call()


def test_length_bins(spark):
    df = spark.createDataFrame([(n, 3, True) for n in (0, 1, 50, 51, 5000, 5001)], "text_length int, stars int, is_ambiguous boolean")
    got = {r["length_bin"]: r["count"] for r in reviews.by_text_length(df).collect()}
    assert got == {"<=0": 1, "0-50": 2, "50-200": 1, "1000-5000": 1, ">5000": 1}


def test_classification_metrics(spark):
    truth = ["a", "a", "a", "b", "b", "c"]
    guess = ["a", "b", "a", "b", "b", "a"]
    df = spark.createDataFrame(list(zip(truth, guess)), "label string, prediction string")
    m = evaluation.classification_metrics(evaluation.confusion(df)).first()
    assert m["accuracy"] == round(4 / 6, 4)
    assert m["precision"] == round((3 * 2 / 3 + 2 * 2 / 3 + 0) / 6, 4)
    assert m["recall"] == round(4 / 6, 4)


def test_range_checks_see_every_row(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 999, 7).otherwise(3).alias("stars"), F.lit("meh").alias("sentiment_label"))
    got = {r["check_name"]: r["violations"] for r in quality.range_checks(df, ("stars", "x")).collect()}
    assert got == {"has_data": 0, "range:stars": 1, "domain:sentiment_label": 1000, "required:stars": 0, "required:x": 1}


def test_profile_and_samples(spark):
    df = spark.createDataFrame([(1, "x"), (3, None)], "n int, s string")
    rows = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert (rows["n"]["mean"], rows["s"]["null_count"], rows["s"]["null_pct"]) == (2.0, 1, 50.0)
    samples = {r["column_name"]: set(r["sample_values"]) for r in profile.sample_values(df).collect()}
    assert samples["s"] == {"x"} and samples["n"] <= {"1", "3"}
    assert profile.date_range(df) is None


def test_category_counts(spark):
    df = spark.createDataFrame([("a, b",), ("b",), ("",), (None,)], "categories string")
    assert [tuple(r) for r in businesses.category_counts(df).collect()] == [("b", 2), ("a", 1)]


def test_quantiles_keep_groups_without_values(spark):
    from reviewlake.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, v double")
    rows = {r["g"]: r["m"] for r in exact_quantiles(df, "v", {"m": (0.5, "linear")}, by=["g"]).collect()}
    assert rows == {"a": 2.0, "b": None, None: 5.0}


def test_large_groups_take_the_sketch_path(spark, monkeypatch):
    from reviewlake.operators import quantiles

    df = spark.range(60_000).selectExpr("id % 2 AS g", "cast((id * 7919) % 60013 AS double) AS v")
    wanted = {"m": (0.5, "linear"), "p": (0.9, "nearest")}
    fast = sorted(map(tuple, quantiles.exact_quantiles(df, "v", wanted, by=["g"]).collect()))
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 1 << 40)
    assert fast == sorted(map(tuple, quantiles.exact_quantiles(df, "v", wanted, by=["g"]).collect()))


def test_splits_do_not_shuffle_on_the_label(spark):
    from reviewlake.operators.sampling import stratified_split

    df = spark.range(1000).selectExpr("id", "id % 3 AS label")
    plan = stratified_split(df, "id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_first_rows_keep_the_smallest_keys(spark):
    from reviewlake.operators.sampling import first_rows

    df = spark.range(100).repartition(4)
    assert sorted(r[0] for r in first_rows(df, "id", 7).collect()) == list(range(7))
    assert first_rows(df, "id", 1000).count() == first_rows(df, "id", None).count() == 100


def test_influence_with_a_zero_maximum(spark):
    from reviewlake.operators.users import user_influence

    df = spark.createDataFrame([(1, 4, 0, 0, True), (2, 8, 0, 0, False)], "user_id int, review_count int, fans int, useful int, is_elite boolean")
    assert all(r["influence_score"] is not None for r in user_influence(df).collect())


def test_brackets_are_narrowed_until_few_values_are_ranked(spark, monkeypatch):
    """Ten million different values and long runs of one value: exact, and no task ranks more than a bounded number."""
    monkeypatch.setattr(quantiles, "MOST_RANKED", 500)
    n = 10_000_000
    df = spark.range(n).selectExpr("cast((id * 7919) % 10000019 AS double) / 3 AS v")
    values = np.sort((np.arange(n, dtype=np.int64) * 7919) % 10000019) / 3
    wanted = {"low": (0.01, "linear"), "mid": (0.5, "linear"), "high": (0.987, "nearest"), "least": (0.0, "linear"), "most": (1.0, "nearest")}
    found = quantiles.exact_quantiles(df, "v", wanted)
    row = found.first()
    for name, (q, how) in wanted.items():
        assert math.isclose(row[name], np.quantile(values, q, method=how), rel_tol=1e-12), name
    tied = spark.range(400_000).selectExpr("id % 2 AS g", "CASE WHEN id % 10 < 4 THEN 5.0 WHEN id % 10 < 8 THEN 7.0 ELSE id * 1e-5 + 4.0 END AS v")
    rows = {r["g"]: r for r in quantiles.exact_quantiles(tied, "v", wanted, by=["g"]).collect()}
    every = tied.toPandas()
    for g in (0, 1):
        own = every["v"][every["g"] == g].to_numpy()
        for name in ("low", "mid", "high"):
            q, how = wanted[name]
            expected = np.quantile(own, q) if how == "linear" else np.sort(own)[int((len(own) - 1) * q + 0.5)]
            assert math.isclose(rows[g][name], expected, rel_tol=1e-12), (g, name)


def test_the_last_step_ranks_few_rows(spark, monkeypatch):
    from reviewlake.operators.quantiles import _narrow

    monkeypatch.setattr(quantiles, "MOST_RANKED", 2_000)
    data = spark.range(5_000_000).selectExpr("id AS _v", "cast(id AS double) AS _d")
    from pyspark.sql import Row

    start = [Row(_n=5_000_000, _edges=[[0.0, 5e6], [2e6, 3e6]])]
    (row,) = _narrow(data, [], start, {"a": (0.3, "linear"), "b": (0.5, "nearest")})
    for (low, high), rank in zip(row["_edges"], (1_500_000 - 0.5, 2_500_000), strict=True):
        assert low <= rank <= high and data.where((F.col("_d") > low) & (F.col("_d") < high)).count() <= 2_000


@pytest.mark.parametrize("kind", ["id", "concat('k', id % 70000)", "date_add(date'1970-01-01', cast(id % 30000 as int))", "if(id % 3 = 0, null, id % 1000)", "struct(id % 50, id)"])
def test_half_of_a_large_table(spark, monkeypatch, kind):
    monkeypatch.setattr(sampling, "MOST_SORTED", 1_000)
    monkeypatch.setattr(sampling, "SAMPLED", 500)
    df = spark.range(200_000).selectExpr(f"{kind} AS k", "id").repartition(6)
    ordered = df.orderBy(F.asc_nulls_first("k")).select("k")
    for n in (1_500, 100_000, 199_999, 200_000, 300_000):
        last = ordered.limit(n).agg(F.max("k")).first()[0]
        expected = df.where(F.col("k").isNull() | (F.col("k") <= F.lit(last) if not isinstance(last, tuple) else F.col("id") < 0)) if not isinstance(last, tuple) else None
        found = sampling.first_rows(df, "k", n)
        if expected is not None:
            assert found.count() == expected.count()
        else:
            assert found.count() == min(n, 200_000)


def test_order_statistic_edges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_SORTED", 100)
    monkeypatch.setattr(sampling, "SAMPLED", 50)
    df = spark.createDataFrame([(None,), *[("same",)] * 3000, ("a",), ("z",)], "k string")
    got = [sampling.order_statistic(df, "k", r).first()["key"] for r in (0, 1, 1500, 3000, 3001)]
    assert got == ["a", "same", "same", "same", "z"]
    assert sampling.order_statistic(df, "k", 3002) is None and sampling.order_statistic(df.limit(0), "k", 0) is None
