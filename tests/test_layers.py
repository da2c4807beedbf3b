"""Readers, builds, the named analyses, streaming and models on small written files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.errors import DatasetError, MissingTableError
from reviewlake.functions.vocabulary import ASPECT_KEYWORDS, DEFAULT_LEXICON, DEFAULT_TAXONOMY, POLARITY_WORDS
from reviewlake.operators import classify, forecast, weekly
from reviewlake.plans.service import ReviewLake
from reviewlake.sources import inventory, lexicons, readers, sinks
from reviewlake.streaming import ingest


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def review(k, **extra):
    return json.dumps({
        "review_id": f"r{k:03}", "user_id": f"u{k % 3}", "business_id": f"b{k % 2}", "stars": k % 5 + 1, "useful": 1, "funny": 0,
        "cool": 0, "text": "great product, fast delivery" if k % 5 > 2 else "terrible and slow service", "date": f"2020-01-{k % 28 + 1:02} 10:00:00", **extra,
    })


@pytest.fixture
def lake(spark, folder):
    write(f"{folder}/bronze/reviews/a.json", [review(k) for k in range(40)] + ["{broken"])
    write(f"{folder}/bronze/shop/orders.csv/a.csv", ["order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date"] + [
        f"o{k},c{k % 4},delivered,2020-{k // 8 + 1:02}-{k % 8 * 3 + 1:02} 08:00:00,,,2020-{k // 8 + 1:02}-{k % 8 * 3 + 3:02} 08:00:00," for k in range(64)])
    write(f"{folder}/bronze/shop/items.csv/a.csv", ["order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value"] + [
        f"o{k},1,p{k % 3},s,2020-01-01 00:00:00,{10 + k * 7 % 13}.5,1.25" for k in range(64)])
    write(f"{folder}/bronze/shop/reviews.csv/a.csv", ["review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp"] + [
        f'v{k},o{k},{k * 3 % 5 + 1},,"multi\nline, ""quoted"" bom",2020-01-01 00:00:00,2020-{k // 8 + 1:02}-{k % 8 * 3 + 4:02} 00:00:00' for k in range(64)])
    write(f"{folder}/bronze/shop/products.csv/a.csv", ["product_id,product_category_name,product_name_length,product_description_length,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm"] + [
        f"p{k},cat{k},1,1,1,1,1,1,1" for k in range(3)])
    write(f"{folder}/bronze/shop/categories.csv/a.csv", ["product_category_name,product_category_name_english"] + [f"cat{k},kind{k}" for k in range(3)])
    return ReviewLake(spark, folder)


def test_build_and_ask(lake):
    status = {r["dataset"]: r["status"] for r in lake.build_all_silver().collect()}
    assert status["reviews"] == "built" and status["orders"] == "built" and status["users"].startswith("error")
    assert lake.silver("order_reviews").where(F.col("text") == 'multi\nline, "quoted" bom').count() == 64
    out = lake.get_reviews_distribution("reviews")
    assert out["summary"].first()["positive_count"] == 16
    assert sum(r["count"] for r in out["distribution"].collect()) == 41  # the broken line stays visible as a null row
    assert lake.get_reviews_by_month("reviews", 2020).first()["review_count"] == 40
    assert lake.get_reviews_by_month("orders", materialize=True).count() == 8
    assert lake.get_sales_by_month()["summary"].first()["total_orders"] == 64
    assert lake.get_sales_by_category(2).count() == 2
    assert lake.get_sentiment_distribution("reviews").first()["positive"] == 16
    assert lake.get_aspect_distribution("reviews", "negative").first()["aspect"] == "service"
    assert lake.get_top_entities("orders", "customer_id", "avg_stars").count() == 4
    lake.build_gold_features("reviews", extract_aspects=True)
    assert "aspect_keywords" in lake.gold("reviews").columns
    assert lake.get_feature_stats("reviews").count() >= 2
    state = {r["table_name"]: r["exists"] for r in lake.get_dataset_status().collect()}
    assert state["silver.reviews"] and state["gold.reviews"] and not state["silver.users"]
    assert lake.get_reviews_sales_correlation()["cross"].count() == 6
    assert not lake.get_nlp_models_status().where("exists").count()
    for call in (lambda: lake.get_reviews_by_month("undated"), lambda: lake.get_reviews_distribution("nope")):
        with pytest.raises(DatasetError):
            call()
    with pytest.raises(MissingTableError):
        lake.get_user_stats()


def test_existing_tables_are_kept(spark, folder):
    path = f"{folder}/t"
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_table(spark.range(9), path, overwrite=True)
    assert spark.read.parquet(path).count() == 9
    assert inventory.try_read(spark, f"{folder}/none") is None


def test_readers(spark, folder):
    write(f"{folder}/r.json", [review(k) for k in range(10)])
    assert readers.read_reviews(spark, f"{folder}/r.json", limit=4).count() == 4
    with pytest.raises(ValueError):
        readers.read_shop_table(spark, folder, "nope")
    assert all(v is None for v in readers.read_shop(spark, folder).values())
    with open(f"{folder}/latin.csv", "wb") as f:
        f.write("review_id,product_id,reviewer_id,stars,review_body,review_title,language,product_category\n1,p,u,3,niño,,es,toy\n".encode("latin1"))
    assert readers.read_undated_reviews(spark, f"{folder}/latin.csv", encoding="ISO-8859-1").first()["review_body"] == "niño"


def test_word_lists_from_json(spark, folder):
    for name, lists in (("t", ASPECT_KEYWORDS), ("l", POLARITY_WORDS)):
        write(f"{folder}/{name}.json", [json.dumps(lists, indent=1)])
    assert lexicons.load_taxonomy(spark, f"{folder}/t.json") == DEFAULT_TAXONOMY
    assert lexicons.load_lexicon(spark, f"{folder}/l.json") == DEFAULT_LEXICON


def test_streaming_ingest_is_incremental(spark, folder):
    write(f"{folder}/in/a.json", [review(k) for k in range(10)])
    args = (spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", 1)
    ingest.ingest_reviews(*args).awaitTermination(120)
    write(f"{folder}/in/b.json", [review(k) for k in range(10, 15)])
    ingest.ingest_reviews(*args).awaitTermination(120)
    ingest.ingest_reviews(*args).awaitTermination(120)
    df = spark.read.parquet(f"{folder}/out")
    assert df.count() == 15 and df.select("review_id").distinct().count() == 15
    seen = []
    ingest.for_each_batch(spark, f"{folder}/in", f"{folder}/cp2", lambda b, n: seen.append(b.count()), 1).awaitTermination(120)
    assert sorted(seen) == [5, 10]


def test_sublinear_counts(spark):
    from pyspark.ml.feature import CountVectorizer

    df = spark.createDataFrame([(["a", "a", "b"],)], "w array<string>")
    counted = CountVectorizer(inputCol="w", outputCol="v").fit(df).transform(df)
    got = counted.select(classify.sublinear(F.unwrap_udt("v")["values"])).first()[0]
    assert np.allclose(got, [1 + np.log(2), 1.0])


def test_sentiment_model_learns_and_reloads(spark, folder):
    rows = [(k, "wonderful lovely excellent item bought" if k % 3 == 0 else "horrible broken awful thing returned" if k % 3 == 1 else "average plain ordinary object received", [5, 1, 3][k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "review_id int, text string, stars int")
    model = classify.train_sentiment(classify.training_rows(df), max_iter=20)
    model.save(f"{folder}/m")
    out = classify.predict_sentiment(df, classify.SentimentModel.load(f"{folder}/m"))
    assert out.where((F.col("stars") == 5) & (F.col("predicted_label") == "positive")).count() == 30
    trends = classify.neutral_trends(df, model).collect()
    assert sum(r["count"] for r in trends) == 30


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) * [3, 10] + [1, 5]
    y = 4 * x[:, 0] - x[:, 1] * 2 + rng.normal(size=60) * 3
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, total_revenue double")
    model = forecast.fit_model(df, "ridge_10", ["a", "b"])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(model.stages[-1].coefficients.toArray(), want, rtol=0.02)


def test_forecast_roundtrip(spark, folder, tables):
    series = weekly.weekly_series(tables.orders, tables.order_reviews)
    trained = forecast.train_forecaster(weekly.weekly_features(series), models=("ridge_1", "lasso_1"))
    trained.save(f"{folder}/f")
    loaded = forecast.Forecaster.load(spark, f"{folder}/f")
    a, b = (forecast.sales_forecast(f, series).first() for f in (trained, loaded))
    assert a["predicted_revenue"] == b["predicted_revenue"] and a["week_of_year"] == 32.0
    assert forecast.sales_forecast(loaded, series, overrides={"revenue_lag_1": 1.0}).first()["revenue_lag_1"] == 1.0


def test_large_csv_is_read_in_parts_and_all_shop_tables_are_known(spark, folder):
    from reviewlake import schemas
    from reviewlake.sources import readers

    assert len(schemas.SHOP_TABLES) == 7
    with open(f"{folder}/sellers.csv", "w") as out:
        out.write("seller_id,seller_zip_code_prefix,seller_city,seller_state\n")
        out.writelines(f"s{k},{k},city,st\n" for k in range(200_000))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = readers.read_shop_table(spark, folder, "sellers")
        assert df.rdd.getNumPartitions() > 2 and df.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_building_silver_keeps_every_row(spark, folder):
    import json

    from reviewlake.plans.service import ReviewLake

    with open(f"{folder}/rows.json", "w") as out:
        out.writelines(json.dumps({"review_id": f"r{k}", "user_id": "u", "business_id": "b", "stars": 5.0, "text": "fine", "date": "2020-01-01 00:00:00"}) + "\n" for k in range(100_500))
    spark.read.text(f"{folder}/rows.json").write.text(f"{folder}/lake/bronze/reviews")
    lake = ReviewLake(spark, f"{folder}/lake")
    assert lake.build_all_silver().where("status = 'built'").count() == 1
    assert lake.silver("reviews").count() == 100_500
    assert lake.get_column_stats("reviews", "stars").first()["row_count"] == 100_500
    assert {r["exists"] for r in lake.get_dataset_status("reviews").collect()} == {True, False}


def test_csv_encodings_are_found_per_file(spark, folder):
    head = "review_id,product_id,reviewer_id,stars,review_body,review_title,language,product_category\n"
    body = {
        "a": (head + '1,p,u,3,"niño, ""así""\nsigue",ï»¿,es,toy\n').encode("utf-8"),
        "b": (head + "2,p,u,3,niño,Ã©,es,toy\n3,p,u,4,,plain,es,toy\n").encode("latin1"),
        "c": b"\xef\xbb\xbf" + (head + "4,p,u,5,日本 €,,es,toy\n").encode("utf-8"),
    }
    for name, data in body.items():
        with open(f"{folder}/{name}.csv", "wb") as out:
            out.write(data)
    df = readers.read_undated_reviews(spark, f"{folder}/*.csv")
    rows = {r["review_id"]: r for r in df.collect()}
    assert rows["1"]["review_body"] == 'niño, "así"\nsigue' and rows["1"]["review_title"] == "ï»¿"
    assert rows["2"]["review_body"] == "niño" and rows["2"]["review_title"] == "Ã©"
    assert rows["3"]["review_body"] is None and rows["4"]["review_body"] == "日本 €" and len(rows) == 4
    assert readers.read_undated_reviews(spark, f"{folder}/b.csv", encoding="ISO-8859-1").count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan


def test_a_ridge_per_group_equals_its_closed_form(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for group, offset in (("a", 0.0), ("b", 1e7), (None, -5.0)):
        x = rng.normal(size=(40, 3)) * [3, 10, 1] + [1, 5, offset]
        x[:, 1] = 7.0 if group == "a" else x[:, 1]
        y = 4 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=40) + offset
        spread = x.std(0)
        z = (x - x.mean(0)) / np.where(spread > 1e-12, spread, 1.0)
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (y - y.mean())) / np.where(spread > 1e-12, spread, 1.0)
        want[group] = [y.mean() - w @ x.mean(0), *w]
        rows += [(group, *map(float, r), float(t)) for r, t in zip(x, y)]
        rows += [(group, None, 1.0, 1.0, 1.0), (group, 1.0, 1.0, 1.0, None)]
    rows.append(("empty", None, None, None, None))
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double").repartition(5)
    found = forecast.group_ridge(df, ["g"], 2.0, ["a", "b", "c"], "y").collect()
    assert {r["g"] for r in found} == set(want) and all(r["weeks"] == 40 for r in found)
    for r in found:
        assert np.allclose([r["intercept"], *r["weights"]], want[r["g"]], rtol=1e-6, atol=1e-6)
    with pytest.raises(ValueError):
        forecast.group_ridge(df, ["g"], 0.0, ["a"], "y")


def test_weeks_ahead_follow_from_one_another(spark):
    weeks = [(g, f"2024-{1 + k // 28:02d}-{1 + k % 28:02d}") for g in ("a", "b") for k in range(0, 84, 7)]
    rows = [(g, day, 10 + k, 100.0 + 13.0 * k * (1 + (g == "b")) + 40 * (k % 3), 3, 4.0 + (k % 5) / 10) for k, (g, day) in enumerate(weeks)]
    rows += [("short", "2024-01-01", 2, 50.0, 1, 4.5)]
    series = spark.createDataFrame(
        rows, "g string, week string, order_count long, total_revenue double, review_count long, avg_review_score double"
    ).withColumn("week", F.col("week").cast("date"))
    models = {r["g"]: [r["intercept"], *r["weights"]] for r in forecast.group_ridge(weekly.weekly_features(series, ["g"]), ["g"]).collect()}
    found = forecast.group_forecast(series, ["g"], weeks=6).orderBy("g", "week").collect()
    assert len(found) == 18 and set(models) == {"a", "b"}
    for g in ("a", "b", "short"):
        own = [r for r in found if r["g"] == g]
        past = [r[3] for r in rows if r[0] == g]
        assert [(r["week"] - own[0]["week"]).days for r in own] == [0, 7, 14, 21, 28, 35]
        for r in own:
            if len(past) >= 4:
                assert np.allclose([r["revenue_lag_1"], r["revenue_lag_2"], r["revenue_lag_4"]], [past[-1], past[-2], past[-4]])
                assert np.isclose(r["revenue_roll_4"], np.mean(past[-4:]))
            want = r["revenue_roll_4"] if g == "short" else models[g][0] + sum(w * r[c] for w, c in zip(models[g][1:], forecast.FEATURES))
            assert np.isclose(r["predicted_revenue"], want)
            past.append(r["predicted_revenue"])
    first = forecast.group_forecast(series, ["g"]).orderBy("g").collect()
    assert [r["predicted_revenue"] for r in first] == [r["predicted_revenue"] for r in found if r["week"] in {f["week"] for f in first if f["g"] == r["g"]}]
    assert forecast.group_forecast(series.limit(0), ["g"], weeks=2).collect() == []
    with pytest.raises(ValueError):
        forecast.group_forecast(series, ["g"], weeks=0)


def test_monthly_table_after_batches_equals_the_recount(spark, folder):
    from reviewlake.operators import reviews as ops, silver
    from reviewlake.streaming.aggregates import MonthlyReviews

    def raw(k):
        row = json.loads(review(k))
        row["date"] = None if k == 7 else f"2020-{1 + k % 3:02d}-05 00:00:00"
        return json.dumps({**row, "stars": None if k == 11 else float(1 + k * 7 % 5)})

    table = MonthlyReviews(spark, f"{folder}/agg")
    assert table.table().collect() == [] and table.merge() == -1
    for batch in range(3):
        write(f"{folder}/raw/part{batch}.json", [raw(k) for k in range(batch * 20, batch * 20 + 20)])
        table.ingest(f"{folder}/raw", f"{folder}/check").awaitTermination()
        if batch == 1:
            assert table.merge() == 1 and table.merge() == 1
    everything = silver.silver_reviews(readers.read_reviews(spark, f"{folder}/raw"))
    shown = lambda df: [tuple(r) for r in df.collect()]
    full = shown(ops.reviews_by_month(everything))
    assert sum(r[2] for r in full) == 60
    assert shown(table.table().drop("std_stars")) == full
    spreads = {(r["year"], r["month"]): r["s"] for r in everything.groupBy("year", "month").agg(F.stddev_samp("stars").alias("s")).collect()}
    assert all(r["std_stars"] == pytest.approx(spreads[r["year"], r["month"]]) for r in table.table().collect())
    part = silver.silver_reviews(readers.read_reviews(spark, f"{folder}/raw/part2.json"))
    for batch in (0, 1, 2):  # replayed batches, merged or not
        table.add(part if batch == 2 else part.limit(3), batch)
    assert shown(table.table().drop("std_stars")) == full
    assert table.merge() == 2 and shown(table.table().drop("std_stars")) == full


def test_years_active_and_months(spark, tables):
    from reviewlake.operators import silver

    df = spark.createDataFrame([("a", "2012-02-29"), ("b", "2020-02-28"), ("c", None), ("d", "2021-01-01")], "user_id string, yelping_since string")
    found = {r["user_id"]: r["years_active"] for r in silver.with_years_active(df, F.lit("2020-02-28").cast("date")).collect()}
    assert found == {"a": 7, "b": 0, "c": None, "d": 0}
    assert silver.with_years_active(df).where("user_id = 'a'").first()["years_active"] == 8
    with pytest.raises(ValueError):
        weekly.weekly_series(tables.orders, tables.order_reviews, granularity="day")
