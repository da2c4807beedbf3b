"""Review-shaped raw tables derived from a star schema (events, documents, orders, lineitem, part, customer).

Ratings, titles and seed phrases are computed from the ids, so the tables are whole and the same on every engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.operators import silver
from reviewlake.schemas import COMPLIMENTS

# Phrases put in front of the invented texts, by residue.
SEED_PHRASES = {
    0: "Great product and fast delivery. ",
    1: "Terrible service, box arrived damaged! ",
    2: "Excelente precio, envio lento. ",
    3: "Produto otimo, entrega no prazo. ",
    4: "Well made and worth the money, love the design. ",
    5: "Malo: el producto llego roto. ",
}

_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
    "documents": "doc_id bigint, text string, lang string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
                "l_tax double, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class DemoTables:
    """Raw and silver tables over one directory of star-schema Parquet files; everything is lazy."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.directory}/{name}.parquet")

    # Row counts are scalar subqueries over Parquet footers; ids cycle through documents and parts.

    def _rows(self, name: str) -> Column:
        return self.base(name).agg(F.count("*")).scalar()

    def _with_document(self, df: DataFrame, key: str) -> DataFrame:
        """Give every row a document, cycling through them by id.

        Texts are spread by key before the join: a sorted join needs that shuffle anyway, and when the narrow side is
        broadcast the text work would otherwise run in as many tasks as the small documents file has splits. Adaptive
        execution sizes the partitions.
        """
        documents = self.base("documents").select(
            F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.col("lang").alias("_lang")
        )
        keyed = df.withColumn("_doc", F.col(key) % self._rows("documents"))
        return keyed.join(documents.repartition("_doc"), "_doc", "inner").drop("_doc")

    # --- raw tables ---------------------------------------------------------------------------

    def _raw_reviews(self, events: DataFrame, *more: str) -> DataFrame:
        """Reviews out of events; `more` names further columns of the events to keep."""
        event, user = F.col("event_id"), F.col("user_id")
        phrase = F.lit("")
        for residue, words in SEED_PHRASES.items():
            phrase = F.when((event * 3 + user) % 8 == residue, words).otherwise(phrase)
        return self._with_document(events.select("event_id", "user_id", "ts", *more), "event_id").select(
            event.alias("review_id"), "user_id", (event % self._rows("part")).alias("business_id"),
            (1 + (event * 7 + user) % 5).cast("int").alias("stars"),
            (event % 11).cast("int").alias("useful"), (event % 5).cast("int").alias("funny"),
            (event % 7).cast("int").alias("cool"),
            F.concat(phrase, F.col("_text")).alias("text"), F.col("ts").alias("date"), F.col("_lang").alias("language"), *more,
        )

    @cached_property
    def raw_reviews(self) -> DataFrame:
        return self._raw_reviews(self.base("events"))

    @cached_property
    def raw_undated_reviews(self) -> DataFrame:
        """The categories join the narrow events, before any text: a sorted join would shuffle and sort the texts."""
        categories = self.base("part").select(F.col("p_partkey").alias("_part"), F.col("p_type").alias("product_category"))
        events = self.base("events").withColumn("_product", F.col("event_id") % self._rows("part"))
        return self._raw_reviews(events.join(categories, F.col("_product") == F.col("_part"), "left"), "product_category").select(
            F.col("business_id").alias("product_id"), "review_id", F.col("user_id").alias("reviewer_id"), "stars",
            F.col("text").alias("review_body"), "language", "product_category",
        )

    @cached_property
    def raw_orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        bought = F.col("o_orderdate")
        delivered = F.when(key % 10 != 9, F.date_add(bought.cast("date"), (key % 20).cast("int")).cast("timestamp_ntz"))
        return self.base("orders").select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"),
            bought.alias("order_purchase_timestamp"), delivered.alias("order_delivered_customer_date"),
        )

    @cached_property
    def raw_order_items(self) -> DataFrame:
        price = F.col("l_extendedprice")
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), price.alias("price"),
            (price * F.col("l_tax")).alias("freight_value"),
        )

    @cached_property
    def raw_order_reviews(self) -> DataFrame:
        key = F.col("o_orderkey")
        orders = self.base("orders").where(key % 10 < 8)
        day = F.date_add(F.col("o_orderdate").cast("date"), (1 + key % 14).cast("int"))
        return self._with_document(orders, "o_orderkey").select(
            key.alias("review_id"), key.alias("order_id"),
            (1 + (key * 7 + F.col("o_custkey")) % 5).cast("int").alias("review_score"),
            F.when(key % 4 != 0, F.concat(F.lit("title "), (key % 9).cast("string"))).alias("review_comment_title"),
            F.when(key % 5 < 2, None).when(key % 25 == 2, "").otherwise(F.col("_text")).alias("review_comment_message"),
            F.date_format(day, "yyyy-MM-dd 00:00:00").alias("review_creation_date"),
            F.date_format(day, "yyyy-MM-dd 00:00:00").alias("review_answer_timestamp"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        size = F.col("p_size")
        return self.base("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"),
            F.char_length("p_name").alias("product_name_length"), F.char_length("p_type").alias("product_description_length"),
            (size % 6).alias("product_photos_qty"), (size * 10).alias("product_weight_g"),
        )

    @cached_property
    def raw_categories(self) -> DataFrame:
        name = F.col("p_type")
        english = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
        return self.base("part").select(
            name.alias("product_category_name"), english.alias("product_category_name_english")
        ).distinct()

    @cached_property
    def raw_users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.base("customer").select(
            key.alias("user_id"), F.col("c_name").alias("name"),
            (key * 13 % 400).cast("int").alias("review_count"),
            F.date_add(F.lit("2010-01-01").cast("date"), (key * 37 % 3000).cast("int")).alias("yelping_since"),
            (key * 7 % 90).cast("int").alias("fans"), (key % 50).cast("int").alias("useful"),
            (key % 20).cast("int").alias("funny"), (key % 30).cast("int").alias("cool"),
            (F.lit(1.0) + (key % 41) / 10.0).alias("average_stars"),
            F.when(key % 3 == 0, "None").otherwise(F.concat(F.repeat(F.lit("u, "), (key % 6).cast("int")), F.lit("u"))).alias("friends"),
            F.when(key % 4 == 0, "2010,2011,20").when(key % 4 == 1, "2015").otherwise("").alias("elite"),
            *[(key % (i + 2)).cast("int").alias(f"compliment_{name}") for i, name in enumerate(COMPLIMENTS)],
        )

    @cached_property
    def raw_businesses(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.base("part").select(
            key.alias("business_id"), F.col("p_name").alias("name"),
            F.concat(F.lit("S"), (key % 17).cast("string")).alias("state"),
            F.concat(F.lit("C"), (key % 97).cast("string")).alias("city"),
            (10000 + key % 90000).cast("string").alias("postal_code"),
            ((key % 180) - 90).cast("double").alias("latitude"), ((key % 360) - 180).cast("double").alias("longitude"),
            (F.lit(1.0) + (key % 9) / 2.0).alias("stars"), (key % 2).cast("int").alias("is_open"),
            (key % 120).cast("int").alias("review_count"),
            F.when(key % 10 != 0, F.concat_ws(", ", "p_type", "p_brand")).alias("categories"),
        )

    # --- silver tables ------------------------------------------------------------------------

    @cached_property
    def reviews(self) -> DataFrame:
        return silver.silver_reviews(self.raw_reviews, language=None)

    @cached_property
    def undated_reviews(self) -> DataFrame:
        return silver.silver_undated_reviews(self.raw_undated_reviews, language=None)

    @cached_property
    def orders(self) -> DataFrame:
        return silver.silver_orders(self.raw_orders, self.raw_order_items)

    @cached_property
    def order_items(self) -> DataFrame:
        return silver.silver_order_items(
            self.raw_orders, self.raw_order_items, self.raw_products, self.raw_categories
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        return silver.silver_order_reviews(self.raw_order_reviews)

    @cached_property
    def users(self) -> DataFrame:
        return silver.silver_users(self.raw_users)

    @cached_property
    def businesses(self) -> DataFrame:
        return silver.silver_businesses(self.raw_businesses)

    @cached_property
    def corpus(self) -> DataFrame:
        """All review tables as one corpus."""
        return silver.unify_reviews({
            "reviews": self.reviews.select("review_id", "stars", "text", "text_length", "is_ambiguous", "language", "year", "month"),
            "undated": self.undated_reviews.select("review_id", "stars", "text", "text_length", "is_ambiguous", "language", "category"),
            "orders": self.order_reviews.select("review_id", "review_score", "text", "text_length", "is_ambiguous", "language", "has_comment"),
        })

    @cached_property
    def annotated(self) -> DataFrame:
        """Texts with an annotated aspect list, for judging the aspect rules."""
        key = F.col("review_id")
        listed = (
            F.when(key % 5 == 0, "shipping, Price").when(key % 5 == 1, "entrega,service")
            .when(key % 5 == 2, "quality ,unknown").when(key % 5 == 3, None).otherwise("product,color")
        )
        return self.raw_reviews.select("review_id", "text", listed.alias("aspects"))
