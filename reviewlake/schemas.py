"""Explicit schemas of the raw tables, layer file names and dataset capabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# The eleven compliment counters of a user.
COMPLIMENTS = ["hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos"]

RAW_REVIEWS = _struct(
    review_id=S, user_id=S, business_id=S, stars=D, useful=I, funny=I, cool=I, text=S, date=S,
)
RAW_USERS = _struct(
    user_id=S, name=S, review_count=I, yelping_since=S, friends=S, elite=S, useful=I, funny=I, cool=I, fans=I,
    average_stars=D, **{f"compliment_{c}": I for c in COMPLIMENTS},
)
RAW_BUSINESSES = _struct(
    business_id=S, name=S, address=S, city=S, state=S, postal_code=S, latitude=D, longitude=D, stars=D,
    review_count=I, is_open=I, attributes=T.MapType(S, S), hours=T.MapType(S, S), categories=S,
)
RAW_UNDATED = _struct(
    review_id=S, product_id=S, reviewer_id=S, stars=I, review_body=S, review_title=S, language=S, product_category=S,
)
RAW_ORDERS = _struct(
    order_id=S, customer_id=S, order_status=S, order_purchase_timestamp=S, order_approved_at=S,
    order_delivered_carrier_date=S, order_delivered_customer_date=S, order_estimated_delivery_date=S,
)
RAW_ITEMS = _struct(
    order_id=S, order_item_id=I, product_id=S, seller_id=S, shipping_limit_date=S, price=D, freight_value=D,
)
RAW_ORDER_REVIEWS = _struct(
    review_id=S, order_id=S, review_score=I, review_comment_title=S, review_comment_message=S,
    review_creation_date=S, review_answer_timestamp=S,
)
RAW_PRODUCTS = _struct(
    product_id=S, product_category_name=S, product_name_length=I, product_description_length=I,
    product_photos_qty=I, product_weight_g=I, product_length_cm=I, product_height_cm=I, product_width_cm=I,
)
RAW_CUSTOMERS = _struct(
    customer_id=S, customer_unique_id=S, customer_zip_code_prefix=S, customer_city=S, customer_state=S,
)
RAW_SELLERS = _struct(seller_id=S, seller_zip_code_prefix=S, seller_city=S, seller_state=S)
RAW_CATEGORIES = _struct(product_category_name=S, product_category_name_english=S)

# The e-commerce tables by their short name.
SHOP_TABLES = {
    "orders": RAW_ORDERS,
    "items": RAW_ITEMS,
    "reviews": RAW_ORDER_REVIEWS,
    "products": RAW_PRODUCTS,
    "customers": RAW_CUSTOMERS,
    "sellers": RAW_SELLERS,
    "categories": RAW_CATEGORIES,
}

# Table names inside the silver and gold layer directories.
SILVER = {
    "reviews": "reviews", "users": "users", "businesses": "businesses", "undated_reviews": "undated_reviews",
    "orders": "orders", "order_items": "order_items", "order_reviews": "order_reviews",
}
GOLD = {
    "reviews": "review_features", "undated_reviews": "undated_review_features",
    "order_reviews": "order_review_features", "users": "user_stats", "sales": "sales_features",
}


@dataclass(frozen=True)
class Dataset:
    """A review dataset: its silver table, its rating column and what can be asked of it."""

    name: str
    table: str
    rating: str
    language: str
    dated: bool
    sales: bool


DATASETS = {
    "reviews": Dataset("reviews", "reviews", "stars", "en", dated=True, sales=False),
    "undated": Dataset("undated", "undated_reviews", "stars", "es", dated=False, sales=False),
    "orders": Dataset("orders", "order_reviews", "review_score", "pt", dated=True, sales=True),
}

_CAPABILITIES = {
    "has_date": ("date", "purchase_date"),
    "has_category": ("category", "categories"),
    "has_text": ("text",),
    "has_stars": ("stars", "review_score"),
    "has_entity_id": ("business_id", "product_id", "order_id"),
    "has_user_id": ("user_id", "reviewer_id", "customer_id"),
}


def capabilities(df: DataFrame) -> dict[str, bool]:
    """What a table can answer, read off its schema; no job runs."""
    present = set(df.columns)
    return {flag: bool(present & set(names)) for flag, names in _CAPABILITIES.items()}


def rating_column(df: DataFrame) -> str:
    """The rating column of a review table."""
    from reviewlake.errors import DatasetError

    for name in ("stars", "review_score"):
        if name in df.columns:
            return name
    raise DatasetError(f"no rating column; columns are {df.columns}")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Reject a table that lacks a column, before anything runs."""
    from reviewlake.errors import DatasetError

    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DatasetError(f"missing columns {missing}; columns are {df.columns}")
    return df
