"""The filter specification and the generic metric x group-by x filter call."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.errors import DatasetError
from reviewlake.functions.numeric import count_if, mean, pct, rnd
from reviewlake.schemas import rating_column

_ENTITY_COLUMNS = ("business_id", "product_id", "order_id")
_CATEGORY_COLUMNS = ("category", "categories", "category_en")
_DATE_COLUMNS = ("date", "purchase_date", "review_date")


@dataclass(frozen=True)
class FilterSpec:
    """Conditions on a review or sales table; unset fields do not filter."""

    date_start: str | date | None = None
    date_end: str | date | None = None
    categories: tuple[str, ...] | None = None
    exclude_categories: tuple[str, ...] | None = None
    entity_ids: tuple | None = None
    stars: tuple[int, ...] | None = None
    min_stars: int | None = None
    max_stars: int | None = None
    is_ambiguous: bool | None = None
    language: str | None = None
    limit: int | None = None

    def __post_init__(self) -> None:
        for name in ("date_start", "date_end"):
            value = getattr(self, name)
            if isinstance(value, str):
                try:
                    date.fromisoformat(value)
                except ValueError:
                    raise ValueError(f"{name}: {value!r} is not a YYYY-MM-DD date") from None
            elif value is not None and not isinstance(value, date):
                raise ValueError(f"{name}: unsupported type {type(value).__name__}")
        for name in ("min_stars", "max_stars"):
            value = getattr(self, name)
            if value is not None and not 1 <= value <= 5:
                raise ValueError(f"{name} must be between 1 and 5")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be at least 1")


def _first(df: DataFrame, names: tuple[str, ...], what: str) -> str:
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise DatasetError(f"the table has no {what} column ({', '.join(names)}); columns are {df.columns}")
    return found


def conditions(df: DataFrame, spec: FilterSpec) -> list[Column]:
    """The specification as conditions on this table. A field the table cannot answer is an error."""
    out: list[Column] = []
    if spec.date_start is not None or spec.date_end is not None:
        day = F.col(_first(df, _DATE_COLUMNS, "date")).cast("date")
        if spec.date_start is not None:
            out.append(day >= F.lit(str(spec.date_start)).cast("date"))
        if spec.date_end is not None:
            out.append(day <= F.lit(str(spec.date_end)).cast("date"))
    if spec.categories is not None or spec.exclude_categories is not None:
        name = _first(df, _CATEGORY_COLUMNS, "category")
        if name == "categories":
            listed = F.split(F.col(name), ", ")
            included = lambda names: F.arrays_overlap(listed, F.array(*[F.lit(v) for v in names]))
        else:
            included = lambda names: F.col(name).isin(*names)
        if spec.categories is not None:
            out.append(included(spec.categories))
        if spec.exclude_categories is not None:
            out.append(~F.coalesce(included(spec.exclude_categories), F.lit(False)))
    if spec.entity_ids is not None:
        out.append(F.col(_first(df, _ENTITY_COLUMNS, "entity id")).isin(*spec.entity_ids))
    if spec.stars is not None:
        out.append(F.col(rating_column(df)).isin(*spec.stars))
    if spec.min_stars is not None:
        out.append(F.col(rating_column(df)) >= spec.min_stars)
    if spec.max_stars is not None:
        out.append(F.col(rating_column(df)) <= spec.max_stars)
    if spec.is_ambiguous is not None:
        flag = F.col(_first(df, ("is_ambiguous",), "ambiguity"))
        out.append(flag if spec.is_ambiguous else ~flag)
    if spec.language is not None:
        out.append(F.col(_first(df, ("language",), "language")) == spec.language)
    return out


def apply_filters(df: DataFrame, spec: FilterSpec, order: tuple[str, ...] = ()) -> DataFrame:
    """Filter a table. A limit is taken after sorting by ``order`` (default: the first column)."""
    for condition in conditions(df, spec):
        df = df.where(condition)
    if spec.limit is not None:
        df = df.orderBy(*(order or (df.columns[0],))).limit(spec.limit)
    return df


def _metrics(df: DataFrame) -> dict[str, Column]:
    """Metrics this table can answer."""
    out = {"count": F.count("*")}
    if {"stars", "review_score"} & set(df.columns):
        rating = F.col(rating_column(df))
        out["avg_stars"] = mean(rating, 2)
        out["pct_positive"] = pct(count_if(rating >= 4), F.count("*"), 2)
        out["pct_negative"] = pct(count_if(rating <= 2), F.count("*"), 2)
    optional = {
        "avg_text_length": ("text_length", lambda c: mean(c, 2)),
        "ambiguous_count": ("is_ambiguous", count_if),
        "avg_sentiment": ("sentiment_score", lambda c: mean(c, 3)),
        "total_revenue": ("order_total", lambda c: rnd(F.sum(c), 2)),
        "avg_order_value": ("order_total", lambda c: mean(c, 2)),
        "total_items": ("item_count", F.sum),
    }
    for name, (column, build) in optional.items():
        if column in df.columns:
            out[name] = build(F.col(column))
    return out


def aggregate(df: DataFrame, metric: str, group_by: list[str], filters: FilterSpec | None = None) -> DataFrame:
    """Any registered metric by any columns under any filter."""
    known = _metrics(df)
    if metric not in known:
        raise DatasetError(f"metric {metric!r} is not available; this table answers {sorted(known)}")
    missing = [c for c in group_by if c not in df.columns]
    if missing:
        raise DatasetError(f"cannot group by {missing}; columns are {df.columns}")
    rows = apply_filters(df, filters) if filters else df
    return rows.groupBy(*group_by).agg(known[metric].alias(metric)).orderBy(*group_by)
