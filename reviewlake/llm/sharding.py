"""Range sharding by sampled splitters: shards of near-equal bytes that keep equal texts together.

Rows are ordered by text hash, then id. A size-weighted sample of keys gives quantile boundaries of many small ranges;
ranges that turn out overfull, as when one text fills them, are subdivided by a sample of their own. Running sums over the
ranges and within each place every row on the line of all bytes, which the shards cut evenly between groups of equal texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.scratch import save

#: Ranges aimed at; their number, and so what reaches the driver, doesn't depend on the data. A range is one task's sort.
RANGES = 1024
#: Sampled keys for each range.
DRAWS = 16
#: Bytes up to which no range is overfull.
LEAST_FULL = 1 << 20


def _padded(hash_column: F.Column) -> F.Column:
    return F.lpad(F.hex(hash_column), 16, "0")


def _sampled(rows: DataFrame, sums: dict[int, tuple[int, int]]) -> list[bytes]:
    """Quantile boundaries inside each range of sums {range: (size, parts)}, from a size-weighted sample of its keys."""
    parts = rows.sparkSession.createDataFrame([(k, n * DRAWS / size) for k, (size, n) in sums.items()], "range int, rate double")
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 53)) / float(1 << 53)
    drawn: dict[int, list[bytes]] = {}
    for r in rows.join(parts, "range").where(draw < F.col("size") * F.col("rate")).select("range", "key").collect():
        drawn.setdefault(r["range"], []).append(r["key"].encode())
    found = set()
    for k, keys in drawn.items():
        keys.sort()
        found |= {keys[len(keys) * i // sums[k][1]] for i in range(1, sums[k][1])}
    return sorted(found)


def _ranged(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    edges = np.array(splitters, "S48")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy().astype("S48"), "right").astype(np.int32))

    return rows.withColumn("range", place("key"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row. Size: UTF-8 bytes of the text, 0 if null, plus 1.

    Shards have near-equal sizes. Equal texts (null counts as empty) lie in one shard unless they fill more than a shard's
    share, when they must be split. A shard's size differs from the even share by one group of equal texts at most. Slots
    number a shard's rows from 0 without gaps. Repeated rows are placed one by one; null ids are ids like any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h"),
    )
    key = F.concat(_padded(F.col("h")), _padded(F.xxhash64("id")), _padded(F.monotonically_increasing_id()))
    rows = save(rows.withColumn("key", key))
    total = rows.agg(F.sum("size")).first()[0] or 0
    splitters = _sampled(rows.withColumn("range", F.lit(0)), {0: (total, ranges)}) if total else []
    full = max(4 * total // ranges, LEAST_FULL)
    while True:
        ranged = _ranged(rows, splitters)
        sums = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()}
        over = {k: (r["size"], -(-r["size"] * ranges // total)) for k, r in sums.items() if r["size"] > full and r["rows"] > 1}
        finer = sorted({*splitters, *_sampled(ranged, over)}) if over else splitters
        if finer == splitters:
            break
        splitters = finer
    before, known = (0, 0), []
    for k in sorted(sums):
        known.append((k, *before))
        before = (before[0] + sums[k]["size"], before[1] + sums[k]["rows"])
    base = docs.sparkSession.createDataFrame(known, "range int, bytes_before long, rows_before long")
    inner = Window.partitionBy("range").orderBy("key")
    placed = save(
        ranged.select("*", F.sum("size").over(inner).alias("upto"), F.row_number().over(inner).alias("number"))
        .join(base, "range")
        .select("id", "size", "crc", "h", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"),
                (F.col("rows_before") + F.col("number") - 1).alias("row"))
    )
    groups = placed.groupBy("h").agg(F.min("start").alias("group_start"), F.sum("size").alias("group_size"))
    whole = F.col("group_size") * shards <= total
    middle = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    chosen = F.least(F.floor(middle * shards / float(max(1, total))), F.lit(shards - 1)).cast("int")
    cut = save(placed.join(groups, "h").select("id", "size", "crc", "row", chosen.alias("shard")))
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))
    return cut.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of `docs` as Parquet folders shard=0, shard=1, ... in slot order. Ids must be unique."""
    joined = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
