"""Mix sources to target weights by pivotal dependent rounding.

A source's documents all want the same number of copies, target / size of the source. The whole part is certain; the
fractional part is rounded in pairs: the word mass of two fractional documents is moved to one or the other, at random
and without bias, until one of them is whole. A pair keeps its sum of words, so a block of documents ends with one
fractional document at most and exact words otherwise; it is a short one as a rule, for the longest documents come first. These residuals meet in a reduction tree over the blocks; the one
left per source is rounded at random, hence a source's words differ from its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.scratch import save

#: Documents that a block holds on average, and blocks or residuals that a step of the tree combines.
BLOCK_ROWS = 4096
FAN_IN = 64


def word_count(text: str) -> F.Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, sid, rows, source_size, target) of sizes (source, size).

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` times all sizes. A target stops
    at `cap` times its source's size, the excess is reshared by weight. With sources ordered by cap over weight, those up
    to some place are capped and the rest get the same words per unit of weight; running sums find that place. The windows
    run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    one = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    one = one.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("sid") % len(weights) + 1)
    one = one.select("*", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most"))
    ranked = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    one = one.select(
        "*",
        ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         / F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))).alias("level"),
    )
    fits = F.col("level") * F.col("weight") <= F.col("most")
    one = one.select("*", F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(everything).alias("found"))
    level = F.col("found.level")
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    return one.select("source", "sid", "rows", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _pivot(rows: DataFrame) -> DataFrame:
    """Round the fractions of rows (id, sid, block, size, h, part) within each (sid, block); one at most stays fractional."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row, group = None, None  # the document that is still fractional
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, size, part = row[1:3], row[3], row[5]
                if key != group:
                    if open_row is not None:
                        out.append(open_row)
                    open_row, group = None, key
                if size == 0 or part in (0.0, 1.0):
                    out.append((*row[:5], float(round(part))))
                elif open_row is None:
                    open_row = row
                else:
                    a, x = open_row[3], open_row[5]
                    gain, loss = min((1 - x) * a, part * size), min(x * a, (1 - part) * size)
                    draw = (row[4] % (1 << 53)) / (1 << 53)
                    if draw * (gain + loss) < loss:  # words go to the open document
                        full, empty = gain == (1 - x) * a, gain == part * size
                        x, part = 1.0 if full else x + gain / a, 0.0 if empty else part - gain / size
                    else:
                        empty, full = loss == x * a, loss == (1 - part) * size
                        x, part = 0.0 if empty else x - loss / a, 1.0 if full else part + loss / size
                    first, second = (*open_row[:5], x), (*row[:5], part)
                    open_row = None
                    for each in (first, second):
                        if each[5] in (0.0, 1.0) or open_row is not None:
                            out.append(each)
                        else:
                            open_row = each
            yield _batch(out, batch.schema)
        if open_row is not None:
            yield _batch([open_row], batch.schema)

    dealt = rows.repartition("sid", "block").sortWithinPartitions("sid", "block", F.desc("size"), "h", "id")
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix(
    sized: DataFrame, id_col: str, source_col: str, size_col: str,
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row; taken = copies x size.

    The draw depends on id, source and size alone, so reruns agree on any number of executors. A null size counts as 0; a
    row of size 0 takes no words. Rows that repeat an id are drawn one by one. Null sources are a source of their own.
    """
    base = sized.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size")
    )
    base = save(base.withColumn("h", F.xxhash64("id", "source", "size")))
    plan = save(targets(base, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = plan.select(F.col("source").alias("named"), "sid", "source_size", "target", rate.alias("rate"), "rows")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("long")
    rows = base.join(known, F.col("source").eqNullSafe(F.col("named"))).select(
        "id", "sid", F.pmod("h", blocks).cast("int").alias("block"), "size", "h", (F.col("rate") - F.floor("rate")).alias("part")
    )
    whole = [0.0, 1.0]
    now = save(_pivot(rows))
    done, left = now.where(F.col("part").isin(whole)), now.where(~F.col("part").isin(whole))
    steps = plan.agg(F.max(blocks)).first()[0] or 1
    while steps > 1:
        up = left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int")).withColumn("h", F.xxhash64("h", "block"))
        now = save(_pivot(up))
        done = done.unionByName(now.where(F.col("part").isin(whole)))
        left, steps = now.where(~F.col("part").isin(whole)), -(-steps // FAN_IN)
    draw = F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 53)) / float(1 << 53)
    done = done.unionByName(left.withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0)))
    copies = (F.floor("rate") + F.col("part")).cast("int")
    return done.join(known, "sid").select(
        F.col("id").alias(id_col), F.col("named").alias("source"), "size", F.col("source_size").cast("long"), "target",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, each as often as the mix takes it.

    Rows that share id and size share their copies: all get the whole part of the mean, the first by text hash one more.
    """
    sized = docs.withColumn("_size", word_count(text_col))
    mixed = mix(sized, id_col, source_col, "_size")
    key = F.xxhash64(F.col(id_col)).alias("_key")
    counts = mixed.groupBy(key, F.col("size").alias("_size")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    near = Window.partitionBy("_key", "_size").orderBy(F.xxhash64(text_col))
    more = F.when(F.row_number().over(near) <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    times = (F.floor(F.col("_copies") / F.col("_rows")) + more).cast("int")
    every = sized.withColumn("_key", key).join(counts, ["_key", "_size"]).withColumn("_times", times)
    return every.where("_times > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), "_times")).alias("_copy")).select(*docs.columns)
