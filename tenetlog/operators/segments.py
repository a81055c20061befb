"""Ordered work per key, cut into position segments.

Log positions are dense and unique, so the rows of one key inside one segment of
``size`` positions are at most ``size``, however hot the key is. Windows run over
(key, segment); what a segment needs from earlier ones travels as one small row
per (key, segment). No task ever holds a whole hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT_ROWS = 65_536
NUMBERED_ROWS = 4_096     # whole rows, texts included, that are numbered in one place


def segment_of(position: Column, size: int = SEGMENT_ROWS) -> Column:
    return F.floor((position - 1) / F.lit(size))


def running_max(df: DataFrame, keys, value: Column, out: str, *, inclusive: bool = False,
                position: str = "log_position", size: int = SEGMENT_ROWS,
                base: DataFrame | None = None) -> DataFrame:
    """Greatest ``value`` among the key's earlier rows (and this row if inclusive).

    ``base``: the rows before other windows were added, for the carried part.
    """
    keys = list(keys)
    source = (df if base is None else base).withColumn(
        "_segment", segment_of(F.col(position), size)).withColumn("_value", value)
    parts = df.withColumn("_segment", segment_of(F.col(position), size)).withColumn("_value", value)
    rows = Window.partitionBy(*keys, "_segment").orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = (source.groupBy(*keys, "_segment").agg(F.max("_value").alias("_top"))
               .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       F.col("_segment").alias("_s"), F.max("_top").over(earlier).alias("_carried"))
               .where(F.col("_carried").isNotNull()))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    local = parts.withColumn("_local", F.max("_value").over(rows))
    joined = local.join(carried, reduce(lambda a, b: a & b, on, F.col("_segment") == F.col("_s")), "left")
    return (joined.withColumn(out, F.greatest("_local", "_carried"))
            .select(*df.columns, out))


def ordinals(df: DataFrame, keys, out: str, *, position: str = "log_position",
             size: int = SEGMENT_ROWS) -> DataFrame:
    """1-based rank of each row within its key, in log order."""
    keys = list(keys)
    parts = df.withColumn("_segment", segment_of(F.col(position), size))
    rows = Window.partitionBy(*keys, "_segment").orderBy(position)
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = (parts.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_n"))
               .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       F.col("_segment").alias("_s"), F.sum("_n").over(earlier).alias("_before"))
               .where(F.col("_before").isNotNull()))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = parts.withColumn("_local", F.row_number().over(rows)).join(
        carried, reduce(lambda a, b: a & b, on, F.col("_segment") == F.col("_s")), "left")
    return (joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
            .select(*df.columns, out))


def neighbour(df: DataFrame, keys, columns: dict[str, str], *, forward: bool,
              position: str = "log_position", size: int = SEGMENT_ROWS) -> DataFrame:
    """Add columns of the key's previous (or next) row: ``{out: source}``."""
    keys = list(keys)
    parts = df.withColumn("_segment", segment_of(F.col(position), size))
    packed = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    rows = Window.partitionBy(*keys, "_segment").orderBy(position)
    edge_pick = F.min_by if forward else F.max_by
    edges = parts.groupBy(*keys, "_segment").agg(edge_pick(packed, F.col(position)).alias("_edge"))
    along = Window.partitionBy(*keys).orderBy("_segment")
    step = F.lead if forward else F.lag
    carried = (edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                            F.col("_segment").alias("_s"), step("_edge").over(along).alias("_carried"))
               .where(F.col("_carried").isNotNull()))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    local = parts.withColumn("_local", step(packed).over(rows))
    joined = local.join(carried, reduce(lambda a, b: a & b, on, F.col("_segment") == F.col("_s")), "left")
    picked = F.coalesce("_local", "_carried")
    return joined.select(*df.columns, *[picked[out].alias(out) for out in columns])


def predecessor(df: DataFrame, columns: dict[str, str], *, position: str = "log_position",
                size: int = SEGMENT_ROWS) -> DataFrame:
    """Columns of the row one log position earlier, over the whole log.

    One shuffle by segment; only each segment's last row crosses a boundary.
    """
    parts = df.withColumn("_segment", segment_of(F.col(position), size))
    packed = F.struct(F.col(position).alias("_at"), *[F.col(src).alias(out) for out, src in columns.items()])
    rows = Window.partitionBy("_segment").orderBy(position)
    last = (parts.groupBy("_segment").agg(F.max_by(packed, F.col(position)).alias("_edge"))
            .select((F.col("_segment") + 1).alias("_s"), "_edge"))
    joined = parts.withColumn("_local", F.lag(packed).over(rows)).join(
        last, F.col("_segment") == F.col("_s"), "left")
    picked = F.coalesce("_local", "_edge")
    adjacent = picked["_at"] == F.col(position) - 1
    return joined.select(*df.columns, *[F.when(adjacent, picked[out]).alias(out) for out in columns])


def dense_positions(df: DataFrame, order: str, out: str = "log_position", start=0,
                    size: int = NUMBERED_ROWS) -> DataFrame:
    """Dense positions after ``start`` in the order of a unique, non-negative LONG column.

    Two passes: counts per segment give each segment's offset. Only the counts,
    one row per segment, meet in one place.
    """
    parts = df.withColumn("_segment", F.floor(F.col(order) / F.lit(size)))
    counts = parts.groupBy("_segment").agg(F.count(F.lit(1)).alias("_n"))
    # Offsets of the segment counts themselves, again in two levels.
    block = F.floor(F.col("_segment") / F.lit(size))
    blocks = (counts.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_bn"))
              .withColumn("_boff", F.coalesce(F.sum("_bn").over(
                  Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    offsets = (counts.withColumn("_block", block)
               .withColumn("_soff", F.coalesce(F.sum("_n").over(
                   Window.partitionBy("_block").orderBy("_segment")
                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .join(blocks, "_block")
               .select("_segment", (F.col("_soff") + F.col("_boff")).alias("_offset")))
    rank = F.row_number().over(Window.partitionBy("_segment").orderBy(order))
    base = start if isinstance(start, Column) else F.lit(start)
    return (parts.withColumn("_rank", rank).join(offsets, "_segment")
            .withColumn(out, (base + F.col("_offset") + F.col("_rank")).cast("long"))
            .drop("_segment", "_rank", "_offset"))
