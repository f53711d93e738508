"""Global order without a single task: row numbers by ranges, percentiles by counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_root

#: Equal parts of a key's range of values that are counted first.
PARTS = 65_536


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that two readers read the same rows."""
    spark, path = df.sparkSession, f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Adds 0..n-1 in the order of the columns (nulls first): rows are sorted by ranges, and
    each range's first number is the rows before it, from one row a range."""
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    firsts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_at")


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """Nearest-rank percentiles of each key by name.

    Values are counted first; a key's counts by equal parts of its range say which part holds
    the rank, and only that part's values are put in order: a key with most rows is no one
    task's values.
    """
    counts = saved(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")
    bounds = counts.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("_n"))
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.least(F.lit(parts - 1), F.floor((F.col("_v") - F.col("_low")) / width * parts))).otherwise(F.lit(0)).cast("long")
    dealt = counts.join(bounds, list(keys)).withColumn("_part", part)
    by_part = dealt.groupBy(*keys, "_part", "_n").agg(F.sum("_c").alias("_c"))
    so_far = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part"))  # at most `parts` rows a key
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(s)).alias("share")) for k, s in shares.items()]))
    held = by_part.withColumn("_end", so_far).select(*keys, "_part", "_n", "_c", "_end", ranks.alias("_r")).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_r.share") * F.col("_n"))))
    held = held.where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_c"))).select(*keys, "_part", F.col("_r.name").alias("_name"), (F.col("_rank") - (F.col("_end") - F.col("_c"))).alias("_inside"))
    inside = dealt.select(*keys, "_part", "_v", "_c").join(held, [*keys, "_part"])
    reached = F.sum("_c").over(Window.partitionBy(*keys, "_part", "_name").orderBy("_v"))
    found = inside.withColumn("_end", reached).where(F.col("_end") >= F.col("_inside"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in shares])
