"""Review queues: exceptions, repeated truth, counts, balanced samples, sectioned truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evaluation import null_safe_join


def exceptions(branches: Sequence[tuple[DataFrame, Column]], keys: Sequence[str]) -> DataFrame:
    """Rows that any branch finds, with their distinct reasons, sorted and joined."""
    out = None
    for rows, reason in branches:
        one = rows.select(*keys, reason.alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(F.concat_ws("; ", F.array_sort(F.collect_set("reason"))).alias("reasons"))


def warning_rows(warnings: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Rows that a warning names as ``side.rowN.``; without a row, all rows of the side."""
    w = warnings.select("*", F.regexp_extract(text, r"^(\w+)\.", 1).alias("_side"), F.regexp_extract(text, r"\.row(\d+)\.", 1).try_cast("int").alias("_row"))
    named = rows.join(w.where("_row is not null"), (rows["side"] == F.col("_side")) & (rows["row"] == F.col("_row")))
    whole = rows.join(w.where("_row is null"), rows["side"] == F.col("_side"))
    return named.unionByName(whole).drop("_side", "_row")


def repeated_truth(records: DataFrame, key: Sequence[str], record: str, truth: str, reviewed: str) -> DataFrame:
    """For each record, the truth that all *other* reviewed records of its key agree on.

    Of each key's values only the least and the greatest matter, and whether there are more:
    without its own row a record's value is left if another record has it too.
    """
    by_value = records.groupBy(*key, truth).agg(F.count("*").alias("_n"))
    given = F.col(truth).isNotNull()
    per_key = by_value.groupBy(*key).agg(F.count_if(given).alias("_values"), F.min(truth).alias("_low"), F.max(truth).alias("_high"), F.min_by("_n", truth).alias("_n_low"), F.max_by("_n", truth).alias("_n_high"))
    joined = null_safe_join(records, per_key, list(key))
    own = F.col(truth)
    alone = (own.eqNullSafe(F.col("_low")) & (F.col("_n_low") == 1)) | (own.eqNullSafe(F.col("_high")) & (F.col("_n_high") == 1))
    other = F.when(own.eqNullSafe(F.col("_low")), F.col("_high")).otherwise(F.col("_low"))
    agreed = F.when(F.col("_values") == 1, F.when(own.isNull() | ~alone, F.col("_low"))).when((F.col("_values") == 2) & alone, other)
    return joined.select(*records.columns, agreed.alias("repeated_truth"))


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Counts for every value of the dimension, 0 where there are none."""
    return dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def completed(decisions: DataFrame, decision: str) -> DataFrame:
    """Whether no record is pending or skipped."""
    return decisions.agg(F.bool_and(~F.col(decision).isin("pending", "skip")).alias("complete"), F.count("*").alias("records"))


def next_unfinished(records: DataFrame, index: str, unfinished: Column, start: int) -> DataFrame:
    """The first unfinished record from ``start`` on, wrapping around."""
    return records.where(unfinished).orderBy((F.col(index) < start).cast("int"), index).limit(1)


def retain_last(df: DataFrame, order: Sequence[str], keep: int = 64) -> DataFrame:
    """The last ``keep`` rows by order: a bounded top-k."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(keep)


def balanced_sample(df: DataFrame, entity: str, side: str, order: Sequence[str], cap: int) -> DataFrame:
    """Up to ``cap`` rows of each entity: half from each side first, then the rest in order."""
    in_side = Window.partitionBy(entity, side).orderBy(*order)
    ranked = df.withColumn("_s", F.row_number().over(in_side)).withColumn("_p", (F.col("_s") > cap // 2).cast("int"))
    # Rows past the cap of their own side can never be drawn.
    ranked = ranked.where(F.col("_s") <= cap)
    whole = Window.partitionBy(entity).orderBy("_p", *order)
    return ranked.withColumn("pick", F.row_number().over(whole)).where(F.col("pick") <= cap).drop("_s", "_p")


def section_fill(lines: DataFrame, source: str, number: str, text: str) -> DataFrame:
    """``[SECTION]`` headers carried down to their ``key: value`` lines."""
    header = F.nullif(F.regexp_extract(text, r"^\s*\[([A-Z0-9_]+)\]\s*$", 1), F.lit(""))
    w = Window.partitionBy(source).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_h", header).withColumn("section", F.last("_h", ignorenulls=True).over(w))
    pair = r"^\s*([^:\[\]]+?)\s*:\s*(.*?)\s*$"
    return rows.where(F.col("_h").isNull() & F.col(text).rlike(pair)).select(source, number, "section", F.regexp_extract(text, pair, 1).alias("key"), F.regexp_extract(text, pair, 2).alias("value"))


def stale_sources(recorded: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """Sources whose digests differ, either way."""
    a = recorded.select(F.col(key), F.col(digest).alias("recorded"))
    b = present.select(F.col(key), F.col(digest).alias("present"))
    return a.join(b, key, "full_outer").where(~F.col("recorded").eqNullSafe(F.col("present")))


def truth_majority(df: DataFrame, key: Sequence[str], value: str, needed: int = 4, of: int = 5) -> DataFrame:
    """Unanimous value, else one with ``needed`` of exactly ``of``, else an error."""
    by = df.groupBy(*key, value).agg(F.count("*").alias("_n")).groupBy(*key).agg(F.max_by(F.struct(value, "_n"), F.struct("_n", value)).alias("_m"), F.sum("_n").alias("total"), F.count("*").alias("values"))
    ok = (F.col("values") == 1) | ((F.col("total") == of) & (F.col("_m._n") >= needed))
    return by.select(*key, F.when(ok, F.col(f"_m.{value}")).alias(value), F.col("_m._n").alias("support"), "total", F.when(ok, "ok").otherwise("conflict").alias("status"))


def both_sides_complete(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side lacks, nulls matching nulls."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    return l.join(r, on(l, r), "left_anti").withColumn("missing_in", F.lit("right")).unionByName(r.join(l, on(r, l), "left_anti").withColumn("missing_in", F.lit("left")))


def semantic_warnings(items: DataFrame, heroes: DataFrame, special_hero: str, special_item: str) -> DataFrame:
    """A seven-item row needs the special hero and item; the special hero needs exactly one such row."""
    rows = items.groupBy("side", "row").agg(F.count("*").alias("n"), F.max((F.col("item_id") == special_item).cast("int")).alias("has_item"))
    rows = rows.join(heroes, ["side", "row"], "left")
    seven = rows.where("n = 7")
    lacking = seven.where((F.coalesce("hero_id", F.lit("")) != special_hero)).select(F.concat_ws(".", "side", F.concat(F.lit("row"), "row"), F.lit("seven_items_without_hero")).alias("warning"))
    without = seven.where("has_item = 0").select(F.concat_ws(".", "side", F.concat(F.lit("row"), "row"), F.lit("seven_items_without_item")).alias("warning"))
    sides = rows.groupBy("side").agg(F.count_if(F.col("hero_id") == special_hero).alias("h"), F.count_if(F.col("n") == 7).alias("s"))
    wrong = sides.where("h > 0 and s <> 1").select(F.concat_ws(".", "side", F.lit("special_hero_rows_disagree")).alias("warning"))
    return lacking.unionByName(without).unionByName(wrong).distinct()
