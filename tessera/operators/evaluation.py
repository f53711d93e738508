"""Ground truth against predictions: checks, ratios, calibration, selective accuracy, slices.

A metric always carries its numerator and denominator; one that cannot be computed is
``unavailable`` with a null value, never 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import aspect, ratio, ratio_status

#: Accepted-confidence thresholds of selective accuracy.
THRESHOLDS = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99)
#: Names of a run's metrics.
METRICS = ("geometry_success", "normalized_coordinate_error", "hero_top1_accuracy", "hero_top3_accuracy", "hero_per_class_recall", "item_top1_accuracy", "item_top3_accuracy", "item_occupancy_accuracy", "item_per_class_recall", "unknown_false_accept_rate", "unknown_false_reject_rate", "ocr_exact_sequence_accuracy", "ocr_character_error_rate", "numeric_exact_value_accuracy", "zero_missing_confusion", "confidence_calibration", "full_json_exact_match", "critical_field_exact_match", "latency", "memory", "selective_accuracy", "slices")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in order: what a dict built row by row would hold."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def truth_checks(truth: DataFrame, predictions: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every truth row with its last prediction, if any; ``matched`` says whether there is one."""
    pred = last_by(predictions, keys, order).withColumn("matched", F.lit(True))
    return null_safe_join(truth, pred, keys).withColumn("matched", F.coalesce("matched", F.lit(False)))


def exact_value(a_type: Column, a_str: Column, a_num: Column, b_type: Column, b_str: Column, b_num: Column) -> Column:
    """Equality of union-typed values: bool only with bool, int with float by number, else same type."""
    numeric = a_type.isin("int", "float") & b_type.isin("int", "float")
    same = a_type == b_type
    return F.coalesce(F.when(numeric, a_num == b_num).when(same & (a_type == "bool"), a_num == b_num).when(same, a_str.eqNullSafe(b_str)), F.lit(False))


def metric_row(name: str, numerator: Column, denominator: Column, unit: str = "ratio") -> Column:
    """One metric as a struct with status, value, numerator, denominator, unit (A1)."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.struct(F.lit(name).alias("metric"), ratio_status(d).alias("status"), ratio(n, d).alias("value"), n.alias("numerator"), d.alias("denominator"), F.lit(unit).alias("unit"))


def metric_table(df: DataFrame, metrics: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """All metrics of a checks table in one aggregation, as rows.

    A metric's numerator and denominator are aggregate columns, so one pass with
    map-side partial sums serves every metric.
    """
    grouped = df.groupBy(*by).agg(F.array(*metrics).alias("_m"))
    return grouped.select(*by, F.explode("_m").alias("_x")).select(*by, "_x.*")


def all_metrics(found: DataFrame, reason: str) -> DataFrame:
    """Every metric name; those without a row are unavailable for the given reason."""
    names = found.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    return names.join(found, "metric", "left").withColumn("status", F.coalesce("status", F.lit("unavailable"))).withColumn("reason", F.when(F.col("status") == "unavailable", F.lit(reason)))


def per_class_recall(df: DataFrame, by: str, correct: Column) -> DataFrame:
    """Recall by class with its micro total (class null, ``is_total``) from one grouping."""
    rolled = df.rollup(by).agg(F.grouping(by).alias("is_total"), F.count_if(correct).alias("numerator"), F.count("*").alias("denominator"))
    return rolled.select(F.col(by).alias("class"), "is_total", "numerator", "denominator", ratio(F.col("numerator").cast("double"), F.col("denominator")).alias("recall"))


def calibration_bins(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins [i/n, (i+1)/n), the last closed; empty bins are absent.

    Bounds are compared as the same i/n doubles, never by floor(n * confidence).
    """
    bin_of = F.lit(0)
    for i in range(1, bins):
        bin_of = bin_of + (confidence >= F.lit(i / bins)).cast("int")
    return (
        df.select(bin_of.alias("bin"), confidence.alias("_c"), correct.cast("double").alias("_y"))
        .where("_c is not null and _c between 0 and 1")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg("_c").alias("mean_confidence"), F.avg("_y").alias("accuracy"), F.sum(F.pow(F.col("_c") - F.col("_y"), 2)).alias("squared_error"))
    )


def calibration_summary(binned: DataFrame) -> DataFrame:
    """Expected calibration error and Brier score from the bins."""
    n = F.sum("n")
    return binned.agg(n.alias("n"), (F.sum(F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")) / n).alias("ece"), (F.sum("squared_error") / n).alias("brier"))


def selective_accuracy(df: DataFrame, confidence: Column, correct: Column, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Accepted, coverage and accuracy (0 if none) at each threshold, in one pass."""
    accepted = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(confidence >= t).alias("accepted"), F.count_if((confidence >= t) & correct).alias("correct"), F.count("*").alias("total")) for t in thresholds]
    one = df.agg(F.array(*accepted).alias("_a")).select(F.explode("_a").alias("_x")).select("_x.*")
    return one.withColumn("coverage", ratio(F.col("accepted").cast("double"), F.col("total"))).withColumn("accuracy", F.coalesce(ratio(F.col("correct").cast("double"), F.col("accepted")), F.lit(0.0)))


def nearest_rank(values: str, share: float) -> Column:
    """Nearest-rank percentile of a named column."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{values}`)")


def character_error_rate(expected: Column, read: Column) -> tuple[Column, Column]:
    """(edits, characters): micro-averaged Levenshtein."""
    return F.sum(F.levenshtein(F.coalesce(read, F.lit("")), expected)), F.sum(F.length(expected))


def supported_top_k(depth: Column, k: int, hits: Column, total: Column) -> tuple[Column, Column]:
    """(numerator, denominator), both 0 if any sample gives fewer than k candidates (A5)."""
    ok = F.bool_and(depth >= k)
    return F.when(ok, hits).otherwise(0), F.when(ok, total).otherwise(0)


def sliced(df: DataFrame, dimensions: dict[str, Column], correct: Column) -> DataFrame:
    """Outcome by each dimension on its own: an unpivot and one grouping.

    Rows without a value in a dimension are left out of it.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dimensions.items()])
    long = df.select(F.explode(pairs).alias("_p"), correct.alias("_y")).where("_p.value is not null")
    return long.groupBy("_p.dimension", "_p.value").agg(F.count_if("_y").alias("numerator"), F.count("*").alias("denominator")).withColumn("accuracy", ratio(F.col("numerator").cast("double"), F.col("denominator")))


def all_critical(df: DataFrame, sample: str, critical: Column, correct: Column) -> DataFrame:
    """Samples whose critical checks are all right, over samples that have any."""
    one = df.where(critical).groupBy(sample).agg(F.bool_and(correct).alias("_ok"))
    return one.agg(F.count_if("_ok").alias("numerator"), F.count("*").alias("denominator")).withColumn("value", ratio(F.col("numerator").cast("double"), F.col("denominator")))


def zero_missing(df: DataFrame, expected: Column, read: Column) -> DataFrame:
    """How often a true zero is read as missing and a missing value as zero."""
    zero, gone = F.count_if(expected == 0), F.count_if(expected.isNull())
    return df.agg(F.count_if((expected == 0) & read.isNull()).alias("zero_to_missing"), zero.alias("zeros"), F.count_if(expected.isNull() & (read == 0)).alias("missing_to_zero"), gone.alias("missing"))


def geometry_success(truth: DataFrame, predictions: DataFrame, sample: str, keys: Sequence[str], start: str, end: str, height: str) -> DataFrame:
    """By sample: whether every truth row has a prediction and the counts agree, and the
    summed edge errors over the image height (A2, A3)."""
    counts = predictions.groupBy(sample).agg(F.count("*").alias("_n_pred"))
    pred = predictions.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(True).alias("_hit"))
    rows = null_safe_join(truth, pred, keys)
    error = (F.abs(F.col("_s") - F.col(start)) + F.abs(F.col("_e") - F.col(end))) / F.col(height)
    by = rows.groupBy(sample).agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("_all"), F.count("*").alias("_n"), F.sum(error).alias("edge_error"), (2 * F.count_if(F.col("_hit"))).alias("edges"))
    return by.join(counts, sample, "left").select(sample, (F.col("_all") & (F.coalesce("_n_pred", F.lit(0)) == F.col("_n"))).alias("correct"), "edge_error", "edges")


def aspect_of(width: Column, height: Column) -> Column:
    return aspect(width, height)


def canonical_json(value: Column) -> Column:
    """Compact JSON with keys in order, of a map of strings."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def run_gate(invalid: Column, samples: Column, unapproved: Column, damaged: Column, failed: Column) -> Column:
    """A run's status, first gate that holds."""
    return F.when(invalid > 0, "blocked").when(samples == 0, "no_data").when(unapproved > 0, "blocked").when(damaged > 0, "blocked").when(failed > 0, "blocked").otherwise("completed")


def approval_gate(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether all samples (of a dataset) are approved, and the sorted offenders."""
    bad = F.when(F.col("approval") != "approved", F.col("sample_id"))
    return samples.groupBy(*by).agg(F.coalesce(F.bool_and(F.col("approval") == "approved"), F.lit(False)).alias("approved"), F.concat_ws(", ", F.array_sort(F.collect_list(bad))).alias("offenders"))
