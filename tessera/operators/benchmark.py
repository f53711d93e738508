"""A benchmark run: truth against predictions, all metrics in one table (C4).

Checks are one row a truth, made by left joins with the last prediction of its key; every
metric is an aggregate of a checks table with map-side partial sums.  A metric without
observations is unavailable with a null value, never 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators.numbering import nearest_ranks

UNIT = "fraction"
_COLUMNS = ("metric", "part", "status", "value", "numerator", "denominator", "unit")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _expected(kind: str) -> Column:
    from tessera.operators.rules import truth_identity

    return truth_identity(F.col("engine_id"), kind, F.col("stable_id"), F.col("legacy"))


def hero_checks(truth: DataFrame, predictions: DataFrame, order: list[Column]) -> DataFrame:
    """truth: sample_id, team, row, stable_id, legacy, unknown, critical, engine_id, depth;
    predictions: class_id, status, confidence, candidates of the same keys (A4, A5, A9)."""
    rows = E.truth_checks(truth.withColumn("expected", _expected("hero")), predictions, ["sample_id", "team", "row"], order)
    known = _yes((F.col("status") == "ok") & F.col("class_id").isNotNull())
    hit = known & _yes(F.col("class_id") == F.col("expected"))
    in_three = _yes(F.array_contains(F.slice("candidates", 1, 3), F.col("expected")))
    return rows.select("sample_id", F.lit("hero").alias("kind"), "expected", "critical", "confidence", "depth", F.col("unknown").alias("is_unknown"), known.alias("known"), F.when(F.col("unknown"), ~known).otherwise(hit).alias("correct"), in_three.alias("in_three"), F.lit(None).cast("boolean").alias("occupancy_match"), F.lit(True).alias("occupied"))


def item_checks(truth: DataFrame, predictions: DataFrame, order: list[Column]) -> DataFrame:
    """As hero_checks, by slot and with occupancy: a missing prediction is ``unknown``; what is
    not occupied is right if its occupancy is (A7, A8)."""
    t = truth.withColumn("expected", _expected("item")).withColumnRenamed("occupancy", "true_occupancy")
    rows = E.truth_checks(t, predictions, ["sample_id", "team", "row", "slot"], order)
    known = _yes((F.col("status") == "ok") & F.col("class_id").isNotNull())
    same = F.coalesce("occupancy", F.lit("unknown")) == F.col("true_occupancy")
    occupied = F.col("true_occupancy") == "occupied"
    right = F.when(~occupied, same).when(F.col("unknown"), ~known).otherwise(known & _yes(F.col("class_id") == F.col("expected")))
    in_three = _yes(F.array_contains(F.slice("candidates", 1, 3), F.col("expected")))
    return rows.select("sample_id", F.lit("item").alias("kind"), "expected", "critical", "confidence", "depth", F.col("unknown").alias("is_unknown"), known.alias("known"), right.alias("correct"), in_three.alias("in_three"), same.alias("occupancy_match"), occupied.alias("occupied"))


def value_text(kind: Column, text: Column, number: Column) -> Column:
    """A value as the text that readings are compared by; empty for none."""
    return F.coalesce(F.when(kind == "int", number.cast("long").cast("string")).when(kind == "bool", F.when(number == 1, "True").otherwise("False")).when(kind == "float", number.cast("string")).when(kind == "str", text), F.lit(""))


def field_checks(truth: DataFrame, predictions: DataFrame, order: list[Column]) -> DataFrame:
    """truth: sample_id, field, team, row, value_type, value_str, value_num, raw, status,
    critical; predictions: the same values and confidence (A10 to A14).

    The text is the truth's raw reading where it is given, else its value."""
    keys = ["sample_id", "field", "team", "row"]
    names = ("value_type", "value_str", "value_num", "status", "confidence")
    p = E.last_by(predictions, keys, order).select(*keys, *[F.col(c).alias(f"p_{c}") for c in names], F.lit(True).alias("matched"))
    rows = E.null_safe_join(truth, p, keys).withColumn("matched", _yes(F.col("matched")))
    read = F.col("status") == "ok"
    said = F.col("p_value_type").isNotNull() & (F.col("p_value_type") != "none")
    text = F.when(said, value_text(F.col("p_value_type"), F.col("p_value_str"), F.col("p_value_num"))).otherwise("")
    want = F.coalesce("raw", value_text(F.col("value_type"), F.col("value_str"), F.col("value_num")))
    given = _yes(F.col("p_status") == "ok")
    numeric = read & F.col("value_type").isin("int", "float")
    zero = _yes(said & F.col("p_value_type").isin("int", "float", "bool") & (F.col("p_value_num") == 0))
    equal = E.exact_value(F.col("value_type"), F.col("value_str"), F.col("value_num"), F.col("p_value_type"), F.col("p_value_str"), F.col("p_value_num"))
    absent = F.coalesce(F.col("value_type") == "none", F.lit(True))
    return rows.select(
        "sample_id", "critical", F.col("p_confidence").alias("confidence"), read.alias("read"), F.when(read, given & (text == want)).otherwise(~given).alias("correct"),
        F.when(read, F.levenshtein(want, text)).alias("edits"), F.when(read, F.length(want)).alias("characters"), numeric.alias("numeric"), (numeric & F.col("matched") & _yes(equal)).alias("number_right"),
        (numeric & (F.col("value_num") == 0) & ~said).alias("zero_missing"), (F.when(read, absent).otherwise(True) & zero).alias("missing_zero"),
    )


def _ratio(name: str, numerator: Column, denominator: Column, unit: str = UNIT, part: str | None = None) -> Column:
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.struct(F.lit(name).alias("metric"), F.lit(part).cast("string").alias("part"), E.ratio_status(d).alias("status"), E.ratio(n, d).alias("value"), n.alias("numerator"), d.alias("denominator"), F.lit(unit).alias("unit"))


def _value(name: str, part: str, value: Column, denominator: Column, unit: str) -> Column:
    d = denominator.cast("double")
    return F.struct(F.lit(name).alias("metric"), F.lit(part).cast("string").alias("part"), F.when(d > 0, "available").otherwise("unavailable").alias("status"), F.when(d > 0, value.cast("double")).alias("value"), F.lit(None).cast("double").alias("numerator"), d.alias("denominator"), F.lit(unit).alias("unit"))


def _rows(df: DataFrame, metrics: list[Column]) -> DataFrame:
    return df.agg(F.array(*metrics).alias("_m")).select(F.explode("_m").alias("_x")).select("_x.*")


def _by_class(checks: DataFrame, name: str) -> DataFrame:
    """Recall by expected class, and (part null) over all."""
    rows = checks.where("occupied and not is_unknown and expected is not null").rollup("expected").agg(F.count_if("correct").alias("n"), F.count("*").alias("d"))
    return rows.select(_ratio(name, F.col("n"), F.col("d")).alias("_x"), "expected").select(F.col("_x.metric"), F.col("expected").alias("part"), *[F.col(f"_x.{c}") for c in _COLUMNS[2:]])


def benchmark(geometry: DataFrame, heroes: DataFrame, items: DataFrame, fields: DataFrame, samples: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """metric, part, status, value, numerator, denominator, unit of a run.

    geometry: sample_id, correct, edge_error, edges; heroes, items, fields: checks; samples:
    sample_id, expected_json and predicted_json (null: none expected), latency_ms,
    peak_memory_mib; dimensions: slices of samples by name.
    """
    entities = heroes.unionByName(items)
    known = F.col("occupied") & ~F.col("is_unknown")
    unknown = F.col("occupied") & F.col("is_unknown")

    def top(kind: str) -> tuple[Column, Column, Column]:
        mine = known & (F.col("kind") == kind)
        deep = _yes(F.min(F.when(mine, F.col("depth"))) >= 3)
        return mine, F.when(deep, F.count_if(mine & F.col("in_three"))).otherwise(0), F.when(deep, F.count_if(mine)).otherwise(0)

    hero, hero_hits, hero_total = top("hero")
    item, item_hits, item_total = top("item")
    is_item = F.col("kind") == "item"
    identity = _rows(entities, [
        _ratio("hero_top1_accuracy", F.count_if(hero & F.col("correct")), F.count_if(hero)), _ratio("hero_top3_accuracy", hero_hits, hero_total),
        _ratio("item_top1_accuracy", F.count_if(item & F.col("correct")), F.count_if(item)), _ratio("item_top3_accuracy", item_hits, item_total),
        _ratio("item_occupancy_accuracy", F.count_if(is_item & F.col("occupancy_match")), F.count_if(is_item)),
        _ratio("unknown_false_accept_rate", F.count_if(unknown & F.col("known")), F.count_if(unknown)), _ratio("unknown_false_reject_rate", F.count_if(known & ~F.col("known")), F.count_if(known)),
    ])
    read = F.count_if("read")
    reading = _rows(fields, [
        _ratio("ocr_exact_sequence_accuracy", F.count_if(F.col("read") & F.col("correct")), read), _ratio("ocr_character_error_rate", F.coalesce(F.sum("edits"), F.lit(0)), F.coalesce(F.sum("characters"), F.lit(0)), "edits_per_character"),
        _ratio("numeric_exact_value_accuracy", F.count_if("number_right"), F.count_if("numeric")),
        _value("zero_missing_confusion", "true_zero_predicted_missing", F.count_if("zero_missing"), read, "count"), _value("zero_missing_confusion", "missing_predicted_zero", F.count_if("missing_zero"), read, "count"),
    ])
    shape = _rows(geometry, [_ratio("geometry_success", F.count_if("correct"), F.count("*")), _value("normalized_coordinate_error", None, F.sum("edge_error") / F.sum("edges"), F.coalesce(F.sum("edges"), F.lit(0)), "fraction_of_source_height")])
    judged = entities.select("sample_id", "critical", "confidence", "correct").unionByName(fields.select("sample_id", "critical", "confidence", "correct"))
    critical = judged.where("critical").groupBy("sample_id").agg(F.bool_and("correct").alias("critical_exact"))
    rows = samples.join(critical, "sample_id", "left").withColumn("json_exact", F.when(F.col("expected_json").isNotNull(), F.col("expected_json").eqNullSafe(F.col("predicted_json"))))
    whole = _rows(rows, [
        _ratio("critical_field_exact_match", F.count_if("critical_exact"), F.count("critical_exact")), _ratio("full_json_exact_match", F.count_if("json_exact"), F.count("json_exact")),
        _value("latency", "mean_ms", F.avg("latency_ms"), F.count("latency_ms"), "milliseconds_per_screenshot"), _value("latency", "max_ms", F.max("latency_ms"), F.count("latency_ms"), "milliseconds_per_screenshot"),
        _value("memory", "mean_peak_mib", F.avg("peak_memory_mib"), F.count("peak_memory_mib"), "mebibytes_peak_rss"), _value("memory", "max_peak_mib", F.max("peak_memory_mib"), F.count("peak_memory_mib"), "mebibytes_peak_rss"),
    ])
    ranks = nearest_ranks(samples.select(F.lit(1).alias("_k"), "latency_ms"), ["_k"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    ranks = _rows(ranks, [_value("latency", p, F.max(p), F.lit(1), "milliseconds_per_screenshot") for p in ("p50_ms", "p95_ms")]).withColumn("denominator", F.lit(None).cast("double"))
    events = judged.where("confidence is not null")
    calibration = _rows(E.calibration_summary(E.calibration_bins(events, F.col("confidence"), F.col("correct"))), [_value("confidence_calibration", p, F.max(p), F.max(F.coalesce("n", F.lit(0))), "probability") for p in ("ece", "brier")])
    selective = E.selective_accuracy(events, F.col("confidence"), F.col("correct"))
    selective = selective.select(F.explode(F.array(*[F.struct(F.lit("selective_accuracy").alias("metric"), F.concat(F.lit(f"{p}@"), "threshold").alias("part"), F.when(F.col("total") > 0, "available").otherwise("unavailable").alias("status"), F.when(F.col("total") > 0, F.col(p)).alias("value"), F.col(n).cast("double").alias("numerator"), F.col(m).cast("double").alias("denominator"), F.lit(UNIT).alias("unit")) for p, n, m in (("coverage", "accepted", "total"), ("accuracy", "correct", "accepted"))])).alias("_x")).select("_x.*")
    outcome = rows.withColumn("_o", F.coalesce("critical_exact", "json_exact")).where("_o is not null")
    slices = E.sliced(outcome, dimensions, F.col("_o")).select(F.lit("slices").alias("metric"), F.concat_ws("=", "dimension", "value").alias("part"), F.lit("available").alias("status"), F.col("accuracy").alias("value"), F.col("numerator").cast("double").alias("numerator"), F.col("denominator").cast("double").alias("denominator"), F.lit("accuracy_by_slice").alias("unit"))
    parts = [shape, identity, _by_class(heroes, "hero_per_class_recall"), _by_class(items, "item_per_class_recall"), reading, whole, ranks, calibration, selective, slices]
    return reduce(DataFrame.unionByName, [p.select(*_COLUMNS) for p in parts])
