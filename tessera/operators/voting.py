"""Votes over repeated readings, and consensus over repeated observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import parse_readings


def reading_votes(df: DataFrame, crop: Sequence[str], text: str, confidence: str, tie: Sequence[str], longest_first: bool = False) -> DataFrame:
    """The chosen text of each crop.

    A text's score is its best confidence plus 0.05 for each further reading, within
    0..1.  Texts rank by score, then text; for levels longer texts come first.
    ``gap`` is the lead over the second text's score.
    """
    groups = df.groupBy(*crop, text).agg(F.count("*").alias("readings"), F.max(confidence).alias("best_confidence"), F.max_by(F.struct(*tie), F.struct(confidence, *tie)).alias("representative"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best_confidence") + 0.05 * (F.col("readings") - 1)))
    groups = groups.withColumn("vote", score)
    order = ([F.length(text).desc()] if longest_first else []) + [F.col("vote").desc(), F.col(text)]
    w = Window.partitionBy(*crop).orderBy(*order)
    return groups.withColumn("_r", F.row_number().over(w)).withColumn("gap", F.col("vote") - F.lead("vote").over(w)).where("_r = 1").drop("_r")


def conflict(parser: Column, gap: Column, least: float = 0.025) -> Column:
    """Two texts of an unconstrained field too close to call."""
    return F.coalesce((parser == "player_name") & (gap < least), F.lit(False))


def majority_first(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The most frequent value; ties go to the value seen first in ``order``."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("_first"))
    ranked = counts.groupBy(*key).agg(F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), "_first")).alias("_w"), F.sum("votes").alias("total"))
    return ranked.select(*key, "_w.*", "total")


def longest_first(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The longest text; ties go to the first."""
    return df.groupBy(*key).agg(F.min_by(value, F.struct(-F.length(value), *order)).alias(value))


def identifier_vote(df: DataFrame, key: Sequence[str], digits: str, order: Sequence[str], size: int = 18) -> DataFrame:
    """Majority among readings of exactly ``size`` digits, else the first longer or slightly
    shorter reading cut to size (A29)."""
    exact = majority_first(df.where(F.length(digits) == size), key, digits, order).select(*key, F.col(digits).alias("_e"))
    near = df.where(F.length(digits).between(size - 3, size + 2)).groupBy(*key).agg(F.min_by(digits, F.struct(*order)).alias("_n"))
    return df.select(*key).distinct().join(exact, list(key), "left").join(near, list(key), "left").select(*key, F.coalesce("_e", F.substring("_n", 1, size)).alias(digits))


def level_vote(df: DataFrame, key: Sequence[str], level: str) -> DataFrame:
    """Level from repeated readings (A30): repeated low digits hint at a lost leading 1.

    Three readings of one of 6..9 win; two-digit readings win if they are at least 30 %
    of the low single digits; then three equal readings; else the greatest.
    """
    counts = df.groupBy(*key, level).agg(F.count("*").alias("_n"))
    value, n = F.col(level), F.col("_n")
    by = counts.groupBy(*key).agg(
        F.min_by(F.when(value.between(6, 9) & (n >= 3), value), F.struct(-F.when(value.between(6, 9), n).otherwise(0), value)).alias("_single"),
        F.sum(F.when(value.between(0, 5), n).otherwise(0)).alias("_low"),
        F.sum(F.when(value >= 10, n).otherwise(0)).alias("_double"),
        F.min_by(F.when(value >= 10, value), F.struct(-F.when(value >= 10, n).otherwise(0), value)).alias("_best_double"),
        F.min_by(F.when(n >= 3, value), F.struct(-n, value)).alias("_agreed"),
        F.max(value).alias("_greatest"),
    )
    doubles = F.when((F.col("_double") > 0) & (F.col("_double") >= 0.3 * F.col("_low")), F.col("_best_double"))
    return by.select(*key, F.coalesce("_single", doubles, "_agreed", "_greatest").alias(level))


def weighted_confidence(length: Column, confidence: Column) -> Column:
    """Mean confidence weighted by text length, at least 1 each."""
    w = F.greatest(F.lit(1), length)
    return F.sum(w * confidence) / F.sum(w)


def consensus(observations: DataFrame, key: Sequence[str], value: Sequence[str], confidence: str, order: str, minimum: int = 2) -> DataFrame:
    """The agreed value of each key (A24): most support, then greatest confidence, then value.

    support of total observations; the best observation is that of greatest confidence,
    the first of equals.  Keys without ``minimum`` support have no row.
    """
    conf = F.coalesce(F.col(confidence), F.lit(0.0))
    by = observations.groupBy(*key, *value).agg(F.count("*").alias("support"), F.max(conf).alias("best_confidence"), F.min_by(order, F.struct(-conf, order)).alias("best_order"))
    pick = F.min_by(F.struct(*value, "support", "best_confidence", "best_order"), F.struct(-F.col("support"), -F.col("best_confidence"), *value))
    return by.groupBy(*key).agg(pick.alias("_w"), F.sum("support").alias("total")).select(*key, "_w.*", "total").where(F.col("support") >= minimum)


def apply_consensus(observations: DataFrame, agreed: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Every observation with the agreed value of its key, and a message of its support."""
    names = agreed.select(*key, F.col(value).alias("_v"), "support", "total", "best_confidence")
    out = observations.join(names, list(key), "left")
    return out.withColumn("final_value", F.coalesce("_v", value)).withColumn("message", F.when(F.col("support").isNotNull(), F.format_string("batch_consensus:%d/%d", "support", "total"))).drop("_v", "support", "total", "best_confidence")


def merged_candidates(own: Column, winner: Column, limit: int = 12) -> Column:
    """Own candidates and the winner's, cut at the evidence limit."""
    return F.slice(F.concat(own, winner), 1, limit)


def evidence(df: DataFrame, crop: Sequence[str], confidence: str, tie: Sequence[str], chosen: Column, limit: int = 8) -> DataFrame:
    """The first ``limit`` readings; the chosen one is forced into the last place."""
    w = Window.partitionBy(*crop)
    ranked = df.withColumn("_chosen", chosen).withColumn("_r", F.row_number().over(w.orderBy(F.col(confidence).desc(), *tie)))
    place = F.min(F.when(F.col("_chosen"), F.col("_r"))).over(w)
    ranked = ranked.withColumn("_at", place)
    keep = (F.col("_r") < limit) | ((F.col("_r") == limit) & ((F.col("_at") <= limit) | F.col("_at").isNull())) | ((F.col("_r") == F.col("_at")) & (F.col("_at") > limit))
    return ranked.where(keep).withColumn("place", F.least(F.col("_r"), F.lit(limit))).drop("_chosen", "_r", "_at")


def right_edge_only(df: DataFrame, crop: Sequence[str], field: Column, variant: Column, valid: Column, routed: str) -> DataFrame:
    """For the routed field, only right-edge readings if any of them is valid."""
    right = variant.startswith("right80-") & valid & (field == routed)
    any_right = F.max(right.cast("int")).over(Window.partitionBy(*crop)) == 1
    return df.withColumn("_any", any_right).where(~F.col("_any") | right).drop("_any")


def unread(df: DataFrame, crop: Sequence[str], valid: Column, raw: str, order: str, messages: str) -> DataFrame:
    """Crops without a valid reading: unknown, with the first raw text (P25)."""
    said = F.array_sort(F.array_distinct(F.flatten(F.collect_list(messages))))
    by = df.groupBy(*crop).agg(F.bool_or(valid).alias("_ok"), F.min_by(raw, order).alias("raw"), said.alias("_m")).where(~F.col("_ok"))
    return by.select(*crop, F.lit("unknown").alias("status"), "raw", F.when(F.size("_m") > 0, F.col("_m")).otherwise(F.array(F.lit("no_local_ocr_candidate"))).alias("messages"))


def reading_status(parser: Column, valid: Column) -> Column:
    """Status of one reading: a field without a parser is unsupported."""
    return F.when(parser.isNull(), "unsupported").when(valid, "ok").otherwise("unknown")


def suggested(df: DataFrame, keys: Sequence[str], value: str, raw: str, candidates: str, parser: str) -> DataFrame:
    """keys and suggested_value: of rows without a value, the first reading that the parser
    takes, the raw text before the candidates in order (X29)."""
    missing = F.col(value).isNull() & F.col(parser).isNotNull()
    readings = F.when(missing, F.concat(F.array(raw), F.coalesce(candidates, F.array().cast("array<string>"))))
    rows = df.select(*keys, F.col(parser).alias("_parser"), F.posexplode_outer(readings).alias("_at", "_raw"))
    parsed = parse_readings(rows, "_raw", "_parser")
    taken = F.when(F.col("valid") & F.col("_raw").isNotNull(), F.col("_at"))
    return parsed.groupBy(*keys).agg(F.min_by(F.when(taken.isNotNull(), F.col("value_str")), taken).alias("suggested_value"))
