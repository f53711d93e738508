"""Crop generation, geometry selection, row bands, quality and occupancy rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import clip_box, map_box


def crops(fields: DataFrame, screen: str, transforms: DataFrame, width: Column, height: Column) -> DataFrame:
    """Fields of a screen expanded over rows and slots to clipped source boxes.

    fields: field_id, kind, screen_types, side, n_rows, n_slots, x1, y1, x2, y2,
    row_step_x, row_step_y, slot_step_x, slot_step_y, padding.
    transforms: side, scale, dx, dy.  Order: kind, field, side, row, slot, nulls first.
    """
    grid = fields.where(F.array_contains("screen_types", screen))
    grid = grid.withColumn("row", F.explode(F.when(F.col("n_rows").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("n_rows") - 1))))
    grid = grid.withColumn("slot", F.explode(F.when(F.col("n_slots").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("n_slots") - 1))))
    r, s = F.coalesce("row", F.lit(0)), F.coalesce("slot", F.lit(0))
    dx, dy = r * F.col("row_step_x") + s * F.col("slot_step_x"), r * F.col("row_step_y") + s * F.col("slot_step_y")
    p = F.coalesce("padding", F.lit(0))
    box = F.struct((F.col("x1") + dx - p).alias("x1"), (F.col("y1") + dy - p).alias("y1"), (F.col("x2") + dx + p).alias("x2"), (F.col("y2") + dy + p).alias("y2"))
    out = grid.withColumn("box", box).join(F.broadcast(transforms), "side", "left")
    out = out.withColumn("box", map_box(F.col("box"), F.coalesce("scale", F.lit(1.0)), F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))))
    out = out.withColumn("clipped", clip_box(F.col("box"), width, height))
    return out.select("kind", "field_id", "side", "row", "slot", "box", "clipped").orderBy("kind", "field_id", F.coalesce("side", F.lit("")), F.coalesce("row", F.lit(-1)), F.coalesce("slot", F.lit(-1)))


def seventh_slot(occupied: Column, side: Column, slots: int = 6) -> Column:
    """Slot offsets of a row: seven where the extra candidate is occupied (P5).

    Own side: the extra slot follows the last; other side: it precedes the first, and
    meanings shift by one.  Gives an array of (offset, slot).
    """
    plain = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.struct(i.alias("offset"), i.alias("slot")))
    after = F.transform(F.sequence(F.lit(0), F.lit(slots)), lambda i: F.struct(i.alias("offset"), i.alias("slot")))
    before = F.transform(F.sequence(F.lit(-1), F.lit(slots - 1)), lambda i: F.struct(i.alias("offset"), (i + 1).alias("slot")))
    return F.when(occupied & (side == "ally"), after).when(occupied, before).otherwise(plain)


def percentage_box(width: Column, height: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box by shares of the image, truncated."""
    at = lambda size, share: (size * share).cast("int")
    return F.struct(at(width, x1).alias("x1"), at(height, y1).alias("y1"), at(width, x2).alias("x2"), at(height, y2).alias("y2"))


def quality_reasons(blur: Column, blocks: Column, dynamic: Column, edges: Column, side: Column, validity: Column) -> tuple[Column, Column]:
    """(reasons, status): any of five reasons, or a validity under 0.28, is low quality.

    The limits and the names of the reasons are fixed values.
    """
    reasons = F.array_compact(
        F.array(
            F.when(blur < 18.0, F.lit("severe_blur")),
            F.when(blocks > 0.75, F.lit("severe_block_compression")),
            F.when(dynamic < 20, F.lit("insufficient_dynamic_range")),
            F.when(edges < 0.003, F.lit("insufficient_structural_edges")),
            F.when(side < 240, F.lit("insufficient_native_resolution")),
        )
    )
    return reasons, F.when((F.size(reasons) > 0) | (validity < 0.28), "low_quality").otherwise("ok")


def occupancy(saturation: Column, value_std: Column, gray_std: Column, edge: Column) -> Column:
    """empty, occupied or unknown; empty wins."""
    empty = (saturation >= 0.80) & (value_std <= 0.05) & (gray_std <= 0.05) & (edge <= 0.05)
    return F.when(empty, "empty").when((gray_std >= 0.10) & (edge >= 0.10), "occupied").otherwise("unknown")


def viewports(df: DataFrame, image: str, score: str, box: str, limit: int = 8) -> DataFrame:
    """The best candidate of each box, the first ``limit`` by score and box (X11)."""
    best = df.groupBy(image, box).agg(F.max(score).alias(score))
    w = Window.partitionBy(image).orderBy(F.col(score).desc(), box)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def classify_screen(evidence: DataFrame, image: str, kind: str, score: str, least: float = 0.68, lead: float = 0.035) -> DataFrame:
    """Best evidence of each type, the best type, and whether it is clear."""
    best = evidence.groupBy(image, kind).agg(F.max(score).alias(score))
    w = Window.partitionBy(image).orderBy(F.col(score).desc(), kind)
    ranked = best.withColumn("_r", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))).where("_r = 1").drop("_r")
    return ranked.withColumn("accepted", (F.col(score) >= least) & (F.col("margin") >= lead))


def geometry_winner(df: DataFrame, image: str, profile: str, anchor: Column, evidence: Column, panel: Column) -> DataFrame:
    """The profile of the greatest weighted score, ties to the greater name."""
    scored = df.withColumn("combined", 0.30 * anchor + 0.42 * evidence + 0.28 * panel)
    return scored.groupBy(image).agg(F.max(F.struct("combined", profile)).alias("_w")).select(image, "_w.*")


def anchor_refinement(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median translation of matched anchors and median residual from it."""
    by = matches.groupBy(*keys).agg(F.median("dx").alias("shift_x"), F.median("dy").alias("shift_y"))
    residual = F.sqrt(F.pow(F.col("dx") - F.col("shift_x"), 2) + F.pow(F.col("dy") - F.col("shift_y"), 2))
    return matches.join(by, list(keys)).groupBy(*keys, "shift_x", "shift_y").agg(F.median(residual).alias("residual"), F.count("*").alias("anchors"))


def moving_sum(value: Column, window) -> Column:
    """Sum over five rows divided by five: edges are padded with zeros."""
    return F.sum(value).over(window.rowsBetween(-2, 2)) / 5


def bands(df: DataFrame, series: str, position: str, value: str, shortest: int = 1, longest: int = 1 << 30) -> DataFrame:
    """Runs of positions whose smoothed value is over the series' mean."""
    w = Window.partitionBy(series).orderBy(position)
    smooth = df.withColumn("_s", moving_sum(F.col(value), w))
    mean = smooth.groupBy(series).agg(F.avg("_s").alias("_m"))
    over = smooth.join(mean, series).withColumn("_o", F.col("_s") > F.col("_m"))
    starts = over.withColumn("_n", F.sum((~F.col("_o")).cast("int")).over(w)).where("_o")
    runs = starts.groupBy(series, "_n").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"))
    return runs.where(F.col("length").between(shortest, longest)).drop("_n")


def equal_split(height: Column, rows: int = 5) -> Column:
    """Fallback bands of equal height."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.struct((i * height / rows).cast("int").alias("first"), ((i + 1) * height / rows - 1).cast("int").alias("last")))
