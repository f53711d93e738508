"""Small rules on literal values."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.operators import voting as V
from tessera.operators.catalog import assign_ids, missing_island
from tessera.operators.numbering import nearest_ranks, number_rows
from tessera.operators.review import repeated_truth


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_policies(spark):
    lit = F.lit
    assert values(spark, R.kind_of(lit("HEROES")), R.kind_of(lit("item")), R.kind_of(lit("tower"))) == ("hero", "item", None)
    assert values(spark, *[R.truth_required(lit(k), lit(s)) for k, s in (("hero", "hero_plus_item_exceptions"), ("item", "hero_plus_item_exceptions"), ("item", "full_match"))]) == (True, False, True)
    assert values(spark, R.by_precedence(lit(None).cast("string"), lit(" "), lit("c"))) == ("c",)
    profiles = values(spark, *[R.runtime_profile(lit(p), lit(c)) for p, c in (("AUTO", False), ("nvidia-cuda", False), ("nvidia-cuda", True), ("turbo", True))])
    assert [(p["selected"], p["status"]) for p in profiles] == [("fast-cpu-vectorized", "ok"), ("nvidia-cuda", "provider_unavailable"), ("nvidia-cuda", "uncertified"), (None, "unknown_profile")]
    routes = values(spark, *[R.field_route(lit(k), lit(f)) for k, f in (("text", "game_result"), ("integer", "hero_level"), ("integer", "kills"), ("integer", "skill_level"), ("integer", "gold"), ("percentage", "x"), ("other", "x"))])
    assert [tuple(r) for r in routes] == [("result_vote", None), ("level_vote", None), ("integer", 99), ("integer", 20), ("integer", None), ("percentage", None), ("text", None)]
    heroes = values(spark, *[R.hero_accept(lit(7), lit("a"), lit(c).cast("double")) for c in (0.3, 0.31234, None)])
    assert [(h["hero_id"], h["confidence"]) for h in heroes] == [(None, 0.0), (7, 0.312), (None, 0.0)]
    assert values(spark, R.truth_identity(lit("legacy-v1"), "hero", lit("s"), lit(17)), R.truth_identity(lit("x"), "hero", lit("s"), lit(17)), R.truth_identity(lit("legacy-v1"), "item", lit("s"), lit(None).cast("string"))) == ("v1-hero-017", "s", "s")
    assert values(spark, R.bootstrap_box(F.array(lit(10.0), lit(0.33333)))) == ([12.0, 0.4],)
    assert values(spark, *[R.asset_faults(lit(h), lit("image/png"), lit(m), lit(w), lit(64), lit(o), lit(s)) for h, m, w, o, s in ((" <HTML>", "image/png", 64, 1, 9.0), ("x", "image/gif", 64, 1, 9.0), ("x", "image/png", 8, 1, 9.0), ("x", "image/png", 64, 0, 9.0), ("x", "image/png", 64, 1, 0.5), ("x", "image/png", 64, 1, 9.0))]) == ("markup_body", "mime_mismatch", "too_small", "fully_transparent", "flat_image", None)
    assert values(spark, R.valid_by_rules(lit(5), {"min": 1, "max": 4}), R.valid_by_rules(lit("abc"), {"max_length": 3, "allowed_values": ["abc"]}), R.valid_by_rules(lit(5), {})) == (False, True, True)


def test_reading_plan(spark):
    def planned(field, parser, fast=True):
        views = [(b, v) for b in (R.FAST_BACKEND, R.SLOW_BACKEND) for v in ("native", *R.SLOW_VARIANTS, *R.RIGHT_EDGE_VARIANTS)]
        df = spark.createDataFrame(views, "b string, v string")
        return {(r["b"] == R.FAST_BACKEND, r["v"]) for r in df.where(R.reading_plan(F.col("b"), F.col("v"), F.lit(field), F.lit(parser).cast("string"), F.lit(fast))).collect()}

    assert planned("kills", "small_integer") == {(True, "native")}
    assert planned("kills", "small_integer", fast=False) == {(True, "native"), (False, "cubic3x"), (False, "clahe3x")}
    assert planned("rating", "percentage") == {(True, "native"), *[(True, v) for v in R.RIGHT_EDGE_VARIANTS]}
    assert planned("jungle_gold", "large_integer") == planned("x", "level") == {(True, "native"), (True, "cubic3x"), (True, "clahe3x"), (False, "cubic3x"), (False, "clahe3x")}
    assert planned("x", None) == set()


def test_suggestions_and_votes(spark):
    rows = [(1, None, "x", ["99", "12"], "level"), (2, "5", "x", ["12"], "level"), (3, None, "7", ["12"], "level"), (4, None, "x", None, "level"), (5, None, "x", ["1"], None)]
    df = spark.createDataFrame(rows, "id int, value string, raw string, candidates array<string>, parser string")
    assert {r["id"]: r["suggested_value"] for r in V.suggested(df, ["id"], "value", "raw", "candidates", "parser").collect()} == {1: "12", 2: None, 3: "7", 4: None, 5: None}
    votes = spark.createDataFrame([("a", 3, 0), ("a", 5, 1), ("b", 3, 0), ("b", 3, 1), ("b", 9, 2)], "k string, v int, ord int")
    assert {r["k"]: (r["gold"], r["greatest"]) for r in R.most_or_greatest(votes, ["k"], "v").collect()} == {"a": (5, 5), "b": (3, 9)}
    said = spark.createDataFrame([("a", "Victory", 0), ("a", "DEFEAT!", 1), ("b", "draw", 0)], "k string, t string, ord int")
    assert [tuple(r) for r in R.result_vote(said, ["k"], "t").collect()] == [("a", "Victory")]


def test_balanced_acceptance(spark):
    schema = "q string, rank int, score double, prototype_similarity double, aligned_gray_correlation double, color_correlation double, histogram_correlation double, edge_correlation double"
    top = [("a", 1, 0.8, 0.9, 0.9, 0.8, 0.7, 0.6), ("a", 2, 0.7, 0.8, 0.8, 0.7, 0.65, 0.6), ("b", 1, 0.8, 0.9, 0.9, 0.8, 0.7, 0.6), ("b", 2, 0.795, 0.8, 0.8, 0.7, 0.65, 0.6), ("c", 1, 0.8, 0.9, 0.9, 0.8, 0.7, 0.6), ("c", 2, 0.7, None, 0.8, 0.7, 0.65, 0.6)]
    got = {r["q"]: (r["votes"], r["accepted"]) for r in R.balanced_accept(spark.createDataFrame(top, schema), "q", {"prototype": 0.7, "rank_margin": 0.01, "prototype_margin": 0.01, "votes": 3}).collect()}
    assert got == {"a": (3, True), "b": (3, False), "c": (3, False)}


def test_ids_and_exclusion(spark):
    refs = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r["id"] for r in R.without_visuals(refs, refs.where("id = 'a'"), "id").collect()] == ["b"]
    with pytest.raises(ValueError):
        R.without_visuals(refs, refs, "id")
    with pytest.raises(ValueError):
        R.assert_unique(refs.unionByName(refs.limit(1)), ["id"])
    c = spark.createDataFrame([(1, "hero", "l", "x:7", "n"), (2, "hero", "l", "y:07", "n"), (3, "item", "l", "z", "EMPTY slot"), (4, "item", "m", "w", "empty-slot")], "o int, kind string, adapter string, identity string, name string")
    assert [r["stable_id"] for r in assign_ids(c, ["o"]).orderBy("o").collect()] == ["hero_0007", "hero_0007_2", "item_empty_slot", "item_empty_slot_2"]
    names = spark.createDataFrame([("Old!",), ("X y",), ("no",)], "n string")
    known = spark.createDataFrame([("new",), ("x Y.",)], "k string")
    assert {r["n"]: r["valid"] for r in R.validated_names(names, "n", known, "k", {"Old!": "New"}).collect()} == {"Old!": True, "X y": True, "no": False}
    assert all(r["valid"] for r in R.validated_names(names, "n", known.where("false"), "k", {}).collect())


def test_empty_rows_are_bound_to_their_sources(spark):
    rows = spark.createDataFrame([("s", "ally", 0, "h"), ("s", "ally", 0, "h"), ("s", "ally", 9, "h"), ("t", "enemy", 1, "old")], "screenshot string, side string, row int, source_sha256 string")
    sources = spark.createDataFrame([("s", "h"), ("t", "now")], "screenshot string, sha256 string")
    seen = rows.where("screenshot = 's'")
    codes = sorted(r["code"] for r in R.empty_row_errors(rows, sources, seen, "a", "a").collect())
    assert codes == ["duplicate_row", "invalid_row", "source_mismatch", "unused_row"]
    assert [r["code"] for r in R.empty_row_errors(rows, sources, seen, "a", "b").collect()] == ["truth_mismatch"]


def test_numbers_ranks_and_gaps(spark):
    df = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "x int").repartition(5)
    assert sorted((r["x"], r["i"]) for r in number_rows(df, ["x"], "i").collect()) == [(k, k) for k in range(101)]
    v = spark.createDataFrame([("a", float(k % 10)) for k in range(100)] + [("b", 3.0)] * 7 + [("c", None), ("d", 1.0), ("d", 1e12)], "k string, v double")
    for parts in (1, 7, 65_536):
        got = {r["k"]: (r["p50"], r["p95"]) for r in nearest_ranks(v, ["k"], "v", {"p50": 0.5, "p95": 0.95}, parts).collect()}
        assert got == {"a": (4.0, 9.0), "b": (3.0, 3.0), "d": (1.0, 1e12)}
    ids = spark.createDataFrame([(k,) for k in (1, 2, 5, 25, 46, 47, None)], "id int")
    assert missing_island(ids, "id", 20).first()[0] == 25 and missing_island(ids, "id", 21).first()[0] == 47 and missing_island(ids.where("false"), "id").first()[0] is None


def test_repeated_truth_leaves_the_own_row_out(spark):
    rows = [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("m", 4, "a"), ("n", 5, "a"), ("n", 6, None), (None, 7, "z"), (None, 8, "z")]
    df = spark.createDataFrame(rows, "k string, id int, truth string").withColumn("at", F.col("id"))
    got = {r["id"]: r["repeated_truth"] for r in repeated_truth(df, ["k"], "id", "truth", "at").collect()}
    assert got == {1: None, 2: None, 3: "a", 4: None, 5: None, 6: "a", 7: "z", 8: "z"}


def test_grid_and_worker(spark):
    flat = spark.createDataFrame([([7] * 9,), (list(range(9)),)], "v array<int>").select(R.grid_statistics(F.col("v"), 3).alias("s")).select("s.*").collect()
    assert (flat[0]["std"], flat[0]["equal_x"], flat[0]["rescaled"]) == (0.0, 1.0, True)
    assert (flat[1]["mean"], flat[1]["p01"], flat[1]["p99"], flat[1]["dynamic_range"], flat[1]["equal_y"]) == (4.0, 0.08, 7.92, 8, 0.0)
    jobs = spark.createDataFrame([(1, 0, 10, False), (2, 3, 5, True), (3, 40, 5, False), (4, 41, 9, False)], "id int, at int, seconds int, failed boolean")
    got = {r["id"]: (r["started"], r["ended"], r["status"]) for r in R.fifo_statuses(jobs, "at", "seconds", F.lit(42), ["id"]).collect()}
    assert got == {1: (0, 10, "completed"), 2: (10, 15, "failed"), 3: (40, 45, "processing"), 4: (45, 54, "queued")}
