"""Relational operators on small literal tables."""

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import evaluation as E
from tessera.operators import geometry as G
from tessera.operators import ranking as R
from tessera.operators import review as V
from tessera.operators import voting as O


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_null_keys_match_and_last_prediction_wins(spark):
    truth = spark.createDataFrame([("a", None), ("a", 1), ("b", 2)], "team string, row int")
    pred = spark.createDataFrame([("a", None, "x", 1), ("a", None, "y", 2), ("b", 3, "z", 1)], "team string, row int, v string, ord int")
    got = {(r["team"], r["row"]): (r["v"], r["matched"]) for r in E.truth_checks(truth, pred, ["team", "row"], [F.col("ord")]).collect()}
    assert got == {("a", None): ("y", True), ("a", 1): (None, False), ("b", 2): (None, False)}


def test_bins_use_the_same_bounds_as_division(spark):
    below = 0.8999999999999999
    df = spark.createDataFrame([(below, True), (0.9, True), (1.0, False), (0.0, True), (None, True)], "c double, y boolean")
    got = dict((r["bin"], r["n"]) for r in E.calibration_bins(df, F.col("c"), F.col("y")).collect())
    assert got == {8: 1, 9: 2, 0: 1}


def test_unavailable_is_not_zero(spark):
    df = spark.createDataFrame([(1, 2)], "n int, d int")
    m = E.metric_table(df, [E.metric_row("hero_top1_accuracy", F.sum("n"), F.sum("d")), E.metric_row("item_top1_accuracy", F.sum("n"), F.sum("d") - 2)])
    full = {r["metric"]: r for r in E.all_metrics(m, "no reason").collect()}
    assert len(full) == len(E.METRICS) == 22
    assert full["hero_top1_accuracy"]["value"] == 0.5 and full["item_top1_accuracy"]["value"] is None and full["item_top1_accuracy"]["status"] == "unavailable"
    assert full["memory"]["reason"] == "no reason" and full["hero_top1_accuracy"]["reason"] is None


def test_benchmark_of_one_perfect_sample(spark):
    """One sample read without a fault: every ratio is 1, every error 0."""
    from tessera.operators import benchmark as B

    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    order = [F.col("confidence")]
    heroes = B.hero_checks(one([("shot-1", "ally", 0, None, 17, False, True, "legacy-v1", 3)], "sample_id string, team string, row int, stable_id string, legacy int, unknown boolean, critical boolean, engine_id string, depth int"), one([("shot-1", "ally", 0, "v1-hero-017", "ok", 0.8, ["v1-hero-017", "b", "c"])], "sample_id string, team string, row int, class_id string, status string, confidence double, candidates array<string>"), order)
    keys = "sample_id string, team string, row int, slot int"
    items = B.item_checks(
        one([("shot-1", "ally", 0, 0, None, "Blade of Despair", False, False, "legacy-v1", 1, "occupied"), ("shot-1", "ally", 0, 1, None, None, False, False, "legacy-v1", 1, "empty")], f"{keys}, stable_id string, legacy string, unknown boolean, critical boolean, engine_id string, depth int, occupancy string"),
        one([("shot-1", "ally", 0, 0, "v1-item:Blade of Despair", "ok", 0.7, ["v1-item:Blade of Despair"], "occupied"), ("shot-1", "ally", 0, 1, None, "empty", None, None, "empty")], f"{keys}, class_id string, status string, confidence double, candidates array<string>, occupancy string"),
        order,
    )
    value = "sample_id string, field string, team string, row int, value_type string, value_str string, value_num double, status string"
    fields = B.field_checks(one([("shot-1", "battle_id", None, None, "str", "001", None, "ok", None, True), ("shot-1", "kills", "ally", 0, "int", None, 0.0, "ok", None, False)], f"{value}, raw string, critical boolean"), one([("shot-1", "battle_id", None, None, "str", "001", None, "ok", 0.9), ("shot-1", "kills", "ally", 0, "int", None, 0.0, "ok", 0.9)], f"{value}, confidence double"), order)
    geometry = one([("shot-1", True, 0.0, 2)], "sample_id string, correct boolean, edge_error double, edges int")
    samples = one([("shot-1", "{}", "{}", 100.0, 50.0)], "sample_id string, expected_json string, predicted_json string, latency_ms double, peak_memory_mib double")
    got = {(r["metric"], r["part"]): r for r in B.benchmark(geometry, heroes, items, fields, samples, {"all": F.lit("x")}).collect()}
    for name in ("geometry_success", "hero_top1_accuracy", "hero_top3_accuracy", "item_top1_accuracy", "item_occupancy_accuracy", "ocr_exact_sequence_accuracy", "numeric_exact_value_accuracy", "full_json_exact_match", "critical_field_exact_match", "hero_per_class_recall"):
        assert got[name, None]["value"] == 1.0, name
    for name in ("normalized_coordinate_error", "ocr_character_error_rate", "unknown_false_reject_rate"):
        assert got[name, None]["value"] == 0.0, name
    assert got["latency", "mean_ms"]["value"] == got["latency", "p95_ms"]["value"] == 100.0 and got["memory", "max_peak_mib"]["value"] == 50.0
    assert got["item_top3_accuracy", None]["status"] == got["unknown_false_accept_rate", None]["status"] == "unavailable"
    assert got["zero_missing_confusion", "true_zero_predicted_missing"]["value"] == 0.0 and {m for m, _ in got} == set(E.METRICS)


def test_typed_equality(spark):
    kinds = spark.createDataFrame([("bool", None, 1.0, "int", None, 1.0, False), ("int", None, 1.0, "float", None, 1.0, True), ("str", "1", None, "int", None, 1.0, False), ("str", "a", None, "str", "a", None, True), ("bool", None, 1.0, "bool", None, 1.0, True)], "at string, a string, an double, bt string, b string, bn double, want boolean")
    for r in kinds.withColumn("got", E.exact_value(*[F.col(c) for c in ("at", "a", "an", "bt", "b", "bn")])).collect():
        assert r["got"] == r["want"]


def test_gates(spark):
    s = spark.createDataFrame([("b", "pending"), ("a", "rejected"), ("c", "approved")], "sample_id string, approval string")
    g = E.approval_gate(s).first()
    assert (g["approved"], g["offenders"]) == (False, "a, b")
    assert E.approval_gate(s.where("false")).first()["approved"] is False
    gate = spark.createDataFrame([(1, 0, 0, 0, 0, "blocked"), (0, 0, 0, 0, 0, "no_data"), (0, 2, 1, 0, 0, "blocked"), (0, 2, 0, 0, 1, "blocked"), (0, 2, 0, 0, 0, "completed")], "i int, s int, u int, d int, f int, want string")
    assert all(r["got"] == r["want"] for r in gate.withColumn("got", E.run_gate(*[F.col(c) for c in "isudf"])).collect())


def test_balanced_policy_values(spark):
    df = spark.createDataFrame([("q", 1, 0.9, 0.9, 0.7, 0.02, 0.9, 0.8, 0.7, 0.6), ("q", 2, 0.8, 0.8, 0.75, 0.01, 0.8, 0.7, 0.6, 0.65)], "query string, rank int, score double, prototype double, catalog double, gain double, aligned double, color double, histogram double, edge double")
    got = R.channel_votes(df, "query", R.CHANNELS).first()
    assert got["votes"] == 3 and abs(got["score_margin"] - 0.1) < 1e-9
    p = df.where("rank = 1").select(R.policy_score(F.col("prototype"), F.col("catalog"), F.col("gain"), 0.4, 0.55).alias("p")).first()["p"]
    assert abs(p - (0.6 * 0.9 + 0.4 * 0.7 - 0.55 * 0.02)) < 1e-12


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("q", "z", 1, 0.5), ("q", "a", 2, 0.5)], "query string, visual string, ord int, score double")
    assert R.best_reference(df, ["query"], "score", ["visual"]).first()["visual"] == "a"
    m = {r["visual"]: (r["rank"], r["margin"]) for r in R.margins(df, "query", "score", ["visual"]).collect()}
    assert m == {"a": (1, 0.0), "z": (2, 0.5)}
    assert R.margins(df.limit(1), "query", "score", ["visual"]).first()["margin"] == 1.0
    v = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("k", "a", 4)], "key string, v string, ord int")
    assert O.majority_first(v, ["key"], "v", ["ord"]).first()["v"] == "b"


def test_reading_votes(spark):
    df = spark.createDataFrame([("c", "5", 0.99, 1), ("c", "15", 0.7, 2)], "crop string, t string, conf double, ord int")
    assert O.reading_votes(df, ["crop"], "t", "conf", ["ord"]).first()["t"] == "5"
    assert O.reading_votes(df, ["crop"], "t", "conf", ["ord"], longest_first=True).first()["t"] == "15"


def test_consensus_needs_support(spark):
    df = spark.createDataFrame([("k", "a", 0.5, 1), ("k", "a", 0.4, 2), ("k", "b", 0.99, 3), ("j", "x", 0.9, 1), ("j", "y", 0.9, 2)], "key string, v string, conf double, ord int")
    got = O.consensus(df, ["key"], ["v"], "conf", "ord").collect()
    assert [(r["key"], r["v"], r["support"], r["total"], r["best_order"]) for r in got] == [("k", "a", 2, 3, 1)]
    applied = {(r["key"], r["ord"]): (r["final_value"], r["message"]) for r in O.apply_consensus(df, O.consensus(df, ["key"], ["v"], "conf", "ord"), ["key"], "v").collect()}
    assert applied[("k", 3)] == ("a", "batch_consensus:2/3") and applied[("j", 1)] == ("x", None)


def test_near_duplicates_match_brute_force_without_a_nested_loop(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(30)]
    bits = base + [b ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for b in base] + [b ^ 0b11111 for b in base[:5]] + base[:3]
    df = spark.createDataFrame(list(enumerate(bits)), "id long, x long")
    got = C.near_duplicates(df, "id", "x")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(bits) for j, b in enumerate(bits) if i < j and a != b and (a ^ b).bit_count() <= 4)
    assert rows(got) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_of_equal_hash_and_other_content(spark, tmp_path):
    bits = [(1, 7, "a"), (2, 7, "b"), (3, 7, "a"), (4, 6, "c"), (5, 1 << 40, "d"), (6, 7, None), (7, None, "e")]
    df = spark.createDataFrame(bits, "id long, x long, sha string")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a, s in bits for j, b, t in bits if i < j and None not in (a, b) and s != t and (a ^ b).bit_count() <= 4)
    assert (1, 2, 0) in want and (1, 3, 0) not in want and rows(C.near_duplicates(df, "id", "x", content="sha")) == want
    # The query: vectors of the same signs and other values are pairs, true copies are not.
    from tessera.plans.catalogue import queries

    v = [1.0, -1.0] * 32
    spark.createDataFrame([(1, v), (2, [2 * x for x in v]), (3, v), (4, [-x for x in v])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(queries()["dup_near_pairs"](spark, str(tmp_path))) == [(1, 2, 0), (2, 3, 0)]


def test_hashes_with_constant_bits_are_not_compared_all_with_all(spark):
    from collections import Counter
    from itertools import combinations
    from math import comb

    n = 4096
    hashes = [((k // 4) * 2654435761) ^ (k % 4) for k in range(n)]

    def compared(masks, distance):
        choices = [sum(c) for c in combinations(masks, len(masks) - distance)]
        return sum(comb(c, 2) for m in choices for c in Counter(x & m for x in hashes).values())

    edges = [64 * k // 5 for k in range(6)]
    assert compared([(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)], 4) > comb(n, 2)  # bands by place: all pairs
    masks = C.agreement_blocks(n, [sum(x >> k & 1 for x in hashes) for k in range(64)], 4)
    assert sum(masks) == (1 << 64) - 1 and all(masks) and compared(masks, 4) < comb(n, 2) / 50
    for some in (0, 1):
        assert sum(C.agreement_blocks(some, [some] * 64, 16)) == (1 << 64) - 1
    few = hashes[:400] + [~x for x in hashes[:50]] + hashes[:5] + [x ^ (15 << 60) for x in hashes[:50]]
    few = [x - (1 << 64) if x >> 63 else x for x in (x & ((1 << 64) - 1) for x in few)]
    df = spark.createDataFrame([(k, x, f"s{k % 7}" if k % 5 else None) for k, x in enumerate(few)], "id long, x long, sha string")
    for distance in (0, 4, 16):
        want = sorted((i, j, ((a ^ b) & ((1 << 64) - 1)).bit_count()) for i, a in enumerate(few) for j, b in enumerate(few[i + 1 :], i + 1))
        want = [w for w in want if w[2] <= distance and (w[0] % 7, w[0] % 5 == 0) != (w[1] % 7, w[1] % 5 == 0) and (w[0] % 5 or w[1] % 5)]
        assert rows(C.near_duplicates(df, "id", "x", distance, "sha")) == want


def test_audit_joins_no_side_through_the_driver(spark, sf_small):
    from tessera.plans.catalogue import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for name in ("catalog_audit_all", "dup_near_pairs"):
            got = queries()[name](spark, sf_small)
            assert got.collect()
            plan = got._jdf.queryExecution().executedPlan().toString()  # as it ran, with what the sizes changed meanwhile
            assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranking_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 10 as q", "rand(1) as s", "id")
    assert "WindowGroupLimit" in R.top_k(df, "q", "s", ["id"], 3)._jdf.queryExecution().executedPlan().toString()


def test_tiers_and_ambiguity(spark):
    c = spark.createDataFrame([(1, "i1", "s9", "x"), (2, None, "s2", "x"), (3, None, None, "lab"), (4, None, None, "new")], "c int, ident string, sha string, label string")
    p = spark.createDataFrame([("h1", "i1", "s1", "q"), ("h2", "i2", "s2", "q"), ("h3", "i3", "s3", "lab"), ("h4", "i4", "s4", "lab"), ("h9", "i9", "s9", "q")], "id string, ident string, sha string, label string")
    tiers = [(F.col(k), F.col(k)) for k in ("ident", "sha", "label")]
    got = {r["c"]: (r["tier"], r["n_matches"], r["matched_id"], r["status"]) for r in C.tiered_match(c, p, "c", tiers, "id").collect()}
    assert got == {1: (1, 1, "h1", "matched"), 2: (2, 1, "h2", "matched"), 3: (3, 2, None, "ambiguous"), 4: (None, 0, None, "new")}


def test_class_numbers_and_diff(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("d",), ("n",)], "id string")
    prev = spark.createDataFrame([("d", 0), ("gone", 1), ("b", 2)], "id string, index int")
    assert {r["id"]: r["index"] for r in C.class_numbers(ids, prev, "id").collect()} == {"d": 0, "b": 1, "a": 2, "n": 3}
    old = spark.createDataFrame([("a", "A", "v"), ("b", "B", "v"), ("c", "C", "v"), ("e", "E", "v")], "id string, name string, vis string")
    new = spark.createDataFrame([("a", "A2", "w"), ("b", "B", "w"), ("d", "D", "v"), ("e", "E", "v")], "id string, name string, vis string")
    assert {r["id"]: r["change"] for r in C.snapshot_diff(old, new, "id", "name", "vis").collect()} == {"a": "renamed", "b": "visual_changed", "c": "removed", "d": "added", "e": "unchanged"}


def test_compatibility_values(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r["check"]: (r["n"], r["compatible"]) for r in C.compatibility(ids("a", "m"), ids("a", "hero_removed"), ids("hero_missing_visual"), "id").collect()}
    assert got == {"runtime_not_in_model": (1, False), "model_not_in_runtime": (1, False), "visual_not_in_runtime": (1, False)}


def test_merge_reports_clashes(spark):
    a = spark.createDataFrame([("s1", "x", 1), ("s2", "y", 2)], "sha string, label string, ord int")
    b = spark.createDataFrame([("s1", "z", 1), ("s3", "y", 2)], "sha string, label string, ord int")
    merged, clash = C.merge_first_wins([a, b], "sha", "label", "ord")
    assert {(r["sha"], r["label"]) for r in merged.collect()} == {("s1", "x"), ("s2", "y"), ("s3", "y")}
    assert [r["sha"] for r in clash.collect()] == ["s1"]


def test_exception_reasons(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "slot int")
    got = V.exceptions([(k(1, 2), F.lit("b")), (k(2), F.lit("a")), (k(2), F.lit("b"))], ["slot"])
    assert rows(got) == [(1, "b"), (2, "a; b")]


def test_repeated_truth_ignores_the_own_record(spark):
    r = spark.createDataFrame([("k", 1, "x", 5), ("k", 2, "x", 6), ("k", 3, "y", 7), ("j", 4, "z", 1)], "key string, id int, truth string, at int")
    got = {x["id"]: x["repeated_truth"] for x in V.repeated_truth(r, ["key"], "id", "truth", "at").collect()}
    assert got == {1: None, 2: None, 3: "x", 4: None}


def test_wrap_around(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, True), (3, False)], "i int, todo boolean")
    assert V.next_unfinished(df, "i", F.col("todo"), 1).first()["i"] == 2
    assert V.next_unfinished(df, "i", F.col("todo"), 3).first()["i"] == 0


def test_sections(spark):
    lines = ["[MATCH]", "id : 5", "noise", "[ALLY_PLAYER_1]", " name: a: b ", "x:y"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "src string, n int, text string")
    assert [(r["section"], r["key"], r["value"]) for r in V.section_fill(df, "src", "n", "text").orderBy("n").collect()] == [("MATCH", "id", "5"), ("ALLY_PLAYER_1", "name", "a: b"), ("ALLY_PLAYER_1", "x", "y")]


def test_semantic_warnings(spark):
    items = spark.createDataFrame([("ally", 0, f"i{k}") for k in range(7)] + [("enemy", 1, "i0")], "side string, row int, item_id string")
    heroes = spark.createDataFrame([("ally", 0, "other"), ("enemy", 1, "special")], "side string, row int, hero_id string")
    got = {r["warning"] for r in V.semantic_warnings(items, heroes, "special", "key").collect()}
    assert got == {"ally.row0.seven_items_without_hero", "ally.row0.seven_items_without_item", "enemy.special_hero_rows_disagree"}


def test_bands_pad_edges_with_zeros(spark):
    import numpy as np

    values = [0, 0, 5, 9, 9, 9, 5, 0, 0, 0, 8, 9, 8, 0, 0]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "s string, p int, v double")
    smooth = np.convolve(values, np.ones(5) / 5, "same")
    over, want, start = smooth > smooth.mean(), [], None
    for i, o in enumerate([*over, False]):
        if o and start is None:
            start = i
        if not o and start is not None:
            want.append((start, i - 1))
            start = None
    assert [(r["first"], r["last"]) for r in G.bands(df, "s", "p", "v").orderBy("first").collect()] == want


def test_seven_slots(spark):
    df = spark.createDataFrame([(True, "ally"), (True, "enemy"), (False, "ally")], "o boolean, side string")
    got = [[tuple(x) for x in r["s"]] for r in df.select(G.seventh_slot(F.col("o"), F.col("side")).alias("s")).collect()]
    assert got[0] == [(i, i) for i in range(7)] and got[1] == [(i - 1, i) for i in range(7)] and got[2] == [(i, i) for i in range(6)]
