"""Sources, sinks, pixel kernels and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pixels as P
from tessera.sources import documents as D
from tessera.sources import store
from tessera.sources.remote import CatalogSource, parse_answer
from tessera.streaming import jobs as J


def png(path, image):
    h, w, _ = image.shape
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def pattern(s):
    x, y = np.meshgrid(np.arange(32), np.arange(32))
    return np.stack(((17 * x + 11 * s) % 256, (19 * y + 23 * s) % 256, (13 * (x + y) + 29 * s) % 256), axis=2).astype(np.uint8)


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", pattern(1))
    (tmp_path / "b.png").write_bytes(b"not an image")
    (tmp_path / "c.png").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in D.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": "ok", "b.png": "ok", "c.png": "empty"}
    rows = D.decoded_images(spark, str(tmp_path)).collect()
    assert [(r["height"], r["width"]) for r in rows] == [(32, 32)]
    bgr = np.frombuffer(bytes(rows[0]["data"]), np.uint8).reshape(32, 32, 3)
    assert (bgr[..., ::-1] == pattern(1)).all()


def test_manifest_and_assets(spark, tmp_path):
    assert D.manifest(spark, f"{tmp_path}/none.json")[0] == "no_data"
    sample = {"sample_id": "s", "match_group_id": "g", "image_path": "a.png", "sha256": "0" * 64, "approval": "approved", "reviewer": "r", "reviewed_at": "2026-01-01"}
    for text, want in ((json.dumps({"dataset_version": "t", "samples": [sample]}), "completed"), ("{", "blocked"), (json.dumps({"dataset_version": "t", "samples": [sample | {"x": 1}]}), "blocked"), (json.dumps({"dataset_version": "t", "samples": [sample, sample]}), "blocked"), (json.dumps({"dataset_version": "t", "samples": []}), "no_data")):
        (tmp_path / "m.json").write_text(text)
        assert D.manifest(spark, f"{tmp_path}/m.json")[0] == want
    (tmp_path / "m.json").write_text(json.dumps({"dataset_version": "t", "samples": [sample, sample | {"sample_id": "t", "image_path": "../x"}, sample | {"sample_id": "u", "image_path": "gone.png"}]}))
    png(tmp_path / "img" / "a.png", pattern(2))
    rows = D.resolve_assets(D.manifest(spark, f"{tmp_path}/m.json")[1], D.images(spark, f"{tmp_path}/img"), f"{tmp_path}/img").collect()
    assert {r["sample_id"]: r["reason"] for r in rows} == {"s": "checksum_mismatch", "t": "unsafe_path", "u": "missing"}


def test_snapshots_are_immutable_and_verified(spark, tmp_path):
    path = f"file://{tmp_path}/snap.json"
    digest = D.write_snapshot(spark, path, {"b": 1, "a": "é"})
    assert D.read_snapshot(spark, path) == {"a": "é", "b": 1} and len(digest) == 64
    with pytest.raises(FileExistsError):
        D.write_snapshot(spark, path, {})
    store.write_atomic(spark, path, b'{"a":2}')
    with pytest.raises(ValueError):
        D.read_snapshot(spark, path)
    with pytest.raises(ValueError):
        store.read_bytes(spark, path, 3)


def test_ledger(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    rows = [("a1", "s1", "c", None, "approve", "r", None, None), ("a2", "s2", "c", "v", "reject", "r", None, "x")]
    D.append_ledger(spark.createDataFrame(rows[:1], D.ACTION), path)
    D.append_ledger(spark.createDataFrame(rows[1:], D.ACTION), path)
    (tmp_path / "ledger" / "part-x.txt").write_text("garbage\n" + "x" * (17 << 10) + "\n")
    good, bad = D.read_ledger(spark, path, "s1")
    assert [r["action_id"] for r in good.collect()] == ["a1"]
    assert sorted(r["reason"] for r in bad.collect()) == ["line_too_long", "other_snapshot", "unreadable"]


def test_catalog_directory_and_profiles(spark, tmp_path):
    for name in ("hero_001_blade_of-despair.png", "item_Magic Potion.png", "x.png"):
        png(tmp_path / "items" / name, pattern(3))
    (tmp_path / "items" / "item_Empty.png").write_bytes(b"")
    meta = spark.createDataFrame([("x.png", "Known")], "file string, name string")
    good, bad = D.catalog_directory(spark, f"{tmp_path}/items", meta)
    assert {r["canonical_name"] for r in good.collect()} == {"Blade Of Despair", "Known"}
    assert [r["reason"] for r in bad.collect()] == ["empty"]
    for name, pid in (("p1", "one"), ("p2", "one")):
        (tmp_path / "prof" / name).mkdir(parents=True)
        (tmp_path / "prof" / name / "profile.json").write_text(json.dumps({"id": pid, "enabled": True, "assets": ["a.png", "b.png"]}))
        (tmp_path / "prof" / name / "a.png").write_bytes(b"x")
    _, errors = D.profiles(spark, f"{tmp_path}/prof")
    assert sorted(r["error"] for r in errors.collect()) == ["missing_asset:p1/b.png", "missing_asset:p2/b.png", "repeated_id"]


def test_captures_yaml_truth(spark, tmp_path):
    files = [(f"/d/fam/g1/{s}.png",) for s in D.CAPTURE_STEMS] + [("/d/fam/g2/dps.png",), ("/d/fam/g2/dps.jpg",)]
    got = {r["game"]: (r["complete"], r["repeated"]) for r in D.captures(spark.createDataFrame(files, "path string")).collect()}
    assert got == {"g1": (True, False), "g2": (False, True)}
    (tmp_path / "c.yaml").write_text("fields:\n  kills:\n    type: INTEGER\n    max: 99\n  name:\n    type: TEXT\n")
    rows = D.yaml_table(spark, f"{tmp_path}/c.yaml", "fields", ["type", "max"]).collect()
    assert sorted(map(tuple, rows)) == [("kills", "INTEGER", "99"), ("name", "TEXT", None)]
    truth = spark.createDataFrame([("f", "B", "k", "2", 2), ("f", "A", "k", "1", 1), ("f", "B", "j", "3", 3)], "src string, section string, key string, value string, ord int")
    assert D.truth_text(truth, "src", "section", "key", "value", [F.col("ord")]).first()["text"] == "[A]\nk: 1\n\n[B]\nk: 2\nj: 3"
    (tmp_path / "t.txt").write_text("[MATCH]\nid: 5\n")
    assert D.truth_lines(spark, f"{tmp_path}/t.txt").where("text like 'id%'").first()["number"] == 1


def test_library_exports_report(spark):
    c = spark.createDataFrame([("h", "hero", True, [("v1", "a")]), ("i", "item", False, [("v2", "b")])], "entity_id string, kind string, classification_enabled boolean, visuals array<struct<id:string,asset_path:string>>")
    p = spark.createDataFrame([("h", "p1", "c"), ("zz", "p2", "d")], "entity_id string, visual_id string, asset_path string")
    refs, errors = D.reference_library(c, p)
    assert {(r["visual_id"], r["source"]) for r in refs.collect()} == {("v1", "catalog"), ("p1", "profile_prototype")}
    assert [r["visual_id"] for r in errors.collect()] == ["p2"]
    m = spark.createDataFrame([("b", 1.0), ("a", None)], "metric string, value double")
    assert json.loads(D.report(m, "blocked")) == {"status": "blocked", "exit_code": 2, "metrics": [{"metric": "a", "value": None}, {"metric": "b", "value": 1.0}]}


def test_remote_catalog(spark):
    assert parse_answer("1", 404, "application/json", b"")[3] == "status_404" and parse_answer("1", 200, "text/html", b"")[3] == "mime"
    assert parse_answer("1", 200, "application/json", b"{}")[3] == "no_name"
    spark.dataSource.register(CatalogSource)
    df = spark.read.format("tessera_catalog").options(first=1, last=20, transport="tessera.sources.remote:recorded", chunk=6).load()
    assert df.count() == 20 and df.where("failure is null").count() == 18 and df.rdd.getNumPartitions() == 4


def test_pixels(spark):
    a, b = pattern(1), pattern(2)
    assert P.area_resize(np.ones((7, 5)), 3, 3) == pytest.approx(np.ones((3, 3)))
    big = np.arange(16.0).reshape(4, 4)
    assert P.area_resize(big, 2, 2) == pytest.approx(np.array([[2.5, 4.5], [10.5, 12.5]]))
    assert P.correlation(np.arange(5.0), np.arange(5.0)) == 1.0 and P.correlation(np.ones(5), np.arange(5.0)) == 0.0
    assert P.histogram_correlation(np.ones(4), np.arange(4.0)) == 1.0
    fa, fb = P.prepare(a), P.prepare(b)
    assert P.aligned_correlation(fa, fa) == pytest.approx(1.0) and P.aligned_correlation(fa, fb) < 1
    x = np.random.default_rng(0).normal(size=(8, 8))
    assert (P.dct2(x) ** 2).sum() == pytest.approx((x**2).sum())
    assert len(P.perceptual_hash(a)) == 16 and P.perceptual_hash(a) == P.perceptual_hash(a)
    plane = np.random.default_rng(1).normal(size=(20, 30))
    assert P.best_offset(plane, plane[5:11, 8:15], 2)[:3] == (8, 5, pytest.approx(1.0))
    rows = spark.createDataFrame([(32, 32, bytearray(a.tobytes())), (32, 32, bytearray(np.zeros((32, 32, 3), np.uint8).tobytes()))], "h int, w int, d binary")
    got = rows.select(P.image_features("h", "w", "d").alias("f")).select("f.*").collect()
    assert got[0]["phash"] == P.perceptual_hash(a) and got[1]["sharpness"] == 0.0


def events(spark, rows):
    return spark.createDataFrame([(k, i, i, e) for i, (k, e) in enumerate(rows)], "content_key string, event_id long, s long, event string").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_jobs_are_shared_only_while_active(spark, tmp_path):
    log = [("a", "submit"), ("a", "submit"), ("b", "submit"), ("a", "end"), ("a", "end"), ("a", "submit"), ("b", "submit")]
    batch = {r["event_id"]: (r["outcome"], r["job_id"]) for r in J.active_jobs_batch(events(spark, log)).collect()}
    assert batch == {0: ("new", 0), 1: ("shared", 0), 2: ("new", 2), 3: ("released", 0), 5: ("new", 5), 6: ("shared", 2)}
    df = events(spark, log)
    for k in range(3):  # several files: state lives from batch to batch
        df.where(f"event_id between {k * 3} and {k * 3 + 2}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["event_id"]: (r["outcome"], r["job_id"]) for r in J.run_available(spark, J.active_jobs_stream(stream), "t").collect()}
    assert got == batch


def test_ledger_view_and_windows(spark, tmp_path):
    df = events(spark, [("a", "x"), ("b", "x"), ("a", "y")])
    for k in range(3):
        df.where(f"event_id = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = J.materialise_ledger(stream, f"{tmp_path}/view", f"{tmp_path}/cp", ["content_key"], ["ts", "event_id"]).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/view/version=2").collect()
    assert {r["content_key"]: r["event"] for r in got} == {"a": "y", "b": "x"}
    w = J.event_windows(df.withColumnRenamed("event", "event_type"), "1 minute", "1 minute").collect()
    assert sum(r["n"] for r in w) == 3


def test_renames_over_and_refuses(spark, tmp_path):
    path = f"{tmp_path}/new/a.json"
    store.write_atomic(spark, path, b"one")
    store.write_atomic(spark, path, b"two")
    assert store.read_bytes(spark, path, 10) == b"two"
    with pytest.raises(FileExistsError):
        store.write_atomic(spark, path, b"three", overwrite=False)
    assert store.read_bytes(spark, path, 10) == b"two" and not list((tmp_path / "new").glob("*.tmp"))


def test_memo_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "id int, k string")
    got = J.once_per_key(df, ["k"], lambda x: x.withColumn("v", F.coalesce("k", F.lit("none")))).collect()
    assert {r["id"]: r["v"] for r in got} == {1: "none", 2: "a", 3: "none"}
