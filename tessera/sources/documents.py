"""Sources and sinks of manifests, snapshots, ledgers, configuration and captures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import filename_identity, normalize_label, url_host
from tessera.operators.catalog import NON_SLOT_NAMES
from tessera.sources import store

MANIFEST_LIMIT, SNAPSHOT_LIMIT, LEDGER_LINE_LIMIT = 10 << 20, 64 << 20, 16 << 10
IMAGE_BYTES, IMAGE_PIXELS, IMAGE_SIDE = 50 << 20, 40_000_000, 16_384
#: The five views that make a capture complete (fixed values).
CAPTURE_STEMS = ("dps", "farm", "hero_item_build", "overall", "team")

MANIFEST = T.StructType([T.StructField("dataset_version", T.StringType(), False), T.StructField("samples", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "match_group_id", "image_path", "sha256", "approval", "reviewer", "reviewed_at")])))])
ACTION = T.StructType([T.StructField("action_id", T.StringType()), T.StructField("snapshot_sha256", T.StringType()), T.StructField("class_id", T.StringType()), T.StructField("visual_version_id", T.StringType()), T.StructField("action", T.StringType()), T.StructField("reviewer", T.StringType()), T.StructField("reviewed_at", T.TimestampType()), T.StructField("comment", T.StringType())])


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with limits applied before decoding and a digest of their bytes.

    Gives path, length, sha256, status: ok, too_large, empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    status = F.when(F.col("length") == 0, "empty").when(F.col("length") > IMAGE_BYTES, "too_large").otherwise("ok")
    none = spark.createDataFrame([(p, 0, bytearray()) for p in store.empty_files(spark, path)], "path string, length long, content binary")
    files = files.select("path", "length", "content").unionByName(none)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), status.alias("status"), "content")


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images within the limits of pixels and sides; undecodable files are dropped.

    Pixels are turned from the reader's channel order to RGB by the pixel kernels' users.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    return rows.where((F.col("height") * F.col("width") <= IMAGE_PIXELS) & (F.greatest("height", "width") <= IMAGE_SIDE) & (F.col("nChannels") == 3)).select("origin", "height", "width", "data")


def manifest(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(status, samples): missing is no_data, anything not as the schema says is blocked (S3)."""
    none = spark.createDataFrame([], MANIFEST["samples"].dataType.elementType)
    if not store.exists(spark, path):
        return "no_data", none
    try:
        raw = json.loads(store.read_bytes(spark, path, MANIFEST_LIMIT))
        names = {f.name for f in MANIFEST["samples"].dataType.elementType.fields}
        extra = set(raw) - {f.name for f in MANIFEST.fields} | {k for s in raw.get("samples", []) for k in s} - names
        ids = [s["sample_id"] for s in raw["samples"]]
        if extra or len(set(ids)) != len(ids) or "dataset_version" not in raw:
            return "blocked", none
    except (ValueError, KeyError, TypeError):
        return "blocked", none
    rows = [tuple(s.get(f.name) for f in none.schema.fields) for s in raw["samples"]]
    return ("completed" if rows else "no_data"), spark.createDataFrame(rows, none.schema)


def resolve_assets(samples: DataFrame, files: DataFrame, root: str, limit: int = IMAGE_BYTES) -> DataFrame:
    """Each sample with the reason its file cannot be used, null if it can."""
    found = files.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").split("://")[-1] + "/", "").alias("_p"), "length", F.col("sha256").alias("_sha"))
    unsafe = F.col("image_path").rlike(r"(^/)|(^|/)\.\.(/|$)")
    reason = F.when(unsafe, "unsafe_path").when(F.col("_p").isNull(), "missing").when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large").when(F.col("_sha") != F.col("sha256"), "checksum_mismatch")
    return samples.join(found, samples["image_path"] == found["_p"], "left").withColumn("reason", reason).drop("_p", "length", "_sha")


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8")


def write_snapshot(spark: SparkSession, path: str, snapshot: dict) -> str:
    """An immutable snapshot and a sidecar with the digest of its canonical JSON (K2)."""
    data = canonical_json(snapshot)
    digest = hashlib.sha256(data).hexdigest()
    store.write_atomic(spark, path, data, overwrite=False)
    store.write_atomic(spark, f"{path}.sha256", digest.encode(), overwrite=False)
    return digest


def read_snapshot(spark: SparkSession, path: str, verify: bool = True) -> dict:
    """The snapshot, whose sidecar must equal the digest of its canonical JSON."""
    value = json.loads(store.read_bytes(spark, path, SNAPSHOT_LIMIT))
    if verify:
        said = store.read_bytes(spark, f"{path}.sha256", 1 << 10).decode().split()[0]
        if said != hashlib.sha256(canonical_json(value)).hexdigest():
            raise ValueError(f"{path}: the sidecar's digest differs")
    return value


def append_ledger(actions: DataFrame, path: str) -> None:
    """Adds actions to the append-only ledger (K3)."""
    actions.select([f.name for f in ACTION.fields]).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_ledger(spark: SparkSession, path: str, snapshot_sha256: str) -> tuple[DataFrame, DataFrame]:
    """(actions, violations): lines too long, unreadable, or bound to another snapshot."""
    lines = spark.read.text(path).withColumn("_a", F.from_json("value", ACTION))
    reason = F.when(F.octet_length("value") > LEDGER_LINE_LIMIT, "line_too_long").when(F.col("_a.action_id").isNull(), "unreadable").when(~F.col("_a.snapshot_sha256").eqNullSafe(F.lit(snapshot_sha256)), "other_snapshot")
    judged = lines.withColumn("reason", reason)
    return judged.where("reason is null").select("_a.*"), judged.where("reason is not null").select("value", "reason")


def catalog_directory(spark: SparkSession, path: str, metadata: DataFrame, pattern: str = "*.png") -> tuple[DataFrame, DataFrame]:
    """(candidates, failures) of a local catalog: identity from file names, names from the
    metadata by file name, names that are no slots left out (S7, J15, P8)."""
    files = images(spark, f"{path}/{pattern}").withColumn("file", F.element_at(F.split("path", "/"), -1))
    rows = files.withColumn("_n", filename_identity(F.col("file"))).join(metadata.select(F.col("file"), F.col("name").alias("_m")), "file", "left")
    rows = rows.withColumn("canonical_name", F.coalesce("_m", "_n.title")).withColumn("source_identity", F.coalesce(F.col("_n.number").cast("string"), F.col("file")))
    keep = ~normalize_label(F.col("canonical_name")).isin(*NON_SLOT_NAMES)
    good = rows.where((F.col("status") == "ok") & F.col("canonical_name").isNotNull() & (F.col("canonical_name") != "") & keep)
    bad = rows.where((F.col("status") != "ok") | F.col("canonical_name").isNull() | (F.col("canonical_name") == ""))
    return good.select("source_identity", "canonical_name", "file", "sha256"), bad.select("source_identity", F.lit("validate").alias("stage"), F.coalesce(F.nullif("status", F.lit("ok")), F.lit("no_name")).alias("reason"))


def allowed_hosts(df: DataFrame, url: str, hosts: list[str]) -> DataFrame:
    """Rows whose address is on the allow-list, with the host."""
    return df.withColumn("host", url_host(F.col(url))).withColumn("allowed", F.col("host").isin(*hosts))


def yaml_table(spark: SparkSession, path: str, section: str, columns: list[str]) -> DataFrame:
    """A section of a YAML file, a mapping of names to settings, as rows."""
    import yaml

    found = yaml.safe_load(store.read_bytes(spark, path, MANIFEST_LIMIT)) or {}
    rows = [(str(k), *[json.dumps(v[c]) if isinstance(v.get(c), (dict, list)) else (None if v.get(c) is None else str(v[c])) for c in columns]) for k, v in (found.get(section) or {}).items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in ("name", *columns)]))


def profiles(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, errors): every ``*/profile.json``; repeated ids and missing assets are errors."""
    schema = "id string, enabled boolean, assets array<string>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/*/profile.json").withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/profile\.json$", 1))
    have = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("asset")).distinct()
    need = rows.select("id", F.explode_outer("assets").alias("_a"), "folder").where("_a is not null").select("id", F.concat_ws("/", "folder", "_a").alias("asset"))
    missing = need.join(have, "asset", "left_anti").select("id", F.concat(F.lit("missing_asset:"), "asset").alias("error"))
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit("repeated_id").alias("error"))
    return rows, missing.unionByName(twice)


def reference_library(catalog: DataFrame, prototypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, errors): enabled catalog visuals and prototypes whose entity is in the catalog."""
    base = catalog.where("kind <> 'item' OR classification_enabled").select("entity_id", F.explode("visuals").alias("_v")).select("entity_id", F.col("_v.id").alias("visual_id"), F.col("_v.asset_path").alias("asset_path"), F.lit("catalog").alias("source"))
    known = catalog.select("entity_id").distinct()
    own = prototypes.join(known, "entity_id", "left_semi").select("entity_id", "visual_id", "asset_path", F.lit("profile_prototype").alias("source"))
    return base.unionByName(own), prototypes.join(known, "entity_id", "left_anti").select("entity_id", "visual_id")


def captures(files: DataFrame, path: str = "path") -> DataFrame:
    """Captures in ``family/game/stem.ext`` trees: complete with all five stems; two files
    of a stem are an error (S16)."""
    parts = F.split(path, "/")
    rows = files.select(F.element_at(parts, -3).alias("family"), F.element_at(parts, -2).alias("game"), F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]+$", 1).alias("stem"))
    by = rows.groupBy("family", "game", "stem").agg(F.count("*").alias("_n")).groupBy("family", "game").agg(F.array_sort(F.collect_set("stem")).alias("stems"), F.max("_n").alias("_most"))
    want = F.array(*[F.lit(s) for s in CAPTURE_STEMS])
    return by.select("family", "game", "stems", (F.size(F.array_except(want, F.col("stems"))) == 0).alias("complete"), (F.col("_most") > 1).alias("repeated"))


def truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of sectioned truth files with their number."""
    whole = spark.read.text(path, wholetext=True).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return whole.select("source", F.posexplode(F.split("value", "\r?\n")).alias("number", "text"))


def uploads(spark: SparkSession, path: str, limit: int = IMAGE_BYTES) -> DataFrame:
    """Dropped files as a stream with the status an upload would get."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.withColumn("http_status", F.when(F.col("length") == 0, 422).when(F.col("length") > limit, 413).otherwise(202))


def truth_text(rows: DataFrame, source: str, section: str, key: str, value: str, order: list[Column]) -> DataFrame:
    """One text of ``[SECTION]`` and ``key: value`` lines for each source (K5)."""
    lines = rows.groupBy(source, section).agg(F.min(F.struct(*order)).alias("_o"), F.array_sort(F.collect_list(F.struct(*order, F.concat_ws(": ", key, value).alias("line")))).alias("_l"))
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col(section), F.lit("]")), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
    return lines.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("_o", block.alias("block")))).alias("_b")).select(source, F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n").alias("text"))


def report(metrics: DataFrame, status: str) -> bytes:
    """A benchmark report as canonical JSON; metrics are a bounded list of names (K6)."""
    rows = [r.asDict(recursive=True) for r in metrics.orderBy("metric").collect()]
    return canonical_json({"status": status, "exit_code": 0 if status == "completed" else 2, "metrics": rows})


def export_manifest(entries: DataFrame) -> DataFrame:
    """The four columns a runtime needs, provenance left out (K7)."""
    return entries.select("entity_id", "visual_id", "asset_path", "sha256")


def inventory_differences(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """Entries that one side lacks, with the side (K8, U4)."""
    a, b = expected.select(*columns), actual.select(*columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("actual")))


def ordered_parity(left: DataFrame, right: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Positions at which two ordered exports differ (K9)."""
    l = left.select(F.col(order), F.struct(*columns).alias("_l"))
    r = right.select(F.col(order), F.struct(*columns).alias("_r"))
    return l.join(r, order, "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r"))).select(order)
