"""SimHash near-duplicates by deletion-variant signatures.

A text's 64-bit fingerprint has bit b set if over half of its shingles' XXH64 values
have it.  Two fingerprints link if they differ in at most four bits.  The 64 bits are
cut into three segments: of four differences spread over three segments, some segment
has at most one.  Each distinct fingerprint is therefore indexed under each segment
with one bit replaced by a wildcard (64 signatures); linked fingerprints share one of
them, equal keys bring them together, and the distance is verified.

Inside a bucket linked fingerprints are found by comparing sorted rows at growing
shifts, and only links between fingerprints that are not yet joined are given out, so a
large family of near copies costs a chain of links, not all its pairs.  A bucket over
``BUCKET`` fingerprints is not compared but dealt anew: its members agree on the bits
used so far, so the rest of the bits is cut into three segments in turn, and so on.
Each level loses nothing, and when few bits are left a bucket is small by itself.

Components: fingerprints first (copies collapse to one row), then links by alternating
large-star and small-star steps over the links alone, each written to the shared
folder.  Nothing about all documents is ever collected.

Edge cases: null and wordless texts have fingerprint zero and link like any other; a
text of fewer words than a shingle is one shingle; repeated rows share a component; the
component is the smallest doc_id, nulls only if all are null; an empty table gives an
empty result; extra columns are ignored, and kept by ``drop_near_copies`` whatever they
are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_by_hot_key, need, numbered, prepare, texts_of, without_rows

SHINGLE, DISTANCE, BUCKET, SEED = 4, 4, 16_384, 42
ALL = (1 << 64) - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_batch(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a list of texts, as signed 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_digest
    held, owners, n = [], [], 0

    def tally() -> None:
        values = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8)
        sizes = np.array([c for _, c in owners])
        at = np.cumsum(sizes) - sizes
        # A text's bits are summed in pieces of rows, so memory does not follow its length.
        sums = np.add.reduceat(np.unpackbits(values, axis=1), at, axis=0, dtype=np.int64)
        np.add.at(bits, [o for o, _ in owners], sums)

    bits, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or b"").translate(_LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        k = min(shingle, len(words))
        values = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]
        total[i] = len(values)
        for s in range(0, len(values), 100_000):
            part = values[s : s + 100_000]
            held.extend(part)
            owners.append((i, len(part)))
            n += len(part)
            if n >= 100_000:
                tally()
                held, owners, n = [], [], 0
    if n:
        tally()
    ones = (2 * bits > total[:, None]).astype(np.uint8)
    out = np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of docs but text, and fp (signed 64-bit), of every document."""
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(fingerprint_batch(texts_of(b.column("text")), shingle))], [*[f.name for f in kept], "fp"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fp long")


def segments(bits: list[int]) -> list[list[int]]:
    """Three runs of bit numbers, as even as they go."""
    n = len(bits)
    return [bits[n * k // 3 : n * (k + 1) // 3] for k in range(3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(fp: np.ndarray, used: int, path: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bits used then, key) of every one-wildcard signature of the bits not yet used.

    path: the key that the fingerprints came by.  Keys of different signatures differ
    by their parts; a chance collision only brings more rows to verify.
    """
    out = []
    x = fp.view(np.uint64)
    for seg in segments([b for b in range(64) if not used >> b & 1]):
        mask = sum(1 << b for b in seg)
        for wild in seg:
            key = _mix(x & np.uint64(mask & ~(1 << wild)))
            out.append((used | mask, _mix(key + path.view(np.uint64) + np.uint64((mask * 64 + wild) & ALL)).view(np.int64)))
    return out


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked inside runs of equal keys (rows sorted by key)."""
    n = len(key)
    head = np.arange(n)  # a row that the row is joined with already
    a, b = [], []
    i = np.nonzero(key[1:] == key[:-1])[0]
    shift = 1
    while len(i):
        j = i + shift
        apart = head[i] != head[j]
        p, q = i[apart], j[apart]
        near = np.bitwise_count((fp[p] ^ fp[q]).view(np.uint64)) <= distance  # of signed numbers it would count the magnitude's bits
        p, q = p[near], q[near]
        if len(p):
            a.append(fp[p])
            b.append(fp[q])
            np.minimum.at(head, head[q], head[p])
            np.minimum.at(head, head[p], head[q])
            while True:
                up = head[head]
                if np.array_equal(up, head):
                    break
                head = up
        shift += 1
        i = i[i + shift < n]
        i = i[key[i] == key[i + shift]]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _links_of_partition(bucket: int, distance: int):
    """Rows (used, key, fp) in key order -> links (kind 0) and rows of large buckets (kind 1)."""
    names = ["kind", "a", "b", "used"]

    def give(kind, a, b, used):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(used)], names)

    def run(batches):
        k0, f0, u0, large = (np.zeros(0, np.int64),) * 3 + (None,)
        for batch in batches:
            key, fp, used = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "used"))
            key, fp, used = np.concatenate((k0, key)), np.concatenate((f0, fp)), np.concatenate((u0, used))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if large is not None and len(key) and key[0] == large:
                go = int(np.searchsorted(key, large, side="right"))
                yield give(1, fp[:go], key[:go], used[:go])
                key, fp, used, cut = key[go:], fp[go:], used[go:], max(0, cut - go)
            yield from flush(key[:cut], fp[:cut], used[:cut])
            k0, f0, u0 = key[cut:], fp[cut:], used[cut:]
            if len(k0) > bucket:
                large = int(k0[0])
                yield give(1, f0, k0, u0)
                k0, f0, u0 = k0[:0], f0[:0], u0[:0]
        yield from flush(k0, f0, u0)

    def flush(key, fp, used):
        if not len(key):
            return
        edge = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        size = np.diff(np.append(edge, len(key)))
        big = np.repeat(size > bucket, size)
        if big.any():
            yield give(1, fp[big], key[big], used[big])
        some = ~big & np.repeat(size > 1, size)
        a, b = bucket_links(key[some], fp[some], distance)
        if len(a):
            yield give(0, np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64))

    return run


def links(distinct: DataFrame, scratch: Scratch, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Links (a < b) that join exactly what chains of near fingerprints join.

    distinct: the distinct fingerprints, column fp.
    """
    rows = distinct.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("used"))
    found, level = None, 0

    def expand(batches):
        for b in batches:
            for s in range(0, b.num_rows, 20_000):
                fp, path, used = (b.column(c).slice(s, 20_000).to_numpy(zero_copy_only=False) for c in ("fp", "path", "used"))
                for u in np.unique(used):
                    mine = used == u
                    out = variants(fp[mine], int(u) & ALL, path[mine])
                    m = int(mine.sum())
                    after = np.array([x for x, _ in out], np.uint64).view(np.int64)
                    for t in range(0, len(out), 16):
                        part = out[t : t + 16]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(after[t : t + 16], m)), pa.array(np.concatenate([k for _, k in part])), pa.array(np.tile(fp[mine], len(part)))], ["used", "key", "fp"])

    while True:
        index = rows.mapInArrow(expand, "used long, key long, fp long")
        if level:
            index = index.distinct()  # a fingerprint of several large buckets meets its partners once
        dealt = index.repartition("key").sortWithinPartitions("key", "fp")
        out = scratch.save(dealt.mapInArrow(_links_of_partition(bucket, distance), "kind int, a long, b long, used long"), f"links{level}")
        mine = out.where("kind = 0").select("a", "b")
        found = mine if found is None else found.unionByName(mine)
        again = out.where("kind = 1")
        if again.isEmpty():
            joined = scratch.save(found.distinct(), "links")
            scratch.drop(*[f"links{k}" for k in range(level + 1)])
            return joined
        rows, level = again.select(F.col("a").alias("fp"), F.col("b").alias("path"), "used"), level + 1


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of the links: the smallest node that chains of links reach."""
    stars = scratch.save(edges.select("a", "b"), "stars0")
    before, turn = None, 0
    while True:
        # Large star: each larger neighbour of u is linked to u's smallest neighbour.
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        turn += 1
        stars = scratch.save(small, f"stars{turn}")
        scratch.drop(f"stars{turn - 1}")
        sign = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == sign:
            # All links now go from a node to its root.
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = sign


def _grouped(docs: DataFrame, scratch: Scratch, shingle: int, distance: int, bucket: int) -> DataFrame:
    """doc_id, row, fp, low (the least of its component: none, doc_id, row); docs: doc_id, text, row."""
    if distance > 5:
        raise ValueError("three segments with one wildcard find up to five differences")
    prints = scratch.save(fingerprints(docs, shingle), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min(place).alias("low"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, scratch, bucket, distance), scratch)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("low"))
    names = scratch.save(rooted.drop("low").join(lows, "root").select("fp", "n", "low"), "names")
    return join_by_hot_key(prints, names, ["fp"], "n")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = need(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    out = _grouped(rows, Scratch(docs.sparkSession, "simhash"), shingle, distance, bucket)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """The documents with one row of each component, all columns kept: the smallest doc_id,
    and of rows that share it the first in the table's order."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, row = numbered(docs, scratch)
    out = _grouped(need(rows, "doc_id", "text", row).toDF("doc_id", "text", "row"), scratch, shingle, distance, bucket)
    gone = scratch.save(out.where(F.col("row") != F.col("low.row")).select(F.col("row").alias(row)), "gone")
    scratch.drop("prints", "names", "distinct")
    return without_rows(rows, row, gone)
