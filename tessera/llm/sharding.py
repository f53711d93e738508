"""Reproducible global shuffle: a Feistel permutation with cycle walking over row numbers.

Rows are numbered 0..N-1 in ``doc_id`` order (ties: text size, then text checksum, so
that the numbering does not depend on the input's partitions).  A keyed Feistel network
on the smallest even number of bits that holds N permutes the numbers; a value that
falls outside 0..N-1 is permuted again until it falls inside (cycle walking), which
keeps the map a bijection.  Shard and slot then follow by arithmetic alone: row ``r``
goes to shard ``p(r) mod k``, slot ``p(r) div k``, so shard sizes differ by one row at
most, whatever the texts are, and any reader can compute where a row number lies.

Edge cases: a null text has size 1 and the checksum of the empty string; a null doc_id
sorts first; repeated rows get different numbers; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, need, prepare

ROUNDS = 6
_M64 = (1 << 64) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Round keys from a seed, by a SplitMix64 sequence."""
    keys, x = [], seed & _M64
    for _ in range(rounds):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        keys.append(z ^ (z >> 31))
    return keys


def half_bits(n: int) -> int:
    """Bits of each Feistel half: 4**bits is the least power of four that is >= n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of 0..n-1 named by seed, applied to an array of row numbers."""
    bits = half_bits(n)
    mask, keys = np.uint64((1 << bits) - 1), [np.uint64(k) for k in round_keys(seed)]
    b, x = np.uint64(bits), rows.astype(np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> b, v & mask
        for key in keys:
            mix = (right + key) * np.uint64(0xFF51AFD7ED558CCD)
            mix ^= mix >> np.uint64(33)
            mix *= np.uint64(0xC4CEB9FE1A85EC53)
            mix ^= mix >> np.uint64(29)
            left, right = right, (left ^ mix) & mask
        return (left << b) | right

    if not len(x):
        return x.astype(np.int64)
    with np.errstate(over="ignore"):
        x = once(x)
        outside = np.nonzero(x >= np.uint64(n))[0]
        while len(outside):  # cycle walking
            x[outside] = once(x[outside])
            outside = outside[x[outside] >= np.uint64(n)]
    return x.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 20) -> tuple[int, int]:
    """(shard, slot) of one row number, without any table."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def number_rows(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Adds ``row_number`` 0..N-1 in the order of the named columns; also gives N.

    Rows are range-partitioned, sorted and written once with their place in their own
    partition; the partitions' first numbers come from one row for each partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.save(placed, "placed")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    firsts = scratch.save(counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "firsts")
    n = firsts.agg(F.sum("_n")).first()[0] or 0
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("_part", part).join(firsts.select("_part", "_first"), "_part").withColumn("row_number", F.col("_first") + local)
    return out.drop("_part", "_first", "_at"), int(n)


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, row_number, position (in the shuffled order), shard, slot."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = need(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(sized, ["doc_id", "size", "text_crc32"], Scratch(docs.sparkSession, "shards"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, row_number long, position long, shard int, slot long"

    def place(batches):
        for b in batches:
            p = permute(b.column("row_number").to_numpy(zero_copy_only=False), n, seed)
            cols = [b.column(c) for c in ("doc_id", "size", "text_crc32", "row_number")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], ["doc_id", "size", "text_crc32", "row_number", "position", "shard", "slot"])

    return numbered.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(place, schema)
