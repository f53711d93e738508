import random
import zlib

import numpy as np
import pytest

from tessera.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents
from tessera.llm.sstable import Shard, ShardWriter, encode_to_shards, id_of, key_of, lookup, read_shards, write_shards
from tessera.llm.tokens import END_ID, Encoder, default_vocabulary
from tests.llm.helpers import AWKWARD, CLASHING, docs_frame, random_texts

TEXTS = AWKWARD + random_texts(40) + ["It's 12,5 km! don't we'LL", "J̌ á Å", "İstanbul ΣΑΣ ς", "x\u0085y z\x1cq\x0bw", "日本語テキスト 中文", "<|endoftext|> hi <|startoftext|>"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, END_ID] for i, x in enumerate(TEXTS)}


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_chunks_equal_whole_texts(whole):
    for limit in (300_000, 5):
        enc = Encoder(default_vocabulary(), limit)
        assert enc.chunked
        got = enc.ids([(t or "").encode() for t in TEXTS])
        assert [g + raw([END_ID]) for g in got] == [raw(whole[i]) for i in range(len(TEXTS))]


def test_shards_round_trip(spark, whole):
    manifest = write_shards(docs_frame(spark, TEXTS, CLASHING), block_bytes=200, shard_bytes=3000)
    rows = sorted(read_shards(spark, manifest).collect())
    start = 0
    for r in rows:
        ids = whole[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    assert [r["doc_id"] for r in rows] == list(range(len(TEXTS)))
    files = manifest.orderBy("part", "seq").collect()
    assert len(files) > 2
    for f in files:
        shard = Shard(open(f["path"].removeprefix("file://"), "rb").read())
        keys = [id_of(k) for k, _, _ in shard.scan()]
        assert keys == sorted(keys)
        for k in keys:
            assert shard.get(k) == [raw(whole[k])]
        assert shard.get(10**9) == []
    for i in (0, 7, len(TEXTS) - 1):
        assert lookup(manifest, i) == [raw(whole[i])]
    assert lookup(manifest, 10**9) == [] and lookup(manifest, None) == []


def test_shard_keys_and_repeats():
    w = ShardWriter(block_bytes=40)
    ids = [None, None, -(1 << 63), -5, 0, 3, 3, 3, 3, 70_000, (1 << 63) - 1]
    for k, i in enumerate(ids):
        w.add(key_of(i), raw([k, 70_000 if k % 2 else 1]))
    shard = Shard(w.finish())
    assert [id_of(k) for k, _, _ in shard.scan()] == ids
    assert shard.get(3) == [raw([k, 70_000 if k % 2 else 1]) for k in (5, 6, 7, 8)]
    assert len(shard.get(None)) == 2 and shard.get(4) == []
    assert sum(shard.may_hold(key_of(i)) for i in range(10**6, 10**6 + 1000)) < 50


def test_empty_and_repeated_rows(spark):
    assert encode_to_shards(docs_frame(spark, [])).count() == 0
    assert pack_documents(docs_frame(spark, [])).count() == 0
    got = encode_to_shards(docs_frame(spark, [(1, "a"), (1, "a"), (None, "b c")])).collect()
    assert sorted(r["start"] for r in got) == [0, 3, 5] and [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][0] is None
    assert pack_documents(docs_frame(spark, [(1, "a"), (1, "a"), (None, None)])).count() == 3


def test_special_strings_are_what_the_plain_call_makes_of_them():
    enc = Encoder(default_vocabulary())
    got = enc.ids([b"a <|endoftext|> b", b"<|ENDOFTEXT|>", b"a b"])
    assert 49407 in np.frombuffer(got[0], "<u4") and 49407 not in np.frombuffer(got[1], "<u4")


def test_equal_rows_do_not_meet_in_one_partition(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import Scratch

    # 100,000 equal rows of 3,000 ids and 40,000 others, more than the bits of one partition's bins once held.
    one = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(3000).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    other = spark.range(40_000).select((F.col("id") + 8).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 1500 + 500).alias("length"), F.col("id").alias("ids_crc32"))
    got = pack(one.unionByName(other), Scratch(spark, "t")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces"), F.countDistinct("offset").alias("places")).agg(F.max("n"), F.sum("pieces"), F.sum("places")).first()
    assert got[0] <= 4096 and got[1] == got[2] == 140_000


def exact_bins(sizes, capacity):
    """Fewest bins, by trying all places."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


def test_lower_bound_never_exceeds_the_optimum():
    r = random.Random(3)
    for _ in range(60):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        bins = best_fit_decreasing(sizes, 20)
        used = np.bincount(bins, weights=sizes)
        assert used.max() <= 20
        low = lower_bound(np.bincount(sizes, minlength=21), 20)
        assert np.ceil(low - 1e-9) <= exact_bins(sizes, 20) <= len(used)
    assert lower_bound(np.bincount([12] * 7, minlength=21), 20) == 7


@pytest.mark.parametrize("capacity,partition", [(64, 50), (64, 5000), (40, 20)])
def test_packing(spark, whole, capacity, partition):
    rows = pack_documents(docs_frame(spark, TEXTS, CLASHING), capacity=capacity, partition_pieces=partition).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, ids in whole.items():
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // capacity)))
        for p in pieces:
            part = ids[p["piece"] * capacity : (p["piece"] + 1) * capacity]
            assert (p["start"], p["length"], p["ids_crc32"]) == (p["piece"] * capacity, len(part), zlib.crc32(raw(part)))
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    total = sum(map(len, whole.values()))
    assert len(by_seq) <= -(-total // capacity) + 1


def test_exchange_lowers_the_count(spark):
    from tessera.llm.common import Scratch

    r = random.Random(5)
    rows = [(i, 0, 0, r.randint(1, 60), i) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(df, Scratch(spark, "t"), capacity=100, partition_pieces=40).collect()
    assert len(got) == 800
    bins = {}
    for x in got:
        bins[x["sequence_id"]] = bins.get(x["sequence_id"], 0) + x["length"]
    assert max(bins.values()) <= 100
    assert len(bins) <= -(-sum(x[3] for x in rows) // 100) + 1


def test_exchange_goes_on_while_it_brings_something(spark, monkeypatch):
    from tessera.llm import packing
    from tessera.llm.common import Scratch

    r = random.Random(1)
    rows = [(i, 0, 0, r.randint(22, 38), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    totals, rounds = [], []
    scratch = Scratch(spark, "t")
    save = scratch.save
    monkeypatch.setattr(scratch, "save", lambda frame, name: (rounds.append(save(frame, name)) or rounds[-1]) if name.startswith("round") else save(frame, name))
    bins = pack(df, scratch, capacity=100, partition_pieces=20).groupBy("sequence_id").sum("length").collect()
    assert sum(b[1] for b in bins) == sum(x[3] for x in rows) and max(b[1] for b in bins) <= 100
    closed = 0
    for packed in rounds:
        n = {o: packed.where("open" if o else "not open").select("group", "bin").distinct().count() for o in (True, False)}
        closed += n[False]
        totals.append(closed + n[True])
    assert len(rounds) > 7 and len(bins) == min(totals)

