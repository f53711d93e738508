import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import drop_exact_copies, exact_groups
from tessera.llm.sharding import feistel_shards, locate, permute
from tests.llm.helpers import AWKWARD, CLASHING, docs_frame, random_texts


def normal(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("block,book", [(1024, 48 << 20), (4, 300), (3, 1 << 20)])
def test_exact_groups_match_brute_force(spark, block, book):
    texts = AWKWARD + random_texts(60) + random_texts(30) + ["abcd" * k for k in range(9)] + ["abcdabce", "abcdabcd x"]
    texts = [t if t is None or len(t) < 10_000 or block > 100 else t[:2000] for t in texts]
    rows = list(enumerate(texts))
    got = exact_groups(docs_frame(spark, texts, CLASHING), block, book).collect()
    assert sorted(tuple(r) for r in got) == brute_exact(rows)


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(5, "x y"), (5, "x  y"), (5, "x y"), (None, "x y"), (None, "z"), (7, "z"), (None, None), (None, "")]
    got = exact_groups(docs_frame(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 3
    assert {(r["doc_id"], r["group_size"]) for r in got if r["kept"]} == {(5, 4), (7, 2), (None, 2)}
    left = drop_exact_copies(docs_frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"] is None or normal(r["text"])) for r in left if r["doc_id"] is not None) == [("5", "x y"), ("7", "z")]
    assert exact_groups(docs_frame(spark, [])).count() == 0


def test_dropping_exact_copies_keeps_one_row_and_any_column(spark):
    extra = ("_sha", "_id", "row", "_row", "_ROW_", "first", "name", "Book")
    rows = [(0, "t  u"), (1, "t u"), (1, "t u"), (1, "other"), (1, "other"), (None, "t u"), (None, None), (None, ""), (2, "x" * 5000), (1, "x" * 5000)]
    for block, book in ((1024, 48 << 20), (3, 20)):
        docs = docs_frame(spark, rows if block > 3 else rows[:8], extra)
        left = drop_exact_copies(docs, block, book)
        assert left.columns == docs.columns
        got = left.collect()
        assert all(r[c] == c for r in got for c in extra)
        want = [("0", "t u"), ("1", "other"), ("None", ""), *([("1", "x" * 5000)] if block > 3 else [])]
        assert sorted((str(r["doc_id"]), normal(r["text"])) for r in got) == sorted(want)
    assert drop_exact_copies(docs_frame(spark, [], extra)).count() == 0


def test_hot_keys_and_large_removals_take_the_same_way(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import Scratch, join_by_hot_key, numbered, without_rows

    rows = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    want = sorted(map(tuple, rows.join(facts, "k").select("k", "id", "n", "low").collect()))
    for hot in (1, 200, 10**9):
        assert sorted(map(tuple, join_by_hot_key(rows, facts, ["k"], "n", hot).select("k", "id", "n", "low").collect())) == want
    scratch = Scratch(spark, "t")
    table, row = numbered(rows, scratch)
    gone = scratch.save(table.where("id % 3 = 0").select(row), "gone")
    for bound in (10, 10**6):
        assert sorted(r["id"] for r in without_rows(table, row, gone, bound).collect()) == [i for i in range(1000) if i % 3]


def feistel(x, n, seed):
    """The same permutation in plain integers."""
    m64, bits, keys, state = (1 << 64) - 1, 1, [], seed
    while 4**bits < n:
        bits += 1
    for _ in range(6):
        state = (state + 0x9E3779B97F4A7C15) & m64
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & m64
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m64
        keys.append(z ^ z >> 31)
    while True:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for k in keys:
            f = ((right + k) * 0xFF51AFD7ED558CCD) & m64
            f = ((f ^ f >> 33) * 0xC4CEB9FE1A85EC53) & m64
            left, right = right, (left ^ f ^ f >> 29) & ((1 << bits) - 1)
        x = left << bits | right
        if x < n:
            return x


def test_permutation_matches_plain_integers():
    import numpy as np

    for n in (1, 2, 5, 17, 1000, 70_000):
        some = range(0, n, max(1, n // 50))
        assert permute(np.array(list(some)), n, 20).tolist() == [feistel(x, n, 20) for x in some]


def test_permutation_is_a_bijection():
    import numpy as np

    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for seed in (0, 20, 12345):
            assert sorted(permute(np.arange(n), n, seed).tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 1).tolist() != permute(np.arange(1000), 1000, 2).tolist()


def test_shards(spark):
    rows = list(enumerate(AWKWARD + random_texts(50))) + [(3, "a"), (None, "n"), (3, "a")]
    got = feistel_shards(docs_frame(spark, rows, CLASHING[:3]), shards=8).collect()
    assert len(got) == len(rows)
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    for r in got:
        assert (r["shard"], r["slot"]) == locate(r["row_number"], len(rows), 8)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    known = {i: t for i, t in rows if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            raw = (known[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    # The same numbers whatever the partitions are.
    again = feistel_shards(docs_frame(spark, rows).repartition(7, "text"), shards=8).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["row_number"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert feistel_shards(docs_frame(spark, [])).count() == 0
