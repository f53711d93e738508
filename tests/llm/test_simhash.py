import random

import numpy as np
import pytest
import xxhash

from tessera.llm.common import Scratch
from tessera.llm.simhash import bucket_links, components, drop_near_copies, fingerprint_batch, links, near_groups, segments
from tests.llm.helpers import AWKWARD, CLASHING, docs_frame, random_texts


def brute_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    n = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = list(prints)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_fingerprints_match_brute_force():
    texts = AWKWARD + random_texts(30) + ["one two three", "one two three four", "A B c D e"]
    got = fingerprint_batch([None if t is None else t.encode() for t in texts]).view(np.uint64).tolist()
    assert got == [brute_fingerprint(t) for t in texts]


def test_segments_find_every_pair_within_four():
    cut = segments(list(range(64)))
    assert [b for s in cut for b in s] == list(range(64)) and len(cut) == 3


def near_family(n, seed, spread=4):
    """Fingerprints around a few centres, chains and random ones."""
    r = random.Random(seed)
    out = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(n // 8):
            x = c
            for b in r.sample(range(64), r.randint(0, spread)):
                x ^= 1 << b
            out.add(x)
    x = r.getrandbits(64)
    for _ in range(n // 4):
        for b in r.sample(range(64), 4):
            x ^= 1 << b
        out.add(x)
    out |= {r.getrandbits(64) for _ in range(n // 4)} | {0, (1 << 64) - 1, 15, 31}
    return [np.uint64(v).astype(np.int64).item() for v in out]


def shared_segment(n, seed):
    """Fingerprints that agree on a whole segment, with near pairs among them: a large bucket."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64) & ~((1 << 22) - 1) | 12345
        out |= {x, x ^ sum(1 << b for b in r.sample(range(22, 64), r.randint(3, 5)))}
    return [np.uint64(v).astype(np.int64).item() for v in out]


@pytest.mark.parametrize("bucket,seed,make", [(16_384, 1, near_family), (16_384, 2, near_family), (12, 3, shared_segment)])
def test_links_and_components_match_brute_force(spark, bucket, seed, make):
    prints = make(120, seed)
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    found = links(df, scratch, bucket)
    for r in found.collect():
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4
    got = {r["node"]: r["root"] for r in components(found, scratch).collect()}
    want = brute_components(prints)
    for p in prints:
        assert all((got.get(p, p) == got.get(q, q)) == (want[p] == want[q]) for q in prints)


def test_bucket_links_join_families_with_few_links():
    r = random.Random(9)
    fp = np.array(sorted({(1 << 40) ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for _ in range(800)}), np.int64)
    a, b = bucket_links(np.zeros(len(fp), np.int64), fp)
    assert len(a) < 4 * len(fp)
    assert len(set(brute_components(fp.tolist()).values())) == 1


def test_near_groups(spark):
    r = random.Random(4)
    base = random_texts(12, longest=400)
    texts = AWKWARD + base
    for t in base:
        w = t.split()
        for _ in range(3):
            if len(w) > 100:
                v = list(w)
                v[r.randrange(len(v))] = "changed"
                texts.append(" ".join(v))
    got = near_groups(docs_frame(spark, texts, CLASHING)).collect()
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    root = brute_components(set(prints.values()))
    low = {}
    for i in sorted(prints):
        low.setdefault(root[prints[i]], i)
    assert sorted(tuple(x) for x in got) == [(i, f"{prints[i]:016x}", low[root[prints[i]]]) for i in sorted(prints)]
    kept = drop_near_copies(docs_frame(spark, texts)).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(low.values())


def test_dropping_near_copies_goes_by_rows(spark):
    extra = ("fp", "low", "row", "_row", "N", "_id")
    docs = docs_frame(spark, [(0, "t"), (1, "t"), (1, "other words here now"), (1, "other words here now"), (None, "other words here now"), (None, "third text of its own"), (5, None), (5, "")], extra)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert all(r[c] == c for r in rows for c in extra)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in rows) == [("0", "t"), ("1", "other words here now"), ("5", ""), ("None", "third text of its own")]
    assert drop_near_copies(docs_frame(spark, [], extra)).count() == 0


def test_empty_and_nulls(spark):
    assert near_groups(docs_frame(spark, [])).count() == 0
    got = near_groups(docs_frame(spark, [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b c d e f")])).collect()
    assert sorted((str(x["doc_id"]), str(x["component_id"])) for x in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "3"), ("None", "None")]
