import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm.decontaminate import FmIndex, contamination, drop_contaminated, find_spans, remove_spans, suffix_array
from tests.llm.helpers import AWKWARD, docs_frame, random_texts


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1) if v else ():
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                if item is not None:
                    found.add(str(item))
    names = sorted(found)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def fixture():
    r = random.Random(7)
    items = [(i, t) for i, t in enumerate(random_texts(12, seed=8, words=60, longest=40))]
    items += [(50, "alpha beta"), (51, "Gamma"), (52, None), (53, "..."), (0, "twice named item"), (None, "nameless passage here"), (10, "alpha beta")]
    texts = AWKWARD + random_texts(40, seed=9, words=60, longest=200)
    for _ in range(30):
        a, (_, b) = r.choice(texts) or "", r.choice(items)
        cut = a.split()[:150]
        k = r.randint(0, len(cut))
        texts.append(" ".join([*cut[:k], (b or "").upper(), *cut[k:]]))
    texts += ["alpha beta", "ALPHA-beta gamma", "alpha", "x alpha beta alpha beta", "twice; named (item) nameless passage here"]
    return texts, items


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_matches_brute_force(spark, block):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, texts, ("key", "n", "at"))
    if block < 1000:
        found = {r["doc_id"]: r for r in find_spans(docs, bench, block_bytes=block)[0].collect()}
        got = [(i, found[i]["n_words"], sum(s["end"] - s["first"] for s in found[i]["spans"]), len(found[i]["items"])) for i in sorted(found)]
        assert got == [(i, *brute(t, items)[:3]) for i, t in enumerate(texts)]
    else:
        got = sorted(tuple(r)[:6] for r in contamination(docs, bench).collect())
        assert got == [(i, *brute(t, items)) for i, t in enumerate(texts)]
        kept = {r["doc_id"] for r in drop_contaminated(docs, bench).collect()}
        assert kept == {i for i, t in enumerate(texts) if not brute(t, items)[-1]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs_frame(spark, []), none).count() == 0
    rows = contamination(docs_frame(spark, ["a b", None]), none).collect()
    assert [(r["n_hit"], r["contaminated"]) for r in rows] == [(0, False)] * 2
    out, names = find_spans(docs_frame(spark, ["a"], ("spans", "Items")), none)
    assert names == ["n_words", "spans_", "items_"] and out.first()["spans"] == "spans"


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_dropping_keeps_columns_of_any_name(spark, block):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = ("n_hit", "contaminated", "N_Words", "spans", "items", "_row", "row")
    docs = docs_frame(spark, [*texts, (3, "alpha beta"), (3, "alpha beta"), (None, "clean words")], extra)
    kept = drop_contaminated(docs, bench, block)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(r[c] == c for r in rows for c in extra)
    ids = [*range(len(texts)), 3, 3, None]
    want = [(str(i), t) for i, t in zip(ids, [*texts, "alpha beta", "alpha beta", "clean words"], strict=True) if not brute(t, items)[-1]]
    assert sorted(((str(r["doc_id"]), r["text"]) for r in rows), key=repr) == sorted(want, key=repr)


def test_benchmark_of_several_blocks_is_merged_by_row(spark):
    texts, items = fixture()
    bench = spark.createDataFrame([*items, *items], "item_id long, text string")  # repeated items count once
    docs = docs_frame(spark, [(1, t) for t in texts])  # one doc_id for all rows
    want = sorted(brute(t, items) for t in texts)
    for block in (2 << 20, 2000, 300):
        got = contamination(docs, bench, block).collect()
        assert sorted(tuple(r)[1:6] for r in got) == want


def test_suffix_array_and_index():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 50, 300):
        x = r.integers(0, 3, n)
        assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    runs = [r.integers(1, 4, r.integers(1, 30)) for _ in range(20)]
    line = np.concatenate([np.append(s, 0) for s in runs])
    for sample in (1, 3, 8):
        index = FmIndex(line, sample)
        for m in (1, 2, 4):
            phrases = np.array([p for p in np.ndindex(*[4] * m) if 0 not in p])
            hit, low, high = index.search(phrases)
            for p in range(len(phrases)):
                want = [i for i in range(len(line) - m + 1) if (line[i : i + m] == phrases[p]).all()]
                rows = [np.arange(a, b) for h, a, b in zip(hit, low, high, strict=True) if h == p]
                assert sorted(index.locate(rows[0]).tolist() if rows else []) == want


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_word_number_after_the_largest_of_a_shard(spark, k):
    top = 2**k - 1
    index = FmIndex(np.append(np.arange(1, top + 1), 0))
    phrases = np.array([[top, top + 1], [top + 1, top + 1], [top + 1, top], [max(1, top - 1), top]])
    hit, low, high = index.search(phrases)
    want = [3] if top > 1 else []
    assert hit.tolist() == want and (high - low).tolist() == [1] * len(want) and index.locate(low).tolist() == [top - 2][: len(want)]
    # Items number their words in order; the text holds the first 2^k - 1 of them, the last item two further ones.
    known = [f"w{i}" for i in range(top)]
    items = [(1, " ".join(known)), (2, f"{known[-1]} next"), (3, "next")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(known), f"x {known[-1]} y", known[-1]]
    got = sorted(tuple(r)[:6] for r in contamination(docs_frame(spark, texts), bench).collect())
    assert got == [(i, *brute(t, items)) for i, t in enumerate(texts)]


def test_remove_spans():
    assert remove_spans("One, two three! Four five", [(1, 3)]) == "One, ! Four five"
    assert remove_spans("Ünd a b", [(0, 1), (2, 3)]) == " a "
