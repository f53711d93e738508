import numpy as np
import pytest

from tessera.llm import langid, quality, toxicity
from tests.llm.helpers import AWKWARD, CLASHING, docs_frame


def table(spark, name, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def brute_profile(text, memory, order=3):
    points = [ord(c.lower()) if len(c.lower()) == 1 and c.isalpha() else (ord(c) if c.isalpha() else 0) for c in text]
    x = [0]
    for p in [*points, 0]:
        if p or x[-1]:
            x.append(p)
    v = np.zeros(memory.dimensions)
    for i in range(len(x) - order + 1):
        g = np.ones(memory.dimensions)
        for k in range(order):
            g = g * np.roll(memory(x[i + k]), order - 1 - k)
        v += g
    return v / max(np.linalg.norm(v), 1e-12)


def test_profiles_match_brute_force():
    memory = langid.ItemMemory(256)
    texts = ["Hello, World!", "ähnlich Ünd 12 so", "a", "日本 語"]
    got = langid.profiles([t.encode() for t in texts], memory)
    for t, g in zip(texts, got, strict=True):
        assert np.allclose(g, brute_profile(t, memory), atol=1e-5)


def test_language_held_out_accuracy(spark):
    docs = table(spark, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 150 and (out.lang_pred == out.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_edge_cases(spark):
    docs = docs_frame(spark, [*AWKWARD, "12 34 !!", "Ein Satz", (None, "null id"), (None, None)], CLASHING)
    got = {(r["doc_id"], i): r for i, r in enumerate(langid.identify(docs).collect())}
    assert len(got) == len(AWKWARD) + 4
    for r in got.values():
        if r["doc_id"] in (0, 1, 2, len(AWKWARD)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(docs_frame(spark, [])).count() == 0
    nothing = docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false").unionByName(docs.drop("lang").selectExpr("*", "cast(null as string) as lang").select(*docs.columns))
    assert {r["lang_pred"] for r in langid.identify(nothing).collect()} == {"und"}


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_quality_held_out(spark):
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    out = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 500
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.98
    assert (out.predicted == out.quality).mean() > 0.97


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, [*AWKWARD, (None, "x"), (2, None)], CLASHING)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(AWKWARD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    one = quality.score_quality(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0}
    assert {r["score"] for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(docs_frame(spark, []), labels).count() == 0


def test_quality_matches_a_direct_fit(spark):
    """All learning rows in one matrix: the same weights, calibration and scores as the partition sums give."""
    import zlib

    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.repartition(7), labels).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    marks = [(r["doc_id"], r["quality"]) for r in labels.where("quality is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    spare = {r["doc_id"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 5) = 0 as s").where("s").collect()}
    x = np.array([quality.statistics(texts[i]) for i, _ in marks], np.float32).astype(np.float64)
    y = np.array([q for _, q in marks], np.float64)
    f = quality.Fourier(x.mean(0), x.std(0))
    fit = np.array([i not in spare for i, _ in marks])
    z = f(x[fit])
    w = np.linalg.solve(z.T @ z + quality.RIDGE * fit.sum() / z.shape[1] / 10 * np.eye(z.shape[1]), z.T @ y[fit])
    bins = np.clip(((np.clip(f(x[~fit]) @ w, -1, 2) + 1) / 3 * quality.BINS).astype(int), 0, quality.BINS - 1)
    at = np.unique(bins)
    n = np.array([(bins == b).sum() for b in at], float)
    value = quality.pool_adjacent(n, np.array([y[~fit][bins == b].mean() for b in at]))
    ids = sorted(texts)
    raw = np.clip(f(np.array([quality.statistics(texts[i]) for i in ids], np.float32).astype(np.float64)) @ w, -1, 2)
    want = np.clip(0.999 * np.interp(raw, (at + 0.5) / quality.BINS * 3 - 1, value) + 0.001 * (raw + 1) / 3, 0, 1)
    assert np.mean(np.abs(np.array([got[i] for i in ids]) - want) < 1e-4) > 0.99


def test_isotonic():
    v = quality.pool_adjacent(np.array([1.0, 1, 2, 1]), np.array([0.0, 0.8, 0.2, 0.9]))
    assert np.allclose(v, [0, 0.4, 0.4, 0.9])


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(size=(30, 5))
    f = quality.Fourier(np.zeros(5), np.ones(5), features=20_000)
    z = f(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 5))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_network_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    table_ = rng.normal(size=(9, 6 * toxicity.HIDDEN))
    index = np.array([[0, 1, 2, 3], [4, 5, -1, -1], [6, 7, 8, -1]])
    weight = np.array([0.3, -0.7, 0.5])

    def value():
        return float((net.logits(table_, index) * weight).sum())

    _, memo = net.logits(table_, index, keep=True)
    grads, dg = net.gradients(weight, memo)
    flat = np.zeros_like(table_)
    at = index.T
    np.add.at(flat, at[at >= 0], dg[at >= 0])
    for name, array, grad in [("table", table_, flat), *[(k, net.p[k], grads[k]) for k in ("Uf", "Ub", "att", "out", "bias")]]:
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in array.shape)
            held = array[i]
            array[i] = held + 1e-3
            up = value()
            array[i] = held - 1e-3
            down = value()
            array[i] = held
            assert abs((up - down) / 2e-3 - grad[i]) < 2e-3, name


def naive_score(net, words):
    """A window's logit, word by word and step by step."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    h, p = toxicity.HIDDEN, {k: v.astype(np.float64) for k, v in net.p.items()}
    x = []
    for w in words:
        row, grams, _ = toxicity.word_inputs([w])
        x.append(p["word"][row[0]] + (p["gram"][grams].sum(0) / np.sqrt(len(grams)) if len(grams) else 0))
    runs = []
    for d, line in (("f", x), ("b", x[::-1])):
        state, states = np.zeros(h), []
        for v in line:
            g = v @ p[f"W{d}"] + p[f"b{d}"]
            z, r = sigmoid(g[:h] + state @ p[f"U{d}"][:, :h]), sigmoid(g[h : 2 * h] + state @ p[f"U{d}"][:, h : 2 * h])
            c = np.tanh(g[2 * h :] + (r * state) @ p[f"U{d}"][:, 2 * h :])
            state = (1 - z) * state + z * c
            states.append(state)
        runs.append(states if d == "f" else states[::-1])
    both = [np.concatenate(s) for s in zip(*runs, strict=True)]
    a = np.exp([s @ p["att"] for s in both])
    return float(sum(k * s for k, s in zip(a / a.sum(), both, strict=True)) @ p["out"] + p["bias"][0])


def test_scores_match_a_naive_forward_pass():
    net = toxicity.Network(2)
    r = np.random.default_rng(3)
    known = [b"w%d" % k for k in range(40)] + ["é".encode(), b"longerword"]
    for n in (1, 5, 64, 65, 200):
        words = [known[k] for k in r.integers(0, len(known), n)]
        want = max(naive_score(net, words[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(n))
        assert abs(toxicity.Scorer(net, 0.0).scores([b" ".join(words)])[0] - 1 / (1 + np.exp(-want))) < 1e-4


@pytest.mark.parametrize("n", [65_600, 131_073, 200_000])
def test_long_texts_are_scored_at_the_named_windows(monkeypatch, n):
    net, seen = toxicity.Network(2), []
    scorer = toxicity.Scorer(net, 0.0)
    monkeypatch.setattr(net, "logits", lambda table, index, keep=False: seen.extend(map(tuple, index.tolist())) or np.zeros(len(index)))
    words = [b"x%d" % (k % 5000) for k in range(n)]
    scorer.scores([b" ".join(words)])
    rows = [scorer.rows[w] for w in words]
    assert sorted(seen) == sorted(tuple(rows[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(n))


def test_learning_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k % 400} " + "w " * 20) for k in range(2000)] + [(3, "same")] * 500, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(50)] * 3, "doc_id long, y int")
    got = toxicity._sample(docs, marks, 30, 10**9).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 30, 1: 30}
    assert toxicity._sample(docs, marks, 30, 200).count() <= 8
    one = toxicity._sample(docs, marks, 10**6, 10**9)
    assert one.count() == one.distinct().count() == docs.distinct().count()


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500, 1000):
        starts = toxicity.window_starts(n)
        seen = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    out = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").toPandas()
    y, p = out.toxic.to_numpy(), out.predicted.to_numpy()
    assert ((p == 1) & (y == 1)).sum() >= 0.75 * (y == 1).sum()
    assert ((p == 1) & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def test_toxicity_scores_do_not_depend_on_company_or_cache(spark):
    net = toxicity.Network(1)
    texts = [(t or "").encode() for t in AWKWARD] + [b"one two three", b"word " * 700 + b"other"]
    whole = toxicity.Scorer(net, 0.0).scores(texts)
    alone = np.array([toxicity.Scorer(net, 0.0, limit=2).scores([t])[0] for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)
    assert whole[0] == whole[1] == 0.0


@pytest.mark.parametrize("which", ["none", "one class", "both"])
def test_toxicity_edge_cases(spark, which):
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0) if which == "both" else 1) for i in range(10)] + [(None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    labels = labels.where("false") if which == "none" else labels
    docs = docs_frame(spark, [*AWKWARD, (None, "x"), (2, None)], CLASHING)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(AWKWARD) + 2 and all(0 <= r["score"] <= 1 for r in got)
    if which != "both":
        assert {r["score"] for r in got} == {0.0 if which == "none" else 1.0}
    assert toxicity.toxicity(docs_frame(spark, []), labels).count() == 0
    clash = docs_frame(spark, ["a b", "c"], ("toxicity", "Toxicity_", "score"))
    kept = toxicity.drop_toxic(clash, labels.where("toxic = 0 or doc_id > 5"), threshold=2.0)
    assert kept.columns == clash.columns and {tuple(r)[-3:] for r in kept.collect()} == {("toxicity", "Toxicity_", "score")}
