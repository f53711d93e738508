"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Every word enters as the sum of a word vector (hashed) and the mean of its character
n-gram vectors (hashed n-grams of 3 to 5 bytes with word ends).  A forward and a
backward recurrent layer read a window of words, attention pools the states, a logistic
unit scores the window.  A text is cut into overlapping windows, all of them are
scored, and the text's score is that of its highest window.

Training is plain numpy with Adam on a bounded sample of labelled texts: of each class
the ``sample`` texts of the least hash, as far as ``sample_bytes`` go (documented
bounds, which hold for any table; a repeated text counts once): a text's loss is taken
at its highest window.  One task trains, so neither texts nor training are the driver's:
the parameters, 3 MB whatever the table, are what reaches it.  The classes are balanced in the
sample, and the output is moved back to the share of toxic texts among all labels.

Scoring is one pass over whole texts without a shuffle.  A worker keeps a bounded
table of the words it met with their input projections, so a word costs its vectors
once, and windows run through the recurrence many at a time.

Edge cases: null and wordless texts score 0; a null doc_id is not held out, never
learned from, and scored; a document with labels of both kinds counts as each; without labels of
both classes every text scores the share of toxic labels (0 without any); repeated rows
score alike; very long texts are scored in blocks of their windows; extra columns are
ignored, and kept by ``drop_toxic`` whatever they are called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, free_names, need, prepare, texts_of
from tessera.llm.langid import held_out_flag

HIDDEN, EMBED, WINDOW, STRIDE = 12, 16, 64, 48
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 14, 1 << 15, (3, 4, 5)
SAMPLE, EPOCHS, SEED, BATCH = 3000, 4, 5, 48
#: Bytes of text of each class to learn from.
SAMPLE_BYTES = 32 << 20
CACHE_WORDS = 200_000
#: Windows that run through the recurrence at a time.
ROWS = 1024
#: Windows of one text whose words are looked up at a time.
BLOCK_WINDOWS = 1365
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))
_FOLD = re.compile(rb"\xc3[\x80-\x9e]")


def words_of(text: bytes | None) -> list[bytes]:
    """Lowered words: letters, digits and non-ASCII characters."""
    low = (text or b"").translate(_LOWER)
    if b"\xc3" in low:  # capital letters of Latin-1
        low = _FOLD.sub(lambda m: b"\xc3" + bytes([m[0][1] + 32]), low)
    return low.split()


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row of each word, n-gram rows of all words, the word of each n-gram)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    line = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(line)) - first[owner]
    # A whole word's hash: sum of its mixed (byte, place) pairs.
    mixed = _spread(line * np.uint64(1_000_003) + place.astype(np.uint64) * np.uint64(7_368_787) + np.uint64(1))
    word = (np.add.reduceat(mixed, first) >> np.uint64(7)) % np.uint64(WORD_ROWS) if len(words) else np.zeros(0, np.uint64)
    rows, owners = [], []
    for n in GRAMS:
        if len(line) < n:
            continue
        gram = np.zeros(len(line) - n + 1, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(257) + line[k : len(line) - n + 1 + k]
        inside = owner[: len(gram)] == owner[n - 1 :]
        rows.append((_spread(gram + np.uint64(n)) >> np.uint64(9)) % np.uint64(GRAM_ROWS))
        rows[-1] = rows[-1][inside]
        owners.append(owner[: len(gram)][inside])
    if not rows:
        return word.astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, owners = np.concatenate(rows).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return word.astype(np.int64), rows[order], owners[order]


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of overlapping windows that cover n words; the last ends with the text."""
    if n <= window:
        return [0] if n else []
    out = list(range(0, n - window, stride))
    return [*out, n - window]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. Each direction: W (E,3H), U (H,3H), b (3H); gates z, r, candidate."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED

        def mat(*shape, scale):
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.p = {"word": mat(WORD_ROWS, e, scale=0.1), "gram": mat(GRAM_ROWS, e, scale=0.2)}
        for d in "fb":
            self.p |= {f"W{d}": mat(e, 3 * h, scale=e**-0.5), f"U{d}": mat(h, 3 * h, scale=h**-0.5), f"b{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": mat(2 * h, scale=0.3), "out": mat(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}

    def embed(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Vectors of distinct words, and what embed_back needs."""
        word, gram, owner = word_inputs(words)
        n = np.bincount(owner, minlength=len(words)).astype(np.float32)
        x = self.p["word"][word].copy()
        if len(gram):
            has = np.nonzero(n)[0]
            at = np.searchsorted(owner, has)
            x[has] += np.add.reduceat(self.p["gram"][gram], at, axis=0) / np.sqrt(n[has, None])
        return x, (word, gram, owner, n)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input projections of both directions, side by side."""
        return np.hstack((x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]))

    def _direction(self, g: np.ndarray, d: str, mask: np.ndarray, keep: bool):
        """g: (T, B, 3H) input projections in reading order. States (T, B, H)."""
        h, u = HIDDEN, self.p[f"U{d}"]
        state = np.zeros((g.shape[1], h), np.float32)
        out, memo = np.empty((*g.shape[:2], h), np.float32), []
        for t in range(len(g)):
            zr = _sigmoid(g[t, :, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            rs = r * state
            c = np.tanh(g[t, :, 2 * h :] + rs @ u[:, 2 * h :])
            new = state + (z * (c - state)) * mask[t]
            if keep:
                memo.append((state, z, r, c, rs))
            out[t] = state = new
        return out, memo

    def logits(self, table: np.ndarray, index: np.ndarray, keep: bool = False):
        """index: (B, T) rows of table (projections), -1 where a window has no word."""
        h = HIDDEN
        at = index.T
        mask = (at >= 0).astype(np.float32)[:, :, None]
        g = table[at]
        fwd, mf = self._direction(g[:, :, : 3 * h], "f", mask, keep)
        bwd, mb = self._direction(g[::-1, :, 3 * h :], "b", mask[::-1], keep)
        states = np.concatenate((fwd, bwd[::-1]), axis=2)
        e = states @ self.p["att"] + (mask[:, :, 0] - 1) * 1e4
        e -= e.max(axis=0)
        a = np.exp(e)
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        y = pooled @ self.p["out"] + self.p["bias"][0]
        return (y, (at, mask, g, states, a, pooled, mf, mb)) if keep else y

    def gradients(self, dy: np.ndarray, memo: tuple) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the projections, and of the projections (T, B, 6H)."""
        at, mask, g, states, a, pooled, mf, mb = memo
        h = HIDDEN
        grads = {"out": pooled.T @ dy, "bias": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * self.p["out"]
        da = np.einsum("bh,tbh->tb", dpool, states)
        de = a * (da - (a * da).sum(axis=0))
        grads["att"] = np.einsum("tb,tbh->h", de, states)
        dstates = a[:, :, None] * dpool[None] + de[:, :, None] * self.p["att"]
        dg = np.zeros_like(g)
        for d, memo_d, ds, view, m in (("f", mf, dstates[:, :, :h], dg[:, :, : 3 * h], mask), ("b", mb, dstates[::-1, :, h:], dg[::-1, :, 3 * h :], mask[::-1])):
            u = self.p[f"U{d}"]
            du, back = np.zeros_like(u), np.zeros((g.shape[1], h), np.float32)
            for t in range(len(ds) - 1, -1, -1):
                state, z, r, c, rs = memo_d[t]
                dn = ds[t] + back
                masked = dn * m[t]
                dz = masked * (c - state) * z * (1 - z)
                dc = masked * z * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                gate = np.hstack((dz, dr))
                view[t, :, : 2 * h], view[t, :, 2 * h :] = gate, dc
                du[:, : 2 * h] += state.T @ gate
                du[:, 2 * h :] += rs.T @ dc
                back = dn - masked * z + drs * r + gate @ u[:, : 2 * h].T
            grads[f"U{d}"] = du
        return grads, dg


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict, rows: dict[str, np.ndarray]) -> None:
        """rows: for the embedding tables, the rows that grads[k] belongs to."""
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = rows.get(k, slice(None))
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= size * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of word numbers padded by -1, the text of each window)."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        for s in window_starts(len(t)):
            rows.append(t[s : s + WINDOW])
            owner.append(i)
    out = np.full((len(rows), max(map(len, rows), default=1)), -1, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, np.array(owner, np.int64)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fits the network; the loss of a text is that of its highest window."""
    net, rng = Network(seed), np.random.default_rng(seed + 1)
    known: dict[bytes, int] = {}
    split = []
    for t in texts:
        words = words_of(t)
        split.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
    vocabulary = list(known)
    use = np.array([i for i, w in enumerate(split) if len(w)], np.int64)
    adam = Adam(net.p)
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - 0.8 * epoch / max(1, epochs - 1))
        rng.shuffle(use)
        by_size = use[np.argsort([-(len(split[i]) // WINDOW) for i in use], kind="stable")]
        starts = list(range(0, len(by_size), BATCH))
        rng.shuffle(starts)
        for s in starts:
            mine = by_size[s : s + BATCH]
            here, number = np.unique(np.concatenate([split[i] for i in mine]), return_inverse=True)
            docs = np.split(number, np.cumsum([len(split[i]) for i in mine])[:-1])
            x, link = net.embed([vocabulary[i] for i in here.tolist()])
            table = net.project(x)
            index, owner = _windows(docs)
            y = np.concatenate([net.logits(table, index[k : k + ROWS]) for k in range(0, len(index), ROWS)])
            order = np.lexsort((y, owner))
            last = order[np.append(np.nonzero(np.diff(owner[order]))[0], len(order) - 1)]
            y, memo = net.logits(table, index[last], keep=True)
            dy = ((_sigmoid(y) - labels[mine[owner[last]]]) / len(last)).astype(np.float32)
            grads, dg = net.gradients(dy, memo)
            at = index[last].T
            there = at >= 0
            flat = np.zeros_like(table)
            np.add.at(flat, at[there], dg[there])
            h3 = 3 * HIDDEN
            grads |= {"Wf": x.T @ flat[:, :h3], "Wb": x.T @ flat[:, h3:], "bf": flat[:, :h3].sum(axis=0), "bb": flat[:, h3:].sum(axis=0)}
            dx = flat[:, :h3] @ net.p["Wf"].T + flat[:, h3:] @ net.p["Wb"].T
            word, gram, gowner, n = link
            rows_w, inv = np.unique(word, return_inverse=True)
            gw = np.zeros((len(rows_w), EMBED), np.float32)
            np.add.at(gw, inv, dx)
            grads["word"], where = gw, {"word": rows_w}
            if len(gram):
                rows_g, inv = np.unique(gram, return_inverse=True)
                gg = np.zeros((len(rows_g), EMBED), np.float32)
                np.add.at(gg, inv, dx[gowner] / np.sqrt(n[gowner, None]))
                grads["gram"], where["gram"] = gg, rows_g
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            if norm > 5:
                grads = {k: g * (5 / norm) for k, g in grads.items()}
            adam.step(grads, where)
    return net


class Scorer:
    """Scores texts with a trained network; keeps a bounded table of words."""

    def __init__(self, net: Network, shift: float, limit: int = CACHE_WORDS):
        self.net, self.shift, self.limit = net, shift, limit
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words, which must be in the table."""
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def _add(self, words: set[bytes]) -> None:
        missing = list(words.difference(self.rows))
        for s in range(0, len(missing), 8192):
            part = missing[s : s + 8192]
            new = self.net.project(self.net.embed(part)[0])
            n = len(self.rows)
            if n + len(part) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), n + len(part)), self.table.shape[1]), np.float32)
                grown[:n] = self.table[:n]
                self.table = grown
            self.table[n : n + len(part)] = new
            self.rows.update(zip(part, range(n, n + len(part)), strict=True))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            # Short windows last: a block is as wide as its widest window.
            held.sort(key=lambda x: -len(x[1]))
            for s in range(0, len(held), ROWS):
                part = held[s : s + ROWS]
                index = np.full((len(part), len(part[0][1])), -1, np.int64)
                for k, (_, w) in enumerate(part):
                    index[k, : len(w)] = w
                np.maximum.at(best, [i for i, _ in part], self.net.logits(self.table, index))
            held.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            starts = window_starts(len(words))
            for a in range(0, len(starts), BLOCK_WINDOWS):  # very long texts: a block of windows at a time
                mine = starts[a : a + BLOCK_WINDOWS]
                block = words[mine[0] : mine[-1] + WINDOW]
                if len(self.rows) > self.limit:
                    flush()
                    self._clear()
                self._add(set(block))
                numbers = self._numbers(block)
                held.extend((i, numbers[s - mine[0] : s - mine[0] + WINDOW]) for s in mine)
                if len(held) >= 8 * ROWS:
                    flush()
        flush()
        return np.where(np.isfinite(best), _sigmoid(np.where(np.isfinite(best), best, 0) + self.shift), 0.0)


def _sample(docs: DataFrame, marks: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """doc_id, hash, y of the texts to learn from: at most 2 x sample rows of 2 x sample_bytes."""
    # Ids, hashes and sizes alone are shuffled, each text of an id once.
    known = need(docs, "doc_id", "text").where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("size")).distinct()
    known = known.join(marks.select("doc_id", "y").distinct(), "doc_id").withColumn("turn", F.xxhash64("doc_id", "hash", F.lit(SEED)))
    # Tasks keep their own first rows of a class; the sum runs over the few that are left.
    order = Window.partitionBy("y").orderBy("turn", "doc_id", "hash")
    first = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    return first.withColumn("so_far", F.sum("size").over(order)).where(F.col("so_far") <= sample_bytes).select("doc_id", "hash", "y")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Scorer | float:
    """A scorer, or the share of toxic labels where there is nothing to learn from."""
    marks = need(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").where(~held_out_flag(5, 0)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return 1.0 if pos else 0.0
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = scratch.save(_sample(docs, marks, sample, sample_bytes), "sample")
    rows = need(docs, "doc_id", "text").where("doc_id is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    got = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "y"]).select("doc_id", "text", "y")

    def fit(batches):
        """One task holds the bounded sample and gives the parameters; a lost one is run again."""
        held = []
        for b in batches:
            held += zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), b.column("y").to_pylist(), strict=True)
        held.sort()
        y = np.array([y for _, _, y in held], np.float32)
        texts = [t for _, t, _ in held]
        del held
        if len(y) and 0 < y.mean() < 1:
            p = train(texts, y).p
            yield pa.RecordBatch.from_arrays([pa.array([float(y.mean())]), *[pa.array([v.astype(np.float32).tobytes()], pa.binary()) for v in p.values()]], ["share", *p])

    shapes = {k: v.shape for k, v in Network().p.items()}
    found = got.repartition(1).mapInArrow(fit, "share double, " + ", ".join(f"`{k}` binary" for k in shapes)).collect()
    scratch.drop("sample")
    if not found:
        return pos / (pos + neg)
    net = Network.__new__(Network)
    net.p = {k: np.frombuffer(found[0][k], np.float32).reshape(shape) for k, shape in shapes.items()}
    share = found[0]["share"]
    return Scorer(net, float(np.log(pos / neg) - np.log(share / (1 - share))))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn_from: DataFrame | None = None) -> tuple[DataFrame, str]:
    """All columns of docs and the score (0 to 1), and the score's name: toxicity, or
    what no column of docs is called."""
    spark = docs.sparkSession
    prepare(spark)
    (name,) = free_names(docs.columns, "toxicity")
    model = learn(learn_from or docs, labels, sample)
    shared = spark.sparkContext.broadcast((model.net.p, model.shift) if isinstance(model, Scorer) else model)  # fixed size

    def run(batches):
        held = shared.value
        scorer = None
        if isinstance(held, tuple):
            net = Network.__new__(Network)
            net.p = held[0]
            scorer = Scorer(net, held[1])
        for b in batches:
            texts = texts_of(b.column("text"))
            score = scorer.scores(texts) if scorer else np.full(len(texts), float(held))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows whose remainder of 5 is not 0."""
    out, _ = score_toxicity(need(docs, "doc_id", "text"), labels, sample)
    return out.select("doc_id", F.coalesce(held_out_flag(5, 0), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, all columns kept."""
    out, name = score_toxicity(docs, labels)
    return out.where(F.col(f"`{name}`") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
