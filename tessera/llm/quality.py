"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of every text (lengths, shares of character classes, repetition of words and
lines) are computed once and written to the shared folder.  Standardised statistics go
through random Fourier features, which approximate a Gaussian kernel.  Each partition
of labelled rows sums its part of the normal equations; the sums are added by row of
the matrix, and the ridge weights are solved from them.  A fifth of the learning rows
is kept from the fit and gives the isotonic calibration: counts of labels in fixed bins
of the raw score, made monotone by pooling adjacent violators.

What reaches the driver has a fixed size: one matrix of (features + 1) squared, and the
bins' counts.  All labelled rows are used.

Edge cases: null and empty texts have statistics (zeros) and a score; a null doc_id is
not held out, never learned from, and scored; several labels of a document all count;
without labels of both classes every score is the share of label 1 (0.5 without any);
repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, need, prepare, texts_of
from tessera.llm.langid import held_out_flag

FEATURES, RIDGE, BINS, SEED, SCALE = 320, 1e-3, 4096, 11, 1.0
#: Kinds of bytes: 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end,
#: 6 sentence marks, 7 marks of typed symbols, 8 brackets and quotes, 9 non-ASCII, 10 bar, 11 exclamation.
_KIND = np.zeros(256, np.uint8)
for _kind, _chars in ((3, b"0123456789"), (4, b" \t"), (5, b"\n\r"), (6, b".,;:?-"), (7, b"#$%&*+=@^~\\/<>_"), (8, b"()[]{}\"'`"), (10, b"|"), (11, b"!")):
    _KIND[list(_chars)] = _kind
_KIND[97:123], _KIND[65:91], _KIND[128:] = 1, 2, 9

NAMES = ["log_bytes", "log_words", "log_lines", *[f"share_{k}" for k in range(12)], "word_length", "word_spread", "distinct_words", "top_word", "repeats", "symbol_words", "distinct_lines", "marks_per_word", "upper_words", "long_words", "local_distinct"]


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    text = text or b""
    n = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=12) if n else np.zeros(12)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    m = len(words)
    out = [np.log1p(n), np.log1p(m), np.log1p(len(lines)), *(kinds / max(n, 1)).tolist()]
    if not m:
        return out + [0.0] * (len(NAMES) - len(out))
    lengths = np.fromiter(map(len, words), np.float64, m)
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    # Distinct words in pieces of 64: repetition that does not depend on the text's length.
    pieces = [len(set(words[s : s + 64])) / len(words[s : s + 64]) for s in range(0, m, 64) if s == 0 or m - s >= 32]
    return out + [
        float(lengths.mean()), float(min(lengths.std(), 50)), len(counts) / m, max(counts.values()) / m, same / m,
        sum(v for w, v in counts.items() if not w[-1:].isalnum() and w[-1:] < b"\x80" and w[-1:] not in b".,;:") / m,
        len(set(lines)) / max(len(lines), 1), float(kinds[6] + kinds[7] + kinds[11]) / m,
        sum(v for w, v in counts.items() if w.isupper()) / m, float((lengths > 20).mean()), float(np.mean(pieces)),
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of floats) of every document."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in texts_of(b.column("text"))], np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Fourier:
    """z(x) = sqrt(2/D) cos(Wx + b) of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), features)) * scale / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.w + self.b
        return np.hstack((np.cos(z) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))))


def pool_adjacent(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares."""
    blocks: list[list[float]] = []  # weight, mean, length
    for w, v in zip(weights.tolist(), values.tolist(), strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w1, v1, n1 = blocks.pop()
            w0, v0, n0 = blocks.pop()
            blocks.append([w0 + w1, (w0 * v0 + w1 * v1) / (w0 + w1), n0 + n1])
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, at: np.ndarray, value: np.ndarray, base: float):
        self.fourier, self.weights, self.at, self.value, self.base = fourier, weights, at, value, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.weights, -1.0, 2.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None or not len(self.at):
            return np.full(len(x), self.base)
        raw = self.raw(x)
        # A trace of the raw score orders rows within a calibrated step.
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 * (raw + 1) / 3, 0, 1)


def _bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 1.0) / 3.0 * BINS).astype(np.int64), 0, BINS - 1)


def fit(rows: DataFrame, scratch: Scratch) -> Model:
    """rows: doc_id, x, y (0 or 1), spare (kept for the calibration)."""
    sums = rows.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("base")).orderBy("i").collect()
    if not sums or not 0 < sums[0]["base"] < 1:
        return Model(None, None, np.zeros(0), np.zeros(0), float(sums[0]["base"]) if sums else 0.5)
    base = float(sums[0]["base"])
    fourier = Fourier(np.array([r["m"] for r in sums]), np.array([r["s"] for r in sums]))
    d = FEATURES + 1

    def normal(batches):
        a, n = np.zeros((d, d + 1)), 0
        for b in batches:
            z, y = fourier(_matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            a[:, :d] += z.T @ z
            a[:, d] += z.T @ y
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array([n] * d, pa.int64())], ["i", "a", "n"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum(part.column("a").to_pylist(), axis=0)
        return pa.table({"i": part.column("i")[:1], "a": pa.array([total.tolist()], pa.list_(pa.float64())), "n": [int(np.sum(part.column("n").to_numpy()))]}).cast(pa.schema([("i", pa.int32()), ("a", pa.list_(pa.float64())), ("n", pa.int64())]))

    kinds = "i int, a array<double>, n long"
    parts = rows.where("not spare").select("x", "y").mapInArrow(normal, kinds)
    solved = sorted(parts.groupBy("i").applyInArrow(lambda part: add(part), kinds).collect(), key=lambda r: r["i"])
    if not solved:
        return Model(None, None, np.zeros(0), np.zeros(0), base)
    a = np.array([r["a"] for r in solved])
    weights = np.linalg.solve(a[:, :d] + RIDGE * solved[0]["n"] / d * np.eye(d) / 10, a[:, d])
    model = Model(fourier, weights, np.zeros(0), np.zeros(0), base)

    def bins(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_bin_of(model.raw(_matrix(b.column("x"))))), b.column("y").cast(pa.int64())], ["bin", "y"])

    spare = sorted(rows.where("spare").select("x", "y").mapInArrow(bins, "bin long, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect(), key=lambda r: r["bin"])
    if not spare:
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    n = np.array([r["n"] for r in spare], np.float64)
    value = pool_adjacent(n, np.array([r["y"] for r in spare]) / n)
    model.at, model.value = (np.array([r["bin"] for r in spare]) + 0.5) / BINS * 3.0 - 1.0, value
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows whose remainder of 5 is not 0."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(statistics_table(docs), "statistics")
    marks = need(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    learning = stats.where(~held_out_flag(5, 0))
    rows = learning.join(marks, learning["doc_id"] == marks["_id"]).select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0).alias("spare"))
    model = fit(scratch.save(rows, "rows"), scratch)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = stats.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out_flag(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
