"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and +1 (from a seed and its code point).  An
n-gram's vector binds its letters' vectors, each permuted (rotated) by its place, by
multiplication.  A text's profile bundles (adds) the vectors of all its n-grams; a
language's prototype adds the unit profiles of its learned texts.  The mean of the
prototypes, what all languages have in common, is taken off both sides; a text gets
the language whose prototype has the greatest cosine with its profile, and that cosine
(at least 0) as its score.

Letters are Unicode letters, lowered; every run of other characters is one boundary,
which has a vector of its own, so n-grams see where words begin and end.

Learning uses a sample of texts bounded for each language (``per_language``, expected
number, chosen by a hash of doc_id and text; documented bound).  Scoring is one pass
without a shuffle over whole texts.

Edge cases: null text, or one without a letter, is `und` with score 0, as is every text
if nothing could be learned; a null doc_id is not held out and never learned from; ties
go to the first language in order; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import need, prepare, texts_of

DIMENSIONS, ORDER, SEED, PER_LANGUAGE, ROWS = 1024, 3, 7, 2000, 128
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point: its lowered letter's code point, or 0 for what is no letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


class ItemMemory:
    """The letters' random vectors, made when first met, the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed, self.rows = dimensions, seed, {}

    def __call__(self, code: int) -> np.ndarray:
        if code not in self.rows:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions)
            self.rows[code] = (2 * bits - 1).astype(np.float32)
        return self.rows[code]


def grams(texts: list[bytes | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of the distinct n-grams; a letter has 21 bits."""
    table = letter_table()
    docs, codes = [], []
    for i, text in enumerate(texts):
        points = np.frombuffer((text or b"").decode("utf-8").encode("utf-32-le"), np.uint32)
        x = table[points].astype(np.int64)
        if not x.any():
            continue
        x = np.concatenate(([0], x, [0]))
        x = x[(x != 0) | np.concatenate(([True], x[:-1] != 0))]
        if len(x) < order:
            continue
        g = np.zeros(len(x) - order + 1, np.int64)
        for k in range(order):
            g = (g << 21) | x[k : len(x) - order + 1 + k]
        g.sort()
        first = np.concatenate(([0], np.nonzero(g[1:] != g[:-1])[0] + 1))
        codes.append(np.stack((g[first], np.diff(np.append(first, len(g))))))
        docs.append(np.full(len(first), i))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(codes, axis=1)
    return np.concatenate(docs), both[0], both[1]


def gram_vectors(codes: np.ndarray, memory: ItemMemory, order: int = ORDER) -> np.ndarray:
    """Bound, permuted letter vectors; the first letter is rotated the most."""
    out = np.ones((len(codes), memory.dimensions), np.float32)
    for k in range(order):
        letters = (codes >> (21 * (order - 1 - k))) & ((1 << 21) - 1)
        known, at = np.unique(letters, return_inverse=True)
        out *= np.stack([np.roll(memory(int(c)), order - 1 - k) for c in known])[at]
    return out


def profiles(texts: list[bytes | None], memory: ItemMemory, order: int = ORDER) -> np.ndarray:
    """The unit profile of each text (zeros for a text without letters)."""
    out = np.zeros((len(texts), memory.dimensions), np.float32)
    doc, code, count = grams(texts, order)
    if not len(doc):
        return out
    known, at = np.unique(code, return_inverse=True)
    for s in range(0, len(known), 8192):  # n-grams in blocks: memory stays bounded
        mine = (at >= s) & (at < s + 8192)
        weights = np.zeros((len(texts), min(8192, len(known) - s)), np.float32)
        weights[doc[mine], at[mine] - s] = count[mine]
        out += weights @ gram_vectors(known[s : s + 8192], memory, order)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def held_out_flag(mod: int, rest: int):
    """Whether crc32(doc_id as text) mod `mod` is `rest`; null doc_id gives null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED) -> dict[str, np.ndarray]:
    """Language prototypes from rows with doc_id, text, lang."""
    prepare(docs.sparkSession)
    rows = need(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(counts.items())])
    # 53 bits of the hash: the expected number holds for any table a double can count.
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) < share * float(1 << 53)

    def run(batches):
        memory, sums = ItemMemory(dimensions, seed), {}
        for b in batches:
            texts, langs = texts_of(b.column("text")), b.column("lang").to_pylist()
            for s in range(0, len(texts), ROWS):
                unit = profiles(texts[s : s + ROWS], memory, order)
                for lang in set(langs[s : s + ROWS]):
                    mine = [i for i, x in enumerate(langs[s : s + ROWS]) if x == lang]
                    sums[lang] = sums.get(lang, 0) + unit[mine].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.where(chosen).select("text", "lang").repartition(24).mapInArrow(run, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    sums = {r["lang"]: np.array([e["x"] for e in r["v"]]) for r in total.collect()}  # one row a language
    return {lang: v / max(np.linalg.norm(v), 1e-12) for lang, v in sorted(sums.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score of every document; reads text alone."""
    prepare(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if names else np.zeros((0, dimensions))
    common = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    centred = matrix - common
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)

    def run(batches):
        memory = ItemMemory(dimensions, seed)
        for b in batches:
            texts, langs, scores = texts_of(b.column("text")), [], []
            for s in range(0, len(texts), ROWS):
                unit = profiles(texts[s : s + ROWS], memory, order)
                some = unit.any(axis=1) & bool(names)
                unit = unit - common
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
                cosine = unit @ centred.T if names else np.zeros((len(unit), 1))
                best = cosine.argmax(axis=1)
                langs += [names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
                scores.append(np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose remainder is not 2."""
    prototypes = learn(docs.where(~held_out_flag(4, 2)), per_language)
    out = predict(docs, prototypes)
    return out.select("doc_id", F.coalesce(held_out_flag(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
