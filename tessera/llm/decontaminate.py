"""Benchmark decontamination with an FM-index for each training shard.

Texts become words (A-Z lowered, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``).  A test
phrase is every run of 13 words of a benchmark item, or the whole item if it is shorter.
For each shard (an Arrow batch of documents, bounded in bytes) an FM-index is built over
its words: suffix array, Burrows-Wheeler transform in a wavelet matrix, and sampled
suffix positions.  All phrases are searched backward at once by wavelet ranks; their
occurrences are located by walking to the next sampled position; their word spans are
merged into the removal spans of each document.

A word that no benchmark item holds cannot lie in an occurrence, so it only separates
runs in the index, and runs shorter than the shortest phrase are left out: the index
holds what can match, which keeps it small, and loses nothing.

Scale: one pass over the documents, no shuffle.  The benchmark is read in blocks of a
checked size, one of which is on the driver and the tasks at a time; beyond one block
the documents are searched once for each block, what a pass finds is written, and spans
are merged by row.

Edge cases: null or wordless text has no words, no hits and is not contaminated; an
item without words matches nothing; several items may share an item_id and count once;
an item without item_id marks words but is not listed; repeated rows are judged each on
its own; empty tables give empty results or no hits; extra columns are kept by
``find_spans`` and ``drop_contaminated`` whatever they are called: what is added to
them has a name that none of them has in any case of letters.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, free_names, need, numbered, prepare, texts_of

WINDOW = 13
#: Bytes of benchmark text that one pass searches for.
BENCHMARK_BLOCK_BYTES = 2 << 20
SAMPLE = 8
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of integers by prefix doubling over what is unresolved."""
    n = len(ranks)
    sa = np.argsort(ranks, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ranks[sa[1:]] != ranks[sa[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 1
    # Rows in groups of more than one: not first, or followed by one that is not first.
    open_rows = np.nonzero(~first | np.append(~first[1:], False))[0]
    while len(open_rows):
        at = sa[open_rows]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_rows] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_rows = open_rows[~new | np.append(~new[1:], False)]
        h *= 2
    return sa


class FmIndex:
    """FM-index over runs of words; word numbers start at 1, 0 ends every run."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n, self.largest = len(symbols), int(symbols.max(initial=0))
        ends = symbols == 0
        # Every run's end is a symbol of its own when sorting, so that runs end comparisons.
        ranks = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
        sa = suffix_array(ranks)
        self.bwt = symbols[sa - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.largest + 2))))
        sampled = (sa % sample == 0) | (self.bwt == 0)  # run starts too: no walk crosses a run
        self.sampled, self.rank_sampled = sampled, np.cumsum(sampled) - 1
        self.positions = sa[sampled]
        self.levels, seq = [], self.bwt
        for bit in range(max(1, self.largest.bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones, dtype=np.int64))), int(n - ones.sum())))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each row."""
        low, high = np.zeros_like(row), row.copy()
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase numbers that occur, first rows, last rows + 1); phrases: one per row."""
        alive = np.arange(len(phrases))
        # Larger numbers do not occur, and the levels may lack a bit for them.
        alive = alive[(phrases <= self.largest).all(axis=1)]
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low, high = self.starts[c] + self.rank(c, low), self.starts[c] + self.rank(c, high)
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, steps, todo, rows = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.sampled[rows]
            out[todo[hit]] = self.positions[self.rank_sampled[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.starts[c] + self.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The test phrases of a block of items: vocabulary, phrases by length, items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        owners: dict[tuple, set[int]] = {}
        for at, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for s in range(max(1, len(words) - window + 1)) if words else ():
                owners.setdefault(tuple(words[s : s + window]), set()).add(at)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(p) for p in owners}):
            mine = [p for p in owners if len(p) == n]
            self.by_length[n] = (np.array(mine, np.int64), [sorted(owners[p]) for p in mine])
        self.shortest = min(self.by_length, default=0)


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
    """For each text: number of words, merged (first word, last word + 1) spans, item places."""
    numbers, counts = [], []
    vocabulary = phrases.vocabulary
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        numbers.append(np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words)))
        numbers.append(np.zeros(1, np.int64))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[list[int]] = [[] for _ in texts]
    if not phrases.by_length or not texts:
        return counts, spans, found
    line = np.concatenate(numbers)  # all words of the shard; a zero after each text
    known = np.concatenate(([False], line > 0, [False]))
    edge = np.diff(known.astype(np.int8))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return counts, spans, found
    size = end - begin + 1  # with the run's end
    offset = np.cumsum(size) - size
    place = np.repeat(begin - offset, size) + np.arange(int(size.sum()))  # in the line
    symbols = line[place]
    symbols[offset + size - 1] = 0
    index = FmIndex(symbols)
    first_word = np.cumsum([0, *[c + 1 for c in counts]])
    marks, pairs = np.zeros(len(line) + 1, np.int64), []
    for n, (matrix, owners) in phrases.by_length.items():
        hit, low, high = index.search(matrix)
        if not len(hit):
            continue
        many = high - low
        rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = place[index.locate(rows)]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + n, -1)
        doc = np.searchsorted(first_word, at, side="right") - 1
        pairs.append((np.unique(doc * len(owners) + np.repeat(hit, many)), owners))
    covered = np.cumsum(marks[:-1]) > 0
    edge = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
    for b, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
        d = int(np.searchsorted(first_word, b, side="right")) - 1
        spans[d].append((b - int(first_word[d]), e - int(first_word[d])))
    sets: dict[int, set[int]] = {}
    for keys, owners in pairs:
        for d, p in zip((keys // len(owners)).tolist(), (keys % len(owners)).tolist(), strict=True):
            sets.setdefault(d, set()).update(owners[p])
    for d, items in sets.items():
        found[d] = sorted(items)
    return counts, spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans; spans that touch become one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8")
    lowered = raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    at = [m.span() for m in _WORD.finditer(lowered)]
    out, last = [], 0
    for b, e in spans:
        out.append(raw[last : at[b][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


_PHRASES: dict[str, Phrases] = {}


def _phrases(key: str, items: list[tuple]) -> Phrases:
    """Built once for each Python worker and block."""
    if key not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[key] = Phrases(items)
    return _PHRASES[key]


#: What find_spans adds to the columns of docs.
OWN = ("n_words", "spans", "items")
_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_OWN_TYPES = (T.LongType(), _SPAN, T.ArrayType(T.StringType()))


def _search(docs: DataFrame, items: list[tuple], names: list[str]) -> DataFrame:
    """All columns of docs and, under the names, what OWN names: one pass, one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # a block: bounded
    key, columns = uuid.uuid4().hex, docs.columns

    def run(batches):
        phrases = _phrases(key, shared.value)
        for b in batches:
            counts, spans, found = search_shard(texts_of(b.column("text")), phrases)
            listed = [sorted({phrases.items[i] for i in f if phrases.items[i] is not None}) for f in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            own = [pa.array(counts, pa.int64()), pa.array([[{"first": x, "end": y} for x, y in s] for s in spans], kind), pa.array(listed, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*columns, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(names, _OWN_TYPES, strict=True)]])
    return docs.mapInArrow(run, schema)


def find_spans(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """All columns of docs, and n_words, spans (half-open, in words, merged), items
    (distinct item_ids, as strings, sorted) under names that no column of docs has."""
    prepare(docs.sparkSession)
    names = free_names(docs.columns, *OWN)
    tests = need(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = tests.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))

    def block(k: int) -> list[tuple]:
        """One block of items; equal items are one row before they come here."""
        mine = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        return sorted(((r["item_id"], r["text"].encode("utf-8")) for r in mine.distinct().collect()), key=lambda x: (x[0] is None, x))

    if blocks == 1:
        return _search(docs, block(0), names), names
    # A pass for each block leaves the rows with hits alone; they meet by row number.
    scratch = Scratch(docs.sparkSession, "spans")
    rows, row = numbered(docs, scratch)
    texts = need(rows, row, "text").toDF("row", "text")
    for k in range(blocks):
        found = _search(texts, block(k), list(OWN)).where("size(spans) > 0").select("row", "spans", "items")
        scratch.save(found, "hits", "append")
    hits = docs.sparkSession.read.schema(found.schema).parquet(scratch.path("hits"))
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def merge(batches):
        for b in batches:
            spans = [[{"first": x, "end": y} for x, y in merge_spans([(s["first"], s["end"]) for s in part])] for part in b.column("spans").to_pylist()]
            listed = [sorted(set(x)) for x in b.column("items").to_pylist()]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(spans, kind), pa.array(listed, pa.list_(pa.string()))], [row, *names[1:]])

    merged = hits.mapInArrow(merge, T.StructType([T.StructField(row, T.LongType()), *[T.StructField(n, t) for n, t in zip(names[1:], _OWN_TYPES[1:], strict=True)]]))
    counted = _search(rows, [], [names[0], *free_names([*rows.columns, *names], "spans", "items")]).select(*[F.col(f"`{c}`") for c in [*rows.columns, names[0]]])
    out = counted.join(merged, row, "left")
    empty = [F.coalesce(F.col(f"`{n}`"), F.array().cast(t)).alias(n) for n, t in zip(names[1:], _OWN_TYPES[1:], strict=True)]
    return out.select(*[F.col(f"`{c}`") for c in [*docs.columns, names[0]]], *empty), names


def hit_words(spans: str):
    """How many words a column of merged spans covers."""
    return F.aggregate(f"`{spans}`", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))


def is_contaminated(n_words: str, spans: str):
    """n_hit > 0 and 20 * n_hit >= n_words."""
    return (hit_words(spans) > 0) & (20 * hit_words(spans) >= F.col(f"`{n_words}`"))


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every document."""
    out, _ = find_spans(need(docs, "doc_id", "text"), benchmark, block_bytes)
    return out.select(
        "doc_id", "n_words", hit_words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), is_contaminated("n_words", "spans").alias("contaminated"), "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    out, (n_words, spans, _) = find_spans(docs, benchmark, block_bytes)
    return out.where(~is_contaminated(n_words, spans)).select(*[F.col(f"`{c}`") for c in docs.columns])
