"""Best-fit packing with certified bin counts.

Documents are encoded, ended by an end id, and cut only where longer than a sequence.
Pieces are numbered and dealt by a hash of their number to partitions of a bounded
number of pieces, so rows that repeat are dealt like any others; each partition is
packed best-fit decreasing.  Dual-feasible functions give a lower bound on the bins any
packing of the partition needs; a partition whose bins meet it is certified.  What the
bound leaves open (the gap, also its fraction) is exchanged: the least filled bins that
hold the gap are opened, their pieces are dealt anew to fewer partitions and packed
again, round by round, until the total meets the bound of the whole table, one
partition holds all that is open, or rounds in a row bring nothing; the round of the
least total counts.

Edge cases: null text is empty and still holds its end id; repeated rows are packed
each on its own; ties are broken by doc_id, piece and number; an empty table packs to nothing;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, prepare, need, texts_of
from tessera.llm.tokens import END_ID, default_vocabulary, encoder

CAPACITY = 4096
#: Pieces that one partition packs.
PARTITION_PIECES = 5_000
#: Exchange rounds in a row that bring nothing, after which the exchange ends.
IDLE_ROUNDS = 3


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; reads each text once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc, step = encoder(vocabulary), 4 * capacity
        for b in batches:
            at, cols = [], ([], [], [], [])
            texts = texts_of(b.column("text"))
            for i in range(0, len(texts), 64):
                for j, ids in enumerate(enc.ids([t or b"" for t in texts[i : i + 64]]), i):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), step)):
                        part = ids[s : s + step]
                        at.append(j)
                        for c, v in zip(cols, (k, s // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """The best of a family of dual-feasible functions; counts[s]: pieces of length s.

    For each threshold t <= capacity/2: pieces over capacity - t count as full, pieces
    under t as nothing, others by their length (t = 0: plain sum).  For k = 1..20: the
    rounding function that sends x to floor((k+1)x)/k unless (k+1)x is whole.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    mass, number = np.cumsum(n * sizes), np.cumsum(n)
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    low = np.where(t > 0, t - 1, 0)
    middle = np.where(t > 0, mass[capacity - t] - mass[low], mass[capacity])
    best = float(np.max(np.where(t > 0, large * capacity, 0) + middle) / capacity)
    for k in range(1, 21):
        x = (k + 1) * sizes
        value = np.where(x % capacity == 0, sizes * k, (x // capacity) * capacity) / (k * capacity)
        best = max(best, float((n * value).sum()))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each piece; sizes must be in descending order.

    Bins are kept by free space; a bit mask of the free spaces in use finds the
    smallest that fits.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, []
    for s in sizes:
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            held = free[room]
            b = held.pop()
            if not held:
                mask &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        left = room - s
        if left:
            free[left].append(b)
            mask |= 1 << left
        out.append(b)
    return out


def pack_partition(part: pa.Table, capacity: int, last: bool = False) -> pa.Table:
    """Adds bin, offset and open (to be exchanged) to the pieces of a partition."""
    part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_piece_no", "ascending")])
    sizes = part.column("length").to_numpy()
    bins = np.array(best_fit_decreasing(sizes.tolist(), capacity), dtype=np.int64)
    by_bin = np.argsort(bins, kind="stable")
    sums = np.cumsum(sizes[by_bin]) - sizes[by_bin]
    used = np.bincount(bins, weights=sizes).astype(np.int64)
    offset = np.empty_like(sums)
    offset[by_bin] = sums - (np.cumsum(used) - used)[bins[by_bin]]
    gap = (len(used) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)) * capacity
    slack = capacity - used
    order = np.argsort(-slack, kind="stable")
    before = np.cumsum(slack[order]) - slack[order]
    opened = np.zeros(len(used), bool)
    opened[order] = (before < gap - 1e-6) & (slack[order] > 0)
    for name, values in (("bin", bins), ("offset", offset), ("open", opened[bins] & (not last))):
        part = part.append_column(name, pa.array(values))
    return part


def _one_argument(run):
    return lambda part: run(part)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    A sequence's number holds its round, its partition and its bin in bits of their own
    (7, 28 and 28); whole sequences of one piece have the piece's number, round 0.
    """
    columns = pieces.columns
    pieces = scratch.save(pieces.withColumn("_piece_no", F.monotonically_increasing_id()), "numbered_pieces")
    full = pieces.where(F.col("length") == capacity)
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[r["length"]] = r["count"]
    need_bins = int(np.ceil(lower_bound(histogram, capacity) - 1e-9))
    left, todo = int(histogram[:capacity].sum()), pieces.where(F.col("length") < capacity)
    closed_bins, least, idle = int(histogram[capacity]), None, 0
    kind = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"{c} {kind[c]}" for c in kind) + ", group long, bin long, offset long, open boolean"
    rounds, best, turn = [], 0, 0
    while left:
        groups = max(1, -(-left // partition_pieces))
        last = groups == 1
        # Other rounds deal otherwise: pieces of different partitions meet.
        key = F.pmod(F.xxhash64("_piece_no", F.lit(turn)), F.lit(groups)).alias("group")

        run = partial(pack_partition, capacity=capacity, last=last)
        packed = scratch.save(todo.select(*kind, key).groupBy("group").applyInArrow(_one_argument(run), schema), f"round{turn}")
        totals = packed.groupBy("open").agg(F.count("*").alias("n"), F.countDistinct("group", "bin").alias("bins")).collect()
        opened = next(((r["n"], r["bins"]) for r in totals if r["open"]), (0, 0))
        closed_bins += sum(r["bins"] for r in totals if not r["open"])
        total = closed_bins + opened[1]
        if turn > 120 or groups >> 28:
            raise ValueError("more rounds or partitions than sequence numbers hold")
        # Certified, or the exchange brings nothing more: what is open stays as packed.
        idle += 1
        if least is None or total < least:
            least, best, idle = total, turn, 0
        ended = total <= need_bins or opened[0] == 0 or idle >= (1 if groups <= 2 else IDLE_ROUNDS)
        rounds.append(packed)
        if ended:
            break
        todo, left, turn = packed.where("open"), opened[0], turn + 1
    whole = full.select(*columns, F.col("_piece_no").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for k, packed in enumerate(rounds[: best + 1]):
        done = packed if k == best else packed.where("not open")
        whole = whole.unionByName(done.select(*columns, (F.lit((k + 1) << 56) + F.col("group") * F.lit(1 << 28) + F.col("bin")).alias("sequence_id"), "offset"))
    return whole


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    return pack(pieces_of(docs, vocabulary or default_vocabulary(), capacity), scratch, capacity, partition_pieces)
