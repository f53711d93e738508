"""Exact deduplication by deterministic block naming.

Every text is normalised (runs of ``[\\x20\\x09-\\x0D]`` become one space) and cut into
blocks of a fixed number of bytes.  Equal blocks get equal integer names: the distinct
blocks are sorted and numbered.  Then adjacent names are paired and the distinct pairs
are sorted and numbered in turn, level by level, until one name is left for a text.
Two texts have the same (level, name) exactly if their bytes are the same; no digest
decides anything.

Scale: each task first names its own blocks and texts (a bounded dictionary that is
flushed as a new *book* when full), so a block or text that fills a third of the table
leaves a task once for each book (16 bytes for 48 MB of distinct text), and only distinct
blocks are shuffled, once.  All
later levels move integers.  Everything that two steps read is written to the shared
scratch folder, so lost executors only cost their own tasks.

Edge cases: null text counts as empty; the empty text has a block of its own; a null
doc_id never stays while its group has another; repeated rows (same doc_id too) form
one group in which one row stays, the first in the table's order; extra columns are
ignored, and kept by ``drop_exact_copies`` whatever they are called.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_by_hot_key, need, numbered, prepare, texts_of, without_rows

BLOCK = 1024
#: Bytes of distinct texts that one book holds.
BOOK_BYTES = 48 << 20
_RUN = re.compile(rb"[\x20\x09-\x0d]+")


def normalise(text: bytes | None) -> bytes:
    return _RUN.sub(b" ", text or b"")


def blocks_of(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _read_books(block: int, book_bytes: int, kinds: dict[str, str]):
    """Rows of a task: (book, text number, sequence of block numbers, sha256) for each
    new text, (book, block number, bytes) for each new block, and one row a document."""

    def run(batches):
        task, flushed = TaskContext.get().partitionId(), 0
        texts: dict[bytes, int] = {}
        blocks: dict[bytes, int] = {}
        held = 0
        for b in batches:
            ids, out = [b.column(k) for k in kinds], {k: [] for k in ("book", "text_no", "seq", "new", "sha")}
            for raw in texts_of(b.column("text")):
                text = normalise(raw)
                if held > book_bytes:
                    texts, blocks, held, flushed = {}, {}, 0, flushed + 1
                no, seq, new, sha = texts.get(text), None, None, None
                if no is None:
                    no = texts[text] = len(texts)
                    seq, new, held = [], [], held + 2 * len(text) + 200
                    for piece in blocks_of(text, block):
                        name = blocks.get(piece)
                        if name is None:
                            name = blocks[piece] = len(blocks)
                            new.append({"no": name, "bytes": piece})
                        seq.append(name)
                    sha = hashlib.sha256(text).hexdigest()
                for k, v in zip(out, ((task << 24) | flushed, no, seq, new, sha), strict=True):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("no", pa.int64()), ("bytes", pa.binary())])), pa.string())
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(out[k], t) for k, t in zip(out, types, strict=True)]], [*kinds, *out])

    own = ", ".join(f"{k} {v}" for k, v in kinds.items())
    return run, f"{own}, book long, text_no long, seq array<long>, new array<struct<no:long,bytes:binary>>, sha string"


def _number(distinct: DataFrame, *keys: str) -> DataFrame:
    """Adds ``name``: the place of each row of ``keys`` in the sorted rows of its hash partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK, book_bytes: int = BOOK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents with book and text_no, texts with book, text_no, level, name, sha).

    docs: doc_id, text, row (a number of each row).
    """
    prepare(docs.sparkSession)
    run, schema = _read_books(block, book_bytes, {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "row": "long"})
    read = scratch.save(docs.select("doc_id", "row", "text").mapInArrow(run, schema), "books")

    # Level 0: names of blocks, by their bytes.
    new = read.where("size(new) > 0").select("book", F.explode("new").alias("b")).select("book", "b.no", "b.bytes")
    named = _number(new.groupBy("bytes").agg(F.collect_list(F.struct("book", "no")).alias("at")), "bytes")
    names = named.select("name", F.explode("at").alias("a")).select("a.book", "a.no", "name")
    seqs = read.where("seq is not null").select("book", "text_no", F.posexplode("seq").alias("pos", "no"))
    row = scratch.save(seqs.join(names, ["book", "no"]).select("book", "text_no", "pos", "name"), "level0")
    lengths = read.where("seq is not null").select("book", "text_no", "sha", F.size("seq").alias("n"))
    longest = lengths.agg(F.max("n")).first()[0] or 1

    done, level = None, 0
    while True:
        width = 1 << level  # texts of at most so many blocks have one name now
        ended = row.join(lengths.where((F.col("n") <= width) & (F.col("n") > width // 2)).select("book", "text_no", "sha"), ["book", "text_no"])
        ended = ended.select("book", "text_no", F.lit(level).alias("level"), "name", "sha")
        done = ended if done is None else done.unionByName(ended)
        if width >= longest:
            break
        more = row.join(lengths.where(F.col("n") > width).select("book", "text_no"), ["book", "text_no"], "left_semi")
        pairs = more.groupBy("book", "text_no", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = scratch.save(pairs, f"pairs{level + 1}")
        of = scratch.save(_number(pairs.groupBy("a", "b").agg(F.count("*").alias("_n")), "a", "b").select("a", "b", "name"), f"names{level + 1}")
        row = scratch.save(pairs.join(of, ["a", "b"]).select("book", "text_no", "pos", "name"), f"level{level + 1}")
        level += 1
    done = scratch.save(done, "identities")
    scratch.drop("level0", *[f"{kind}{k}" for k in range(1, level + 1) for kind in ("pairs", "names", "level")])
    return read.select("doc_id", "row", "book", "text_no"), done


def _judged(docs: DataFrame, scratch: Scratch, block: int, book_bytes: int) -> DataFrame:
    """doc_id, row, first (the row that stays), group_size, sha of every document."""
    read, texts = identities(docs, scratch, block, book_bytes)
    # One row for each text of a book, then one for each identity: a hot text is small here.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    local = read.groupBy("book", "text_no").agg(F.min(place).alias("low"), F.count("*").alias("n")).join(texts, ["book", "text_no"])
    whole = local.groupBy("level", "name").agg(F.min("low").alias("first"), F.sum("n").alias("group_size"))
    known = scratch.save(local.join(whole, ["level", "name"]).select("book", "text_no", "n", "first", "group_size", "sha"), "known")
    return join_by_hot_key(read, known, ["book", "text_no"], "n")


def exact_groups(docs: DataFrame, block: int = BLOCK, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = need(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    out = _judged(rows, Scratch(docs.sparkSession, "naming"), block, book_bytes)
    return out.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, block: int = BLOCK, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """The documents with one row of each group of equal texts, all columns kept.

    The identity decides, and rows go by their number: of rows that share doc_id and
    normalised text too, the first stays.  Texts are shuffled as blocks alone.
    """
    scratch = Scratch(docs.sparkSession, "naming")
    rows, row = numbered(docs, scratch)
    out = _judged(need(rows, "doc_id", "text", row).toDF("doc_id", "text", "row"), scratch, block, book_bytes)
    gone = scratch.save(out.where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)), "gone")
    scratch.drop("books", "known", "identities")
    return without_rows(rows, row, gone)
