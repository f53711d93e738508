"""Token ids in sorted-string-table shards, keyed by document identifier.

A shard file is: data blocks, block index, Bloom filter, footer.

* Keys sort as bytes: ``\\x00`` for null, else ``\\x01`` and the signed 64-bit doc_id,
  big-endian with the sign bit flipped.
* A data block holds entries in key order.  An entry is: varint length of the prefix it
  shares with the key before it in the block, varint length of the rest, the rest,
  varint token count, varint byte length, ids (little-endian, 2 bytes each where all
  fit, else 4: the low bit of the byte length's varint says which).  A block is
  compressed by zstd and has a CRC-32.
* The sparse index has one entry a block: first key, offset, stored size, CRC-32,
  documents and tokens before it in the shard.
* The Bloom filter has 10 bits a key and 7 probes from two halves of one XXH64.
* The footer (fixed size, at the end) has the places of index and filter, the totals
  of documents and tokens, a version and a magic number.

A point lookup reads the footer, asks the filter, finds the block by binary search in
the index and scans that block alone, each by a read of its own range of the file; over
a table of shards the manifest's first and last keys say which files can hold a key.

Files go to a shared folder through ``pyarrow.fs`` (file, hdfs, s3, gs addresses) under
names that no other attempt of the task uses; only those named in the committed
manifest count, so a lost executor or a repeated task leaves no double rows.  Shards
are cut by size, so neither writer nor reader holds more than one shard.

Edge cases: null text is empty and holds its end id alone; null doc_id sorts first;
repeated doc_ids are entries side by side, in the order of their texts; an empty table
writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, prepare, need, texts_of
from tessera.llm.tokens import END_ID, default_vocabulary, encoder

MAGIC, VERSION = b"TSSTIDS1", 1
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, size; filter at, size; documents; tokens; version; magic
BLOCK_BYTES, SHARD_BYTES, PROBES = 64 << 10, 16 << 20, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = buf[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key, 42)
    low, high = h & 0xFFFFFFFF, h >> 32 | 1
    return [(low + i * high) % bits for i in range(PROBES)]


class ShardWriter:
    """Takes (key, ids) in key order; ``finish()`` gives the file's bytes."""

    def __init__(self, block_bytes: int = BLOCK_BYTES):
        self.block_bytes, self.out, self.index, self.keys = block_bytes, bytearray(), [], []
        self.block, self.first, self.last = bytearray(), None, b""
        self.documents = self.tokens = 0
        self._before = (0, 0)
        self._zstd = zstandard.ZstdCompressor(level=1)

    @property
    def first_key(self) -> bytes:
        return self.keys[0]

    def __len__(self) -> int:
        return len(self.out) + len(self.block)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        wide = np.frombuffer(ids, "<u4")
        narrow = not len(wide) or int(wide.max()) < 1 << 16
        value = wide.astype("<u2").tobytes() if narrow else ids
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        self.block += key[shared:]
        put_varint(self.block, len(wide))
        put_varint(self.block, len(value) << 1 | (not narrow))
        self.block += value
        self.last = key
        self.keys.append(key)
        self.documents += 1
        self.tokens += len(wide)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        stored = self._zstd.compress(bytes(self.block))
        self.index.append((self.first, len(self.out), len(stored), zlib.crc32(stored), *self._before))
        self.out += stored
        self.block, self.first, self.last, self._before = bytearray(), None, b"", (self.documents, self.tokens)

    def finish(self) -> bytes:
        self._flush()
        index = bytearray()
        for key, *numbers in self.index:
            put_varint(index, len(key))
            index += key + struct.pack("<QQIQQ", *numbers)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        index_at = len(self.out)
        return bytes(self.out + index + packed + FOOTER.pack(index_at, len(index), index_at + len(index), len(packed), self.documents, self.tokens, VERSION, MAGIC))


class Shard:
    """Reads one shard, given as bytes or as an open file: point lookups and scans."""

    def __init__(self, data: bytes | pa.NativeFile):
        if isinstance(data, bytes):
            data = pa.BufferReader(data)
        self.file, end = data, data.size()
        index_at, index_size, bloom_at, bloom_size, self.documents, self.tokens, version, magic = FOOTER.unpack(self.read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        self.index, at, raw = [], 0, self.read(index_at, index_size)
        while at < len(raw):
            n, at = get_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQIQQ", raw, at + n)))
            at += n + 36
        self.firsts = [x[0] for x in self.index]
        bloom = self.read(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def read(self, at: int, size: int) -> bytes:
        """A range of the file."""
        self.file.seek(at)
        return self.file.read(size)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def block(self, i: int):
        """(key, tokens before it in the shard, ids as little-endian 32-bit) of each entry."""
        _, offset, size, crc, _, start = self.index[i]
        stored = self.read(offset, size)
        if zlib.crc32(stored) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(stored)
        at, key = 0, b""
        while at < len(raw):
            shared, at = get_varint(raw, at)
            n, at = get_varint(raw, at)
            key, at = key[:shared] + raw[at : at + n], at + n
            count, at = get_varint(raw, at)
            n, at = get_varint(raw, at)
            value, at = raw[at : at + (n >> 1)], at + (n >> 1)
            yield key, start, value if n & 1 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            start += count

    def scan(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry under doc_id."""
        key, found = key_of(doc_id), []
        if not self.index or not self.may_hold(key):
            return found
        i = max(0, bisect_right(self.firsts, key) - 1)
        while i > 0 and self.firsts[i] == key:  # repeated keys may begin in a block before
            i -= 1
        while i < len(self.index) and self.firsts[i] <= key:
            found += [ids for k, _, ids in self.block(i) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; gives the manifest: part, seq, path, documents, tokens, first_key,
    last_key, base (tokens before)."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    prepare(spark)
    scratch = Scratch(spark, "shards")
    folder = scratch.path("files")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc, part, seq, writer = encoder(vocabulary), TaskContext.get().partitionId(), 0, ShardWriter(block_bytes)
        fs, root = pa.fs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex[:12]

        def close() -> pa.RecordBatch:
            nonlocal seq, writer
            name = f"shard-{part:06d}-{seq:05d}-{attempt}.sst"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(writer.finish())
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "documents": [writer.documents], "tokens": [writer.tokens], "first_key": [writer.first_key], "last_key": [writer.keys[-1]]})
            seq, writer = seq + 1, ShardWriter(block_bytes)
            return row.cast(out)

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), texts_of(b.column("text"))
            for i in range(0, len(texts), 64):
                for doc_id, coded in zip(ids[i : i + 64], enc.ids([t or b"" for t in texts[i : i + 64]]), strict=True):
                    writer.add(key_of(doc_id), coded + end)
                    if len(writer) >= shard_bytes:
                        yield close()
        if writer.documents:
            yield close()

    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])
    ordered = need(docs, "doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = scratch.save(ordered.mapInArrow(run, "part int, seq int, name string, documents long, tokens long, first_key binary, last_key binary"), "manifest")
    # One row a shard, so a window over all of them is small.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", "seq", "name", F.concat(F.lit(folder + "/"), "name").alias("path"), "documents", "tokens", "first_key", "last_key", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))


def read_shards(spark, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the manifest's files."""
    first = manifest.select("path").first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").load(first["path"].rpartition("/")[0]).select("path", "content")

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                ids, starts, lengths, crcs = [], [], [], []
                for key, start, raw in Shard(content.as_buffer().to_pybytes()).scan():
                    ids.append(id_of(key))
                    starts.append(start)
                    lengths.append(len(raw) // 4)
                    crcs.append(zlib.crc32(raw))
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * len(ids)), *[pa.array(x, pa.int64()) for x in (ids, starts, lengths, crcs)]], ["name", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(manifest.select("name", "base"), "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[bytes]:
    """The ids of every entry under doc_id, from the shards that can hold it (one, but for
    repeated ids), a few ranges of each."""
    key = F.lit(bytearray(key_of(doc_id)))
    found = []
    for r in manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "seq").select("path").collect():
        fs, path = pa.fs.FileSystem.from_uri(r["path"])
        with fs.open_input_file(path) as f:
            found += Shard(f).get(doc_id)
    return found


def encode_to_shards(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes every document's ids to shards and reads the files back."""
    return read_shards(docs.sparkSession, write_shards(docs, vocabulary))
