"""Token shards: independent zstandard frames with a trailing seek table.

One shard is one file in the zstandard seekable format, so any zstandard tool can
read it from front to back:

* frames, each compressed on its own, holding the ids of whole documents one
  after another (a document longer than a frame continues in the next ones);
* a skippable frame with the document index: count, then id, null flag, byte
  position in the shard's uncompressed stream and number of ids per document;
* a skippable frame with the seek table: compressed size, uncompressed size and
  checksum (low 32 bits of XXH64 of the content) per frame, then the footer.

A reader takes the file's end, finds the frames that hold the documents asked
for, and decompresses and verifies those only.

Writing: documents are range-partitioned by id and sorted inside partitions, so
shards follow ascending id order. Every task attempt writes files of its own
name and returns their manifest rows; only files named in the written manifest
count, so a lost or repeated task leaves nothing that is read twice. The folder
may be any place pyarrow's file systems reach (local or shared folder, object
store, HDFS); it must be visible to all executors.

Defined results: null text is a document without ids of its own; null ids sort
first; equal ids stay next to each other in unspecified order; an empty table
gives an empty manifest.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.llm import bpe
from rowlens.llm.common import stage_path, stage_table, text_or_empty

#: Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: A frame closes when it holds so many uncompressed bytes.
FRAME_BYTES = 256 << 10
#: A shard closes when it holds so many compressed bytes.
SHARD_BYTES = 128 << 20
LEVEL = 3

ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("at", "<u8"), ("n", "<u8")])
MANIFEST = "part int, seq int, path string, docs long, tokens long, bytes long, first_id long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; ids come as little-endian unsigned 32-bit bytes and are kept as ``dtype``."""

    def __init__(self, folder: str, dtype: str):
        self.path, self.dtype = f"{folder}/{uuid4().hex}.tok.zst", dtype
        system, at = _filesystem(folder)
        system.create_dir(at, recursive=True)
        self.out = system.open_output_stream(f"{at}/{self.path.rsplit('/', 1)[1]}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.open, self.entries, self.index, self.at, self.size, self.tokens = bytearray(), [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        body = np.frombuffer(ids, "<u4").astype(self.dtype).tobytes()
        self.index.append((doc_id or 0, doc_id is None, self.at, len(ids) // 4))
        self.at, self.tokens = self.at + len(body), self.tokens + len(ids) // 4
        view = memoryview(body)
        while len(view):
            take = max(FRAME_BYTES - len(self.open), 0)
            self.open += view[:take]
            view = view[take:]
            if len(self.open) >= FRAME_BYTES:
                self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            raw = bytes(self.open)
            frame = self.packer.compress(raw)
            self.out.write(frame)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.size += len(frame)
            self.open = bytearray()

    def close(self) -> tuple[int, int, int, int | None]:
        """Docs, tokens, bytes and first id of the finished shard."""
        self.close_frame()
        index = np.array(self.index, ENTRY)
        body = self.dtype.encode().ljust(4) + struct.pack("<Q", len(index)) + index.tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        seek = b"".join(struct.pack("<III", *e) for e in self.entries)
        seek += struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()
        first = None if not self.index or self.index[0][1] else self.index[0][0]
        return len(index), self.tokens, self.size + len(body) + len(seek) + 16, first


class ShardReader:
    """Random access to one shard by the tables at its end."""

    def __init__(self, path: str):
        folder, name = path.rsplit("/", 1)
        system, at = _filesystem(folder)
        self.file = system.open_input_file(f"{at}/{name}")
        self.unpacker, self.cached = zstandard.ZstdDecompressor(), (-1, b"")
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        seek_at = end - 9 - 12 * count
        table = np.frombuffer(self.file.read_at(12 * count, seek_at), "<u4").reshape(count, 3)
        self.frames = table
        self.file_at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.raw_at = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        index_at = int(self.file_at[-1])
        magic, size = struct.unpack("<II", self.file.read_at(8, index_at))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{path}: no document index")
        body = self.file.read_at(size, index_at + 8)
        self.dtype = body[:4].decode().strip()
        self.docs = np.frombuffer(body[12:], ENTRY, count=struct.unpack("<Q", body[4:12])[0])

    def frame(self, k: int) -> bytes:
        """Content of frame k, verified; the last one read is kept."""
        if self.cached[0] != k:
            packed = self.file.read_at(int(self.frames[k, 0]), int(self.file_at[k]))
            raw = self.unpacker.decompress(packed, max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.frames[k, 2]):
                raise ValueError(f"frame {k}: checksum differs")
            self.cached = (k, raw)
        return self.cached[1]

    def ids(self, entry: np.void) -> bytes:
        """A document's ids as little-endian unsigned 32-bit bytes."""
        width = np.dtype(self.dtype).itemsize
        begin, end = int(entry["at"]), int(entry["at"]) + int(entry["n"]) * width
        if begin == end:
            return b""
        out, k = [], int(np.searchsorted(self.raw_at, begin, "right")) - 1
        while k < len(self.frames) and self.raw_at[k] < end:
            raw, at = self.frame(k), int(self.raw_at[k])
            out.append(raw[max(begin - at, 0) : end - at])
            k += 1
        return np.frombuffer(b"".join(out), self.dtype).astype("<u4").tobytes()


def write_shards(
    docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int | None = 2, dtype: str = "<u2"
) -> DataFrame:
    """Encode, append ``end_id`` to each document and write shards; returns the written manifest.

    ``dtype`` must hold the vocabulary: two bytes an id serve up to 65,536 tokens.
    """
    spark = docs.sparkSession
    folder, path = folder or stage_path(spark, "token-shards"), tokenizer or bpe.default_tokenizer()
    ending = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = bpe.coder(bpe.ChunkCoder, path), TaskContext.get().partitionId()
        seq, shard, done = 0, None, []

        def close():
            done.append((part, seq, shard.path, *shard.close()))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard = shard or ShardWriter(folder, dtype)
                shard.add(doc_id, coder.encode(text.as_py()) + ending)
                if shard.size >= SHARD_BYTES:
                    close()
                    seq, shard = seq + 1, None
        if shard:
            close()
        if done:
            p, s, f, docs_n, tokens, size, first = map(list, zip(*done))
            yield pa.record_batch(
                [pa.array(p, pa.int32()), pa.array(s, pa.int32()), pa.array(f, pa.string()), *(pa.array(x, pa.int64()) for x in (docs_n, tokens, size, first))],
                names=["part", "seq", "path", "docs", "tokens", "bytes", "first_id"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stage_table(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def scan_shards(manifest: DataFrame, measure: Callable[[bytes], object], kind: str, arrow_kind: pa.DataType) -> DataFrame:
    """Read shards back: doc_id, part, seq, local start, n_tokens and ``value``, which ``measure`` makes of a document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, path in zip(*(b.column(k).to_pylist() for k in range(3))):
                shard = ShardReader(path)
                starts = np.concatenate([[0], np.cumsum(shard.docs["n"], dtype=np.int64)])
                for at in range(0, len(shard.docs), 2048):
                    some = shard.docs[at : at + 2048]
                    yield pa.record_batch(
                        [
                            pa.array([None if e["is_null"] else int(e["doc_id"]) for e in some], pa.int64()),
                            pa.array([part] * len(some), pa.int32()),
                            pa.array([seq] * len(some), pa.int32()),
                            pa.array(starts[at : at + len(some)], pa.int64()),
                            pa.array(some["n"].astype(np.int64), pa.int64()),
                            pa.array([measure(shard.ids(e)) for e in some], arrow_kind),
                        ],
                        names=["doc_id", "part", "seq", "local_start", "n_tokens", "value"],
                    )

    files = manifest.select("part", "seq", "path").repartition("path")
    return files.mapInArrow(run, f"doc_id long, part int, seq int, local_start long, n_tokens long, value {kind}")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id and ids (array<int>) of every document in the shards."""
    found = scan_shards(manifest, lambda ids: array("i", ids), "array<int>", pa.list_(pa.int32()))
    return found.select("doc_id", F.col("value").alias("ids"))


def read_documents(spark: SparkSession, manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """ids of the documents asked for (a list from the caller); frames without any of them are not decompressed."""
    ask = np.array(sorted(set(wanted)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                shard = ShardReader(path)
                some = shard.docs[np.isin(shard.docs["doc_id"], ask) & (shard.docs["is_null"] == 0)]
                yield pa.record_batch(
                    [pa.array([int(e["doc_id"]) for e in some], pa.int64()), pa.array([array("i", shard.ids(e)) for e in some], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<int>")


def with_start(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before, over all shards. The running sum is over shards, of which there is one per 128 MB."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("part", "seq", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return scanned.join(base, ["part", "seq"]).withColumn("start", F.col("base") + F.col("local_start"))


def shard_digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all documents, read the files back, and give each one's place and checksum."""
    manifest = write_shards(docs, folder)
    found = with_start(scan_shards(manifest, zlib.crc32, "long", pa.int64()), manifest)
    return found.select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))
