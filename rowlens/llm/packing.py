"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens, and pieces are dealt by
a hash to buckets of about ``BUCKET`` pieces. Each bucket is packed by best-fit
decreasing and its bin count held against lower bounds from dual-feasible
functions: a bucket whose count equals the bound is certified, no packing of its
pieces is smaller. Buckets with a gap exchange documents: ``FAN`` neighbours
pool their pieces, best-fit decreasing runs again on the pool, and the pool's
packing counts where it needs fewer bins. Rounds follow, each with pools ``FAN`` times
as wide, until nothing has a gap or the pools reach ``FAN ** ROUNDS`` buckets. A gap
that is left then stays, and the result shows it (``bins`` beyond ``bound``): less
than a bin for every ``BUCKET`` pieces in practice, and a wider pool would need a task
to hold more pieces. Pieces that are equal in everything are dealt like others.

A task holds the lengths of one pool, never texts or ids: a bounded number of
rows at any input size. A document longer than the capacity is cut so that the
first piece takes the remainder and all others are full.

Defined results: null text counts as empty and takes its end token only; repeated
rows are packed each; null ids are packed like others; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm import bpe
from rowlens.llm.common import stage_table, text_or_empty

CAPACITY = 2048
BUCKET = 32_768
FAN = 4
ROUNDS = 2
#: Chunks whose ids a worker keeps: with fewer a worker that other stages use too stays small.
CACHE_CHUNKS = 150_000
#: Buckets that rows equal in everything can reach.
SPREAD = 1024
#: Bits of a sequence number that count bins inside a bucket, and of a bucket number below its round.
BIN_BITS, ROUND_BITS = 22, 36


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Largest bound that the dual-feasible functions below give for these lengths.

    * f(x) = x: the volume;
    * for each k up to half the capacity, f = 1 above capacity - k, 0 below k,
      x / capacity between (Martello and Toth's first bound);
    * for k = 1..32, f = x / capacity where (k + 1) x / capacity is whole,
      else floor((k + 1) x / capacity) / k (Fekete and Schepers).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    best = math.ceil(volume[-1] / capacity)
    k = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    between = volume[capacity - k] - volume[k - 1]
    best = max(best, int((large + -(-between // capacity)).max()))
    for k in range(1, 33):
        whole = (k + 1) * size % capacity == 0
        share = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, math.ceil(int((share * count).sum()) / (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and place of every piece, and the number of bins.

    Open bins stand in one stack per room left; a bit set of rooms finds the
    tightest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], places[i] = b, capacity - room
        if left := room - x:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, places, made


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    path = tokenizer or bpe.default_tokenizer()
    ending = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(bpe.ChunkCoder, path, CACHE_CHUNKS)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = coder.encode(text.as_py()) + ending
                n = len(ids) // 4
                first = (n - 1) % capacity + 1 if n else 0
                for k, end in enumerate(range(first, n + 1, capacity) if n else []):
                    start = max(end - capacity, 0) if k else 0
                    out.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket long, bin long, offset long, bins long, bound long"


def pack(items: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """Sequence number and place of every piece; ``bins`` and ``bound`` tell how far its bucket is certified."""

    def packed(rows: pd.DataFrame, number: int) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "length"], na_position="first").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, places, made = best_fit(lengths, capacity)
        return rows.assign(bucket=number, bin=bins, offset=places, bins=made, bound=lower_bound(lengths, capacity))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return packed(rows, int(rows["bucket"].iloc[0]))[NAMES]

    def pooled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before = int(rows.drop_duplicates("bucket")["bins"].sum())
        after = packed(rows, key[0])
        if int(after["bins"].iloc[0]) < before:
            return after[NAMES]
        return rows[NAMES]

    buckets = max(1, math.ceil(items.count() / bucket))
    # the row's number spreads rows that are equal in everything
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id() % SPREAD), F.lit(buckets)))
    now = stage_table(dealt.groupBy("bucket").applyInPandas(first, PACKED), "packed")
    done: DataFrame | None = None
    for r in range(1, ROUNDS + 1):
        if buckets == 1:
            break
        settled, gap = now.filter("bins <= bound"), now.filter("bins > bound")
        done = settled if done is None else done.unionByName(settled)
        # a bucket's number counts in units of the round it was packed in
        made = F.shiftright("bucket", ROUND_BITS)
        number = F.col("bucket").bitwiseAND(F.lit((1 << ROUND_BITS) - 1))
        place = F.floor(number / F.pow(F.lit(float(FAN)), r - made)).cast("long")
        pool = F.lit(r << ROUND_BITS) + place
        now = stage_table(gap.groupBy(pool.alias("pool")).applyInPandas(pooled, PACKED), f"packed-{r}")
        buckets = math.ceil(buckets / FAN)  # pools of this round
    found = now if done is None else done.unionByName(now)
    return found.withColumn("sequence_id", F.col("bucket") * (1 << BIN_BITS) + F.col("bin"))


NAMES = [c.split(" ")[0] for c in PACKED.split(", ")]


def packed_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The contract's columns, and the bin count and bound of the piece's bucket."""
    items = stage_table(pieces(docs, capacity), "pieces")
    return pack(items, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bucket", "bins", "bound"
    )
