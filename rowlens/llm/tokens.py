"""BPE encoding and decoding of whole document texts with forced boundaries.

Narrow work: every document is encoded where it is read, nothing is shuffled, and
a lost executor costs the tasks it ran. Memory in a task is one Arrow batch and
the worker's bounded cache.

Defined results: a null or empty text has no ids and decodes to the empty text; a
null id column stays null; repeated rows are encoded each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm import bpe
from rowlens.llm.common import text_or_empty


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    path = tokenizer or bpe.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(bpe.ForcedBoundaryCoder, path)
        for b in batches:
            ids = [array("i", coder.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to the empty text."""
    path = tokenizer or bpe.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(bpe.ForcedBoundaryCoder, path)
        for b in batches:
            texts = [coder.decode(array("I", ids or []).tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them, in one pass."""
    path = tokenizer or bpe.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder(bpe.ForcedBoundaryCoder, path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                ids = coder.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
