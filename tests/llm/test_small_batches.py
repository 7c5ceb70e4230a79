"""What a Python worker holds of texts and of encoded chunks is bounded, results are the same."""

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from rowlens.llm import bpe, packing
from rowlens.llm.common import ARROW_ROWS, small_batches

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def batches(spark):
    yield spark
    spark.conf.unset(BATCH)


def largest(spark):
    def run(given):
        for b in given:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    return max(r.n for r in spark.range(0, 3 * ARROW_ROWS, 1, 1).mapInArrow(run, "n long").collect())


@pytest.mark.parametrize("name", ["language", "near", "packing"])
def test_stages_give_python_few_rows_at_once(batches, name):
    docs = batches.createDataFrame([(1, "a few words of one text", "en")], "doc_id long, text string, lang string")
    assert largest(batches) > ARROW_ROWS
    dict(cp.STAGES)[name](batches, docs, "")
    assert largest(batches) == ARROW_ROWS
    batches.conf.set(BATCH, 10)
    small_batches(batches)
    assert largest(batches) == 10


def test_packing_is_the_same_in_small_batches(batches):
    rows = [(None if k % 97 == 0 else k // 2, k % 2, 2048 * (k % 2), 1 + k * k % 2048, k) for k in range(3000)]
    items = batches.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(1)
    found = []
    for n in (10_000, 100):
        batches.conf.set(BATCH, n)
        found.append(sorted(map(str, packing.pack(items, bucket=500).collect())))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_the_cache_of_chunks_is_bounded():
    path = bpe.default_tokenizer()
    coder, other = bpe.ChunkCoder(path, 100), bpe.ForcedBoundaryCoder(path)
    for k in range(400):
        text = f"word{k} xyz{k % 7}q Nothing{k * k}"
        assert coder.encode(text) == other.encode(text)
        assert len(coder.cache) <= 50 and len(coder.cache) + len(coder.cache.older) <= 100
    assert len(coder.cache.older) == 50 and not coder.ranks and not coder.bytes_of
