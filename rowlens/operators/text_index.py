"""A positional inverted index of texts on disk, and searches that read it instead of the texts.

Texts are numbered by block: a block is up to ``BLOCK`` texts that a task reads in a row. ``words``
holds a row per (block, column, word) with two lists, the rows of the block where the word occurs and
its places there, in a folder for each of ``BUCKETS`` hash buckets of the word and sorted by word within:
a search for words opens their buckets only, and there the row groups that can hold them. One more folder,
bucket ``IDS``, holds a row per block with the posting of each of its rows. ``names`` is the sorted dictionary
(word, bucket), in which a prefix is a range.

Lists are made where the texts are read, so that what is shuffled is near what is stored. They are dealt
by bucket in parts of bounded size (a frequent word's blocks go to several), and a search
joins a block's lists, so no task holds all texts of a word.

A batch appends to both and rewrites nothing; rows of a posting that a later batch wrote again are left out
by a join with the later batches' postings, until ``compact`` writes the index anew.
The index must lie where driver and executors reach it. A lost executor costs tasks:
an append that fails leaves no committed files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.functions.text import fold
from rowlens.operators.search import COLUMNS, Match, _folded, folded_text, tokens

BUCKETS = 64
#: The bucket of the postings' ids.
IDS = -1
#: Texts of a block, and blocks that a task of a search joins.
BLOCK = 8192
TOGETHER = 16


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _less(k: int):
    return lambda x: x["at"] - k


def _is(term: str):
    return lambda x: x["term"] == term


def _lists(said: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct words of a block's texts, and for each the rows and the places where it occurs, in order."""
    ends = np.concatenate([[0], np.cumsum(said.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    words = said.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(said)), np.diff(ends))
    at = np.arange(len(codes)) - ends[row]
    order = np.argsort(codes, kind="stable")
    starts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))]), pa.int32())
    return words.dictionary, *(pa.ListArray.from_arrays(starts, pa.array(x[order], pa.int32())) for x in (row, at))


def _blocks(columns: tuple[str, ...]):
    """Batches of (posting_id, the words of each column) to rows of blocks, those of the ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                none = pa.nulls(1, pa.list_(pa.int32()))
                yield _batch(block, [None], pa.nulls(1, pa.string()), none, none, ids)
                for k, name in enumerate(columns, 1):
                    words, rows, at = _lists(b.column(k))
                    if len(words):
                        yield _batch(block, [name] * len(words), words, rows, at, pa.nulls(len(words), ids.type))
                block += 1

    return run


def _batch(block: int, names: list[str | None], *rest: pa.Array) -> pa.RecordBatch:
    numbers = pa.array(np.full(len(names), block), pa.int64())
    return pa.record_batch([numbers, pa.array(names, pa.string()), *rest], names=["block", "column", "word", "rows", "at", "ids"])


class TextIndex:
    """The index in a folder; ``columns`` are the text columns that it covers."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS):
        self.spark, self.path, self.columns, self.batch = spark, path.rstrip("/"), columns, 0

    def _words(self, text: Column) -> Column:
        """What of a folded text is indexed, in order."""
        return tokens(text)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def add(self, texts: DataFrame) -> None:
        """Index a batch: posting_id and the text columns, one row a posting; a posting indexed before is replaced."""
        folded = texts.select("posting_id", *[fold(F.coalesce(F.col(c), F.lit(""))).alias(f"c{k}") for k, c in enumerate(self.columns)])
        self._append(folded.select("posting_id", *[self._words(F.col(f"c{k}")).alias(f"c{k}") for k in range(len(self.columns))]))

    def _append(self, said: DataFrame) -> None:
        """Write the words of a batch's texts, one array a column."""
        self.batch += 1
        kind = said.schema["posting_id"].dataType.simpleString()
        rows = said.mapInArrow(_blocks(self.columns), f"block long, column string, word string, rows array<int>, at array<int>, ids array<{kind}>")
        rows = rows.withColumn("bucket", F.when(F.col("word").isNull(), IDS).otherwise(_bucket(F.col("word")))).withColumn("batch", F.lit(self.batch))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/words")
        names = self._table("words").filter((F.col("batch") == self.batch) & (F.col("bucket") != IDS)).select("word", "bucket").distinct()
        names.repartitionByRange("word").sortWithinPartitions("word").write.mode("append").parquet(f"{self.path}/names")

    def _ids(self) -> DataFrame:
        """batch, block, row and posting_id of every text."""
        return self._table("words").filter(F.col("bucket") == IDS).select("batch", "block", F.posexplode("ids").alias("row", "posting_id"))

    def _current(self, rows: DataFrame) -> DataFrame:
        """The rows (posting_id, batch) that no later batch replaced."""
        later = self._ids().filter("batch > 1").select(F.col("posting_id").alias("again"), F.col("batch").alias("later"))
        return rows.join(later, (F.col("posting_id") == F.col("again")) & (F.col("batch") < F.col("later")), "left_anti")

    def compact(self, path: str) -> TextIndex:
        """The index without what was replaced, in another folder."""
        new = type(self)(self.spark, path, self.columns)
        rows = self._table("words").filter(F.col("bucket") != IDS)
        said = rows.select("batch", "block", "column", "word", F.explode(F.arrays_zip("rows", "at")).alias("x"))
        said = said.groupBy("batch", "block", F.col("x.rows").alias("row")).agg(F.collect_list(F.struct("column", F.col("x.at").alias("at"), "word")).alias("said"))
        found = self._current(self._ids()).join(said, ["batch", "block", "row"], "left")
        own = lambda c: F.transform(F.array_sort(F.filter("said", lambda x: x["column"] == c)), lambda x: x["word"])
        new._append(found.select("posting_id", *[own(c).alias(f"c{k}") for k, c in enumerate(self.columns)]))
        return new

    def _rows(self, exact: list[str], starts: list[str], columns: tuple[str, ...]) -> DataFrame:
        """batch, block, row, column, term and place of the terms' words; a term with a star is a prefix."""
        words, names = self._table("words"), self._table("names")
        ranges = [(F.col("word") >= s) & (F.col("word") < s + "\U0010ffff") for s in starts]
        wanted = F.col("word").isin(*exact) if exact else F.lit(False)
        for r in ranges:
            wanted |= r
        # buckets are few whatever the dictionary holds: at most BUCKETS numbers come to the driver
        buckets = [r.bucket for r in names.filter(wanted).select("bucket").distinct().collect()]
        terms = F.array_compact(F.array(*[F.when(F.col("word") == w, F.lit(w)) for w in exact], *[F.when(r, F.lit(s + "*")) for r, s in zip(ranges, starts)]))
        rows = words.filter(F.col("bucket").isin(*(buckets or [IDS - 1])) & F.col("column").isin(*columns) & wanted)
        # a block's lists meet in one task, and as few blocks as its memory holds
        blocks = words.filter(F.col("bucket") == IDS).count()
        rows = rows.select("batch", "block", "column", F.explode(terms).alias("term"), "rows", "at").repartition(max(1, -(-blocks // TOGETHER)), "batch", "block")
        return rows.select("batch", "block", "column", "term", F.explode(F.arrays_zip("rows", "at")).alias("x")).select("batch", "block", F.col("x.rows").alias("row"), "column", "term", F.col("x.at").alias("at"))

    def matching(self, match: Match) -> DataFrame:
        """posting_id of the rows that ``search.matching`` finds in the texts."""
        def phrase(text: str, prefix: bool = False) -> tuple[str, ...]:
            words = _folded(text)
            return (*words[:-1], words[-1] + "*") if prefix and words else tuple(words)

        must = [phrase(t) for t in (*match.every, *match.phrases)] + [phrase(t, True) for t in match.prefixes]
        some, never = [phrase(t) for t in match.any if _folded(t)], [phrase(t) for t in match.none if _folded(t)]
        if not (must or match.any) or not all(must) or (match.any and not some):
            return self._ids().filter(F.lit(False)).select("posting_id")
        every = list(dict.fromkeys([*must, *some, *never]))
        found = self._standing(every, match.columns)
        has = {p: F.col(f"p{k}") for k, p in enumerate(every)}
        for p in must:
            found = found.filter(has[p])
        if some:
            found = found.filter(F.array_contains(F.array(*[has[p] for p in some]), True))
        for p in never:
            found = found.filter(~has[p])
        return self._postings(found)

    def _standing(self, every: list[tuple[str, ...]], columns: tuple[str, ...]) -> DataFrame:
        """batch, block, row, and p0, p1, ... that say whether each phrase stands in one of the columns."""
        terms = {t for p in every for t in p}
        rows = self._rows(sorted(t for t in terms if t[-1:] != "*"), sorted(t[:-1] for t in terms if t[-1:] == "*"), columns)
        lines = rows.groupBy("batch", "block", "row", "column").agg(F.collect_list(F.struct("term", "at")).alias("said"))

        def stands(p: tuple[str, ...]) -> Column:
            """Whether the words stand one after the other: where they would begin, by each word, agree."""
            begins = [F.transform(F.filter("said", _is(t)), _less(k)) for k, t in enumerate(p)]
            common = begins[0]
            for b in begins[1:]:
                common = F.array_intersect(common, b)
            return F.size(common) > 0

        return lines.groupBy("batch", "block", "row").agg(*[F.max(stands(p)).alias(f"p{k}") for k, p in enumerate(every)])

    def _postings(self, found: DataFrame) -> DataFrame:
        """posting_id of the texts (batch, block, row), but those replaced."""
        return self._current(self._ids().join(found.select("batch", "block", "row"), ["batch", "block", "row"])).select("posting_id")


class GramIndex(TextIndex):
    """Positions of the runs of three characters of folded texts: a text holds a needle where its runs stand one after the other, so no text is read to verify."""

    SIZE, END = 3, "\u0001"

    def _words(self, text: Column) -> Column:
        line = F.concat(text, F.lit(self.END * (self.SIZE - 1)))
        runs = F.transform(F.sequence(F.lit(1), F.char_length(line) - (self.SIZE - 1)), lambda k: F.substr(line, k, F.lit(self.SIZE)))
        return F.when(F.char_length(line) >= self.SIZE, runs).otherwise(F.expr("cast(array() as array<string>)"))

    def containing(self, needle: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        """posting_id of the rows with the needle in one of the columns, without case and accents; of an empty needle all rows."""
        plain = folded_text(needle)
        if not plain:
            return self._current(self._ids()).select("posting_id")
        runs = tuple(plain[k : k + self.SIZE] for k in range(len(plain) - self.SIZE + 1)) or (plain + "*",)
        return self._postings(self._standing([runs], columns or self.columns).filter("p0"))
