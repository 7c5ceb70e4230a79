"""Vector codes: one codebook per part of a vector, nearest entries by a vantage-point tree.

Components become integers, floor(``SCALE`` * x). Every part position has a codebook of
``ENTRIES`` integer vectors, first those of the smallest vec_ids, then ``ROUNDS`` times the
floor of the mean of the parts assigned to them. Sums and counts are formed in the tasks
and added by Spark, so what reaches the driver are the codebooks alone: parts times
entries times the parts' length, whatever the number of vectors.

The nearest entry is found by branch and bound in a vantage-point tree of each codebook.
Distances are exact integers. Where a bound needs a square root, it is rounded away
from pruning; a subtree is visited when its bound equals the best distance too
(non-strict), so that ties end at the lower index, which is compared in integers.
A batch of vectors walks the tree together: of each node the vectors that are nearer go
inside first, the others outside first.

Defined results: vectors that are null or hold null or non-finite components are
dropped, and so are empty ones, those that don't fall into ``PARTS`` equal parts, those
whose length isn't that of the smallest kept vec_id, and those with a component of 2**20
or more, whose error no long could hold. Rows with one vec_id are vectors of their own
(the codebook takes them in the order of their integers), null ids come last. With fewer
than ``ENTRIES`` vectors the codebooks have as many entries. An empty table gives an
empty result. Only id, vector and label are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components must be smaller, so that squared distances of a part stay exact in 64 bits.
LARGEST = 1 << 20
LEAF = 4
#: A float64 value is wrong by at most this share after a conversion and a square root.
SLACK = 2.0**-50


class VantageTree:
    """A tree over the entries of one codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.root = self._build(np.arange(len(book)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        vantage, rest = members[0], members[1:]
        far = _squared(self.book[rest], self.book[vantage])
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        sides = []
        for part in (order[:half], order[half:]):
            radius = np.sqrt(far[part].astype(np.float64))
            sides.append((radius.min() * (1 - SLACK), radius.max() * (1 + SLACK), self._build(rest[part])))
        return vantage, sides

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance, both exact."""
        best = np.full(len(points), np.iinfo(np.int64).max, dtype=np.int64)
        index = np.full(len(points), len(self.book), dtype=np.int64)
        self._visit(self.root, np.arange(len(points)), points, best, index)
        return index, best

    def _offer(self, entry: int, at: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        distance = _squared(points[at], self.book[entry])
        better = (distance < best[at]) | ((distance == best[at]) & (entry < index[at]))
        best[at[better]], index[at[better]] = distance[better], entry
        return distance

    def _visit(self, node, at: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self._offer(entry, at, points, best, index)
            return
        vantage, sides = node
        root = np.sqrt(self._offer(vantage, at, points, best, index).astype(np.float64))
        low, high = root * (1 - SLACK), root * (1 + SLACK)
        bounds = [np.maximum(np.maximum(near - high, low - far), 0.0) ** 2 * (1 - 4 * SLACK) for near, far, _ in sides]
        inner = bounds[0] <= bounds[1]
        # inside for those whose bound is smaller there, outside for all that still need it, then inside for the rest
        for side, who in ((0, inner), (1, np.ones(len(at), dtype=bool)), (0, ~inner)):
            chosen = at[who]
            needed = bounds[side][who] <= best[chosen].astype(np.float64) * (1 + SLACK)
            self._visit(sides[side][2], chosen[needed], points, best, index)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _rows(column: pa.Array) -> np.ndarray:
    """A batch of equally long vectors as a matrix."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label and ``ints`` of every kept row, written once."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # comparisons with NaN count it as the largest value
    sound = F.size("v").between(1, 1 << 20) & (F.size("v") % parts == 0) & F.forall("v", lambda x: x.isNotNull() & (x < float(LARGEST)) & (x > -float(LARGEST)))
    kept = rows.filter("v is not null").filter(sound)
    return stage_table(kept.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("ints")), "vector-ints")


def _trees(books: list[np.ndarray]) -> list[VantageTree]:
    return [VantageTree(b) for b in books]


def _assigned(ints: np.ndarray, trees: list[VantageTree]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of every row's parts."""
    width = ints.shape[1] // len(trees)
    found = [t.nearest(np.ascontiguousarray(ints[:, p * width : (p + 1) * width])) for p, t in enumerate(trees)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _updated(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ints = _rows(batch.column(0))
                index, _ = _assigned(ints, trees)
                for p in range(parts):
                    np.add.at(sums[p], index[:, p], ints[:, p * width : (p + 1) * width])
                    counts[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        cells = np.column_stack([counts[part, entry][:, None], sums[part, entry]])
        place = np.tile(np.arange(width + 1), len(part))
        yield pa.record_batch(
            [pa.array(np.repeat(part, width + 1), pa.int32()), pa.array(np.repeat(entry, width + 1), pa.int32()), pa.array(place, pa.int32()), pa.array(cells.ravel(), pa.int64())],
            names=["part", "entry", "place", "amount"],
        )

    summed = rows.select("ints").mapInArrow(run, "part int, entry int, place int, amount long")
    summed = summed.groupBy("part", "entry", "place").agg(F.sum(F.col("amount").cast("decimal(20, 0)")).alias("amount"))
    found = {(r.part, r.entry, r.place): int(r.amount) for r in summed.toLocalIterator()}
    after = [b.copy() for b in books]
    for (p, e, place), amount in found.items():
        if place:
            after[p][e, place - 1] = amount // found[p, e, 0]
    return after


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of ``integer_vectors`` that are equally long; none for an empty table."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        return []
    start = np.array([r.ints for r in first], dtype=np.int64)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _updated(rows, books)
    return books


def encoded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every row of ``integer_vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for batch in batches:
            if batch.num_rows:
                index, distance = _assigned(_rows(batch.column(2)), trees)
                codes = [bytes(row).hex() for row in index.astype(np.uint8)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = integer_vectors(vectors, scale=scale, parts=parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(1).select(F.size("ints").alias("size")).collect()
    rows = rows.filter(F.size("ints") == (first[0]["size"] if first else 0))
    books = fit(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    found = stage_table(encoded(rows, books), "vector-codes") if books else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    errors = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    with_label = found.join(errors.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return with_label.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


ORACLE_SQL = """
with recursive kept as (
    select row_number() over (order by vec_id) - 1 as place, vec_id, label,
           list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as ints
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
    select place, p, ints[p * w + 1 : p * w + w] as v
    from (select place, ints, len(ints) // 16 as w from kept), range(16) t(p)
), rounds as (
    select 0 as round, p, place as e, v as book from parts where place < 64
    union all
    (
        with near as (
            select b.round, p.p, p.place, p.v, b.e,
                   list_sum(list_transform(list_zip(p.v, b.book), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
            from parts p join rounds b on b.p = p.p where b.round < 2
        ), chosen as (
            select p, v, e from near qualify row_number() over (partition by p, place order by d, e) = 1
        ), means as (
            select p, e, list(floor_mean order by i) as book from (
                select p, e, i, floor(sum(v[i])::hugeint / count(*)) :: bigint as floor_mean
                from chosen, range(1, (select max(len(v)) + 1 from parts)) t(i) group by p, e, i
            ) group by p, e
        )
        select b.round + 1, b.p, b.e, coalesce(m.book, b.book)
        from rounds b left join means m on m.p = b.p and m.e = b.e where b.round < 2
    )
), final as (
    select p, e, book from rounds where round = 2
), near as (
    select p.p, p.place, b.e, list_sum(list_transform(list_zip(p.v, b.book), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from parts p join final b on b.p = p.p
), chosen as (
    select p, place, e, d from near qualify row_number() over (partition by p, place order by d, e) = 1
), codes as (
    select place, string_agg(lpad(format('{:x}', e), 2, '0'), '' order by p) as code, sum(d)::bigint as error from chosen group by place
), digest as (
    select sha256(string_agg(array_to_string(book, ','), ',' order by p, e)) as codebooks_sha256 from final
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join codes using (place), digest
"""
