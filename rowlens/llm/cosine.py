"""Near duplicates among vectors: random-hyperplane signs, exact cosines, connected components.

Every vector gets ``tables`` keys of ``bits`` signs each against fixed random hyperplanes.
Two vectors that share a key of one table are candidates; a candidate pair is linked if
its cosine in double precision is ``threshold`` or more. ``bits`` follows the logarithm of
the number of vectors, so that a key holds ``PER_KEY`` unrelated vectors on average at
any size, and ``tables`` follows from ``bits``: a pair exactly at the threshold shares no
key with probability ``MISS`` at most. Work grows with less than the square for that reason.

Groups of copies, which may hold any share of the rows, are never spread into pairs:

1. Balls. A vector joins the ball of the smallest vec_id among the first ids of its keys
   whose angle to it is at most half the threshold's. Any two members of a ball are then linked by the
   triangle inequality, so a ball is one vertex with a size and a radius, and no pair in
   it is looked at. A vector that finds no ball is its own.
2. Keys are reduced to distinct (table, key, ball), and balls that share a key are joined.
   The join's condition compares sign sketches of 256 bits of the centres and passes what
   can be near, given both radii; so unrelated vectors that share a key leave no row.
3. Balls whose farthest members are within the threshold are linked as wholes, those whose
   nearest members are beyond it are not. Only what the radii leave open is settled
   by comparing members, first with the other ball's centre, then with its members.

All of it is joins and groupings of the written vectors; keys and candidates carry ids only. Angles that
decide without a comparison of members have a margin of ``MARGIN``.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing and is its own component. Vectors of different lengths
are not linked. Of rows that repeat a vec_id one counts, that with the smallest vector
(nulls first), and one row is returned; rows without a vec_id are returned each with
no links and no component, kept. An empty table gives an empty result. Only id and
vector are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import drop_stage, stage_table
from rowlens.llm.components import components

THRESHOLD = 0.9
#: Unrelated vectors behind a key on average, and the chance that a pair at the threshold shares no key.
PER_KEY, MISS = 32, 0.0005
SKETCH_WORDS, SEED, MARGIN = 4, 20_011, 1e-6
#: Tables of one shuffle, and those that propose balls.
WAVE, PROPOSING = 16, 16


def plan(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Signs a key and tables for so many vectors."""
    bits = min(48, max(6, math.ceil(math.log2(max(2, rows) / PER_KEY))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def _signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """vec_id, unit vector, keys and sketch words of every sound vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        word = np.int64(1) << np.arange(64, dtype=np.int64)
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)])
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                if size not in planes:
                    planes[size] = np.random.default_rng(SEED + size).standard_normal((size, max(bits * tables, 64 * SKETCH_WORDS)))
                signs = x @ planes[size] > 0
                keys = (signs[:, : bits * tables].reshape(len(x), tables, bits) * weights).sum(axis=2)
                sketch = (signs[:, : 64 * SKETCH_WORDS].reshape(len(x), SKETCH_WORDS, 64) * word).sum(axis=2)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (x, keys, sketch)]
                yield pa.record_batch([part.column(0), *lists], names=["vec_id", "unit", "keys", "sketch"])

    return vectors.mapInArrow(run, "vec_id long, unit array<double>, keys array<long>, sketch array<long>")


def cosine(x: str, y: str) -> Column:
    """Of unit vectors; of different lengths null."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def _angle(c: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def _balls(signed: DataFrame, tables: int, threshold: float) -> DataFrame:
    """vec_id, ball and angle to its centre, for vectors in the ball of another one; at least two in each."""
    keys = signed.select("vec_id", F.size("unit").alias("size"), F.posexplode(F.slice("keys", 1, min(PROPOSING, tables))).alias("t", "key"))
    firsts = keys.groupBy("size", "t", "key").agg(F.min("vec_id").alias("ball"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    proposed = keys.join(firsts, ["size", "t", "key"]).filter("ball < vec_id").groupBy("vec_id", "ball").count()
    # a vector within half the angle shares many keys with the centre, an unrelated one hardly a second
    proposed = proposed.filter(F.col("count") > 1).select("vec_id", "ball")
    x = signed.select("vec_id", F.col("unit").alias("x"))
    y = signed.select(F.col("vec_id").alias("ball"), F.col("unit").alias("y"))
    near = proposed.join(x, "vec_id").join(y, "ball").select("vec_id", "ball", _angle(cosine("x", "y")).alias("angle"))
    inside = near.filter(F.col("angle") <= math.acos(threshold) / 2 - MARGIN)
    chosen = stage_table(inside.groupBy("vec_id").agg(F.min(F.struct("ball", "angle")).alias("b")).select("vec_id", "b.ball", "b.angle"), "cosine-chosen")
    # one member that has the centre in another ball is no ball
    return chosen.join(chosen.groupBy("ball").count().join(_unchosen(signed, chosen), "ball", "left").filter("count > 1 or own"), "ball", "left_semi")


def _unchosen(signed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The vectors that stay at the centre of their own ball."""
    return signed.join(chosen, "vec_id", "left_anti").select(F.col("vec_id").alias("ball"), F.lit(True).alias("own"))


def _placed(signed: DataFrame, tables: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Every vector with its ball; and every ball with centre, sketch, radius and size."""
    inside = _balls(signed, tables, threshold)
    ball_of = stage_table(signed.select("vec_id").join(inside, "vec_id", "left").select("vec_id", F.coalesce("ball", "vec_id").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "cosine-ball-of")
    sizes = ball_of.groupBy("ball").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)]
    centres = stage_table(sizes.join(signed.select(F.col("vec_id").alias("ball"), "unit", *words), "ball"), "cosine-centres")
    rows = signed.select("vec_id", "unit", "keys").join(ball_of.select("vec_id", "ball"), "vec_id")
    return stage_table(rows.join(centres.drop("unit"), "ball"), "cosine-placed"), centres


def _candidates(placed: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of balls that share a key and whose sketches allow a link."""
    share = 64 * SKETCH_WORDS / math.pi
    few = math.acos(threshold) * share + 6 * math.sqrt(64 * SKETCH_WORDS) / 2
    words = [f"s{i}" for i in range(SKETCH_WORDS)]
    waves = []
    for begin in range(0, tables, WAVE):
        rows = placed.select("ball", F.size("unit").alias("size"), "radius", *words, F.posexplode(F.slice("keys", begin + 1, WAVE)).alias("t", "key"))
        rows = rows.groupBy("size", "t", "key", "ball").agg(*(F.first(c).alias(c) for c in ("radius", *words)))
        a, b = (rows.select("size", "t", "key", *(F.col(c).alias(f"{c}_{x}") for c in ("ball", "radius", *words))) for x in "ab")
        apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
        on = (F.col("ball_a") < F.col("ball_b")) & (apart <= few + (F.col("radius_a") + F.col("radius_b")) * share)
        pairs = a.join(b, ["size", "t", "key"]).filter(on).select(F.col("ball_a").alias("a"), F.col("ball_b").alias("b"))
        waves.append(stage_table(pairs.distinct(), f"cosine-candidates-{begin}"))
    every = waves[0]
    for wave in waves[1:]:
        every = every.unionByName(wave)
    found = stage_table(every.distinct(), "cosine-candidates")
    for wave in waves:
        drop_stage(wave)
    return found


def _linked(placed: DataFrame, centres: DataFrame, pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """vec_id, ball and n_links of every vector; and the links (a, b) of balls."""
    theta = math.acos(threshold)
    a, b = (centres.select(*(F.col(c).alias(f"{c}_{x}") for c in ("ball", "unit", "radius", "n"))).withColumnRenamed(f"ball_{x}", x) for x in "ab")
    seen = pairs.join(a, "a").join(b, "b").withColumn("cos", cosine("unit_a", "unit_b")).withColumn("angle", _angle(F.col("cos")))
    spread = F.col("radius_a") + F.col("radius_b")
    kind = (
        F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), F.when(F.col("cos") >= threshold, "all").otherwise("none"))
        .when(F.col("angle") + spread <= theta - MARGIN, "all")
        .when(F.col("angle") - spread > theta + MARGIN, "none")
        .otherwise("some")
    )
    seen = stage_table(seen.select("a", "b", "n_a", "n_b", kind.alias("kind")).filter("kind <> 'none'"), "cosine-balls")
    whole = seen.filter("kind = 'all'")
    of_balls = whole.select(F.col("a").alias("ball"), F.col("n_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("n_a").alias("n")))

    # members of the smaller ball against the larger one's centre, then what is still open against its members
    few, many = (F.when(F.col("n_a") <= F.col("n_b"), F.col(x)).otherwise(F.col(y)) for x, y in ("ab", "ba"))
    members = placed.select(F.col("ball").alias("few"), "vec_id", F.col("unit").alias("x"))
    larger = centres.select(F.col("ball").alias("many"), F.col("unit").alias("y"), "radius", "n")
    against = seen.filter("kind = 'some'").select(few.alias("few"), many.alias("many")).join(members, "few").join(larger, "many")
    against = against.withColumn("cos", cosine("x", "y")).withColumn("angle", _angle(F.col("cos")))
    sure = (
        F.when(F.col("n") == 1, F.col("cos") >= threshold)
        .when(F.col("angle") + F.col("radius") <= theta - MARGIN, True)
        .when(F.col("angle") - F.col("radius") > theta + MARGIN, False)
    )
    against = stage_table(against.select("few", "many", "vec_id", "x", "n", sure.alias("sure")).filter("coalesce(sure, true)"), "cosine-members")
    covered = against.filter("sure")
    others = placed.select(F.col("ball").alias("many"), F.col("vec_id").alias("other"), F.col("unit").alias("y"))
    single = stage_table(against.filter("sure is null").join(others, "many").filter(cosine("x", "y") >= threshold).select("few", "many", "vec_id", "other"), "cosine-single")

    one = F.lit(1).cast("long").alias("n")
    of_balls = of_balls.unionByName(covered.select(F.col("many").alias("ball"), one)).groupBy("ball").agg(F.sum("n").alias("of_ball"))
    of_vectors = covered.select("vec_id", "n").unionByName(single.select("vec_id", one)).unionByName(single.select(F.col("other").alias("vec_id"), one))
    of_vectors = of_vectors.groupBy("vec_id").agg(F.sum("n").alias("of_vector"))
    links = F.col("n") - 1 + F.coalesce("of_ball", F.lit(0)) + F.coalesce("of_vector", F.lit(0))
    counted = placed.select("vec_id", "ball", "n").join(of_balls, "ball", "left").join(of_vectors, "vec_id", "left").select("vec_id", "ball", links.cast("long").alias("n_links"))
    between = [x.select(F.col(p).alias("a"), F.col(q).alias("b")) for x, p, q in ((whole, "a", "b"), (covered, "few", "many"), (single, "few", "many"))]
    return counted, between[0].unionByName(between[1]).unionByName(between[2]).distinct()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    named = stage_table(rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "cosine-vectors")
    # NaN counts as the largest value
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (x < float("inf")) & (x > -float("inf"))) & F.exists("v", lambda x: x != 0)
    good = named.filter("v is not null").filter(sound)
    bits, tables = plan(good.count(), threshold)
    signed = stage_table(_signed(good, bits, tables), "cosine-signed")
    placed, centres = _placed(signed, tables, threshold)
    counted, links = _linked(placed, centres, _candidates(placed, tables, threshold), threshold)

    of_ball = components(links).select(F.col("node").alias("ball"), "component")
    counted = stage_table(counted.join(of_ball, "ball", "left").select("vec_id", "n_links", F.coalesce("component", "ball").alias("component")), "cosine-counted")
    smallest = counted.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = counted.join(smallest, "component").select("vec_id", "n_links", "component_id")
    rest = named.select("vec_id").join(signed.select("vec_id"), "vec_id", "left_anti").unionByName(rows.filter("vec_id is null").select("vec_id"))
    every = linked.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = """
with recursive sound as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as x, b.vec_id as y from sound a join sound b
    on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9
), reached as (
    select vec_id, vec_id as y from embeddings
    union
    select r.vec_id, l.y from reached r join links l on l.x = r.y
), counts as (
    select x as vec_id, count(*) as n from links group by x
)
select r.vec_id, coalesce(max(n), 0)::bigint as n_links, min(y) as component_id, r.vec_id = min(y) as kept
from reached r left join counts using (vec_id) group by r.vec_id
"""
