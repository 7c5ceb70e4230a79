"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct five-word shingles (fewer words: the whole
sequence). Instead of hashing one band per table, ``COLLECTIONS`` small
collections of ``ROWS`` minhashes are made, and every *pair* of collections is
one table, its key combining both: 20 collections of 3 give 190 tables of six
minhashes from 60 minhash functions, where plain banding would need 1,140. Two
documents share a table when two of their collections agree; at the threshold
similarity 0.75 all tables miss a pair with probability 3e-4, at 0.8 1e-5.

Work follows the candidates, not the table count:

* documents with the same words are one class, and only its smallest id goes on;
* a collection value that no other class has can't meet anything, so only values
  of two or more classes are combined;
* inside a table's bucket every member is compared with the smallest member, not
  with all others. Where members then still lie in different components, the rest
  is worked off exactly (``_rest``) by what rare shingles and parities prove;
* each candidate pair is confirmed on both full sets, 100 * intersection >= 75 *
  union. Sets are of 64-bit shingle hashes.

The rest of the buckets: let a shingle be rare when at most ``RARE`` of the classes
left have it, and c the count of a class's other shingles.

1. Two classes that share a rare shingle meet in that shingle's short list; the
   lists give how many they share, and with min(c, c') that bounds the intersection.
2. Two classes that share none have at most min(c, c') in common. A class whose c is
   too small even for a subset of it drops out. That is linear in the classes, and
   in a large group of edited copies it leaves those near the group's centre. A class
   that shares fewer than two collection values with other components drops out too:
   a bucket combines two. From here on a class has 20 rows, not one for each bucket.
3. In the 20 tables that combine a collection with the next one, the class of a
   bucket with the largest share of common shingles is compared with the others: it is
   the likely centre of a group. What meets in other tables only is left to the next
   step.
4. Pairs that still lie apart are joined on single collections, classes outside a
   value's largest component against all of them, and only pairs within both bounds
   come out: min(c, c'), and a 1,024-bit parity of each set, whose differing bits are
   no more than the shingles that only one of the two has. A pair comes out at the
   first collection it shares.

Step 4 looks at each class that is apart from its bucket's main component once for
every class it meets there; that is quadratic only in families of texts whose every
shingle is common and which are yet not linked with their centre.

Links become components by contraction (``components``). No group is gathered in
one task, nothing but loop conditions reaches the driver, and each stage is
written to the shared folder.

Defined results: null or empty texts and texts of white space only have size 0,
are linked with nothing and kept. A null id is never a component's name while
its copies have one; alone it keeps null and is kept. Rows that repeat id and
text share component and ``kept``. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import drop_stage, stage_table, text_or_empty
from rowlens.llm.components import components

SHINGLE = 5
COLLECTIONS, ROWS = 20, 3
PERCENT = 75
#: Shingles of so many classes at most are rare; three is the most that ``_short_lists`` can tell apart.
RARE = 3
#: 64-bit words of a set's parity.
PARITY = 16
#: Words whose hashes a worker keeps.
CACHE_WORDS = 100_000
#: Shingles hashed at once, to bound a task's memory on very long texts.
BLOCK = 8_192

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(array("Q", map(_WORDS.__getitem__, words)), np.uint64)
    k = min(size, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        total = _mixed(total + w[j : len(w) - k + 1 + j])
    return np.unique(total)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(75)
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def collection_keys(shingles: np.ndarray, collections: int = COLLECTIONS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit value per collection, made of its minhashes."""
    a, b = _functions(collections * rows)
    least = np.full(collections * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        for j in range(len(a)):
            least[j] = min(least[j], (part * a[j] + b[j]).min())
    total = np.arange(collections, dtype=np.uint64)
    for j in range(rows):
        total = _mixed(total + least.reshape(collections, rows)[:, j])
    return total.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, set size and collection keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys = [], [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                shingles = shingle_set(words)
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                sizes.append(len(shingles))
                keys.append(collection_keys(shingles) if len(shingles) else [])
            yield pa.record_batch(
                [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text as a zstandard frame, so that joins move less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            packed = [pack(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, packed binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            found = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                left = shingle_set(words_of(unpack(x.as_py()).decode("utf-8", "surrogatepass")))
                if last[0] != b:
                    last = (b, shingle_set(words_of(unpack(y.as_py()).decode("utf-8", "surrogatepass"))))
                both = len(np.intersect1d(left, last[1], assume_unique=True))
                if both and 100 * both >= percent * (len(left) + len(last[1]) - both):
                    found.append((a, b))
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _near(n: str, m: str, percent: int) -> str:
    """Sets of these sizes can be similar enough."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _bound(both: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets of n and m shingles with at most ``both`` in common can be similar enough."""
    return 100 * both >= percent * (n + m - both)


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    return shingle_set(words_of(zstandard.ZstdDecompressor().decompress(packed.as_py()).decode("utf-8", "surrogatepass")))


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of ``64 * PARITY`` bits whether an odd number of shingles falls on it."""
    at = (_mixed(shingles) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _shingles(texts: DataFrame) -> DataFrame:
    """(node, shingle) of every text of (doc_id, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, packed in zip(b.column(0).to_pylist(), b.column(1)):
                found = _unpacked(packed)
                for at in range(0, len(found), BLOCK):
                    part = found[at : at + BLOCK].view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(part), node)), pa.array(part)], names=["node", "shingle"])

    return texts.select("doc_id", "packed").mapInArrow(run, "node long, shingle long")


def _short_lists(shingles: DataFrame) -> DataFrame:
    """shingle and members (ascending nodes) of every shingle that at most ``RARE`` nodes have; three nodes are their least, their greatest and what is left of their exclusive or."""
    found = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor("node").alias("all"))
    third = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    members = F.when(F.col("m") == 1, F.array("low")).when(F.col("m") == 2, F.array("low", "high")).otherwise(F.array(F.col("low"), third, F.col("high")))
    return stage_table(found.filter(F.col("m") <= RARE).select("shingle", members.alias("members")), "rare-shingles")


def _parities(texts: DataFrame) -> DataFrame:
    """(node, parity) of every text of (doc_id, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parity(_unpacked(packed)) for packed in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "parity"])

    return texts.select("doc_id", "packed").mapInArrow(run, "node long, parity array<long>")


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n): one key per pair of a class's collections that other classes share."""
    values = nodes.select("node", "n", F.posexplode("keys").alias("c", "h"))
    shared = stage_table(values.groupBy("c", "h").count().filter("count > 1").select("c", "h"), "shared-collections")
    live = values.join(shared, ["c", "h"]).groupBy("node", "n").agg(F.collect_set(F.struct("c", "h")).alias("own"))
    own = live.filter("size(own) > 1").select("node", "n", F.array_sort("own").alias("own"))
    pairs = F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> xxhash64(x.c, x.h, y.c, y.h))))")
    return own.select(F.explode(pairs).alias("key"), "node", "n")


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component) of the rows (key, node) whose key has several components."""
    named = rows.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return named.join(keys.select("key"), "key")


def _placed(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes (node, ...) with their components as they are now."""
    return classes.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _between(classes: DataFrame) -> DataFrame:
    """The classes (node, component, keys, ...) that share two collection values or more with classes of other components; a row a collection, joined by collection value."""
    values = classes.select("node", "component", F.posexplode("keys").alias("i", "h"))
    mixed = values.groupBy("i", "h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    nodes = values.join(mixed.select("i", "h"), ["i", "h"]).groupBy("node").count().filter("count > 1")
    return classes.join(nodes.select("node"), "node", "left_semi")


def _seen(rest: DataFrame, alive: DataFrame) -> DataFrame:
    """The rows (key, node, component) with n and c of their classes.

    A class's buckets travel as one list (at most one for each pair of its collections), so the join gives a row a class.
    """
    own = rest.groupBy("node", "component").agg(F.collect_list("key").alias("own"))
    return own.join(alive.select("node", "n", "c"), "node").select(F.explode("own").alias("key"), "node", "component", "n", "c")


def _neighbours(live: DataFrame) -> DataFrame:
    """(key, node, component, n, c) of classes (node, component, n, c, keys): one key for each collection and the next one, so a row a collection."""
    keys = [F.xxhash64(F.lit(i), F.col("keys")[i], F.col("keys")[(i + 1) % COLLECTIONS]) for i in range(COLLECTIONS)]
    return live.select(F.explode(F.array(*keys)).alias("key"), "node", "component", "n", "c")


def _to_centres(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each class and the likely centre of its buckets of neighbouring collections, where they lie in different components."""
    seen = _neighbours(live)
    centre = seen.groupBy("key").agg(
        F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("node")).alias("order"), "n", "c", "component")).alias("o"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    centre = centre.filter("low < high").select("key", "o")
    pairs = seen.join(centre, "key").filter((F.col("component") != F.col("o.component")) & _bound(F.least("c", "o.c"), F.col("n"), F.col("o.n"), percent))
    return pairs.select("node", (-F.col("o.order")).alias("other")).select(*_ordered("node", "other"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _apart(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (node, n, c, keys, parity, component) that may be linked and lie in different components.

    A pair has two collections in common at least; both bounds hold.
    """
    at = [F.col("keys")[j].alias(f"k{j}") for j in range(COLLECTIONS)] + [F.col("parity")[j].alias(f"p{j}") for j in range(PARITY)]
    values = live.select("node", "n", "c", "component", F.posexplode("keys").alias("i", "h"), *at)
    counts = values.groupBy("i", "h", "component").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("i", "h").agg(F.max(F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("found"))
    main = main.filter("found > 1").select("i", "h", F.col("main.component").alias("main"))
    rows = values.join(main, ["i", "h"])
    left = rows.filter("component <> main").select("i", "h", *[F.col(x).alias(f"l_{x}") for x in rows.columns if x not in "ih"])
    differ = sum((F.bit_count(F.col(f"p{j}").bitwiseXOR(F.col(f"l_p{j}"))) for j in range(PARITY)), F.lit(0))
    agree = [F.col(f"k{j}") == F.col(f"l_k{j}") for j in range(COLLECTIONS)]
    first = F.coalesce(*[F.when(x, F.lit(j)) for j, x in enumerate(agree)])
    size = F.col("n") + F.col("l_n")
    met = left.join(rows, ["i", "h"]).filter(
        (F.col("component") != F.col("l_component"))
        & ((F.col("component") == F.col("main")) | (F.col("node") > F.col("l_node")))
        & _bound(F.least("c", "l_c"), F.col("n"), F.col("l_n"), percent)
        & ((100 + percent) * differ <= (100 - percent) * size)
        & (first == F.col("i"))
        & (sum((x.cast("int") for x in agree), F.lit(0)) > 1)
    )
    return met.select(*_ordered("node", "l_node"))


def _rest(rows: DataFrame, nodes: DataFrame, texts: DataFrame, tried: DataFrame, edges: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Components once all pairs of the open buckets are settled; see the module's docstring."""

    def settled(pairs: DataFrame) -> None:
        nonlocal tried, edges, found
        new = stage_table(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(new)
        more = stage_table(_confirmed(new, texts, percent), "links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            found = components(edges)

    named = _open(rows, found).select("node", "component").distinct()
    named = stage_table(named.join(nodes, "node").select("node", "component", "n", "keys"), "open-classes")
    if named.isEmpty():
        return found
    some = stage_table(texts.join(named, texts["doc_id"] == named["node"], "left_semi"), "open-texts")
    lists = _short_lists(_shingles(some))
    rare = lists.select(F.explode("members").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("r"))
    counted = named.join(rare, "node", "left")
    counted = stage_table(counted.withColumn("c", F.col("n") - F.coalesce("r", F.lit(0))).drop("r"), "open-counts")
    drop_stage(named)

    # 1: pairs that share rare shingles
    two = "flatten(transform(members, (x, i) -> transform(slice(members, i + 2, size(members)), y -> struct(y as a, x as b))))"
    met = lists.filter("size(members) > 1").select(F.explode(F.expr(two)).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    for side in "ab":
        met = met.join(counted.select(F.col("node").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in ("n", "c", "component")]), side)
    both = F.col("k") + F.least("a_c", "b_c")
    settled(met.filter((F.col("a_component") != F.col("b_component")) & _bound(both, F.col("a_n"), F.col("b_n"), percent)).select("a", "b"))
    drop_stage(lists)

    # 2: what is left can only be linked by its common shingles
    alive = counted.filter(100 * F.col("c") >= percent * F.col("n"))
    around = stage_table(_between(_placed(alive, found)), "open-around")
    if around.isEmpty():
        return found

    # 3: the likely centres against the classes around them
    settled(_to_centres(around, percent))

    # 4: all others within both bounds
    last = stage_table(_between(_placed(around, found)), "open-last")
    if last.isEmpty():
        return found
    live = last.join(_parities(some.join(last, some["doc_id"] == last["node"], "left_semi")), "node")
    settled(_apart(stage_table(live, "open-live"), percent))
    drop_stage(some)
    return found


def links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of every class that is linked with another; nodes: node, n, keys."""
    keys = stage_table(table_keys(nodes), "table-keys")
    hubs = stage_table(keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "hub"), "hubs")
    rows = stage_table(keys.join(hubs, "key").select("key", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    drop_stage(keys)
    drop_stage(hubs)
    members = rows.select("node").distinct()
    texts = _packed_texts(docs)
    texts = stage_table(texts.join(members, texts["doc_id"] == members["node"], "left_semi").distinct(), "candidate-texts")
    pairs = rows.filter(_near("n", "hub_n", percent) + " and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tried = stage_table(pairs, "pairs")
    edges = stage_table(_confirmed(tried, texts, percent), "links")
    return _rest(rows.select("key", "node"), nodes, texts, tried, edges, components(edges), percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = stage_table(signatures(docs), "signatures")
    # n and keys follow from the digest, so any row of a class has them
    rows = signed.filter("n > 0 and doc_id is not null").groupBy("digest")
    classes = stage_table(rows.agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "classes")
    found = links(classes.select("node", "n", "keys"), docs, percent)
    placed = signed.select("doc_id", "digest", "n").join(classes.select("digest", "node"), "digest", "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
