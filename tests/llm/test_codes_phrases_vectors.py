"""Vector codes, collocations and near vectors against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import codes, collocations, cosine
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<double>, label int"


def clash(df):
    return df.withColumns({c: F.lit(1) for c in ("ints", "v", "part", "ball", "keys", "unit", "phrase", "words", "n", "rank", "code", "error")})


# --- vector codes ------------------------------------------------------------------


def coded(rows, parts=16, entries=64, rounds=2):
    """The contract, part by part; rows are (id, ints, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    split = [np.split(np.array(r[1], dtype=object), parts) for r in rows]
    books = [[split[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(p, x):
        return min((int(((x - b) ** 2).sum()), e) for e, b in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            chosen = defaultdict(list)
            for s in split:
                chosen[nearest(p, s[p])[1]].append(s[p])
            books[p] = [np.array([int(c) // len(chosen[e]) for c in sum(chosen[e])], dtype=object) if chosen[e] else b for e, b in enumerate(books[p])]
    found = [[nearest(p, s[p]) for p in range(parts)] for s in split]
    errors = Counter()
    for r, f in zip(rows, found):
        errors[r[2]] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0] is None, r[0] or 0), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[r[2]], digest) for r, f in zip(rows, found))


def result(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_of_the_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding], r.label) for r in table.collect()]
    assert result(codes.vector_codes(table)) == coded(rows)


def test_codes_with_ties_and_odd_rows(spark):
    r = random.Random(1)
    rows = [(k, [r.choice((-0.004, 0.0, 0.004, 0.0117)) for _ in range(32)], r.choice((1, 2, None))) for k in range(150)]
    rows += [(200, rows[0][1], 1), (200, rows[1][1], 1), (201, rows[0][1], None), (None, rows[2][1], 2)]
    bad = [(300, None, 1), (301, [0.0] * 31 + [None], 1), (302, [0.0] * 31 + [float("nan")], 1), (303, [float("inf")] + [0.0] * 31, 1), (304, [], 1), (305, [0.0] * 48, 1), (306, [0.0] * 17, 1), (307, [1e30] + [0.0] * 31, 1)]
    df = clash(spark.createDataFrame(rows + bad, VECTORS))
    assert result(codes.vector_codes(df)) == coded([(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows])
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert result(codes.vector_codes(few)) == coded([(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows[:3]])
    assert codes.vector_codes(df.limit(0)).count() == 0


def test_vantage_trees(spark):
    r = np.random.default_rng(2)
    for size, spread in ((1, 5), (2, 1), (5, 2), (64, 2), (64, 300), (64, 1 << 27)):
        book, points = r.integers(-spread, spread + 1, (size, 4)), r.integers(-spread, spread + 1, (500, 4))
        points[: min(size, 500)] = book[: min(size, 500)]
        index, distance = codes.VantageTree(book).nearest(points)
        every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


# --- collocations --------------------------------------------------------------------


def mined(rows, max_words=3, least=10, share=50, top=2000):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \\t]+", piece) if w]
            for k in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        longest = Counter()
        for p, c in f.items():
            if len(p) > 2 and c >= least:
                for i in range(len(p)):
                    for j in range(i + 2, len(p) + 1):
                        if j - i < len(p):
                            longest[p[i:j]] = max(longest[p[i:j]], c)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * longest[p] < share * a or len(p) == max_words and a >= least:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrases(df, **how):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **how).collect())


def test_collocations_of_the_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = mined([(r.lang, r.text) for r in table.collect()])
    assert phrases(table) == want and want
    # fewer than there are, with ties; and a longer depth
    assert phrases(table, top=5) == [x for x in want if x[1] <= 5]
    assert phrases(table, max_words=4, min_count=20) == mined([(r.lang, r.text) for r in table.collect()], 4, 20)


def test_collocations_of_odd_rows(spark, monkeypatch):
    r = random.Random(3)
    words = ["A", "b", "Été", "a b", "x\ty", "", ".", "a,b", "한", "\x00", "c"]
    rows = [(r.choice(("en", "fr", None)), " ".join(r.choices(words, k=r.randint(0, 40)))) for _ in range(300)] + [("en", None), ("en", ""), (None, "..."), ("de", "a b " * 20_000)]
    df = clash(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    want = mined(rows)
    assert phrases(df) == want and {x[0] for x in want} == {"en", "fr", "und", "de"}
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.filter("lang = 'de'"), min_count=10**9).count() == 0
    many = sorted(set(b"".join(collocations._slices(b"x. " * 3_000_000)).split())), [len(s) for s in collocations._slices(b"x. " * 3_000_000)]
    assert many[0] == [b"x."] and max(many[1]) <= collocations.SHARD_BYTES + 4 and sum(many[1]) == 9_000_000


def test_states_of_an_automaton():
    text = "a b a b c a b. b a b"
    shard = collocations.Automaton(text.encode(), "en")
    full = np.full(collocations.BITS // 8 + 1, 255, dtype=np.uint8)
    for depth in (1, 2, 3, 4):
        want = Counter(" ".join(w[i : i + depth]) for w in (p.split() for p in text.split(".")) for i in range(len(w) - depth + 1))
        found, n = shard.phrases()
        assert dict(zip(found.to_pylist(), n.tolist())) == want
        shard.deepen(full)


# --- near vectors -----------------------------------------------------------------------


def near(rows, threshold=0.9):
    """Links, smallest reachable id and kept of every row by all pairs."""
    sound = {i: np.array(v, dtype=float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(sound)
    links = defaultdict(set)
    for size in {len(v) for v in sound.values()}:
        own = [i for i in ids if len(sound[i]) == size]
        x = np.array([sound[i] / np.abs(sound[i]).max() for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[own[a]].add(own[b])
    component = {}
    for i in ids:
        if i not in component:
            stack = [i]
            while stack:
                at = stack.pop()
                if at not in component:
                    component[at] = i
                    stack += links[at]
    return {i: (len(links[i]), component.get(i, i)) for i, _ in rows}


def check_near(spark, rows, least=1.0):
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cosine.near_vectors(clash(df)).collect()}
    want = near(rows)
    assert set(got) == set(want)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found <= there and found >= least * there
    if least == 1.0:
        assert got == want


def test_near_vectors_of_the_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_near(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors_around_the_threshold(spark, seed):
    """Groups from tight to wide, one of a third of all rows, so that balls meet in every way."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 24))
    rows = [(int(k), (centres[0 if k % 3 == 0 else k % 12] + r.standard_normal(24) * r.choice([0.01, 0.1, 0.2, 0.35])).tolist()) for k in range(900)]
    check_near(spark, rows, 0.995)


def test_near_vectors_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, v), (4, [-1.0, -2.0, -3.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 3.0]), (9, [float("nan"), 2.0, 3.0]), (10, [float("inf"), 2.0, 3.0]), (11, [1e-300, 2e-300, 3e-300]), (12, [1e300, 2e300, 3e300]), (13, [1.0, 2.0])]
    check_near(spark, rows)
    again = spark.createDataFrame([(1, v, 1), (1, v, 2), (2, v, 1), (None, v, 1), (None, v, 1)], VECTORS)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in cosine.near_vectors(again).collect())
    assert got == [(-1, 0, None, True), (-1, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert cosine.near_vectors(again.limit(0)).count() == 0


def test_tables_follow_the_rows():
    for rows in (10, 10**4, 10**6, 10**9):
        bits, tables = cosine.plan(rows)
        assert rows / 2**bits <= cosine.PER_KEY * 1.01 and (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= cosine.MISS
