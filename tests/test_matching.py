"""Assignment by rounds against the same decisions taken one pair after the other."""

import random

import pytest

from rowlens.operators import matching


def greedy_rows(pairs):
    order = sorted(pairs, key=lambda x: (-x[3], x[0], x[1]))
    options, twin = {}, {}
    for r, f, t, p in order:
        options.setdefault(r, []).append((p, f))
        twin[r] = t
    done, used, tied = {}, set(), {}
    for r, f, _, p in order:
        if r in done or r in tied or f in used:
            continue
        rivals = sorted(g for q, g in options[r] if q == p and g != f and g not in used)
        alike = [o for o in options if o != r and twin[o] == twin[r] and o not in done and o not in tied]
        if len(alike) < len(rivals):
            tied[r] = sorted([f, *rivals])
        else:
            done[r] = f
            used.add(f)
    return done, tied


def greedy_links(pairs):
    order = sorted(pairs, key=lambda x: (-x[3], x[0], x[1]))
    twin = {a: t for _, a, t, _ in pairs}
    done, used, torn = {}, set(), {}
    for p, a, _, n in order:
        if p in done or p in torn or a in used:
            continue
        rivals = sorted(b for q, b, _, m in pairs if q == p and m == n and b not in used and twin[b] != twin[a])
        if rivals:
            torn[p] = [a, *rivals]
        else:
            done[p] = a
            used.add(a)
    return done, torn


def invented(seed, links):
    """Pairs whose points depend on what looks alike only, as evidence does."""
    rng = random.Random(seed)
    pairs = []
    for employer in range(12):
        kinds, others = rng.randint(1, 4), rng.randint(1, 6)
        points = {(k, o): rng.choice([0, 1, 1, 2, 5]) for k in range(kinds) for o in range(others)}
        for row in range(rng.randint(1, 8)):
            kind = rng.randrange(kinds)
            for o in range(others):
                if points[kind, o]:
                    left, right = f"{employer}-{row}", f"{employer}-{o}"
                    pairs.append((right, left, f"{employer}/{kind}", points[kind, o]) if links else (left, right, f"{employer}/{kind}", points[kind, o]))
    return pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_and_folders(spark, seed):
    pairs = invented(seed, False)
    paired, tied = matching.one_to_one(spark.createDataFrame(pairs, "row_id string, folder_id string, twin string, points int"))
    want, torn = greedy_rows(pairs)
    assert {r.row_id: r.folder_id for r in paired.collect()} == want
    assert {r.row_id: r.candidates for r in tied.collect()} == torn


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_postings_and_applications(spark, seed):
    pairs = invented(seed, True)
    done, torn = matching.linked(spark.createDataFrame(pairs, "posting_id string, application_id string, twin string, points int"))
    want, open_ = greedy_links(pairs)
    assert {r.posting_id: r.application_id for r in done.collect()} == want
    assert {r.posting_id: r.ambiguous for r in torn.collect()} == open_


def test_a_long_chain_of_twins_takes_one_round(spark):
    pairs = [(f"r{k:04}", f"f{j:04}", "t", 3) for k in range(60) for j in range(60)]
    paired, tied = matching.one_to_one(spark.createDataFrame(pairs, "row_id string, folder_id string, twin string, points int"))
    assert sorted(map(tuple, paired.collect())) == [(f"r{k:04}", f"f{k:04}") for k in range(60)] and tied.count() == 0


def test_no_pairs(spark):
    none = spark.createDataFrame([], "row_id string, folder_id string, twin string, points int")
    paired, tied = matching.one_to_one(none)
    assert paired.count() == 0 and tied.count() == 0
