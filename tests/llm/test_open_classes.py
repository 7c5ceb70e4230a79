"""Behind the search for open buckets a class has a row, or a row a collection, however many buckets it stands in."""

import random

from rowlens.llm import minhash
from rowlens.llm.minhash import COLLECTIONS, _between


def test_no_stage_has_a_row_a_bucket(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9))):
            words[r.randrange(120)] = f"y{r.randint(0, 3)}"
        rows.append((k, " ".join(words)))
    made, plain = {}, minhash.stage_table

    def counted(df, label):
        out = plain(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "stage_table", counted)
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert made["open-around"] > 0 and made["buckets"] > COLLECTIONS * 150
    assert {label: n for label, n in made.items() if label.startswith("open-") and n > 150} == {}


def test_classes_between_components(spark):
    def keys(*shared):
        return [7 if i in shared else None for i in range(COLLECTIONS)]

    rows = [(1, 1, keys(0, 1, 2)), (2, 1, keys(0, 1)), (3, 3, keys(1, 2)), (4, 4, keys(2)), (5, 5, keys(5, 6)), (6, 5, keys(5, 6))]
    # no value is null in the operator: what is not shared gets one of its own
    rows = [(node, component, [1000 * node + i if h is None else h for i, h in enumerate(own)]) for node, component, own in rows]
    found = _between(spark.createDataFrame(rows, "node long, component long, keys array<long>"))
    # 2 shares value 1 only with another component, value 0 with its own; 4 has one value; 5 and 6 are one component
    assert sorted(r.node for r in found.collect()) == [1, 3]
