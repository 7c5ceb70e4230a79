"""The pipeline's stages one by one on the smallest tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from rowlens.llm import pii
from tests.conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, source = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    from rowlens.llm.common import stage_table

    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage_table(stage(spark, docs, SMALL), f"t-{name}")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept["language"]) >= 0.97 * len(source)
    by_text = {}
    for i, t in kept["language"].items():
        by_text[t] = max(i, by_text.get(t, i))
    assert set(kept["exact"]) == set(by_text.values())
    assert set(kept["near"]) <= set(kept["exact"]) and set(kept["pii"]) == set(kept["near"])
    changed = {i for i, t in kept["pii"].items() if t != kept["near"][i]}
    assert changed and all(re.search(r"\[(EMAIL|IP|CARD|PHONE|ACCOUNT|SSN)\]", kept["pii"][i]) for i in changed)
    assert not any(re.search(pii.BASE["email"].replace(r"\G|", "(?!)|"), t or "") for t in kept["pii"].values())
    rows = cp.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == set(kept["pii"])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 2048
    assert [n for n, _ in cp.STAGES] == ["language", "exact", "near", "pii", "packing"]


def test_stages_with_odd_rows(spark):
    text = "many words of one text that is written here more than once for a test"
    rows = [(1, None, "en"), (2, "", "en"), (3, text, "en"), (4, text, None), (4, text, None), (None, text, "en"), (None, None, None), (5, "a@b.de " + text, "en"), (6, "1 2 3", "en"), (7, text * 2_000, "en")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for clash in ("digest", "node", "base", "row", "__own", "kept", "free", "bucket"):
        odd = odd.withColumn(clash, F.lit(clash))
    kept = {name: stage(spark, odd, SMALL).collect() for name, stage in cp.STAGES}
    for name, _ in cp.STAGES[:-1]:
        assert list(kept[name][0].asDict()) == odd.columns and {r.bucket for r in kept[name]} == {"bucket"}
    assert {r.doc_id for r in kept["language"]} == {3, 4, 5, 7, None}
    assert sorted((r.doc_id or 0, r.text or "") for r in kept["exact"]) == sorted([(4, text), (2, ""), (5, "a@b.de " + text), (6, "1 2 3"), (7, text * 2_000)])
    assert Counter(r.doc_id for r in kept["pii"]) == Counter(r[0] for r in rows) and [r.text for r in kept["pii"] if r.doc_id == 5] == ["[EMAIL] " + text]
    assert {r.doc_id for r in kept["near"]} >= {1, 2, 3, 6, 7} and 4 not in {r.doc_id for r in kept["near"]}
    assert Counter(r.doc_id for r in kept["packing"] if r.piece == 0) == Counter(r[0] for r in rows)
    for name, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), SMALL).count() == 0
