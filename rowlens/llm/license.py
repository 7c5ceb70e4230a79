"""License scans by a positional index of rare licence words, with DataFrame functions only.

The templates (``license_templates``: several windows of each licence's text, its
names and SPDX identifiers) have a label and mandatory key phrases. Their words with
positions are the index, a constant table. How rare a
word is, the corpus says: document frequencies of all template words are counted
over all documents. They choose what is looked up, no word is left out for being
frequent: of every template the ``LOOKED_UP`` rarest words of its key phrases,
which no occurrence can lack, at all their places in the document. Document
position minus template position is where the template would begin, and the
postings that agree on template and begin are intersected by counting their
distinct words. A template counts at a begin when all its looked-up words are
found there and all its key phrases stand in the document at their place relative
to that begin, so the lookup loses nothing: neither other notices nor stray words
nor the text's length matter. Its support is the inverse document frequency of its
words that stand at their places, against the most that ``SUPPORTING`` of its words
could bring.

Base results are exact and stay: the places where the words of a fixed phrase
stand one after another.

Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z
count as a-z. Only documents with all looked-up words of a template reach the index, their
looked-up words are rows keyed by document, template and begin, each with the few
words around it, so no document's or word's rows meet in one task.

Defined results: null text counts as empty and has no words; a null id stays
null; rows that repeat id and text get equal results; an empty table gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import stage_table, text_or_empty
from rowlens.llm.license_templates import templates

#: Between words of a lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only character beyond ASCII whose lower case is an ASCII letter, and a stand-in that has none.
KELVIN, STAND_IN = "\u212a", "\u0138"
#: Fixed phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (name, label, notice, key phrases).
TEMPLATES = templates()
LOOKED_UP = 2
SUPPORTING = 4
#: Words of the longest template.
LONGEST = max(len(notice.split(" ")) for _, _, notice, _ in TEMPLATES)


def _index() -> list[tuple[str, int, str]]:
    return [(name, at, word) for name, _, notice, _ in TEMPLATES for at, word in enumerate(notice.split(" "))]


VOCABULARY = sorted({word for *_, word in _index()})


def _key_places() -> list[tuple[str, str, int]]:
    """(template, key phrase, place in the template)."""
    found = []
    for name, _, notice, phrases in TEMPLATES:
        words = notice.split(" ")
        for phrase in phrases:
            own = phrase.split(" ")
            found.append((name, phrase, next(k for k in range(len(words)) if words[k : k + len(own)] == own)))
    return found


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def _places(words: Column, phrase: str) -> Column:
    """Word numbers where the phrase's words stand one after another."""
    own = phrase.split(" ")
    starts = F.when(F.size(words) >= len(own), F.sequence(F.lit(0), F.size(words) - len(own))).otherwise(F.expr("cast(array() as array<int>)"))

    def here(k: Column) -> Column:
        same = F.get(words, k) == own[0]
        for j, w in enumerate(own[1:], 1):
            same = same & (F.get(words, k + j) == w)
        return same

    return F.filter(starts, here)


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash and length (equal rows are told by them), and its lower-cased words."""
    text = text_or_empty("text")
    low = F.lower(F.replace(text, F.lit(KELVIN), F.lit(STAND_IN)))
    return docs.select(
        F.col("doc_id"),
        F.xxhash64(text).alias("same"),
        F.char_length(text).alias("chars"),
        F.array_remove(F.split(low, GAP, -1), "").alias("words"),
    )


def idf_table(rows: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word that some document has, counted over all documents."""
    seen = rows.select(F.explode(F.array_intersect("words", _strings(VOCABULARY))).alias("word"))
    counts = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    total = rows.count()
    return {w: math.log((1 + total) / (1 + n)) for w, n in counts.items()}


def _with_base(rows: DataFrame) -> DataFrame:
    """Places of the base's phrases and the labels they give."""
    none = F.expr("cast(array() as array<int>)")
    rows = rows.withColumn("may", F.array_contains("words", "license"))
    phrases = [F.struct(F.lit(label).alias("label"), F.when(F.col("may"), _places(F.col("words"), p)).otherwise(none).alias("at")) for p, label in PHRASES.items()]
    rows = rows.withColumn("phrases", F.array(*phrases))
    rows = rows.withColumn("places", F.flatten(F.transform("phrases", lambda p: p["at"])))
    labels = F.transform(F.filter("phrases", lambda p: F.size(p["at"]) > 0), lambda p: p["label"])
    return rows.withColumn("base", F.array_sort(F.array_distinct(labels))).drop("may", "phrases")


def _verified() -> Column:
    """All key words of the row's template (``keys``) at their place relative to ``begin``, a place in ``around``."""
    return F.forall("keys", lambda k: F.coalesce(F.get("around", F.col("begin") + k["at"]) == k["word"], F.lit(False)))


def _weight() -> Column:
    """Inverse document frequency of the distinct words of the row's template (``parts``) that stand at their place."""
    there = F.filter("parts", lambda p: F.coalesce(F.get("around", F.col("begin") + p["at"]) == p["word"], F.lit(False)))
    distinct = F.array_distinct(F.transform(there, lambda p: F.struct(p["word"], p["idf"])))
    return F.aggregate(distinct, F.lit(0.0), lambda total, p: total + p["idf"])


def looked_up(idf: dict[str, float]) -> dict[str, list[str]]:
    """The rarest words of every template's key phrases; templates with a key word that no document has can't occur."""
    found = {}
    for name, _, _, phrases in TEMPLATES:
        own = {w for p in phrases for w in p.split(" ")}
        if own <= set(idf):
            found[name] = sorted(own, key=lambda w: (-idf[w], w))[:LOOKED_UP]
    return found


def template_labels(rows: DataFrame, idf: dict[str, float]) -> DataFrame:
    """doc_id, same, chars and hits (label, support) of documents with a verified template."""
    spark = rows.sparkSession
    chosen = looked_up(idf)
    own = F.array_intersect(_strings(sorted({w for ws in chosen.values() for w in ws})), F.col("words"))
    # words of the templates whose looked-up words are all in the document
    sets = F.array(*[_strings(ws) for ws in sorted(set(map(tuple, chosen.values())))])
    whole = F.filter(sets, lambda ws: F.size(F.array_intersect("own", ws)) == F.size(ws))
    top = F.array_distinct(F.flatten(whole)) if chosen else _strings([])
    near = rows.withColumn("own", own).filter("size(own) > 0").withColumn("top", top).filter("size(top) > 0")
    # the words before and behind, as far as a template reaches; "lead" is the word's own place among them
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("top", x["word"]))
    lead = lambda x: F.least(x["at"], F.lit(LONGEST))
    placed = F.transform(placed, lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), lead(x).alias("lead"), F.slice("words", x["at"] - lead(x) + 1, lead(x) + LONGEST).alias("around")))
    postings = near.select("doc_id", "same", "chars", F.explode(placed).alias("x")).select("doc_id", "same", "chars", "x.*")
    # a constant table of the templates, a row for each place of a looked-up word: it may be broadcast
    index = []
    for t, label, notice, _ in TEMPLATES:
        parts = sorted((w, at, idf[w]) for at, w in enumerate(notice.split(" ")) if w in idf)
        reach = sum(sorted({w: x for w, _, x in parts}.values(), reverse=True)[:SUPPORTING])
        keys = sorted({(w, place + j) for n, phrase, place in _key_places() if n == t for j, w in enumerate(phrase.split(" "))}, key=lambda k: k[1])
        index += [(t, label, at, w, reach, len(chosen[t]), keys, parts) for w, at, _ in parts if w in chosen.get(t, ())]
    entry = "array<struct<word:string,at:int>>", "array<struct<word:string,at:int,idf:double>>"
    table = spark.createDataFrame(index, f"template string, label string, t_at int, word string, reach double, agreeing int, keys {entry[0]}, parts {entry[1]}")
    hits = postings.join(F.broadcast(table), "word").withColumn("begin", F.col("lead") - F.col("t_at")).filter(_verified())
    hits = hits.select("doc_id", "same", "chars", "template", "label", "reach", "agreeing", (F.col("at") - F.col("t_at")).alias("start"), "word", _weight().alias("weight"))
    by = ["doc_id", "same", "chars", "template", "label", "reach", "agreeing", "start"]
    words = hits.groupBy(*by, "word").agg(F.max("weight").alias("weight"))
    places = words.groupBy(*by).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n")).filter("n >= agreeing")
    # nothing tells where every document has every word
    support = F.when(F.col("reach") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("reach"))).otherwise(1.0)
    best = places.groupBy("doc_id", "same", "chars", "label").agg(F.max(support).alias("support"))
    return best.groupBy("doc_id", "same", "chars").agg(F.collect_list(F.struct("label", "support")).alias("hits"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    rows = with_words(docs)
    idf = idf_table(rows)
    every = _with_base(rows).select("doc_id", "same", "chars", F.size("words").cast("long").alias("n_words"), "places", "base")
    if idf:
        found = stage_table(template_labels(rows, idf), "license-hits")
        right = found.select(F.col("doc_id").alias("h_id"), F.col("same").alias("h_same"), F.col("chars").alias("h_chars"), "hits")
        same = every["doc_id"].eqNullSafe(right["h_id"]) & (every["same"] == right["h_same"]) & (every["chars"] == right["h_chars"])
        every = every.join(right, same, "left")
    else:
        every = every.withColumn("hits", F.expr("cast(null as array<struct<label:string,support:double>>)"))
    more = F.coalesce(F.transform("hits", lambda h: h["label"]), F.expr("cast(array() as array<string>)"))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["support"])), F.lit(0.0))
    return every.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
