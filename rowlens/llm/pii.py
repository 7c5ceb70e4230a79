"""Personal data in texts by weak supervision, with DataFrame functions only.

Base spans are what four fixed patterns and their checks find; they always stay.
Beyond them, wider patterns propose candidate spans, and labelers vote on each:

* regex labelers: the candidate passes its kind's strict form or checksum, or has
  the separators that people write;
* a gazetteer labeler: country calling codes, card issuer prefixes, common
  top-level domains, country codes of account numbers;
* context labelers: a cue word of the kind stands in the words before it, or a
  word that speaks against it (order, version, token, hash ...) does.

Each labeler says yes, no or nothing. The votes of all candidates are counted by
pattern, at most 3 ** labelers patterns a kind, and on that bounded table
expectation-maximisation estimates every labeler's reliability and each
pattern's probability. The final classifier is a logistic regression on votes and
the span's shape, trained on those probabilities, again on the counted table; it
is applied to every candidate as an expression. Counting covers all rows.

Positions are code points: the parts between matches (``split``) and the matches
(``regexp_extract_all``) of one pattern alternate, so their lengths add up to
each start. Patterns are possessive where that can't change a match, so that
long runs neither backtrack nor recurse. Work is near linear in a text's spans: what grows
is gathered in blocks, places are looked up in short pieces of the text, and candidates are
looked for in the text without its base spans, so none has to be compared with them.

Defined results: null text counts as empty and has no spans; a null id stays
null; repeated rows give equal rows; an empty table gives an empty result and
labelers keep their prior reliability. Columns other than id and text are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "ssn")

#: Fixed patterns of the base, as possessive Java patterns. A run before @ starts where the last match ended or a run begins: no other start can match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Cheap tests that hold wherever the pattern can match.
MAY = {"email": "@[A-Za-z0-9-]++\\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Wider patterns that propose candidates, by kind.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9+-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
MAY_WIDER = {
    "email": r"[\[(]\x20?at\x20?[\])]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}",
    "account": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
}
#: Cue words looked for in the CONTEXT characters before a candidate.
CONTEXT = 48
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp)\b",
    "account": r"(?i)\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|isbn|issn|version|token|hash|sha|uuid|build|serial|part|ticket|ref)\b"
#: Gazetteers, fixed values: common top-level domains, card issuer prefixes, area codes that exist nowhere, account country codes.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\(?(?![01])[0-9]{3}",
    "account": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
LABELERS = ("strict", "written", "gazetteer", "cue", "against")
#: Prior belief: share of candidates that are personal data, and how often a labeler's yes or no is right.
PRIOR, RIGHT = 0.3, 0.8
#: Pseudo-counts that keep the priors' weight.
WEIGHT = 10.0
CUT = 0.5


#: Elements that are gathered one by one before they are set aside as a block.
BLOCK = 256
#: Code points of a piece of text.
PIECE = 1024
#: Stands for what is taken out of a text; in no pattern.
GONE = "\u0001"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _walk(items: Column, none: Column, at: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], end: Callable[[Column], Column] | None = None) -> Column:
    """What ``emit`` (an array) gives for every item, ``at`` being carried from item to item, and ``end`` of the last.

    Growing one array costs its length with each item, so items are gathered in blocks.
    """

    def one(acc: Column, x: Column) -> Column:
        return F.struct(at(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], emit(acc["at"], x)).alias("out"))

    def whole(every: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), none.alias("out"))
            return F.aggregate(F.slice(every, k * BLOCK + 1, BLOCK), start, one, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / BLOCK).cast("int") - 1, F.lit(0)))
        begin = F.struct(F.lit(0).alias("at"), F.array_remove(F.array(none), none).alias("out"))
        last = (lambda acc: F.concat(F.flatten(acc["out"]), end(acc["at"]))) if end else (lambda acc: F.flatten(acc["out"]))
        return F.aggregate(blocks, begin, block, last)

    return _with(items, whole)


def _spans(text: Column, may: str, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, match>> of all matches, leftmost and not overlapping."""
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,match:string>>)")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = _with(matches, lambda m: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("g"), m.alias("m")))

    def span(at: Column, z: Column) -> Column:
        start = at + F.char_length(z["g"])
        return F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(z["m"])).alias("end"), z["m"].alias("match")))

    return F.when(text.rlike(may), _walk(both, none, lambda at, z: at + F.char_length(z["g"]) + F.char_length(z["m"]), span)).otherwise(none)


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points: Spark finds a place in a text by reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from start to end (exclusive)."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head, tail = F.get(pieces, first), F.get(pieces, last)
    same = F.substring(head, start - first * PIECE + 1, end - start)
    over = F.concat(F.substring(head, start - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), end - last * PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, same).otherwise(over)


def _rewritten(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with every span replaced by ``by`` (its kind, its length); of overlapping spans the one that starts first, then the longest, is written."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    none = F.expr("cast(array() as array<string>)")

    def walked(pieces: Column) -> Column:
        def emit(at: Column, s: Column) -> Column:
            # of what overlaps the span before, only the rest counts
            begin = F.greatest(at, s["start"])
            left = F.greatest(-s["back"] - begin, F.lit(0))
            return F.when(s["start"] < at, F.array(F.repeat(F.lit(GONE), left) if by is _gone else F.lit(""))).otherwise(F.array(_cut(pieces, at, s["start"]), by(s["kind"], left)))

        return F.array_join(_walk(order, none, lambda at, s: F.greatest(at, -s["back"]), emit, lambda at: F.array(_cut(pieces, at, F.char_length(text)))), "")

    return F.when(F.size(spans) == 0, text).otherwise(_with(_pieces(text), walked))


def _gone(kind: Column, length: Column) -> Column:
    return F.repeat(F.lit(GONE), length)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    """The base's checks of a match."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.char_length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns that pass their checks, by kind as listed, then start."""
    def of(kind: str) -> Column:
        return F.filter(_spans(text, MAY[kind], BASE[kind], kind), lambda s: _valid(kind, s["match"]))

    return F.concat(*map(of, KINDS))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, F.lit("y")).when(F.lit(True) if no is None else no, F.lit("n" if no is not None else "-")).otherwise(F.lit("-"))


def _votes(kind: str, match: Column, before: Column) -> Column:
    """One letter per labeler: yes, no or nothing."""
    digits = _digits(match)
    strict = {
        "email": _vote(match.rlike(r"^[A-Za-z][A-Za-z0-9._%+-]*\x20?[\[(]")),
        "card": _vote(F.call_function("luhn_check", digits), F.lit(True)),
        "phone": _vote(match.rlike(r"^\([0-9]{3}\)")),
        "account": _vote(F.char_length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), F.lit(True)),
        "ssn": _vote(F.lit(True)),
    }[kind]
    written = {
        "email": _vote(match.contains("dot")),
        "card": _vote(match.rlike(r"^[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-]"), ~match.rlike(r"[\x20-]")),
        "phone": _vote(match.rlike(r"[\x20-][0-9]{4}$")),
        "account": _vote(match.contains(" ")),
        "ssn": _vote(F.lit(False)),
    }[kind]
    return F.concat(
        strict,
        written,
        _vote(match.rlike(GAZETTEER[kind]), F.lit(True)),
        _vote(before.rlike(CUES[kind])),
        F.when(before.rlike(AGAINST), "n").otherwise("-"),
    )


def candidate_spans(free: Column) -> Column:
    """Candidates in a text whose base spans are taken out: kind, start, end, votes and shape (length class)."""

    def of(kind: str) -> Column:
        def all_of(pieces: Column) -> Column:
            return F.transform(
                _spans(free, MAY_WIDER[kind], WIDER[kind], kind),
                lambda s: F.struct(
                    s["kind"].alias("kind"),
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    _votes(kind, s["match"], _cut(pieces, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])).alias("votes"),
                    F.least(F.floor(F.char_length(s["match"]) / 8), F.lit(7)).cast("int").alias("shape"),
                ),
            )

        none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,votes:string,shape:int>>)")
        return F.when(free.rlike(MAY_WIDER[kind]), _with(_pieces(free), all_of)).otherwise(none)

    return F.concat(*map(of, WIDER))


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds to rows with ``text`` its base spans and candidates, which overlap none of them."""
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("free", _rewritten(F.col("text"), F.col("base"), _gone))
    return rows.withColumn("candidates", candidate_spans(F.col("free"))).drop("free")


@dataclass(frozen=True)
class Model:
    """Logistic weights of a candidate's votes, kind and shape."""

    bias: dict[str, float]
    votes: dict[tuple[str, str], float]
    shape: dict[int, float]
    reliability: dict[tuple[str, str], float]

    def score(self, kind: str, votes: str, shape: int) -> float:
        z = self.bias.get(kind, 0.0) + self.shape.get(shape, 0.0) + sum(self.votes.get((n, v), 0.0) for n, v in zip(LABELERS, votes))
        return 1 / (1 + math.exp(-z))


def train(counted: list[tuple[str, str, int, int]], rounds: int = 30, steps: int = 200) -> Model:
    """From (kind, votes, shape, count) rows: reliabilities by expectation-maximisation, then the classifier on the resulting probabilities."""
    kinds = sorted({k for k, *_ in counted})
    share = {k: PRIOR for k in kinds}
    right = {(k, n): RIGHT for k in kinds for n in LABELERS}

    def probability(kind: str, votes: str) -> float:
        yes, no = share[kind], 1 - share[kind]
        for n, v in zip(LABELERS, votes):
            if v != "-":
                r = right[kind, n]
                yes, no = yes * (r if v == "y" else 1 - r), no * (1 - r if v == "y" else r)
        return yes / (yes + no)

    for _ in range(rounds):
        seen = {k: [WEIGHT * PRIOR, WEIGHT] for k in kinds}
        agree = {key: [WEIGHT * RIGHT, WEIGHT] for key in right}
        for kind, votes, _, count in counted:
            p = probability(kind, votes)
            seen[kind][0] += p * count
            seen[kind][1] += count
            for n, v in zip(LABELERS, votes):
                if v != "-":
                    agree[kind, n][0] += count * (p if v == "y" else 1 - p)
                    agree[kind, n][1] += count
        share = {k: min(max(a / b, 0.01), 0.99) for k, (a, b) in seen.items()}
        # a labeler is at worst uninformative: below one half the two classes would trade names
        right = {key: min(max(a / b, 0.5), 0.99) for key, (a, b) in agree.items()}

    bias, votes_w, shape_w = {k: 0.0 for k in kinds}, {(n, v): 0.0 for n in LABELERS for v in "yn"}, {s: 0.0 for s in range(8)}
    total = sum(c for *_, c in counted) or 1
    for _ in range(steps):
        model = Model(bias, votes_w, shape_w, right)
        g_bias, g_votes, g_shape = dict.fromkeys(bias, 0.0), dict.fromkeys(votes_w, 0.0), dict.fromkeys(shape_w, 0.0)
        for kind, votes, shape, count in counted:
            gap = (probability(kind, votes) - model.score(kind, votes, shape)) * count / total
            g_bias[kind] += gap
            g_shape[shape] += gap
            for n, v in zip(LABELERS, votes):
                if v != "-":
                    g_votes[n, v] += gap
        bias = {k: w + 2 * g_bias[k] for k, w in bias.items()}
        votes_w = {k: w + 2 * g_votes[k] for k, w in votes_w.items()}
        shape_w = {k: w + 2 * (g_shape[k] - 0.001 * w) for k, w in shape_w.items()}
    return Model(bias, votes_w, shape_w, right)


def fit(found: DataFrame) -> tuple[Model, list[tuple[str, str, int]]]:
    """Model, and the (kind, votes, shape) patterns it accepts; both from counts over all rows."""
    # outer: else a filter on the array's size is pushed below, and with it the base spans into the candidates' lambda
    counted = (
        found.select(F.explode_outer("candidates").alias("c"))
        .filter("c is not null")
        .groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.shape").alias("shape"))
        .count()
    )
    # at most kinds * 3 ** labelers * 8 rows
    rows = sorted((r["kind"], r["votes"], r["shape"], r["count"]) for r in counted.collect())
    model = train(rows)
    return model, [(k, v, s) for k, v, s, _ in rows if model.score(k, v, s) >= CUT]


def _plain(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _rank(s: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS + MORE_KINDS)), s["kind"])


def accepted_spans(found: DataFrame, accepted: list[tuple[str, str, int]]) -> DataFrame:
    """Adds ``spans``: base spans and the accepted candidates, by kind as listed, then start; of overlapping additions the one that starts first, then the first kind's, stays."""
    if not accepted:
        return found.withColumn("spans", F.transform("base", _plain))
    names = F.array(*[F.lit(f"{k}:{v}:{s}") for k, v, s in accepted])
    found = found.withColumn("taken", F.filter("candidates", lambda c: F.array_contains(names, F.concat_ws(":", c["kind"], c["votes"], c["shape"].cast("string")))))
    # spans of one kind never overlap
    several = F.size(F.array_distinct(F.transform("taken", lambda c: c["kind"]))) > 1
    keyed = lambda spans: F.transform(spans, lambda s: F.struct(_rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    by_start = F.array_sort(F.transform("taken", lambda s: F.struct(s["start"].alias("start"), _rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    clear = _walk(by_start, none, lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at, F.array(_plain(s))).otherwise(none))
    more = F.when(several, clear).otherwise(F.transform("taken", _plain))
    spans = F.when(F.size("taken") == 0, F.transform("base", _plain)).otherwise(F.transform(F.array_sort(keyed(F.concat(F.transform("base", _plain), more))), _plain))
    return found.withColumn("spans", spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, start, end) of every document."""
    found = with_spans(docs.select(F.col("doc_id"), text_or_empty("text").alias("text")))
    _, accepted = fit(found)
    return accepted_spans(found, accepted).select("doc_id", "text", "base", "spans")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    found = find_spans(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest, is written."""
    return _rewritten(text, spans, lambda kind, _: F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are but for ``text``, where every span gives way to its kind, and ``n_chars``; null texts stay null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty("text").alias("text"))
    found = with_spans(rows)
    _, accepted = fit(found)
    done = accepted_spans(found, accepted).withColumn("clean", F.when(F.col("row.text").isNotNull(), redacted(F.col("text"), F.col("spans"))))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.char_length("clean").cast("long"))}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
