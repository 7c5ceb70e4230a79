"""Review of postings by a reader's replies: what of a reply is applied, field by field.

A reply is a row (posting_id, confidence and per-field claims with quotes); no
model is called here. Quotes must stand in the posting, figures in their quotes;
a gap is filled from the least confidence on, a value replaced only from the
override confidence on, and nothing is ever erased.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.config import Profile, build_taxonomy
from rowlens.functions.dates import date_in_text
from rowlens.functions.money import amounts_in, detect_period, is_weekly, same_pay
from rowlens.functions.text import java_literal, squash
from rowlens.operators.normalize import INTERNS

#: One or two words and a colon that a reader may put before what it copies.
LABEL = r"^\s*\p{L}+(?: \p{L}+)?\s*:\s*"


def _any(*words: str) -> str:
    """Pattern of any of the beginnings of words, case aside."""
    return r"(?i)(?<![a-z])(?:" + "|".join(words) + ")"


#: What a quote must say for a claim to rest on it, by claim: what is named, and what softens, demands or denies it.
SAYS = {
    "doctorate": _any(r"ph\W?d", "doctor"),
    "alternative": _any("prefer", "plus\\b", "advantage", "nice", "or\\b", "equivalent", "optional"),
    "condition": _any("requir", "must", "need", "mandat", "only\\b", "hold"),
    "no": _any("not\\b", "no\\b", "without", "unable", "never", "cannot", r"\w+n't", "right to work", "nationals", "citizen"),
    "sponsors": _any("sponsor", "visa", "permit", "relocat"),
}
_RULES = build_taxonomy()
#: Words that name a level: those that the titles are read by.
LEVELS = {level: _any(*(java_literal(w.strip()) for w in words)) for level, words in {"intern": INTERNS, "graduate": _RULES.programme, "mid": ("mid-level", "mid level", "intermediate"), **_RULES.level_words}.items()}


def haystack() -> Column:
    return squash(F.concat_ws(" ", "title_raw", "location_raw", "description"))


def quoted(quote: Column, least: int) -> Column:
    """Whether a quote is long enough and stands in the posting, case and punctuation aside; a label of ours in front is not held against it."""
    inside = F.col("__hay").contains(squash(F.regexp_replace(quote, LABEL, "")))
    return F.coalesce((F.char_length(squash(quote)) >= least) & inside, F.lit(False))


def _checked(*rules: tuple[Column, str]) -> Column:
    """The first rule that refuses, else null."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), why) for test, why in rules])


#: Reasons of refusal, as codes.
LOW = "confidence_below_override"


def compensation_plan(p: Profile) -> tuple[Column, Column]:
    """(changes, refusal) of the pay claim."""
    low, high, quote = F.col("r.amount_min").try_cast("decimal(18,4)"), F.col("r.amount_max").try_cast("decimal(18,4)"), F.col("r.pay_quote")
    code, period = F.upper("r.currency"), F.col("r.period")
    figures = amounts_in(quote)
    named = quote.contains(code)
    for symbol, codes in p.review["currency_symbols"].items():
        named = named | (quote.contains(symbol) & code.isin(*codes))
    bounds = reduce(lambda acc, kv: acc | ((period == kv[0]) & ~(F.coalesce(low, high).between(*kv[1]) & F.coalesce(high, low).between(*kv[1]))), p.review["salary_bounds"].items(), F.lit(False))
    claimed = F.col("r.amount_min").isNotNull() | F.col("r.amount_max").isNotNull()
    has = F.col("compensation.amount_min").isNotNull() | F.col("compensation.amount_max").isNotNull()
    same = same_pay((low, high, code, period), (F.col("compensation.amount_min"), F.col("compensation.amount_max"), F.col("compensation.currency"), F.col("compensation.period")))

    def missing(x: Column) -> Column:
        return x.isNotNull() & ~F.array_contains(figures, x)

    refusal = _checked(
        (~quoted(quote, p.review["evidence_min_chars"]), "quote_not_found"),
        ((F.col("r.amount_min").isNotNull() & low.isNull()) | (F.col("r.amount_max").isNotNull() & high.isNull()), "amount_unreadable"),
        (missing(low) | missing(high), "amount_not_quoted"),
        (low > high, "range_reversed"),
        (code.isNull() | ~code.isin(*p.review["currencies"]), "currency_unknown"),
        (~named, "currency_not_quoted"),
        (period.isNull(), "period_missing"),
        (is_weekly(quote), "period_is_week"),
        (detect_period(quote) != period, "period_differs"),
        (bounds, "amount_out_of_bounds"),
        (~same & has & (F.col("r.confidence") < p.review["override_confidence"]), LOW),
    )
    return claimed & ~same, F.when(claimed, refusal)


def _value_plan(p: Profile, claim: Column, current: Column, unset: Column, quote: Column, cue: Column, why: str) -> tuple[Column, Column]:
    changes = claim.isNotNull() & ~claim.eqNullSafe(current)
    refusal = _checked(
        (~quoted(quote, p.review["evidence_min_chars"]), "quote_not_found"),
        (~cue, why),
        (~unset & (F.col("r.confidence") < p.review["override_confidence"]), LOW),
    )
    return changes, F.when(changes, refusal)


def plan(postings: DataFrame, replies: DataFrame, p: Profile) -> DataFrame:
    """posting_id, outcome, confidence, corrections (field, before, after, evidence) and refused (field: why).

    postings: posting_id, title_raw, location_raw, description, compensation,
    seniority, min_years, visa_sponsorship, phd_required, closes_at, first_seen_at;
    replies: posting_id, confidence, amount_min, amount_max, currency, period,
    pay_quote, seniority, min_years, level_quote, visa, visa_quote, phd, phd_quote,
    closes_on, closes_quote.
    """
    claims = replies.select("posting_id", F.struct(*[c for c in replies.columns if c != "posting_id"]).alias("r"))
    rows = postings.join(claims, "posting_id").withColumn("__hay", haystack())
    level, years, visa = F.nullif(F.col("r.seniority"), F.lit("unknown")), F.col("r.min_years"), F.nullif(F.col("r.visa"), F.lit("unknown"))
    level_cue = reduce(lambda acc, kv: acc | ((level == kv[0]) & F.col("r.level_quote").rlike(kv[1])), LEVELS.items(), F.lit(False))
    visa_cue = F.when(visa == "no", F.col("r.visa_quote").rlike(SAYS["no"])).otherwise(F.col("r.visa_quote").rlike(SAYS["sponsors"]))
    deadline = F.col("r.closes_on").try_cast("date")
    phd = F.col("r.phd_quote")
    least, sure = p.review["evidence_min_chars"], F.col("r.confidence") >= p.review["override_confidence"]
    wants_phd = F.coalesce(F.col("r.phd"), F.lit(False)) & ~F.col("phd_required")
    closes = F.col("r.closes_on").isNotNull() & F.col("closes_at").isNull()
    plans: dict[str, tuple[Column, Column, Column, Column, Column]] = {}
    changes, refusal = compensation_plan(p)
    pay = F.to_json(F.struct("r.amount_min", "r.amount_max", F.upper("r.currency").alias("currency"), "r.period"))
    plans["compensation"] = (changes, refusal, F.to_json("compensation"), pay, F.col("r.pay_quote"))
    found = _value_plan(p, level, F.col("seniority"), F.col("seniority") == "unknown", F.col("r.level_quote"), level_cue, "level_not_quoted")
    plans["seniority"] = (*found, F.col("seniority"), level, F.col("r.level_quote"))
    found = _value_plan(p, years, F.col("min_years"), F.col("min_years").isNull(), F.col("r.level_quote"), F.array_contains(amounts_in(F.col("r.level_quote")), years.cast("decimal(18,4)")), "years_not_quoted")
    plans["min_years"] = (*found, F.col("min_years").cast("string"), years.cast("string"), F.col("r.level_quote"))
    found = _value_plan(p, visa, F.col("visa_sponsorship"), F.col("visa_sponsorship") == "unknown", F.col("r.visa_quote"), visa_cue, "visa_not_quoted")
    plans["visa_sponsorship"] = (*found, F.col("visa_sponsorship"), visa, F.col("r.visa_quote"))
    refusal = _checked(
        (~quoted(phd, least) | ~phd.rlike(SAYS["doctorate"]), "doctorate_not_quoted"), (phd.rlike(SAYS["alternative"]), "doctorate_optional"),
        (~phd.rlike(SAYS["condition"]), "condition_not_quoted"), (~sure, LOW),
    )
    plans["phd_required"] = (wants_phd, F.when(wants_phd, refusal), F.lit("false"), F.lit("true"), phd)
    refusal = _checked(
        (~quoted(F.col("r.closes_quote"), least), "quote_not_found"), (deadline.isNull(), "date_unreadable"),
        (deadline < F.to_date("first_seen_at"), "date_before_first_seen"), (~date_in_text(deadline, F.col("r.closes_quote")), "date_not_quoted"),
    )
    plans["closes_at"] = (closes, F.when(closes, refusal), F.lit(None).cast("string"), deadline.cast("string"), F.col("r.closes_quote"))
    heard = F.coalesce(F.col("r.confidence") >= p.llm["min_confidence"], F.lit(False))
    fixes, refused = [], []
    for name, (change, why, before, after, evidence) in plans.items():
        taken = heard & F.coalesce(change, F.lit(False)) & why.isNull()
        fixes.append(F.when(taken, F.struct(F.lit(name).alias("field"), before.alias("before"), after.alias("after"), evidence.alias("evidence"))))
        refused.append(F.when(heard & why.isNotNull(), F.concat(F.lit(f"{name}: "), why)))
    rows = rows.select("posting_id", F.col("r.confidence").alias("confidence"), heard.alias("heard"), F.array_compact(F.array(*fixes)).alias("corrections"), F.array_compact(F.array(*refused)).alias("refused"))
    outcome = F.when(~F.col("heard"), "set_aside").when(F.size("corrections") > 0, "corrected").otherwise("confirmed")
    return rows.select("posting_id", outcome.alias("outcome"), "confidence", "corrections", "refused")


def unreviewed(postings: DataFrame, reviews: DataFrame, track_scores: DataFrame, version: int) -> DataFrame:
    """Live postings without a review of their present content and this version, best score of any feed first."""
    best = track_scores.groupBy("posting_id").agg(F.max("score").alias("__best"))
    current = reviews.filter(F.col("review_version") == version).select("posting_id", "content_hash")
    rows = postings.filter("is_active and is_canonical").join(current, ["posting_id", "content_hash"], "left_anti").join(best, "posting_id", "left")
    return rows.withColumn("best", F.greatest("score", F.coalesce("__best", F.lit(-1)))).drop("__best").orderBy(F.desc("best"), "posting_id")


def current_corrections(corrections: DataFrame, postings: DataFrame) -> DataFrame:
    """Corrections made for the content that the posting still has; their fields are protected from the rules."""
    return corrections.join(postings.select("posting_id", "content_hash"), ["posting_id", "content_hash"])


def originals(corrections: DataFrame) -> DataFrame:
    """posting_id, field and the value before the first correction: what a revert restores."""
    first = Window.partitionBy("posting_id", "field").orderBy("correction_id")
    return corrections.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("posting_id", "field", "before")


def revert(corrections: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(values to restore, corrections that stay)."""
    return originals(corrections).filter(F.col("field").isin(*fields)), corrections.filter(~F.col("field").isin(*fields))


def apply_replies(postings: DataFrame, replies: DataFrame, p: Profile) -> DataFrame:
    """The residual lane: replies sure enough replace role, level, years, visa and PhD; the others are left for a person."""
    fields = ("role_family", "seniority", "min_years", "visa_sponsorship", "phd_required")
    told = replies.filter(F.col("confidence") >= p.llm["min_confidence"]).select("posting_id", *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__told"))
    rows = postings.join(told, "posting_id", "left")
    new = {f: F.when(F.col("__told"), F.coalesce(f"__{f}", f)).otherwise(F.col(f)) for f in fields}
    new["resolver_stage"] = F.when(F.col("__told"), "llm").otherwise(F.col("resolver_stage"))
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in postings.columns])


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """posting_id, urgent, queued_at, attempts: a queued posting keeps its place, urgency only rises."""
    both = queue.select("posting_id", "urgent", "queued_at", "attempts").unionByName(new.select("posting_id", "urgent", "queued_at", F.lit(0).cast("int").alias("attempts")))
    return both.groupBy("posting_id").agg(F.max("urgent").alias("urgent"), F.min("queued_at").alias("queued_at"), F.max("attempts").alias("attempts"))


def next_in_queue(queue: DataFrame, n: int) -> DataFrame:
    return queue.orderBy(F.desc("urgent"), "queued_at", "posting_id").limit(n)


def after_turn(queue: DataFrame, done: DataFrame, skipped: DataFrame) -> DataFrame:
    """Queue without the done ones; skipped ones have one more attempt."""
    rows = queue.join(done.select("posting_id"), "posting_id", "left_anti").join(skipped.select("posting_id", F.lit(1).alias("__s")), "posting_id", "left")
    return rows.select("posting_id", "urgent", "queued_at", (F.col("attempts") + F.coalesce("__s", F.lit(0))).alias("attempts"))


__all__ = ["plan", "quoted", "unreviewed", "current_corrections", "originals", "revert", "apply_replies", "enqueue", "next_in_queue", "after_turn", "java_literal"]
