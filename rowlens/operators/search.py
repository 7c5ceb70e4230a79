"""Full-text filtering over titles, employers, tags and descriptions.

Conditions are values, not a query language: words that must all, may or must not
occur, phrases, prefixes, and the columns to look in. Text is folded and cut into
runs of letters and digits first, so no input can be malformed. It is a filter; nothing is ranked.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.text import fold

COLUMNS = ("title", "company_name", "tech", "description")


@dataclass(frozen=True)
class Match:
    every: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    columns: tuple[str, ...] = COLUMNS


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def folded_text(text: str) -> str:
    """A condition's text as ``fold`` makes the searched ones."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _folded(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", folded_text(text)) if w]


def _starts(start: str):
    return lambda line: line.contains(start)


def matching(texts: DataFrame, match: Match) -> DataFrame:
    """posting_id of the rows whose columns together satisfy the conditions; a condition without any letter or digit admits nothing."""
    words = [*match.every, *match.any, *match.phrases, *match.prefixes]
    if not words or any(not _folded(w) for w in (*match.every, *match.phrases, *match.prefixes)):
        return texts.filter(F.lit(False)).select("posting_id")
    # a column's words never run into the next column's
    joined = F.concat_ws(" \u0001 ", *[F.coalesce(F.col(c), F.lit("")) for c in match.columns])
    rows = texts.select("posting_id", fold(joined).alias("folded"))
    rows = rows.select("posting_id", tokens(F.col("folded")).alias("words"), F.transform(F.split("folded", "\u0001"), lambda p: F.concat(F.lit(" "), F.array_join(tokens(p), " "), F.lit(" "))).alias("lines"))

    def phrase(p: str) -> Column:
        text = " " + " ".join(_folded(p)) + " "
        return F.exists("lines", lambda x: x.contains(text))

    for w in match.every:
        rows = rows.filter(phrase(w))
    if match.any:
        rows = rows.filter(F.exists(F.array(*[phrase(w) for w in match.any if _folded(w)]), lambda x: x))
    for w in match.none:
        rows = rows.filter(~phrase(w)) if _folded(w) else rows
    for p in match.phrases:
        rows = rows.filter(phrase(p))
    for p in match.prefixes:
        start = " " + " ".join(_folded(p))
        rows = rows.filter(F.exists("lines", _starts(start)))
    return rows.select("posting_id")


def token_table(texts: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """posting_id, column and word of every folded text, once each; ``text_index`` keeps such rows on disk with positions."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in columns])
    rows = texts.select("posting_id", F.explode(parts).alias("p")).select("posting_id", "p.column", fold(F.col("p.text")).alias("folded"))
    return rows.select("posting_id", "column", F.explode(F.array_distinct(tokens(F.col("folded")))).alias("word"))
