r"""Text expressions: hashes, titles, names, tokens, labels.

Patterns that must see accented letters as letters carry ``(?U)``: Java's ``\b``
and ``\w`` are ASCII without it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "\x1f"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: the optimizer does not copy what a lambda is given."""
    return F.get(F.transform(F.array(value), use), 0)


def blank_to_null(c: Column) -> Column:
    """Empty text is missing."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*map(blank_to_null, columns))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


# --- hashes ------------------------------------------------------------------


def content_hash(title: Column, description: Column, location: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, description, location)]
    return F.sha2(F.concat_ws(SEP, *parts), 256)


#: Words of a title that say when or under which number a job is listed, not which job it is.
LISTING_WORDS = ("start", "starting", "intake", "cohort", "req", "ref", "job", "f", "h", "m", "w", "d", "x")


def fingerprint_title(title: Column) -> Column:
    """The words of a title that name the job: what stands in brackets, years, numbers of three digits and more, and words of the listing are left out."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(title), r"\([^)]*\)|\[[^\]]*\]", " "), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~_in(w, LISTING_WORDS) & ~w.rlike(r"^\d{3,}$")), " ")


WINDOW_DAYS = 14


def fingerprint(slug: Column, title: Column, country: Column, posted_at: Column) -> Column:
    """Key of one job across sources; an undated posting has no time part, so it never meets a dated one."""
    bucket = F.floor(F.unix_timestamp(posted_at) / (WINDOW_DAYS * 86_400)).cast("string")
    return F.sha2(F.concat_ws(SEP, F.lower(slug), fingerprint_title(title), F.upper(F.coalesce(country, F.lit("??"))), bucket), 256)


def posting_id(source: Column, slug: Column, job_id: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEP, source, slug, job_id), 256), 1, 26)


# --- titles ------------------------------------------------------------------


#: Parts of a display title that are dropped wherever they stand: marks of gender, numbers of the listing, years of a cohort; and a work mode behind the last stroke.
TITLE_PARTS = (
    r"[(\[](?:\s*\p{L}\s*[/|])+\s*\p{L}\s*[)\]]",
    r"(?i)\b[a-z]{2,4}[-_#]+\d{3,}\b",
    r"(?i)[(\[]?\b(?:(?:class of|start(?:ing)?|intake|cohort)\s+)?20\d\d(?:\s+(?:start|intake|cohort))?\b[)\]]?",
    r"(?i)\s[-–—|]\s*(?:remote|hybrid|on-?site)\b[^-–—|]*$",
)


def clean_title(title: Column) -> Column:
    """Title for display; as written if nothing would be left."""
    c = title
    for part in TITLE_PARTS:
        c = F.regexp_replace(c, part, " ")
    parts = F.filter(F.transform(F.split(c, r"\s*,\s*"), squeeze), lambda x: x.rlike(r"(?U)\w"))
    # what a dropped part leaves at an end
    c = F.trim(F.regexp_replace(F.array_join(parts, ", "), r"^[-–—|\s]+|[-–—|\s]+$", ""))
    return F.coalesce(blank_to_null(c), F.trim(title))


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(c), F.lit(" "))


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | c.contains(n)
    return found


def word_keyword(c: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a keyword stands in the text with no ASCII letter or digit right before or after it."""
    if not keywords:
        return F.lit(False)
    return F.lower(c).rlike("(?<![a-z0-9])(?:" + "|".join(map(java_literal, keywords)) + ")(?![a-z0-9])")


def java_literal(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


#: Beginnings of words that titles of technical, research and trading jobs have, in four languages, and whole words too short for that.
RELEVANT_STEMS = ("engineer", "develop", "entwickl", "program", "quant", "research", "forsch", "cherch", "scien", "wissenschaft", "data", "algorithm", "model", "analy", "trad", "intern", "graduat", "ing[eé]nieur", "d[eé]velop", "stagi", "appren", "werkstud")
RELEVANT_WORDS = ("ai", "ml", "it", "strat", "gpu", "c\\+\\+")


def looks_relevant(title: Column) -> Column:
    """Title prefilter, wide on purpose: a word with a relevant beginning, a short relevant word, or the acronym VIE as written."""
    return title.rlike(rf"(?iU)(?<!\w)(?:(?:{'|'.join(RELEVANT_STEMS)})\w*|(?:{'|'.join(RELEVANT_WORDS)})(?!\w))") | title.rlike(r"(?U)\bVIE\b")


# --- names -------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Lower case without accents (NFKD, combining marks dropped); ASCII has none."""
    plain = lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return text.map(lambda t: None if t is None else plain(t).lower())


def ascii_fold(c: Column) -> Column:
    """Accents dropped, then everything beyond ASCII, in lower case."""
    return F.regexp_replace(fold(c), r"[^\x00-\x7F]", "")


#: Legal forms, words that many employers' names have, and words of those who hire for others.
LEGAL = ("ltd", "limited", "llc", "llp", "lp", "inc", "plc", "gmbh", "ag", "kg", "sa", "sas", "sarl", "spa", "srl", "bv", "nv", "oy", "ab", "corp", "co", "pte", "pty")
GENERIC = ("and", "assets", "capital", "consulting", "digital", "global", "group", "international", "invest", "networks", "software", "solutions", "tech", "the", "ventures", "worldwide")
HIRING = ("recruitment", "recruiting", "staffing", "talent", "agency")


def _in(word: Column, words: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), word)


def normal_name(name: Column) -> Column:
    """Employer name without accents, dots, punctuation and legal forms."""
    c = F.regexp_replace(F.replace(ascii_fold(name), F.lit("."), F.lit("")), "[^a-z0-9]+", " ")
    return F.array_join(F.filter(F.split(c, " "), lambda w: (w != "") & ~_in(w, LEGAL)), " ")


def employer_slug(name: Column) -> Column:
    return F.coalesce(blank_to_null(F.replace(normal_name(name), F.lit(" "), F.lit("_"))), F.lit("unknown"))


def company_key(folded: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Comparison key of a folded employer name; ``aliases`` maps a key to its canonical one.

    The name's own words run together; a generic word written without a blank behind
    three letters or more is no own word. A name of such words only keeps them.
    """
    words = F.regexp_extract_all(F.regexp_replace(folded, r"\([^)]*\)", " "), F.lit("[a-z0-9+]+"), F.lit(0))
    own = F.array_join(F.filter(words, lambda w: ~_in(w, LEGAL) & ~_in(w, GENERIC)), "")
    glued = "|".join(sorted((w for w in GENERIC if len(w) > 3), key=len, reverse=True))
    key = F.regexp_replace(F.coalesce(blank_to_null(own), F.array_join(words, "")), rf"(?<=^[a-z0-9+]{{3,40}}?)(?:{glued})$", "")
    if not aliases:
        return key
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def alias_map(variants: Mapping[str, list[str]]) -> dict[str, str]:
    """canonical -> variants as key -> canonical."""
    return {key: canonical for canonical, names in variants.items() for key in (canonical, *names)}


#: Beginnings of title words with the token that stands for all of them; abbreviations of two words by their initials.
TITLE_STEMS = (("quant", "quant"), ("develop", "dev"), ("engineer", "eng"), ("research", "research"), ("softw", "sw"), ("graduat", "grad"), ("cpp", "c++"))
FIELDS, TRADES = {"q": "quant", "s": "sw", "sw": "sw", "ml": "ml"}, {"d": "dev", "e": "eng", "r": "research"}
SHORT_TITLES = {f + t: f"{field} {trade}" for f, field in FIELDS.items() for t, trade in TRADES.items()}
#: Words without meaning in a title: numbers, numerals, single letters, joining words.
EMPTY_WORD = "^(?:[0-9]+|[ivx]+|[a-z]|the|of|and|for|in|new)$"


def title_tokens(folded: Column, places: tuple[str, ...] = ()) -> Column:
    """Set of canonical tokens of a folded job title; ``places`` are words to leave out."""

    def canonical(w: Column) -> Column:
        found = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHORT_TITLES.items() for x in pair]), w)
        for stem, token in TITLE_STEMS:
            found = F.coalesce(found, F.when(w.startswith(stem), token))
        return F.split(F.coalesce(found, w), " ")

    words = F.filter(F.regexp_extract_all(folded, F.lit(r"[a-z0-9]+\+*"), F.lit(0)), lambda w: ~w.rlike(EMPTY_WORD) & ~_in(w, places or ("",)))
    return F.array_distinct(F.flatten(F.transform(words, canonical)))


def name_leftover(longer: Column, shorter: Column) -> Column:
    """Words of one folded employer name that the other lacks, but for those that many names have."""
    own = F.array_except(F.regexp_extract_all(longer, F.lit("[a-z0-9+]+"), F.lit(0)), F.regexp_extract_all(shorter, F.lit("[a-z0-9+]+"), F.lit(0)))
    return F.array_join(F.filter(own, lambda w: ~_in(w, LEGAL + GENERIC + HIRING)), " ")


def short_slug(text: Column, limit: int = 40) -> Column:
    """ASCII words joined by dashes, at most ``limit`` characters, ``x`` if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(ascii_fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(F.regexp_replace(F.left(c, F.lit(limit)), "-+$", "")), F.lit("x"))


def squash(text: Column) -> Column:
    """Lower case, punctuation and white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "))


def place_in_path(path: Column) -> Column:
    """Place named by the third part of a job path."""
    parts = F.split(path, "/")
    place = F.trim(F.replace(F.get(parts, 2), F.lit("-"), F.lit(" ")))
    return F.when((F.size(parts) >= 4) & (F.get(parts, 1) == "job"), blank_to_null(place))


def has_prefix(text: Column, prefix: str) -> Column:
    """Prefix test in which no character of the prefix is a wildcard."""
    return text.startswith(prefix)


# --- labels ------------------------------------------------------------------


def location_label(city: Column, country: Column, mode: Column) -> Column:
    place = F.concat_ws(", ", city, country)
    label = F.when(mode.isin("remote", "hybrid"), F.trim(F.concat(place, F.lit(" ("), mode, F.lit(")")))).otherwise(place)
    return blank_to_null(label)


def pay_label(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """One figure or a range with currency and period, never converted."""
    def figure(c: Column) -> Column:
        return F.format_number(c.cast("decimal(18,0)"), 0)

    one = F.coalesce(low, high)
    figures = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat_ws(" – ", figure(low), figure(high))).otherwise(figure(one))
    return F.when(one.isNotNull(), F.concat_ws(" ", currency, figures, F.concat(F.lit("per "), period)))


# --- markup ------------------------------------------------------------------

#: A tag with its name, or a run of text.
_PIECE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<!--.*?-->|[^<]+|<", re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z]+|#\d+|#[xX][0-9a-fA-F]+);")
#: What an element puts between the text before it and its own; elements that hide their text.
_BREAKS = dict.fromkeys(("p", "div", "section", "article", "header", "footer", "ul", "ol", "table", "tr", "blockquote", "pre", *(f"h{k}" for k in range(1, 7))), "\n\n") | {"br": "\n", "li": "\n"}
_HIDING = {"script", "style", "head"}


def _pieces(markup: str) -> Iterator[str]:
    hidden = ""
    for m in _PIECE.finditer(markup):
        tag = (m["tag"] or "").lower()
        if hidden:
            hidden = "" if tag == hidden and m["end"] else hidden
        elif tag in _HIDING and not m["end"]:
            hidden = tag
        elif tag:
            yield _BREAKS.get(tag, "") if not (tag == "li" and m["end"]) else ""
            if tag == "li" and not m["end"]:
                yield "• "
        elif not m[0].startswith("<!--"):
            yield html.unescape(m[0])


def readable(raw: str | None) -> str | None:
    """Markup as paragraphs and bullets; plain text stays as it is. Markup written as entities is read as markup."""
    if not raw:
        return raw
    plain = html.unescape(raw) if _ENTITY.search(raw) else raw
    while plain != raw and not any(m["tag"] for m in _PIECE.finditer(raw)) and any(m["tag"] for m in _PIECE.finditer(plain)):
        raw, plain = plain, html.unescape(plain)
    if not any(m["tag"] for m in _PIECE.finditer(raw)):
        return plain
    paragraphs = re.split(r"\n[^\S\n]*\n\s*", "".join(_pieces(raw)))
    lines = ("\n".join(filter(None, (" ".join(line.split()) for line in p.split("\n")))) for p in paragraphs)
    return "\n\n".join(filter(None, lines))


@F.pandas_udf(T.StringType())
def html_to_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in parts:
        yield text.map(readable)


def description_blocks(text: Column) -> Column:
    """Blocks of a plain description in order: array<struct<kind, lines>> of kind list (its items), heading or paragraph (one line).

    A heading is a short line that ends with a colon or has no small letter.
    """
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    bullet = r"^(?:[•*·–-]\s+)"

    def kind(x: Column) -> Column:
        short = (F.char_length(x) <= 60) & (x.rlike(":$") | (x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")))
        return F.when(x == "", "").when(x.rlike(bullet), "list").when(short, "heading").otherwise("paragraph")

    # a line begins a block, unless it is an item right behind an item
    marked = F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), F.regexp_replace(x, bullet, "").alias("line")))
    none = F.expr("cast(array() as array<struct<kind:string,lines:array<string>>>)")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["kind"].alias("kind"), F.concat(last["lines"], F.array(x["line"])).alias("lines"))))
        alone = F.concat(done, F.array(F.struct(x["kind"].alias("kind"), F.when(x["kind"] == "", F.expr("cast(array() as array<string>)")).otherwise(F.array(x["line"])).alias("lines"))))
        return F.when((x["kind"] == "list") & (F.size(done) > 0) & F.coalesce(last["kind"] == "list", F.lit(False)), joined).otherwise(alone)

    return F.filter(F.aggregate(marked, none, add), lambda b: b["kind"] != "")
