"""Rendered pages: listings of anchors and readable page text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.functions.text import readable

LEAST_MAIN = 200


class _Anchors(HTMLParser):
    """href and text of every anchor, and the text of the card (list item or article) around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.open: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = [dict(attrs).get("href") or "", ""]

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append([self.open[0], " ".join(self.open[1].split())])
            self.open = None


def anchors(html: str | None) -> list[list[str]]:
    parser = _Anchors()
    parser.feed(html or "")
    return parser.found


def listing(pages: DataFrame, link_pattern: str) -> DataFrame:
    """company_slug, source_job_id, url and title of the anchors that match; the id is the pattern's first group, one row per id."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(slug, href, text) for slug, body in zip(pdf.company_slug, pdf.body) for href, text in anchors(body)]
            yield pd.DataFrame(rows, columns=["company_slug", "url", "title"])

    found = pages.select("company_slug", "body").mapInPandas(run, "company_slug string, url string, title string")
    job = F.regexp_extract("url", link_pattern, 1 if re.compile(link_pattern).groups else 0)
    rows = found.filter(F.col("url").rlike(link_pattern) & (F.col("title") != "")).withColumn("source_job_id", job)
    return rows.groupBy("company_slug", "source_job_id").agg(F.min("url").alias("url"), F.min_by("title", "url").alias("title"))


def page_text(html: str | None) -> tuple[str, str | None]:
    """Readable text of the main part if it is long enough, else of the page, and the first heading."""
    html = html or ""
    main = re.search(r"(?is)<(main|article)\b[^>]*>(.*?)</\1>", html)
    inner = readable(f"<div>{main[2]}</div>") if main else ""
    head = re.search(r"(?is)<h1\b[^>]*>(.*?)</h1>", html)
    title = " ".join((readable(f"<p>{head[1]}</p>") or "").split()) if head else None
    return (inner if len(inner) >= LEAST_MAIN else readable(f"<div>{html}</div>") or ""), title or None


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text and heading of every page."""

    @F.pandas_udf("struct<text:string,heading:string>")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([page_text(h) for h in s], columns=["text", "heading"])

    return pages.select(F.col(id_col), read(F.col(html_col)).alias("r")).select(id_col, "r.text", "r.heading")


def embedded_json(html: F.Column, marker: str) -> F.Column:
    """The JSON text that a script assigns behind a marker, up to the line's or script's end."""
    return F.regexp_extract(html, rf"(?s){re.escape(marker)}\s*=\s*(\{{.*?\}})\s*;?\s*(?:\n|</script>)", 1)
