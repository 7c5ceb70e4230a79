"""Histories kept by hand: a calendar-like spreadsheet and a tree of folders."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowlens.functions.dates import folder_date, sheet_date

HEADERS = {"country": "location", "company": "company", "job": "title", "application date": "applied", "rejection date": "closed", "reason": "reason"}
MONTHS = {m for m in ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")}
CELLS = "file string, line int, block int, location string, company string, title string, applied string, closed string, reason string, cells array<string>"


def blocks(header: list[str]) -> list[dict[str, int]]:
    """Per block of a header row its fields' columns; none if it is no header row."""
    names = [" ".join(c.split()).lower() for c in header]
    starts = [i for i, n in enumerate(names) if n == "country"]
    out = []
    for start, stop in zip(starts, [*starts[1:], len(names)]):
        fields: dict[str, int] = {}
        for i in range(start, stop):
            if not names[i]:
                break
            if names[i] in HEADERS:
                fields[HEADERS[names[i]]] = i
        out.append(fields)
    return out


def cells(text: str) -> list[tuple]:
    """(line, block, location, company, title, applied, closed, reason, cells) of every filled block row but month rows and totals."""
    layout: list[dict[str, int]] = []
    out = []
    for line, row in enumerate(csv.reader(io.StringIO(text)), 1):
        found = blocks(row)
        if found:
            layout = found
            continue
        for b, fields in enumerate(layout):
            at = sorted(fields.values())
            raw = [" ".join(c.split()) for c in row[at[0] : at[-1] + 1]]
            filled = [c for c in raw if c]
            if not filled or (len(filled) == 1 and filled[0].lower() in MONTHS) or all(c.replace(".", "").isdigit() for c in filled):
                continue
            value = {name: " ".join(row[i].split()) if i < len(row) else "" for name, i in fields.items()}
            out.append((line, b, *[value.get(k, "") for k in ("location", "company", "title", "applied", "closed", "reason")], raw))
    return out


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Block rows of all files of a path; a file is parsed as a whole since quoted cells span lines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(file, *r) for file, text in zip(pdf.file, pdf.value) for r in cells(text)]
            yield pd.DataFrame(rows, columns=["file", "line", "block", "location", "company", "title", "applied", "closed", "reason", "cells"])

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(run, CELLS)


def sheet_rows(block_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): rows with dates, and those without a company or with an unreadable date."""
    rows = block_rows.withColumn("a", sheet_date(F.col("applied"))).withColumn("c", sheet_date(F.col("closed")))
    message = F.when(F.col("company") == "", "no company").when(~F.col("a.readable") | ~F.col("c.readable"), "unreadable date")
    rows = rows.withColumn("message", message)
    good = rows.filter("message is null").select(
        F.concat_ws(":", "file", F.lpad(F.col("line").cast("string"), 9, "0"), "block").alias("row_id"), "company", F.nullif("title", F.lit("")).alias("title"), "location", F.col("a.day").alias("applied_on"), F.col("c.day").alias("closed_on"), "reason"
    )
    return good, rows.filter("message is not null").select("file", "line", "block", "message", "cells")


EVIDENCE = ("png", "jpg", "jpeg", "webp", "pdf", "html", "txt", "docx", "eml")
IMAGES = ("png", "jpg", "jpeg", "webp")
SKIPPED = ("templates", "archive", "notes")
UNTITLED = ("old", "new")


def file_kind(name: F.Column) -> F.Column:
    low = F.lower(name)
    return F.when(low.rlike(r"\b(?:cv|resume)\b"), "cv").when(low.rlike("cover|letter|motivation"), "letter").when(F.regexp_extract(low, r"\.([a-z]+)$", 1).isin("docx", "eml"), "other").otherwise("offer")


def folder_entries(files: DataFrame) -> DataFrame:
    """Application folders of a file listing (path relative to the root, modified): company, title, day, files and what parent folders without an offer lend them.

    ``spark.read.format("binaryFile")`` gives the listing; contents are not read.
    """
    parts = F.split("path", "/")
    rows = files.withColumn("parts", parts).withColumn("name", F.element_at("parts", -1)).withColumn("depth", F.size("parts"))
    kind = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    rows = rows.filter(kind.isin(*EVIDENCE) & ~F.exists("parts", lambda p: F.lower(p).isin(*SKIPPED)))
    loose = rows.filter((F.col("depth") == 1) & kind.isin(*IMAGES)).select(F.regexp_replace("name", r"\.[^.]+$", "").alias("company"), F.lit("").alias("relative"), F.col("name").alias("file"), "modified", F.lit("offer").alias("kind"))
    inside = rows.filter("depth > 1").select(F.get("parts", 0).alias("company"), F.regexp_replace("path", "/[^/]*$", "").alias("relative"), F.col("name").alias("file"), "modified", file_kind(F.col("name")).alias("kind"))
    every = inside.unionByName(loose)
    offer = F.min(F.when(F.col("kind") == "offer", F.to_date("modified")))
    found = every.groupBy("company", "relative").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "kind")))).alias("files"), F.coalesce(offer, F.min(F.to_date("modified"))).alias("oldest"), F.max((F.col("kind") == "offer").cast("int")).alias("has_offer"))
    # a folder without an offer that has folders below it lends them its files
    lend = found.select(F.col("relative").alias("upper"), F.col("files").alias("lent"), "has_offer").filter("has_offer = 0 and upper <> ''")
    lower = found.filter("relative like '%/%'").select("relative", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("relative", "/")) - 1), lambda n: F.array_join(F.slice(F.split("relative", "/"), 1, n), "/"))).alias("upper"))
    given = lower.join(lend, "upper").groupBy("relative").agg(F.array_sort(F.flatten(F.collect_list(F.transform(F.map_keys("lent"), lambda f: F.concat("upper", F.lit("/"), f))))).alias("inherited"))
    givers = lower.join(lend.select("upper"), "upper").select("upper").distinct()
    kept = found.join(givers, found["relative"] == givers["upper"], "left_anti").join(given, "relative", "left")
    leaf = F.when(F.col("relative").contains("/"), F.element_at(F.split("relative", "/"), -1)).otherwise("")
    dated = folder_date(leaf, F.col("oldest"))
    title = F.when((leaf != "") & ~F.lower(leaf).isin(*UNTITLED) & ~leaf.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), leaf)
    return kept.select(F.concat_ws("/", "company", "relative").alias("folder_id"), "company", title.alias("title"), dated["day"].alias("day"), dated["estimated"].alias("estimated"), "relative", "files", F.coalesce("inherited", F.expr("cast(array() as array<string>)")).alias("inherited"))


def boards(registry: DataFrame, source: str | None = None) -> DataFrame:
    """Enabled boards in order of priority and slug; a slug may occur once."""
    twice = registry.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("company_slug"))).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"registry: {twice[0]['company_slug']} occurs more than once")
    rows = registry.filter("enabled")
    return (rows.filter(F.col("source") == source) if source else rows).orderBy("priority", "company_slug")
