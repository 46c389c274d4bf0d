"""Further sources and sinks: sitemaps, workbooks, histories, safe CSV, report rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import formula_safe


def sitemap_entries(documents: DataFrame, xml: str) -> DataFrame:
    """Adds one row a sitemap entry: loc and lastmod (null without one), from XML text; comments and CDATA marks are dropped first."""
    clean = F.regexp_replace(F.regexp_replace(F.col(xml), r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    blocks = F.regexp_extract_all(clean, F.lit(r"(?si)<(?:\w+:)?(?:url|sitemap)\b[^>]*>(.*?)</(?:\w+:)?(?:url|sitemap)>"), F.lit(1))
    rows = documents.select(*[c for c in documents.columns if c not in (xml, "loc", "lastmod")], F.explode(blocks).alias("_b"))
    part = lambda name: F.nullif(F.trim(F.regexp_extract("_b", rf"(?si)<(?:\w+:)?{name}\b[^>]*>(.*?)</", 1)), F.lit(""))
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    return rows.withColumn("loc", unescape(part("loc"))).withColumn("lastmod", part("lastmod")).drop("_b").where("loc IS NOT NULL")


def recrawl_coverage(entries: DataFrame, crawls: DataFrame) -> DataFrame:
    """(loc, lastmod_day, crawl_day, state): each sitemap entry against the last crawl of its address.

    `crawls` has loc and crawled (timestamp). lastmod counts only with a zone or as a plain day. States: crawled-since,
    not-crawled-since, never-crawled, no-lastmod.
    """
    day = F.to_date(F.when(F.col("lastmod").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("lastmod")).when(F.col("lastmod").rlike(r"^\d{4}-\d{2}-\d{2}T.*(?:Z|[+-]\d{2}:?\d{2})$"), F.date_format(F.to_utc_timestamp(F.try_to_timestamp(F.col("lastmod")), F.current_timezone()), "yyyy-MM-dd")))
    last = crawls.groupBy("loc").agg(F.to_date(F.max("crawled")).alias("crawl_day"))
    joined = entries.groupBy("loc").agg(F.max(day).alias("lastmod_day")).join(last, "loc", "left")
    state = F.when(F.col("crawl_day").isNull(), "never-crawled").when(F.col("lastmod_day").isNull(), "no-lastmod").when(F.col("crawl_day") >= F.col("lastmod_day"), "crawled-since").otherwise("not-crawled-since")
    return joined.withColumn("state", state)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
#: Refused sizes: a workbook that unpacks to more is no export.
MAX_SHEETS, MAX_UNPACKED = 32, 512 << 20


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of an .xlsx file, cached values only."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
            raise ValueError("workbook too large")
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)]
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        if len(parts) > MAX_SHEETS:
            raise ValueError("too many sheets")
        for title, part in zip(titles, parts):
            for row in ElementTree.fromstring(z.read(part)).iterfind("m:sheetData/m:row", _NS):
                cells: list[str | None] = []
                for c in row.iterfind("m:c", _NS):
                    column = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        column = column * 26 + ord(letter) - 64
                    cells += [None] * (max(column, len(cells) + 1) - len(cells))
                    value = c.find("m:v", _NS)
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) or None
                    cells[-1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                yield title or "", int(row.get("r", 0)), cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row_no, cells, error) of all .xlsx files under a path, one task a file; unreadable files give one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(name, s, r, c, None) for s, r, c in workbook_rows(bytes(content))]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(name, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file STRING, sheet STRING, row_no INT, cells ARRAY<STRING>, error STRING")


_HISTORY = "url STRING, run_at TIMESTAMP, score INT, rules INT, failed INT"


def append_history(scores: DataFrame, path: str) -> None:
    """Appends scored pages (url, run_at, score, rules, failed) to a history of JSON lines, split by day."""
    scores.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in _HISTORY.split(", "))]).withColumn("day", F.to_date("run_at")).write.mode("append").partitionBy("day").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history in its schema; lines that don't fit are in _corrupt."""
    return spark.read.schema(_HISTORY + ", day DATE, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_safe_csv(df: DataFrame, path: str) -> None:
    """CSV with quoted cells and header; text cells that a spreadsheet would run as a formula are defused."""
    safe = [formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    df.select(*safe).write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def sarif_results(checks: DataFrame) -> DataFrame:
    """(value): one SARIF result object a failed check, as JSON lines."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    where = F.array(F.struct(F.struct(F.struct(F.col("url").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return checks.where("NOT passed").select(F.to_json(F.struct(F.concat_ws("/", "category", "rule").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", F.col("rule"), F.lit("failed")).alias("text")).alias("message"), where.alias("locations"))).alias("value"))


def junit_cases(checks: DataFrame) -> DataFrame:
    """(value): one JUnit testcase element a check, as text lines."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    head = F.concat(F.lit('<testcase classname="'), escape(F.col("url")), F.lit('" name="'), escape(F.concat_ws("/", "category", "rule")), F.lit('"'))
    return checks.where("passed IS NOT NULL").select(F.when(F.col("passed"), F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit('><failure type="'), F.col("severity"), F.lit('"/></testcase>'))).alias("value"))
