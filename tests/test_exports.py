"""Export reading, unreadable rows and schema drift."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sightline.operators import badrows, drift
from sightline.operators.ordered import last_before
from sightline.sources import exports

TERMS = [("page address", "url"), ("seitenadresse", "url"), ("times cited", "citations"), ("dia del informe", "export_date"), ("market", "market"), (None, "x"), ("topic", "topic")]
LINES = {
    1: ["﻿Report for x", "", '"Page address";Times_Cited; DÍA DEL INFORME ', "https://a.test/1;5;2026-01-02", '"https://a.test/2";"1,5";2026-01-03', 'https://a.test/3;"7;2026-01-04', 'https://a.test/3;"7"x;2026-01-04', "https://a.test/4;5", "htp://a;5;2026-01-02", "https://a b.test/;5;x", "https://a.test/5;-1;x", ";;", "ftp://x;abc;"],
    2: ["seitenadresse,market,times\xa0cited", "https://a.test/1,64,5%", '"https://a.test/""q""",65,6%', ",,"],
    3: ["no header here", "1,2"],
}
EXPORTS = [(1, "p", datetime(2026, 1, 1)), (2, "p", datetime(2026, 6, 1)), (2, "p", datetime(2026, 6, 1)), (3, "p", datetime(2026, 7, 1)), (4, None, None)]


def _read(spark):
    lines = exports.distinct_lines(spark.createDataFrame([(e, n, text, "clash") for e, ls in LINES.items() for n, text in enumerate(ls, 1)] * 2 + [(1, 50, None, "x")], "export_id BIGINT, line_no INT, raw_line STRING, fields STRING"))
    terms = spark.createDataFrame(TERMS, "term STRING, field STRING")
    headers = exports.find_headers(lines, terms)
    return headers, exports.read_records(lines, terms, headers)


def test_headers(spark):
    headers, _ = _read(spark)
    got = {r.export_id: (r.header_line, r.delimiter, r.fields) for r in headers.collect()}
    assert got == {1: (3, ";", ["url", "citations", "export_date"]), 2: (1, ",", ["url", "market", "citations"])}


def test_failed_and_clean_rows(spark):
    _, records = _read(spark)
    failed = badrows.failed_rows(records, badrows.rule_table(spark))
    got = {(r.export_id, r.line_no): r.reason for r in failed.collect()}
    assert got == {(1, 6): "quoting", (1, 7): "quoting", (1, 8): "column_count", (1, 9): "url", (1, 10): "url", (1, 11): "citations", (1, 13): "url", (1, 50): "quoting", (2, 2): "citations", (2, 3): "citations"}
    assert {(r.export_id, r.line_no) for r in badrows.clean_rows(records, failed).collect()} == {(1, 4), (1, 5), (1, 12), (2, 4)}


def test_ingest_rescue_promote(spark):
    _, records = _read(spark)
    good = records.where("cells IS NOT NULL AND size(cells) = size(fields)")
    table = drift.ingest(good)
    rows = {(r.export_id, r.line_no): r for r in table.collect()}
    assert rows[1, 5].citations == 1.5 and rows[1, 5]._rescued is None
    assert json.loads(rows[1, 13]._rescued) == {"citations": "abc"} and rows[1, 13].citations is None
    assert json.loads(rows[2, 2]._rescued) == {"market": "64"} and rows[2, 2].citations == 5.0
    assert rows[2, 3].url == 'https://a.test/"q"' and rows[2, 4].url is None and rows[2, 2]._kinds["citations"] == "percent"
    promoted = {(r.export_id, r.line_no): r for r in drift.promote(table, "market", "bigint").collect()}
    assert promoted[2, 2].market == 64 and promoted[2, 2]._rescued is None and promoted[1, 13]._rescued is not None


def test_changes(spark):
    headers, records = _read(spark)
    table = drift.ingest(records.where("cells IS NOT NULL AND size(cells) = size(fields)"))
    found = drift.changes(spark.createDataFrame(EXPORTS, "export_id BIGINT, property_id STRING, exported_at TIMESTAMP"), headers, drift.column_kinds(table))
    assert {tuple(r) for r in found.collect()} == {(2, "url", "renamed"), (2, "market", "added"), (2, "export_date", "removed"), (2, "citations", "retyped")}


def test_empty(spark):
    lines = spark.createDataFrame([], "export_id BIGINT, line_no INT, raw_line STRING")
    terms = spark.createDataFrame([], "term STRING, field STRING")
    headers = exports.find_headers(lines, terms)
    records = exports.read_records(lines, terms, headers)
    assert badrows.failed_rows(records, badrows.rule_table(spark)).count() == 0
    assert drift.changes(spark.createDataFrame([], "export_id BIGINT, property_id STRING, exported_at TIMESTAMP"), headers, drift.column_kinds(drift.ingest(records))).count() == 0


def test_very_long_cell(spark):
    text = '"' + "a" * 300_000 + '""' + "b" * 300_000 + '",1'
    df = spark.createDataFrame([(text,)], "t STRING").select(exports.split_cells(F.col("t"), F.lit(",")).alias("c"))
    assert [len(x) for x in df.first().c] == [600_001, 1]


def test_last_before_matches_plain_window(spark):
    rows = [("a" if k % 3 else None, k, k * 7 % 11 if k % 4 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "g STRING, k INT, v INT")
    got = {(r.g, r.k): r.p for r in last_before(df, ["g"], ["k"], F.floor(F.col("k") / 9), F.col("v"), "p").collect()}
    state: dict = {}
    for g, k, v in rows:
        assert got[g, k] == state.get(g)
        state[g] = v if v is not None else state.get(g)


def test_changes_come_from_the_whole_table(spark, data, monkeypatch):
    from sightline.plans import problems

    written = {}
    keep = problems.materialize
    monkeypatch.setattr(problems, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    found = problems.p4_found(spark, data)
    table = written["ingested"]
    assert {"_rescued", "_kinds", "device", "market", *drift.TARGET} <= set(table.columns)
    assert sorted(map(tuple, table.drop("_kinds").collect()), key=str) == sorted(map(tuple, problems.p4_table(spark, data).collect()), key=str)
    assert found.where("change_kind = 'retyped'").count() > 0
