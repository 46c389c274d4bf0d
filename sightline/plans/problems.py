"""Queries of the general problems: log lines, schema drift, timestamps, unreadable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import badrows, drift, loglines
from sightline.operators.timestamps import InstantDictionary
from sightline.session import load, materialize, work_path
from sightline.sources import exports

_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every log entry."""
    return loglines.found_form(loglines.parse_entries(load(spark, sf_dir, "crawler_log_lines"), load(spark, sf_dir, "log_files")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of all texts that are not canonical yet, one row per table and key."""

    def rows(table: str, key: str, raw: str, context: str, canonical: str) -> DataFrame:
        return load(spark, sf_dir, table).where(~F.col(raw).rlike(canonical)).select(
            F.lit(table).alias("table_name"), F.col(key).alias("row_key"), F.lit(f"{table}.{raw}").alias("source"), F.col(raw).alias("raw"), F.col(context).alias("context")
        )

    every = (
        rows("answer_observations", "observation_id", "observed_at", "zone_name", _CANONICAL)
        .unionByName(rows("crawler_requests", "request_id", "logged_at", "zone_name", _CANONICAL))
        .unionByName(rows("bing_rows", "row_id", "export_date", "locale", r"^\d{4}-\d{2}-\d{2}$"))
    )
    dictionary = InstantDictionary(spark, work_path(spark, "instants"), day_sources=("bing_rows.export_date",))
    return dictionary.normalize(every).where("utc_ms IS NOT NULL").groupBy("table_name", "row_key").agg(F.min("utc_ms").alias("utc_ms"))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Headers and records of all exports."""
    lines, terms = exports.distinct_lines(load(spark, sf_dir, "bing_export_lines")), load(spark, sf_dir, "export_header_terms")
    headers = materialize(exports.find_headers(lines, terms), "headers")
    return headers, exports.read_records(lines, terms, headers)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines that can't be read, with the first reason."""
    _, records = _records(spark, sf_dir)
    return badrows.failed_rows(records, badrows.rule_table(spark)).select("export_id", F.col("line_no").cast("int").alias("line_no"), "reason")


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Headers of all exports, and their readable lines in the target schema."""
    headers, records = _records(spark, sf_dir)
    records = materialize(records, "records")
    return headers, drift.ingest(badrows.clean_rows(records, badrows.failed_rows(records, badrows.rule_table(spark))))


def _promoted(table: DataFrame) -> DataFrame:
    return drift.promote(drift.promote(table, "device", "string"), "market", "string")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable export lines in one typed table: unknown and uncastable values rescued, `device` and `market` promoted."""
    _, table = _ingested(spark, sf_dir)
    return _promoted(table).drop("_kinds")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and kind changes of each export against the one before, the kinds from the written table of p4_table."""
    headers, table = _ingested(spark, sf_dir)
    table = materialize(_promoted(table), "ingested")
    return drift.changes(load(spark, sf_dir, "bing_exports"), headers, drift.column_kinds(table))


def _cells(delimiter: str) -> tuple[str, str]:
    d = {"\t": r"\t", "|": r"\|"}.get(delimiter, delimiter)
    cell = f'(?:"(?:[^"]|"")*"|(?:[^"{d}][^{d}]*)?)'
    return f"^{cell}(?:{d}{cell})*$", f"{d}({cell})"


def _per_delimiter(expression: int) -> str:
    """A CASE over the delimiter d: whether the line s is sound (0), or its raw cells (1)."""
    out = "CASE d"
    for delimiter in exports.DELIMITERS:
        whole, each = _cells(delimiter)
        literal = "chr(9)" if delimiter == "\t" else f"'{delimiter}'"
        out += f" WHEN {literal} THEN " + (f"regexp_matches(s, '{whole}')" if expression == 0 else f"regexp_extract_all({literal} || s, '{each}', 1)")
    return out + " END"


_UNQUOTE = "CASE WHEN c LIKE '\"%' THEN replace(c[2:-2], '\"\"', '\"') ELSE c END"
_HEADER_FORM = "trim(regexp_replace(replace(replace(strip_accents(lower(c)), 'ß', 'ss'), 'ı', 'i'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_FIRST_CELL = "trim(regexp_replace(replace(replace(strip_accents(lower(regexp_extract(s, '^\"?([^,;' || chr(9) || '|]*)', 1))), 'ß', 'ss'), 'ı', 'i'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
#: Records under their export's header for the SQL side: q holds export_id, line_no, sound, cells, fields, terms. Only lines whose first
#: cell is a known wording are tried as headers, and each line is cut by its export's delimiter alone.
_RECORDS = f"""WITH l AS MATERIALIZED (SELECT export_id, line_no, regexp_replace(min(raw_line), '^' || chr(65279) || '|' || chr(13) || '$', '') AS s FROM bing_export_lines GROUP BY 1, 2),
    t AS (SELECT list(term) AS ts, map_from_entries(list((term, field))) AS m FROM export_header_terms),
    w AS MATERIALIZED (SELECT l.* FROM l JOIN export_header_terms ON {_FIRST_CELL} = term),
    n AS MATERIALIZED (SELECT export_id, line_no, d, list_transform(list_transform({_per_delimiter(1)}, lambda c: {_UNQUOTE}), lambda c: {_HEADER_FORM}) AS terms FROM w, (SELECT unnest([',', ';', chr(9), '|']) AS d) WHERE {_per_delimiter(0)}),
    h AS (SELECT export_id, arg_max((line_no, d, terms), len(terms) * 1000000 - line_no) AS b FROM n, t WHERE len(list_filter(terms, lambda x: NOT list_contains(ts, x))) = 0 GROUP BY 1),
    g AS MATERIALIZED (SELECT export_id, b[1] AS header_line, b[2] AS d, b[3] AS terms, list_transform(b[3], lambda x: m[x]) AS fields FROM h, t),
    cl AS MATERIALIZED (SELECT l.export_id, l.line_no, l.s, g.d, g.fields, g.terms FROM l JOIN g USING (export_id) WHERE l.line_no > g.header_line),
    q AS (SELECT export_id, line_no, fields, terms, {_per_delimiter(0)} AS sound, list_transform({_per_delimiter(1)}, lambda c: {_UNQUOTE}) AS cells FROM cl),
    r AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN len(cells) <> len(fields) THEN 'column_count' WHEN coalesce(cells[list_position(fields, 'url')], '') <> '' AND NOT regexp_matches(cells[list_position(fields, 'url')], '^(?i:https?)://[^\\s/?#:@]\\S*$') THEN 'url'
        WHEN coalesce(cells[list_position(fields, 'citations')], '') <> '' AND NOT regexp_matches(cells[list_position(fields, 'citations')], '^[0-9]+([.,][0-9]+)?$') THEN 'citations' END AS reason FROM q)
"""
_KIND = "CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?[0-9]+[.,][0-9]+$') THEN 'decimal' WHEN regexp_matches(v, '^[+-]?[0-9]+([.,][0-9]+)?\\s*%$') THEN 'percent' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'day' ELSE 'text' END"

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_table": p4_table, "p5_found": p5_found, "p6_found": p6_found}
ORACLES: dict[str, str] = {
    "p6_found": _RECORDS + "SELECT export_id, CAST(line_no AS INTEGER) AS line_no, reason FROM r WHERE reason IS NOT NULL",
    "p4_found": _RECORDS + f""", v AS (SELECT export_id, unnest(fields) AS field, unnest(cells) AS v FROM r WHERE reason IS NULL), k AS (SELECT export_id, field, {_KIND} AS kind, count(*) n FROM v WHERE trim(v) <> '' GROUP BY 1, 2, 3), km AS (SELECT export_id, field, arg_min(kind, (-n, kind)) AS kind FROM k GROUP BY 1, 2),
        e AS (SELECT export_id, max(property_id) property_id, max(exported_at) exported_at FROM bing_exports GROUP BY 1), x AS (SELECT e.*, lag(export_id) OVER (PARTITION BY property_id ORDER BY exported_at, export_id) AS prior FROM e JOIN g USING (export_id)),
        f AS (SELECT export_id, unnest(fields) AS field, unnest(terms) AS term FROM g), c AS (SELECT x.export_id, f.field, f.term FROM x JOIN f USING (export_id) WHERE prior IS NOT NULL), b AS (SELECT x.export_id, f.field, f.term, x.prior FROM x JOIN f ON f.export_id = x.prior),
        j AS (SELECT coalesce(c.export_id, b.export_id) AS export_id, coalesce(c.field, b.field) AS field, c.term AS now, b.term AS before FROM c FULL JOIN b ON b.export_id = c.export_id AND b.field = c.field)
        SELECT export_id, field, CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind FROM j WHERE before IS NULL OR now IS NULL OR now <> before
        UNION ALL SELECT j.export_id, j.field, 'retyped' FROM j JOIN x USING (export_id) JOIN km a ON a.export_id = j.export_id AND a.field = j.field JOIN km z ON z.export_id = x.prior AND z.field = j.field WHERE j.now IS NOT NULL AND j.before IS NOT NULL AND a.kind <> z.kind""",
}
