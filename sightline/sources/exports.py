"""Delimited exports kept as lines: finding each export's delimiter and header, and cutting lines into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]
#: A header dictionary larger than this is no reference table of wordings.
MAX_TERMS = 10_000


def _cell(delimiter: str) -> str:
    """One cell: quoted with doubled quotes inside, or unquoted and not starting with a quote."""
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"|(?!")[^{_esc(delimiter)}]*+)'


def _esc(delimiter: str) -> str:
    return {"\t": r"\t", "|": r"\|"}.get(delimiter, delimiter)


def split_cells(line: Column, delimiter: Column) -> Column:
    """The cells of one record line as ARRAY<STRING>, quotes removed; null where a quoted cell isn't closed or has text after its end.

    The delimiter is one of DELIMITERS, per row; a null line or another delimiter gives null, an empty line one empty cell.
    """
    out = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        cell, e = _cell(d), _esc(d)
        sound = line.rlike(rf"^{cell}(?:{e}{cell})*+$")
        raw = F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf"{e}({cell})"), F.lit(1))
        plain = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
        out = F.when(delimiter == d, F.when(sound, plain)).otherwise(out)
    return out


def without_mark(line: Column) -> Column:
    """The line without a leading byte order mark or a trailing carriage return."""
    return F.regexp_replace(line, r"^﻿|\r$", "")


def find_headers(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(export_id, header_line, delimiter, terms, fields): of each export the line all of whose cells are known header wordings.

    `lines` has export_id, line_no, raw_line; `terms` has term and field, terms in header form. Of several such
    lines the one with most cells is taken, then the first; exports without one are left out.
    """
    from sightline.functions.text import header_form

    known = terms.where(F.col("term").isNotNull()).groupBy("term").agg(F.min("field").alias("field")).limit(MAX_TERMS + 1).collect()
    if len(known) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} header terms")
    if not known:
        return lines.select("export_id", F.col("line_no").alias("header_line"), F.lit("").alias("delimiter"), F.array().cast("array<string>").alias("terms"), F.array().cast("array<string>").alias("fields")).where(F.lit(False))
    names = F.array(*[F.lit(r.term) for r in known])
    mapping = F.create_map(*[F.lit(x) for r in known for x in (r.term, r.field)])
    line = F.col("_line")
    base = lines.withColumn("_line", without_mark(F.col("raw_line")))
    # a cheap necessary condition first: the wording before the first delimiter of either kind is known
    base = base.where(F.array_contains(names, header_form(F.regexp_extract(line, r'^"?([^,;\t|"]*)', 1))))
    options = [F.struct(F.transform(split_cells(line, F.lit(d)), header_form).alias("terms"), F.lit(d).alias("delimiter")) for d in DELIMITERS]
    base = base.withColumn("_o", F.explode(F.array(*options))).where(F.col("_o.terms").isNotNull())
    base = base.where(F.forall("_o.terms", lambda t: F.array_contains(names, t)))
    best = F.max_by(F.struct("line_no", "_o.terms", "_o.delimiter"), F.struct(F.size("_o.terms"), -F.col("line_no")))
    return base.groupBy("export_id").agg(best.alias("b")).select(
        "export_id", F.col("b.line_no").alias("header_line"), F.col("b.delimiter").alias("delimiter"), F.col("b.terms").alias("terms"), F.transform("b.terms", lambda t: mapping[t]).alias("fields")
    )


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each (export_id, line_no) once; of differing texts the least, null last."""
    return lines.groupBy("export_id", "line_no").agg(F.min("raw_line").alias("raw_line"))


def read_records(lines: DataFrame, terms: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Lines after each export's header as (export_id, line_no, raw_line, fields, cells).

    `cells` is null where the quoting is broken. Lines of exports without a header are left out; see find_headers.
    """
    headers = find_headers(lines, terms) if headers is None else headers
    joined = lines.join(headers, "export_id").where(F.col("line_no") > F.col("header_line"))
    return joined.select("export_id", "line_no", "raw_line", "fields", split_cells(without_mark(F.col("raw_line")), F.col("delimiter")).alias("cells"))


#: Kinds of export by the fields that its header must have, the first that holds.
DATASET_KINDS = [
    ("query-page-mapping", ["url", "query"]), ("page-citations", ["url"]), ("grounding-queries", ["query"]), ("time-series", ["date"]),
    ("topic-intent-summary", ["topic", "intent"]), ("topic-summary", ["topic"]), ("intent-summary", ["intent"]),
]


def dataset_kind(fields: Column) -> Column:
    """What an export holds, by the fields of its header; overview without any dimension."""
    out = F.lit("overview")
    for kind, needed in reversed(DATASET_KINDS):
        out = F.when(F.size(F.array_except(F.array(*[F.lit(f) for f in needed]), fields)) == 0, kind).otherwise(out)
    return F.when(fields.isNotNull(), out)
