"""Schemas that drift between files: one typed table with a rescue column, and a report of each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ordered import last_before

#: The target schema of imported exports: field, type.
TARGET = {
    "url": "string", "query": "string", "export_date": "date", "citations": "double", "cited_pages": "bigint", "citation_share": "double", "intent": "string", "topic": "string",
}
_KINDS = [("integer", r"^[+-]?\d+$"), ("decimal", r"^[+-]?\d+[.,]\d+$"), ("percent", r"^[+-]?\d+(?:[.,]\d+)?\s*%$"), ("day", r"^\d{4}-\d{2}-\d{2}$")]


def value_kind(value: Column) -> Column:
    """integer, decimal, percent, day or text; null for null and empty values."""
    kind = F.lit("text")
    for name, pattern in reversed(_KINDS):
        kind = F.when(value.rlike(pattern), name).otherwise(kind)
    return F.when(F.trim(value) != "", kind)


def cast_value(value: Column, kind: str) -> Column:
    """The value as `kind`, or null: numbers may use a decimal comma and a percent sign, dates are yyyy-MM-dd or d.M.yyyy."""
    if kind == "string":
        return value
    if kind == "date":
        flipped = F.regexp_replace(value, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")
        padded = F.regexp_replace(F.regexp_replace(flipped, r"-(\d)(?=-|$)", "-0$1"), r"-(\d)$", "-0$1")
        return padded.try_cast("date")
    number = F.regexp_replace(F.regexp_replace(F.trim(value), r"\s*%$", ""), ",", ".")
    return F.when(number.rlike(r"^[+-]?\d+(?:\.\d+)?$"), number).try_cast(kind)


def ingest(records: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """Readable records in the target schema: export_id, line_no, one column a target field, _rescued, _kinds.

    `records` has export_id, line_no, fields, cells as from read_records, each with as many cells as fields. A
    field that target lacks, or a non-empty value that can't be cast, is kept in the JSON object _rescued (null
    if nothing was rescued); _kinds maps each field of the row to the kind of its non-empty value. Of a field
    that a header has twice, the first cell counts. Empty cells give null.
    """
    target = TARGET if target is None else target
    first = F.filter(F.arrays_zip("fields", "cells"), lambda c, i: F.array_position("fields", c["fields"]) == i + 1)
    values = records.select("export_id", "line_no", F.map_from_entries(F.transform(F.filter(first, lambda c: c["cells"] != ""), lambda c: F.struct(c["fields"], c["cells"]))).alias("_v"))
    typed = {f: cast_value(F.col("_v")[f], t) for f, t in target.items()}
    failed = [F.when(F.col("_v")[f].isNotNull() & c.isNull(), F.lit(f)) for f, c in typed.items() if target[f] != "string"]
    uncast = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    known = F.array(*[F.lit(f) for f in target]) if target else F.array().cast("array<string>")
    rescued = F.map_filter("_v", lambda k, v: ~F.array_contains(known, k) | F.array_contains(F.col("_u"), k))
    return values.withColumn("_u", uncast).select(
        "export_id", "line_no", *[c.alias(f) for f, c in typed.items()],
        F.when(F.size(rescued) > 0, F.to_json(rescued)).alias("_rescued"),
        F.map_filter(F.transform_values("_v", lambda k, v: value_kind(v)), lambda k, v: v.isNotNull()).alias("_kinds"),
    )


def promote(table: DataFrame, field: str, kind: str) -> DataFrame:
    """Approves a field: adds (or refills) its typed column by replaying rescued values; what still can't be cast stays rescued."""
    entries = F.from_json("_rescued", "map<string,string>")
    value = F.coalesce(entries, F.create_map().cast("map<string,string>"))[field]
    replayed = cast_value(value, kind)
    filled = F.coalesce(F.col(field), replayed) if field in table.columns else replayed
    left = F.map_filter(entries, lambda k, v: (k != field) | replayed.isNull())
    rest = F.when(F.size(left) > 0, F.to_json(left))
    return table.withColumn("_left", rest).withColumn(field, filled).drop("_rescued").withColumnRenamed("_left", "_rescued")


def column_kinds(table: DataFrame) -> DataFrame:
    """(export_id, field, kind): the kind that most non-empty values of the column have; of equally many the first by name."""
    counts = table.select("export_id", F.explode("_kinds").alias("field", "kind")).groupBy("export_id", "field", "kind").count()
    return counts.groupBy("export_id", "field").agg(F.min_by("kind", F.struct(-F.col("count"), "kind")).alias("kind"))


def changes(exports: DataFrame, headers: DataFrame, kinds: DataFrame) -> DataFrame:
    """(export_id, field, change_kind): each export against the one before it of the same property.

    `exports` has export_id, property_id, exported_at (repeated rows count once), `headers` comes from
    find_headers, `kinds` from column_kinds. added, removed: the field is in only one of the two; renamed:
    another wording; retyped: another kind, if both columns have values. Exports without a property or time, or
    without a header, take no part.
    """
    known = exports.where("property_id IS NOT NULL AND exported_at IS NOT NULL").groupBy("export_id").agg(F.max("property_id").alias("property_id"), F.max("exported_at").alias("exported_at"))
    own = F.map_from_entries(F.filter(F.arrays_zip("fields", "terms"), lambda c, i: F.array_position("fields", c["fields"]) == i + 1))
    kind_map = kinds.groupBy("export_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "kind"))).alias("kinds"))
    schema = known.join(headers.select("export_id", own.alias("terms")), "export_id").join(kind_map, "export_id", "left")
    state = F.struct("export_id", "terms", F.coalesce("kinds", F.create_map().cast("map<string,string>")).alias("kinds"))
    rows = last_before(schema.withColumn("_s", state), ["property_id"], ["exported_at", "export_id"], F.date_trunc("quarter", "exported_at"), F.col("_s"), "_before")
    pairs = rows.where(F.col("_before").isNotNull()).select("export_id", "_s", "_before", F.explode(F.array_union(F.map_keys("_s.terms"), F.map_keys("_before.terms"))).alias("field"))
    now, then = F.col("_s.terms")[F.col("field")], F.col("_before.terms")[F.col("field")]
    kind_now, kind_then = F.col("_s.kinds")[F.col("field")], F.col("_before.kinds")[F.col("field")]
    found = F.array_compact(F.array(
        F.when(then.isNull(), "added"), F.when(now.isNull(), "removed"), F.when(now != then, "renamed"), F.when(now.isNotNull() & then.isNotNull() & (kind_now != kind_then), "retyped"),
    ))
    return pairs.select("export_id", "field", F.explode(found).alias("change_kind"))
