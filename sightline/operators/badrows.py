"""Rows that fail to parse: cells in long form against a rule table, errors gathered per row, clean rows by anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (field, reason, rank, pattern that a non-empty value must match); the lowest rank names the row's reason.
EXPORT_RULES = [
    ("url", "url", 3, r"^(?i:https?)://[^\s/?#:@]\S*$"),
    ("citations", "citations", 4, r"^\d+(?:[.,]\d+)?$"),
]
QUOTING, COLUMN_COUNT = 1, 2


def rule_table(spark: SparkSession, rules: list[tuple[str, str, int, str]] | None = None) -> DataFrame:
    """Validation rules as a table (field, reason, rank, pattern)."""
    return spark.createDataFrame(EXPORT_RULES if rules is None else rules, "field STRING, reason STRING, rank INT, pattern STRING")


def failed_rows(records: DataFrame, rules: DataFrame) -> DataFrame:
    """(export_id, line_no, reason): the first reason why a record can't be read, of the records that can't.

    `records` comes from read_records. Broken quoting is `quoting`, a number of cells other than the header's
    `column_count`; otherwise the cells are exploded to (field, value), joined with `rules`, and each non-empty
    value must match the rule's pattern. A null line counts as broken quoting. Repeated records count once.
    """
    shape = F.when(F.col("cells").isNull(), QUOTING).when(F.size("cells") != F.size("fields"), COLUMN_COUNT)
    shaped = records.select("export_id", "line_no", "fields", "cells", shape.alias("rank"))
    broken = shaped.where(F.col("rank").isNotNull()).select("export_id", "line_no", F.col("rank"), F.element_at(F.array(F.lit("quoting"), F.lit("column_count")), F.col("rank")).alias("reason"))
    cells = shaped.where(F.col("rank").isNull()).select("export_id", "line_no", F.explode(F.arrays_zip("fields", "cells")).alias("c")).select(
        "export_id", "line_no", F.col("c.fields").alias("field"), F.col("c.cells").alias("value")
    )
    invalid = cells.where(F.col("value") != "").join(F.broadcast(rules), "field").where(~F.expr("value RLIKE pattern")).select("export_id", "line_no", "rank", "reason")
    return broken.unionByName(invalid).groupBy("export_id", "line_no").agg(F.min_by("reason", "rank").alias("reason"))


def clean_rows(records: DataFrame, failed: DataFrame) -> DataFrame:
    """The records that failed_rows does not name."""
    return records.join(failed, ["export_id", "line_no"], "left_anti")
