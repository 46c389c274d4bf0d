"""Mixed timestamp forms: a persistent dictionary of distinct texts, parsed once and joined back to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.instants import with_instant

KEY = ["source", "raw", "context"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in KEY] + [T.StructField("utc_ms", T.LongType())])


class InstantDictionary:
    """Distinct (source, text, zone or locale) keys with the instant each gives, kept as Parquet at `path`.

    `source` names the column a text comes from. Sources in `day_sources` hold dates, whose context is a
    locale; the others hold timestamps, whose context is a zone name. A null context is the empty string; a
    null text is never a key and its instant is null.
    """

    def __init__(self, spark: SparkSession, path: str, day_sources: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.day_sources = spark, path.rstrip("/"), day_sources

    def entries(self) -> DataFrame:
        """All entries so far; empty before the first update."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def update(self, rows: DataFrame) -> DataFrame:
        """Parses the keys of `rows` (source, raw, context) that are not in the dictionary yet, appends them, returns all entries."""
        known = self.entries()
        keys = rows.select("source", "raw", F.coalesce("context", F.lit("")).alias("context")).where(F.col("raw").isNotNull() & F.col("source").isNotNull()).distinct()
        if not known.isEmpty():
            keys = keys.join(known.select(KEY), KEY, "left_anti")
        days = F.col("source").isin(*self.day_sources) if self.day_sources else F.lit(False)
        stamps = with_instant(keys.where(~days), "raw", "utc_ms", zone="context")
        parsed = stamps
        if self.day_sources:
            parsed = stamps.unionByName(with_instant(keys.where(days), "raw", "utc_ms", locale="context", day_column=True))
        parsed.select(*KEY, "utc_ms").write.mode("append").parquet(self.path)
        return self.entries()

    def normalize(self, rows: DataFrame) -> DataFrame:
        """`rows` (source, raw, context and any other columns) with `utc_ms`, from the updated dictionary.

        Every row is kept, repeated rows too; the instant is null for null or unreadable texts. A column
        `utc_ms` that rows already has is replaced.
        """
        found = self.update(rows).withColumnsRenamed({c: f"_d_{c}" for c in KEY}).withColumnRenamed("utc_ms", "_d_utc_ms")
        on = (F.col("source") == F.col("_d_source")) & (F.col("raw") == F.col("_d_raw")) & (F.coalesce("context", F.lit("")) == F.col("_d_context"))
        return rows.drop("utc_ms").join(found, on, "left").withColumnRenamed("_d_utc_ms", "utc_ms").drop(*[f"_d_{c}" for c in KEY])
