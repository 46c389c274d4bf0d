"""Items that appear together: persistent pair counts, kept up to date by signed deltas of the baskets that changed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A count's key: a pair of items of a group, one item (no right), or the group itself (no left either).
_KEY = ["grp", "left_item", "right_item"]
_SCORE = "grp STRING, left_item STRING, right_item STRING, n BIGINT, n_left BIGINT, n_right BIGINT, n_all BIGINT, lift DOUBLE, jaccard DOUBLE"
_SCHEMAS = {
    "baskets": "basket_id STRING, grp STRING, items ARRAY<STRING>, bucket INT",
    "counts": "grp STRING, left_item STRING, right_item STRING, n BIGINT, bucket INT",
    "scores": _SCORE + ", bucket INT",
}
_BUCKET_KEYS = {"baskets": ["basket_id"], "counts": _KEY, "scores": _KEY}
#: Items of one piece of a basket: pairs are formed between two pieces at a time.
PIECE = 256


class PairStore:
    """Counts of baskets, items and item pairs by group, in Parquet tables under `path`, each split into hash buckets.

    A basket is a set of distinct items in one group; it counts as one occurrence of each item and each pair. apply()
    takes new contents of baskets, emits -1 for every pair, item and group of the old contents and +1 for those of the new, and
    appends the summed deltas to the buckets they fall into; compact() merges each bucket's deltas into its counts, which apply()
    does by itself after `compact_after` batches. refresh() recomputes the scores that a change can have moved.

    A manifest lists the versions that make up each table, and holds the number of buckets, so a store is read as it was
    written whatever number a later session asks for. A manifest is a new file that is renamed into place, and each
    run writes into folders of its own, so a failed run leaves the store as it was and the next one succeeds. vacuum()
    deletes what no manifest names.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, compact_after: int = 4) -> None:
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self.buckets = self._manifest().get("buckets", buckets)

    # manifests are numbered lines of JSON; the greatest number holds
    def _hadoop(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        fs, at = self._hadoop("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{numbers[-1]:08}.json").first()[0])

    def _publish(self, manifest: dict) -> None:
        numbers = self._numbers()
        fs, temporary = self._hadoop(f"manifest/{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest | {"buckets": self.buckets}).encode()))
        out.close()
        _, target = self._hadoop(f"manifest/{(numbers or [0])[-1] + 1:08}.json")
        if fs.exists(target) or not fs.rename(temporary, target):
            raise RuntimeError("another run changed the pair store at the same time")

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*_BUCKET_KEYS[name]), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, df: DataFrame) -> str:
        """Writes df as a version of its own, one file a bucket."""
        version = uuid.uuid4().hex
        df.withColumn("bucket", self._bucket(name)).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{version}")
        return version

    def _read(self, name: str, versions: list[str]) -> DataFrame:
        """All rows of the versions, with their number in the list as `v`."""
        out = None
        for v, version in enumerate(versions):
            part = self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}/{version}").withColumn("v", F.lit(v))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], _SCHEMAS[name]).withColumn("v", F.lit(0)) if out is None else out

    def _counts(self, versions: list[str]) -> DataFrame:
        rows = self._read("counts", versions).drop("v", "bucket")
        return rows if len(versions) < 2 else rows.groupBy(*_KEY).agg(F.sum("n").alias("n")).where("n <> 0")

    def _latest(self, name: str, versions: list[str]) -> DataFrame:
        """Of each key the row written last."""
        rows = self._read(name, versions)
        if len(versions) < 2:
            return rows.drop("v", "bucket")
        keys = _BUCKET_KEYS[name]
        rest = [c for c in rows.columns if c not in (*keys, "v", "bucket")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "v").alias("r")).select(*keys, "r.*")

    def table(self, name: str) -> DataFrame:
        """The current contents of `baskets`, `pairs`, `items` or `groups`."""
        manifest = self._manifest()
        if name == "baskets":
            return self._latest("baskets", manifest.get("baskets", []))
        counts = self._counts(manifest.get("counts", []))
        if name == "pairs":
            return counts.where("right_item IS NOT NULL")
        if name == "items":
            return counts.where("left_item IS NOT NULL AND right_item IS NULL").select("grp", F.col("left_item").alias("item"), "n")
        return counts.where("left_item IS NULL").select("grp", "n")

    def apply(self, changed: DataFrame) -> None:
        """Takes baskets (basket_id, grp, items) whose contents are new or changed; other columns are ignored.

        Rows without basket_id or group are left out; of several rows of a basket one is taken (the greatest). Null
        items are dropped, repeated items count once, null or empty lists are baskets without items. Baskets of any size are
        paired piece by piece, so none has to fit one task with all its pairs.
        """
        manifest = self._manifest()
        clean = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("items", F.array().cast("array<string>")))))
        new = changed.where("basket_id IS NOT NULL AND grp IS NOT NULL").select(F.col("basket_id").cast("string").alias("basket_id"), "grp", clean.alias("items"))
        version = self._write("baskets", new.groupBy("basket_id").agg(F.max(F.struct("grp", "items")).alias("b")).select("basket_id", "b.grp", "b.items"))
        new = self._read("baskets", [version]).drop("v")
        signed = new.select("basket_id", "grp", "items", F.lit(1).alias("sign"))
        if manifest.get("baskets"):
            # only buckets with changed baskets are read
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            old = self._read("baskets", manifest["baskets"]).where(F.col("bucket").isin(touched)).join(new.select("basket_id"), "basket_id", "left_semi")
            old = old.groupBy("basket_id").agg(F.max_by(F.struct("grp", "items"), "v").alias("o"))
            both = new.join(old, "basket_id", "left").where(~F.struct("grp", "items").eqNullSafe(F.col("o")))
            sides = F.explode(F.array(F.struct("grp", "items", F.lit(1).alias("sign")), F.struct(F.col("o.grp"), F.col("o.items"), F.lit(-1).alias("sign"))))
            signed = both.select("basket_id", sides.alias("s")).select("basket_id", "s.*").where("grp IS NOT NULL")
        deltas = _keys_of(signed).groupBy(*_KEY).agg(F.sum("sign").alias("n")).where("n <> 0")
        manifest["baskets"] = [*manifest.get("baskets", []), version]
        manifest["counts"] = [*manifest.get("counts", []), self._write("counts", deltas)]
        self._publish(manifest)
        if len(manifest["counts"]) > self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Merges the deltas of every table into one version each. Scores that are not refreshed yet are refreshed first."""
        manifest = self._manifest()
        if manifest.get("scores") and manifest.get("scored", 0) < len(manifest["counts"]):
            self.refresh()
            manifest = self._manifest()
        fresh = manifest.get("scored", 0) == len(manifest.get("counts", []))
        for name in ("baskets", "counts", "scores"):
            versions = manifest.get(name, [])
            if len(versions) > 1:
                merged = self._counts(versions) if name == "counts" else self._latest(name, versions)
                manifest[name] = [self._write(name, merged if name != "scores" else merged.where("n > 0"))]
        manifest["scored"] = len(manifest.get("counts", [])) if fresh else 0
        self._publish(manifest)

    def vacuum(self) -> None:
        """Deletes versions and manifests that the current manifest doesn't name. No other run may be at work."""
        manifest, numbers = self._manifest(), self._numbers()
        for name in _SCHEMAS:
            fs, at = self._hadoop(name)
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if s.getPath().getName() not in manifest.get(name, []):
                    fs.delete(s.getPath(), True)
        for n in numbers[:-1]:
            fs, at = self._hadoop(f"manifest/{n:08}.json")
            fs.delete(at, False)

    def _scored(self, pairs: DataFrame, counts: DataFrame) -> DataFrame:
        items, n = counts.where("left_item IS NOT NULL AND right_item IS NULL"), F.col("n").cast("double")
        lefts, rights = items.select("grp", "left_item", F.col("n").alias("n_left")), items.select("grp", F.col("left_item").alias("right_item"), F.col("n").alias("n_right"))
        groups = counts.where("left_item IS NULL").select("grp", F.col("n").alias("n_all"))
        joined = pairs.join(groups, "grp").join(lefts, ["grp", "left_item"]).join(rights, ["grp", "right_item"])
        lift, jaccard = n * F.col("n_all") / (F.col("n_left").cast("double") * F.col("n_right")), F.col("n") / (F.col("n_left") + F.col("n_right") - F.col("n"))
        return joined.select(*_KEY, "n", "n_left", "n_right", "n_all", lift.alias("lift"), jaccard.alias("jaccard"))

    def refresh(self) -> None:
        """Recomputes the scores of the pairs that batches since the last refresh can have moved, and appends them.

        These are the pairs whose own count, or the count of one of whose items, or of whose group changed; a pair that is gone gets
        a row with n = 0.
        """
        manifest = self._manifest()
        counts, done = manifest.get("counts", []), manifest.get("scored", 0)
        if done == len(counts):
            return
        now = self._counts(counts)
        pairs = now.where("right_item IS NOT NULL")
        if not done:
            scores = self._scored(pairs, now)
        else:
            delta = self._read("counts", counts[done:]).select(*_KEY)
            flag = lambda d, name: d.distinct().withColumn(name, F.lit(True))
            items = delta.where("left_item IS NOT NULL AND right_item IS NULL").select("grp", "left_item")
            own = delta.where("right_item IS NOT NULL").distinct()
            marked = pairs.join(flag(delta.where("left_item IS NULL").select("grp"), "_g"), "grp", "left").join(flag(items, "_l"), ["grp", "left_item"], "left")
            marked = marked.join(flag(items.withColumnRenamed("left_item", "right_item"), "_r"), ["grp", "right_item"], "left").join(flag(own, "_p"), _KEY, "left")
            moved = marked.where(F.coalesce("_g", "_l", "_r", "_p").isNotNull()).select(*pairs.columns)
            gone = own.join(pairs, _KEY, "left_anti").select(*_KEY, F.lit(0).cast("bigint").alias("n"))
            scores = self._scored(moved, now).unionByName(gone, allowMissingColumns=True)
        manifest["scores"] = [*manifest.get("scores", []), self._write("scores", scores)] if done else [self._write("scores", scores)]
        self._publish(manifest | {"scored": len(counts)})

    def scores(self, min_pairs: int = 1) -> DataFrame:
        """Pairs that occur in at least min_pairs baskets with their association: grp, left_item, right_item, n, n_left, n_right, n_all, lift, jaccard."""
        self.refresh()
        return self._latest("scores", self._manifest().get("scores", [])).where(F.col("n") >= max(1, min_pairs))


def _keys_of(signed: DataFrame) -> DataFrame:
    """(grp, left_item, right_item, sign) of every group, item and pair of signed baskets; lists longer than PIECE are cut, and two pieces at a time are paired."""
    none = F.lit(None).cast("string")
    groups = signed.select("grp", none.alias("left_item"), none.alias("right_item"), "sign")
    items = signed.select("grp", F.explode("items").alias("left_item"), none.alias("right_item"), "sign")
    order = lambda x, y: F.transform(y, lambda b: F.struct(F.least(x, b).alias("l"), F.greatest(x, b).alias("r")))
    within = lambda p: F.flatten(F.transform(p, lambda x, i: order(x, F.slice(p, i + 2, F.size(p)))))
    pairs = lambda rows, made: rows.select("grp", "sign", F.explode(made).alias("p")).select("grp", F.col("p.l").alias("left_item"), F.col("p.r").alias("right_item"), "sign")
    short = pairs(signed.where((F.size("items") > 1) & (F.size("items") <= PIECE)), within(F.col("items")))
    # long baskets: each two pieces become a row of their own before they are spread over the cluster
    long = signed.where(F.size("items") > PIECE)
    starts = F.sequence(F.lit(0), F.floor((F.size("items") - 1) / PIECE).cast("int"))
    pieces = long.select("grp", "sign", "basket_id", F.posexplode(F.transform(starts, lambda k: F.slice("items", k * PIECE + 1, PIECE))).alias("a", "x"))
    first = pieces.withColumn("b", F.explode(F.sequence(F.lit(0), "a")))
    other = pieces.select("basket_id", "sign", F.col("a").alias("b"), F.col("x").alias("y"))
    met = first.join(other, ["basket_id", "sign", "b"]).repartition(F.col("basket_id"), F.col("a"), F.col("b"))
    across = F.flatten(F.transform("x", lambda x: order(x, F.col("y"))))
    out = groups.unionByName(items).unionByName(short)
    return out.unionByName(pairs(met.where("a = b"), within(F.col("x")))).unionByName(pairs(met.where("a <> b"), across))


def domain(url):
    """The URL's host in lower case without port, final dot or leading `www.`; null if it has none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(plain != "", plain)


def bare_domain(name):
    """A domain as written in an edge table, in the same form."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r":\d+$", ""), r"\.$", ""), r"^www\.", "")
    return F.when(plain != "", plain)
