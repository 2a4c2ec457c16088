"""Re-scoring: a stream's batches replace rows of a keyed table, one row a (unit, method).

The table lies in a fixed number of buckets. A batch rewrites only the buckets
that its keys fall in, as a new version: what it doesn't replace (an anti-join)
and its own rows. Versions stand beside each other; the list of each bucket's
version is one file, and its renaming is the moment at which all of a batch
shows at once. A repeated batch starts from the list before it, so it gives the
same table again; a batch that was lost half way leaves the old list valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tessera.session import stored

KEY = ["unit", "method"]


class MergedTable:
    """Rows of schema (unit, method, others) below path."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The batch that last wrote each bucket, by the latest list (older than batch `before`): as many numbers as buckets."""
        try:
            lists = self.spark.read.schema("bucket int, version long, batch long").parquet(f"{self.path}/lists")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            lists = lists.filter(F.col("batch") < before)
        latest = lists.agg(F.max("batch")).first()[0]
        return {r["bucket"]: r["version"] for r in lists.filter(F.col("batch") == latest).collect()} if latest is not None else {}

    def _buckets(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._buckets(self.versions())

    def merge(self, rows: DataFrame, number: int, order: str) -> None:
        """Replaces the keys of rows; of several rows of a key the one with the greatest order stays (nulls last), ties by the other columns."""
        names = self.schema.names
        best = F.max(F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_order"), *[c for c in names if c not in KEY])).alias("r")
        new = rows.groupBy(*KEY).agg(best).select(*[F.col(c) if c in KEY else F.col(f"r.{c}") for c in names])
        new = stored(new.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")), "merge")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
        if not touched:
            return
        now = self.versions(before=number)
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in KEY]
        kept = self._buckets({b: v for b, v in now.items() if b in touched}).alias("o").join(new.alias("n"), same, "left_anti")
        kept = kept.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))
        kept.unionByName(new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        listed = [(b, number if b in touched else now[b]) for b in sorted({*now, *touched})]
        self.spark.createDataFrame(listed, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={number}")


def merge_stream(table: MergedTable, source: str, order: str, checkpoint: str) -> StreamingQuery:
    """Merges rows that arrive as Parquet below source, batch by batch; progress lives in the checkpoint."""
    schema = StructType(table.schema.fields)
    if order not in schema.names:
        schema = schema.add(order, "long")
    stream = table.spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, number: table.merge(df, number, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
