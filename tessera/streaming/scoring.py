"""Incremental scoring: new units are scored once, batch by batch, with the model joined as a table.

The batch operators have no streams of their own; this wraps them so that files
of events that arrive later are scored as they come. Progress lives in the
stream's checkpoint, and a unit's rows are keyed, so a repeated batch replaces
its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts per key and time window of a stream, late rows up to the watermark included."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def score_stream(spark: SparkSession, source: str, schema: str, cells: DataFrame, digits: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Scores rows that arrive as Parquet below source by a cell table (d, level, frac); each batch goes to its own folder of out."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        long = df.select("unit", "i", F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("level")) for d in digits])))
        scored = long.join(cells, ["d", "level"], "left").groupBy("unit", "i").agg(F.sum(F.coalesce("frac", F.lit(0.0))).alias("score"))
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
