"""Structured Streaming forms: daily windows, the embedding queue's drain. Pacing by domain is batch only (operators.corpus.schedule)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import process
from ..tables import shared_dir

#: Numbers of the small and the large vector.
DIM, LARGE = 384, 1024


def shared(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def hashed(text: str | None, dim: int) -> list[float]:
    """Hashing-trick unit vector: a stand-in for an embedding service, the same on every run."""
    v = [0.0] * dim
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def embedder(dim: int = DIM, service: Callable[[list[str], int], list[list[float]]] | None = None):
    """A function of text columns, batch by batch, to vectors of dim numbers; any other length is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = service(list(texts), dim) if service else [hashed(t, dim) for t in texts]
        if any(len(v) != dim for v in out):
            raise ValueError(f"the service gave vectors of other than {dim} numbers")
        return pd.Series(out)

    return run


embed = embedder()


def dual(text: Column) -> Column:
    """small and large vectors of a text."""
    return F.struct(embedder(DIM)(text).alias("small"), embedder(LARGE)(text).alias("large"))


def read_events(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls by day and type from a stream with a day's watermark; the last state of each window is kept."""
    out = shared(spark)
    agg = read_events(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(F.to_date("window.start").alias("day"), "event_type", "n").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/data/batch={epoch}")

    q = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("day date, event_type string, n long, epoch int").parquet(f"{out}/data")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "epoch").alias("n"))


def _drain(spark: SparkSession, sf_dir: str, out: str):
    """A writer of drained jobs: pending ones are embedded, and completed, failed or put back. Each micro-batch overwrites
    its own folder, so a repeated batch leaves the same rows. The stand-in service embeds every second document only.
    """
    from ..plans.adapters import NOW, VIEWS

    jobs = read_events(spark, sf_dir)

    def write(batch: DataFrame, epoch: int) -> None:
        view = f"events_{uuid.uuid4().hex}"
        batch.createOrReplaceTempView(view)
        q = batch.sparkSession.sql(VIEWS["queue"].replace("FROM events", f"FROM {view}"))
        text = F.when(F.col("message") != "bad input", F.concat_ws(" ", F.lit("document"), F.col("document_id").cast("string")))
        q = q.withColumn("vector", F.when((F.col("status") == "pending") & text.isNotNull() & (F.col("document_id") % 2 == 0), embed(text)))
        done = process(q, F.coalesce(F.size("vector") == DIM, F.lit(False)), F.col("message"), F.expr(NOW))
        done.select("id", "status", "attempts").write.mode("overwrite").parquet(f"{out}/data/batch={epoch}")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state")


def auto_process(spark: SparkSession, sf_dir: str, seconds: int = 30):
    """The running query that drains the queue on an interval until it is stopped."""
    return _drain(spark, sf_dir, shared(spark)).trigger(processingTime=f"{seconds} seconds").start()


def drain_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after one drain of all there are."""
    out = shared(spark)
    _drain(spark, sf_dir, out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long, status string, attempts int").parquet(f"{out}/data").select("id", "status", "attempts")
