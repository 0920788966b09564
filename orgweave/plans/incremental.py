"""Incremental embedding of arriving chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orgweave.partitioning import first_n_per_key
from orgweave.plans.retrieval import TEXT_ROWS, Embedder, embed_batches, hashing_embedder
from orgweave.plans.seen import SeenIndex, content_key
from orgweave.session import arrow_rows, has_path
from orgweave.streaming.events import drain

STORED = ("chunk_id string, domain string, content string, seq long, content_hash string, embedding array<float>, "
          "embedded_at timestamp, batch_id long, part string")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def seen_index(spark: SparkSession, path: str, **sizes: int) -> SeenIndex:
    """The index of the contents stored under ``path``, in a folder beside it."""
    def stored_keys(first: int, end: int) -> DataFrame:
        # by folder: the other batches are not even listed
        folders = [f for f in (f"{path}/batch_id={b}" for b in range(first, end)) if has_path(spark, f)]
        rows = spark.read.schema(STORED).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], STORED)
        return rows.select(content_key("domain", "content_hash").alias("key"))

    return SeenIndex(spark, f"{path.rstrip('/')}-seen", stored_keys, **sizes)


def embed_stream(chunks: DataFrame, path: str, checkpoint: str, embed: Embedder = hashing_embedder,
                 **sizes: int) -> StreamingQuery:
    """Per micro-batch: embed only unseen contents, append them, stamp embedded_at.

    ``chunks``: chunk_id, domain, content, seq. Each batch owns one folder, so
    a batch that is run again after a failure replaces its own output. Whether a
    content is stored already is asked of the index beside the store, which reads
    filters and the few parts that may hold it. ``sizes`` go to the index.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = seen_index(spark, path, **sizes)
        index.clean(batch_id)
        hashed = batch.withColumn("content_hash", F.sha2("content", 256))
        fresh = first_n_per_key(hashed, ["domain", "content_hash"], ["seq"]).withColumns({
            "part": F.substring("content_hash", 1, 2), "key": content_key("domain", "content_hash")}).persist()
        new = fresh
        if batch_id > 0:
            seen, _ = index.seen(fresh.select("key"), batch_id)
            new = fresh.join(seen, "key", "left_anti")
        # one file per part and batch
        done = embed_batches(new.drop("key").repartition("part"), embed).withColumn("embedded_at", F.current_timestamp())
        with arrow_rows(spark, TEXT_ROWS):
            done.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch_id={batch_id}")
        index.add(batch_id, index.stored_keys(batch_id, batch_id + 1))
        fresh.unpersist()

    return drain(chunks, path, checkpoint, each=write)
