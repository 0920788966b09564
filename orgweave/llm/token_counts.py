"""Token counts by a separator scan over flat, unindexed token files.

A token file is a bare run of little-endian unsigned ids, documents following
each other with an end-of-document id after each; nothing tells where they begin.
Files are read in blocks of ``block_bytes``. Within a block the separators are found
with one vectorised comparison; their distances are the lengths of the
documents that begin and end there. The first document of a block began in
an earlier one: a prefix scan over the blocks' summaries (last separator so far,
separators so far) gives its start and the number of documents before it.

Blocks are read where they lie, so one file of any size is spread over the
cluster, and only (file, block) summaries and lengths are shuffled. What a block
gave is kept as a Parquet working table in the shared folder.

Odd input: an empty file holds no document; tokens after the last separator
form a last document that is not ``closed``; a null or empty text has no tokens;
repeated rows and null ids each get a count; other input columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweave.llm.tokens import encoder, slices, tokenizer_path
from orgweave.session import stored, work_path

BLOCK_BYTES = 4 << 20
FILE_BYTES = 512 << 20
END_ID = 49407  # <|endoftext|> of the default vocabulary; its string in a text is ordinary text here

_BLOCKS = "file string, block long, tokens long, separators long, last_end long, lengths array<long>"


def _open(path: str, mode: str):
    """A stream of a path that the executors share: a local or mounted folder, or any store pyarrow knows."""
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


def write_token_files(docs: DataFrame, folder: str, end_id: int = END_ID, dtype: str = "<u2",
                      file_bytes: int = FILE_BYTES, path: str | None = None) -> DataFrame:
    """Write the texts as flat token files; returns (file, ordinal, doc_id), stored.

    A task that runs again writes files of another name, so the table returned,
    and not the folder, tells which files hold the data.
    """
    vocabulary = path or tokenizer_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary, plain_specials=True)
        end = np.array([end_id], dtype=dtype).tobytes()
        out, name, written, ordinal = None, "", 0, 0
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].astype("Int64")
            for part in slices(texts):
                names, ordinals = [], []
                for raw in coder.encode(texts[part]):
                    if out is None or written >= file_bytes:
                        if out:
                            out.close()
                        name, written, ordinal = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                        out = _open(name, "w")
                    own = np.frombuffer(raw, dtype="<u4").astype(dtype).tobytes() + end
                    out.write(own)
                    written += len(own)
                    names.append(name)
                    ordinals.append(ordinal)
                    ordinal += 1
                yield pd.DataFrame({"file": names, "ordinal": ordinals, "doc_id": ids.iloc[part].array})
        coder.rest()
        if out:
            out.close()

    return stored(docs.select("doc_id", "text").mapInPandas(run, "file string, ordinal long, doc_id long"), "token-rows")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size) of a folder of token files; Spark lists it and reads no content."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def scan_blocks(files: DataFrame, end_id: int = END_ID, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of every (file, size)."""
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("a block holds whole ids")
    places = files.where("size > 0").select(
        "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, size, at in zip(pdf["file"], pdf["size"].tolist(), pdf["at"].tolist(), strict=True):
                with _open(file, "r") as f:
                    f.seek(at)
                    raw = f.read(min(block_bytes, size - at) // width * width)
                ids = np.frombuffer(raw, dtype=dtype)
                ends = np.flatnonzero(ids == end_id)
                # the first length is up to the first separator; the scan adds what earlier blocks hold of it
                lengths = np.diff(ends, prepend=-1) - 1
                yield pd.DataFrame({"file": [file], "block": [at // block_bytes], "tokens": [len(ids)],
                                    "separators": [len(ends)], "last_end": [int(ends[-1]) if len(ends) else None],
                                    "lengths": [lengths]}).astype({"last_end": "Int64"})

    # blocks of one file go to different tasks
    return places.repartition("file", "at").mapInPandas(run, _BLOCKS)


def count_documents(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document, from stored block rows."""
    summary = blocks.select("file", "block", "tokens", "separators", "last_end")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))
    summary = summary.withColumn("start", start).withColumn("end", F.col("start") + F.col("last_end"))
    scanned = summary.select(
        F.col("file").alias("f"), F.col("block").alias("b"), "start", "separators", "tokens",
        F.coalesce(F.sum("separators").over(before), F.lit(0).cast("long")).alias("ordinal0"),
        F.coalesce(F.max("end").over(before), F.lit(-1).cast("long")).alias("open_from"),
        F.max("end").over(W.partitionBy("file")).alias("final"),
        F.sum("tokens").over(W.partitionBy("file")).alias("all"), F.sum("separators").over(W.partitionBy("file")).alias("n"),
        F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull().alias("ends_file"))
    joined = blocks.select("file", "block", "lengths").join(
        scanned, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    closed = joined.select("file", "ordinal0", "start", "open_from", F.posexplode("lengths").alias("k", "length")).select(
        "file", (F.col("ordinal0") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("length") + F.col("start") - F.col("open_from") - 1).otherwise(
            F.col("length")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = F.col("all") - F.coalesce("final", F.lit(-1)) - 1
    open_ = scanned.where("ends_file").where(rest > 0).select(
        F.col("f").alias("file"), F.col("n").alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(open_)


def count_tokens(files: DataFrame, end_id: int = END_ID, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Token counts of all documents in (file, size) token files."""
    return count_documents(stored(scan_blocks(files, end_id, dtype, block_bytes), "token-blocks"))


def document_counts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens of every row, by way of flat token files in the shared folder."""
    spark = docs.sparkSession
    folder = work_path(spark, "token-files")
    rows = write_token_files(docs, folder)
    names = rows.select("file").distinct()
    if not rows.take(1):
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    tail = F.element_at(F.split("file", "/"), -1)
    files = token_files(spark, folder).withColumn("name", tail).join(
        names.select(tail.alias("name")), "name", "left_semi")
    counts = count_tokens(files.select("file", "size"), block_bytes=block_bytes).withColumn("name", tail).drop("file")
    own = rows.select(tail.alias("name"), "ordinal", "doc_id")
    return own.join(counts, ["name", "ordinal"]).select("doc_id", "n_tokens")
