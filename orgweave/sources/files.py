"""Reading and writing the landed tables and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.urls import url_host
from orgweave.operators.ordering import paginate
from orgweave.partitioning import first_n_per_key


LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def scan_pages(pages: DataFrame, domain: str, limit: int, order: str = "page_id") -> DataFrame:
    """Pages of one domain in page order, at most ``limit``."""
    return paginate(pages.where(F.col("domain") == domain), [order], limit=limit)


def scan_homepage(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """The depth-0 page of each domain."""
    return first_n_per_key(pages.where("depth = 0"), ["domain"], [order])


def scan_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines, gzipped or not; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def page_counts_gz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages per domain of a gzipped page log."""
    return scan_jsonl(spark, path, schema).groupBy("domain").agg(F.count("*").alias("pages"))


def append_log(df: DataFrame, path: str) -> None:
    """Append records to a JSON-lines log."""
    df.write.mode("append").option("timestampFormat", LOG_TIME).json(path)


def write_pages_gz(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pages as gzipped JSON lines without their links."""
    (pages.drop("links").write.mode(mode).option("compression", "gzip").option("timestampFormat", LOG_TIME).json(path))


def bulk_insert(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_domains(df: DataFrame, path: str, key: str = "domain") -> None:
    """Delete-then-insert per domain: only the partitions present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))


def build_global_index(companies: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all_companies with product counts, all_products) for export."""
    counts = products.groupBy("domain").agg(F.count("*").alias("products_count"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    all_companies = companies.join(counts, "domain", "left").select(
        "domain", text("company"), "email", F.coalesce("products_count", F.lit(0)).alias("products_count"))
    fields = ("product_id", "brand", "name", "category", "price", "url")
    return all_companies, products.select("domain", *[text(c) for c in fields])


ITEMS_SHAPE = "struct<items:array<struct<title:string,link:string,snippet:string>>>"
PAGES_SHAPE = "struct<webPages:struct<value:array<struct<name:string,url:string,snippet:string>>>>"


def serp_results(payloads: DataFrame) -> DataFrame:
    """Flatten landed search payloads (query, payload) of both vendor shapes.

    ``seq`` orders the results of a payload row; results without a host are dropped.
    """
    def shape(hits: Column, title: str, url: str, source: str) -> DataFrame:
        rows = payloads.select(*[c for c in payloads.columns if c != "payload"], F.posexplode(hits).alias("rank", "hit"))
        out = rows.select(*[c for c in rows.columns if c != "hit"], url_host(F.col(f"hit.{url}")).alias("domain"),
                          F.col(f"hit.{url}").alias("url"), F.coalesce(f"hit.{title}", F.lit("")).alias("title"),
                          F.coalesce("hit.snippet", F.lit("")).alias("snippet"), F.lit(source).alias("source"))
        return out.where(F.coalesce("domain", F.lit("")) != "")

    google = shape(F.from_json("payload", ITEMS_SHAPE)["items"], "title", "link", "google")
    bing = shape(F.from_json("payload", PAGES_SHAPE)["webPages"]["value"], "name", "url", "bing")
    return google.unionByName(bing)


EXPORT_COLUMNS = ["sent_at", "domain", "recipient", "subject_line", "campaign_id", "status", "message_id"]


def recent_sends(sends: DataFrame, limit: int, order: str = "seq") -> DataFrame:
    """The last ``limit`` log rows with the display columns, in log order."""
    last = sends.orderBy(F.col(order).desc()).limit(limit)
    return last.orderBy(order).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS])


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
