"""Counts, statistics and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import parse_price
from orgweave.operators.folds import consecutive_failures
from orgweave.partitioning import first_n_per_key, nest_pages, position


def dashboard_stats(companies: DataFrame, contact_counts: DataFrame) -> DataFrame:
    """Per owner: companies, companies with contacts, contacts in total."""
    n = F.coalesce("n_contacts", F.lit(0))
    return companies.join(contact_counts, "id", "left").groupBy("owner").agg(
        F.count("*").alias("companies"), F.count_if(n > 0).alias("with_contacts"), F.sum(n).alias("total_contacts"))


def companies_with_score(companies: DataFrame) -> DataFrame:
    return companies.groupBy("owner").agg(F.count_if(F.col("contact_score") > 0).alias("with_score"))


def simple_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def collection_stats(collections: dict[str, DataFrame], domains: DataFrame) -> DataFrame:
    """(name, n) rows: the size of each collection and the number of distinct domains."""
    rows = domains.agg(F.countDistinct("domain").alias("n")).select(F.lit("domains").alias("name"), "n")
    for name, df in collections.items():
        rows = rows.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return rows


def distinct_domains(df: DataFrame) -> DataFrame:
    return df.select("domain").distinct().orderBy("domain")


def send_stats(sends: DataFrame) -> DataFrame:
    return sends.agg(
        F.count("*").alias("total_sent"), F.count_if(F.col("status") == "sent").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.countDistinct("domain").alias("unique_domains"),
        F.min("sent_at").alias("earliest"), F.max("sent_at").alias("latest"))


def verification_summary(results: DataFrame) -> DataFrame:
    total, valid = F.count("*"), F.count_if("is_valid")
    share = lambda n: F.when(total > 0, F.round(n * 100.0 / total, 1))
    return results.agg(total.alias("total"), valid.alias("valid"), (total - valid).alias("invalid"),
                       share(valid).alias("valid_pct"), share(total - valid).alias("invalid_pct"),
                       F.round(F.avg("seconds"), 2).alias("mean_seconds"))


def failure_reasons(results: DataFrame) -> DataFrame:
    """Histogram of reasons of the invalid results, most frequent first."""
    return (results.where(~F.col("is_valid")).groupBy(F.coalesce("reason", F.lit("Unknown")).alias("reason"))
            .agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason"))


def pricing_summary(products: DataFrame) -> DataFrame:
    """Parsed positive prices per domain: count, mean, range."""
    priced = products.withColumn("_p", parse_price(F.col("price"))).where(F.col("_p").isNotNull())
    return priced.groupBy("domain").agg(
        F.count("*").alias("product_count"), F.round(F.avg("_p"), 2).alias("average_price"),
        F.min("_p").alias("min_price"), F.max("_p").alias("max_price")).withColumn(
        "price_range", F.concat(F.col("min_price").cast("string"), F.lit(" - "), F.col("max_price").cast("string")))


def crawl_summary(results: DataFrame) -> DataFrame:
    """``results``: pages_crawled, outcome (success / skipped / failed)."""
    return results.agg(
        F.count("*").alias("total_domains"), F.count_if(F.col("outcome") == "success").alias("crawled_domains"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_domains"),
        F.count_if(F.col("outcome") == "failed").alias("failed_domains"),
        F.sum("pages_crawled").alias("total_pages"))


def discovery_summary(results: DataFrame) -> DataFrame:
    """``results``: domain, status (approved / rejected / null), saved; one row of counts."""
    return results.agg(
        F.count("*").alias("total_results"), F.countDistinct("domain").alias("unique_domains"),
        F.count("status").alias("vetted"), F.count_if(F.col("status") == "approved").alias("approved_domains"),
        F.count_if(F.col("status") == "rejected").alias("rejected_domains"),
        F.count_if("saved").alias("saved_domains"))


def execution_summary(executions: DataFrame) -> DataFrame:
    """``executions``: success, started_at, completed_at."""
    return executions.agg(
        F.count("*").alias("total_queries"), F.count_if("success").alias("successful_queries"),
        F.count_if(~F.col("success")).alias("failed_queries"),
        ((F.unix_micros(F.max("completed_at")) - F.unix_micros(F.min("started_at"))) / 1_000_000.0)
        .alias("total_duration_seconds"))


def vetting_split(vetting: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Domains by status in pages of at most ``page_size``, with the count of the status."""
    counts = vetting.groupBy("status").agg(F.count("*").alias("n"))
    return nest_pages(vetting.select("status", "seq", "domain"), ["status"], "seq", ["domain"], page_size,
                      "domains").join(counts, "status")


def campaign_rollup(drafts: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return drafts.groupBy("campaign_id").pivot("status", list(statuses)).count().fillna(0)


def bulk_send_summary(sends: DataFrame, success: Column) -> DataFrame:
    return sends.agg(F.count_if(success).alias("success_count"),
                     (F.count("*") - F.count_if(success)).alias("fail_count"))


def with_batch_position(sends: DataFrame, order: str) -> DataFrame:
    """batch_index (1-based along the unique ``order``) and batch_total."""
    total = sends.agg(F.count("*").alias("n"))
    return position(sends, [], order, "batch_index").withColumn("batch_total", total.scalar())


def source_health(accesses: DataFrame, source: str, success: Column, order: str) -> DataFrame:
    """Total, healthy and unhealthy sources after the last access of each."""
    rows = consecutive_failures(accesses, source, success, order)
    last = first_n_per_key(rows, [source], [F.col(order).desc()])
    return last.agg(F.count("*").alias("total"), F.count_if("healthy").alias("healthy"),
                    F.count_if(~F.col("healthy")).alias("unhealthy"))


def product_rollup(products: DataFrame, extracted_at: str) -> DataFrame:
    return products.groupBy("domain").agg(F.count("*").alias("products_extracted"),
                                          F.max(extracted_at).alias("extraction_date"))


def domain_relevance(companies: DataFrame, products: DataFrame) -> DataFrame:
    """Companies without a single product are irrelevant."""
    some = products.select("domain").distinct().withColumn("_some", F.lit(True))
    return companies.join(some, "domain", "left").withColumn(
        "relevance_status", F.when(F.col("_some"), F.lit("relevant")).otherwise(F.lit("irrelevant"))).withColumn(
        "relevance_reason", F.when(F.col("_some").isNull(), F.lit("No relevant products found after extraction"))
    ).drop("_some")
