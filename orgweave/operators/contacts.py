"""Contact rows: best per value, list membership, merged enrichment results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import contacts as C
from orgweave.partitioning import first_n_per_key


def dedup_contacts(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Best confidence per (scope, type, lower-case value); the earliest ``seq`` wins ties."""
    keys = [*(scope or []), "type", F.lower("value")]
    return first_n_per_key(df, keys, [F.col("confidence").desc(), F.col("seq")])


def list_membership(mails: DataFrame, whitelist: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Add ``listed``: valid on the whitelist, else invalid on the blacklist, else null."""
    mark = lambda df, name: df.select(F.trim(F.lower("email")).alias("_key"), F.lit(True).alias(name)).distinct()
    keyed = mails.withColumn("_key", F.trim(F.lower("email")))
    joined = keyed.join(mark(whitelist, "_white"), "_key", "left").join(mark(blacklist, "_black"), "_key", "left")
    return joined.withColumn("listed", F.when(F.col("_white"), F.lit("valid")).when(
        F.col("_black"), F.lit("invalid"))).drop("_key", "_white", "_black")


def verify_mails(mails: DataFrame, whitelist: DataFrame, blacklist: DataFrame, check_smtp: bool = True) -> DataFrame:
    """Verdict per address; ``mails`` carries mx_found and smtp_result (null = blocked)."""
    listed = list_membership(mails, whitelist, blacklist)
    verdict = C.email_verdict(F.col("email"), F.col("listed") == "valid", F.col("listed") == "invalid",
                              F.col("mx_found"), F.col("smtp_result"), check_smtp)
    return listed.withColumn("_v", verdict).select(
        *mails.columns, F.col("_v.is_valid").alias("is_valid"), F.col("_v.reason").alias("reason"))


def contact_counts(contacts: DataFrame, socials: DataFrame, key: str = "domain") -> DataFrame:
    """Tier and notes per key out of contact rows (key, type) and social rows (key, platform, url)."""
    kind = F.col("type")
    counted = contacts.groupBy(key).agg(
        F.count_if(kind == "whatsapp").alias("whatsapp"), F.count_if(kind == "phone").alias("phones"),
        F.count_if(kind.contains("individual")).alias("people"),
        F.count_if(kind.contains("company")).alias("companies"),
        F.count_if(kind.startswith("linkedin")).alias("linkedin"))
    # one row per known platform survives the distinct, so the list stays short
    platforms = (socials.where(F.coalesce("url", F.lit("")) != "").select(key, "platform").distinct()
                 .groupBy(key).agg(F.array_sort(F.collect_set("platform")).alias("platforms")))
    joined = counted.join(platforms, key, "full_outer")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("whatsapp", "phones", "people", "companies", "linkedin")}
    names = F.coalesce("platforms", F.array().cast("array<string>"))
    return joined.select(
        key, *[v.alias(c) for c, v in zero.items()], F.size(names).cast("long").alias("socials"),
        C.contact_tier(zero["whatsapp"], zero["phones"], zero["linkedin"], F.size(names)).alias("contact_score"),
        C.contact_notes(zero["whatsapp"], zero["phones"], zero["people"], zero["companies"], names).alias("notes"))


def merge_enrichment(contacts: DataFrame, socials: DataFrame, key: str = "domain") -> dict[str, DataFrame]:
    """Merge the results of several sources.

    ``contacts``: key, kind (phones / whatsapp / linkedin list), type, value,
    confidence, source, seq. ``socials``: key, platform, url, source, seq.
    Returns merged contacts, socials, the sources per key and the rescored row.
    """
    best = first_n_per_key(contacts, [key, "kind", F.lower("value")], [F.col("confidence").desc(), "seq"])
    last = first_n_per_key(socials, [key, "platform"], [F.col("seq").desc()])
    sources = contacts.select(key, "source").unionByName(socials.select(key, "source")).distinct()
    return {"contacts": best, "socials": last, "sources": sources, "summary": contact_counts(best, last, key)}
