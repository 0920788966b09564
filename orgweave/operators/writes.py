"""Keyed writes as table-in, table-out operators.

Plain files have no MERGE; each operator returns the new content of the table,
to be written next to the old one or over a partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.partitioning import first_n_per_key


def upsert_latest(base: DataFrame, changes: DataFrame | None, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key of both tables by ``order``; changes win ties.

    ``base`` has one row per key (without ``changes`` it is reduced to that). The
    changes are cut to one row per key first. The base meets them in two joins whose other side is the
    change set: it is broadcast when small, and then only base rows whose keys are changed move.
    """
    if changes is None:
        return first_n_per_key(base, keys, [F.col(order).desc()])
    latest = first_n_per_key(changes, keys, [F.col(order).desc()])
    newer = latest.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(order).alias("_c_at"))
    older = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(order).alias("_b_at"))
    changed = reduce(and_, [F.col(f"_b_{k}").eqNullSafe(F.col(f"_c_{k}")) for k in keys])
    older = older.join(newer, changed, "left_semi")
    # a missing order value is older than any other
    loses = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]) & (
        F.col(order).isNull() | F.coalesce(F.col("_c_at") >= F.col(order), F.lit(False)))
    beats = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]) & F.col("_b_at").isNotNull() & ~F.coalesce(
        F.col(order) >= F.col("_b_at"), F.lit(False))
    return base.join(newer, loses, "left_anti").unionByName(latest.join(older, beats, "left_anti"))


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Base plus the first new row of every key the base lacks."""
    fresh = first_n_per_key(rows, keys, [order]).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh)


def partial_update(base: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str],
                   stamp: Column | None = None, stamp_field: str = "updated_at") -> DataFrame:
    """Overwrite the fields a patch row sets (non-null); stamp touched rows.

    ``patch`` has at most one row per key.
    """
    p = patch.select(*keys, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    out = base.join(p, list(keys), "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_p_{f}"), F.col(f)))
    if stamp is not None:
        out = out.withColumn(stamp_field, F.when(F.col("_hit"), stamp).otherwise(F.col(stamp_field)))
    return out.drop("_hit", *[f"_p_{f}" for f in fields])


def delete_by_key(base: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return base.join(keys.select(*on), list(on), "left_anti")


def cascade_delete(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame,
                   key: str) -> dict[str, DataFrame]:
    """Delete parents and their child rows; ``children`` maps a name to (table, foreign key column)."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    out = {"parent": parent.join(ids, F.col(key) == F.col("_gone"), "left_anti")}
    for name, (child, fk) in children.items():
        out[name] = child.join(ids, child[fk] == F.col("_gone"), "left_anti")
    return out


def merge_crawl_state(state: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Apply one crawl update per domain; unset fields stay, completion is stamped, new domains are added."""
    fields = ["visited_urls", "visited_hashes", "is_complete", "pages_crawled"]
    s = state.select("domain", *[F.col(f).alias(f"_s_{f}") for f in fields],
                     F.col("started_at").alias("_s_started"), F.col("completed_at").alias("_s_completed"),
                     F.lit(True).alias("_old"))
    joined = s.join(updates.select("domain", *fields), "domain", "full_outer")
    none = F.array().cast("array<string>")
    is_new = F.col("_old").isNull()
    empty = {"visited_urls": none, "visited_hashes": none, "is_complete": F.lit(False), "pages_crawled": F.lit(0)}
    # a domain without a state starts with zero pages whatever the update says
    new_value = lambda f: empty[f] if f == "pages_crawled" else F.coalesce(F.col(f), empty[f])
    return joined.select(
        "domain",
        *[F.when(is_new, new_value(f)).otherwise(F.coalesce(F.col(f), F.col(f"_s_{f}"))).alias(f) for f in fields],
        F.when(is_new, now).otherwise(F.col("_s_started")).alias("started_at"),
        F.when(~is_new & F.coalesce(F.col("is_complete"), F.lit(False)), now).otherwise(F.col("_s_completed"))
        .alias("completed_at"))


def backfill_relevance(df: DataFrame) -> DataFrame:
    """Mark extracted rows that are still pending as relevant."""
    hit = F.col("extracted_at").isNotNull() & (F.col("relevance_status") == "pending")
    return df.withColumn("relevance_status", F.when(hit, F.lit("relevant")).otherwise(F.col("relevance_status")))


def set_decision(vetting: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (domain, decision) rows to the vetting table."""
    return partial_update(vetting, decisions, ["domain"], ["decision"])


def decisions_without_row(vetting: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(vetting.select("domain"), "domain", "left_anti")


def expire_rows(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Keep rows no older than ``days``."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def whitelist_domain(listed: DataFrame, profile_mails: DataFrame, reason: str, order: str) -> DataFrame:
    """Add every address of a domain's profile to the list, once."""
    rows = profile_mails.select("email", F.lit(reason).alias("reason"), "domain", order)
    return insert_if_absent(listed, rows, ["email"], order)


def guarded_transition(df: DataFrame, allowed: Sequence[str], target: str, only: DataFrame | None = None,
                       on: Sequence[str] = (), status: str = "status") -> DataFrame:
    """Move rows in an allowed status to ``target``; with ``only``, just rows matching its keys."""
    hit = F.col(status).isin(list(allowed)) if allowed else F.lit(True)
    if only is not None:
        chosen = only.select(*on).distinct().withColumn("_chosen", F.lit(True))
        df = df.join(chosen, list(on), "left")
        hit = hit & F.col("_chosen").isNotNull()
    out = df.withColumn(status, F.when(hit, F.lit(target)).otherwise(F.col(status)))
    return out.drop("_chosen") if only is not None else out
