"""Keyed writes."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.operators import writes as ops


@query("k1_upsert_latest", """select user_id, event_type, event_id, value from (select *, row_number() over (partition by
  user_id, event_type order by event_id desc) as rn from events) where rn = 1""")
def k1(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    base, changes = ev.where("event_type <> 'click' or value < 20"), ev.where("event_type = 'click' and value >= 20")
    stored = ops.upsert_latest(base, None, ["user_id", "event_type"], "event_id")
    return ops.upsert_latest(stored, changes, ["user_id", "event_type"], "event_id")


@query("k2_insert_if_absent", """with b as (select user_id, min(event_id) as event_id from events where event_type = 'view'
  group by 1), n as (select user_id, min(event_id) as event_id from events group by 1)
select user_id, event_id from b union all select user_id, event_id from n where user_id not in (select user_id from b)""")
def k2(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type")
    base = ev.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return ops.insert_if_absent(base, ev.select("user_id", "event_id"), ["user_id"], "event_id")


@query("k3_partial_update", f"""with p as (select l_orderkey, max(l_quantity) as q, case when max(l_quantity) > 40 then
  'patched' end as note from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, coalesce(q, o_totalprice) as o_totalprice, coalesce(note, o_orderstatus) as o_orderstatus,
  case when q is not null then epoch_us(timestamp '{st.NOW}') else epoch_us(o_orderdate) end as updated_us
from orders left join p on l_orderkey = o_orderkey""")
def k3(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus",
                                            F.col("o_orderdate").alias("updated_at"))
    patch = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_quantity").alias("o_totalprice")).withColumn(
        "o_orderstatus", F.when(F.col("o_totalprice") > 40, F.lit("patched")))
    out = ops.partial_update(base, patch, ["o_orderkey"], ["o_totalprice", "o_orderstatus"],
                             F.lit(st.NOW).cast("timestamp"))
    return out.select("o_orderkey", "o_totalprice", "o_orderstatus", F.unix_micros("updated_at").alias("updated_us"))


@query("k4_delete_by_key", """select o_orderkey, o_custkey from orders where o_custkey not in
  (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def k4(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ops.delete_by_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("k5_cascade_delete", """with gone as (select o_orderkey from orders where o_orderpriority = '1-URGENT')
select 'parent' as tbl, count(*) as n, sum(o_orderkey)::bigint as keys from orders
where o_orderkey not in (select * from gone)
union all select 'products', count(*), sum(l_orderkey)::bigint from lineitem
where l_orderkey not in (select * from gone)""")
def k5(spark, d):
    orders = table(spark, d, "orders")
    left = ops.cascade_delete(orders, {"products": (table(spark, d, "lineitem"), "l_orderkey")},
                              orders.where("o_orderpriority = '1-URGENT'"), "o_orderkey")
    count = lambda name, key: left[name].agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(
        F.lit(name).alias("tbl"), "n", "keys")
    return count("parent", "o_orderkey").unionByName(count("products", "l_orderkey"))


@query("k6_merge_crawl_state", f"""with s as (select 'd' || c_custkey as domain, ['u' || c_nationkey] as visited,
  c_acctbal > 5000 as done, c_nationkey as pages from customer where c_nationkey < 20),
u as (select 'd' || c_custkey as domain, case when c_nationkey > 5 then ['v', 'w'] end as visited,
  case when c_nationkey > 10 then c_nationkey > 15 end as done, case when c_nationkey > 8 then 99 end as pages
  from customer where c_nationkey > 3)
select coalesce(s.domain, u.domain) as domain,
  array_to_string(case when s.domain is null then coalesce(u.visited, []) else coalesce(u.visited, s.visited) end, '|')
    as visited,
  case when s.domain is null then coalesce(u.done, false) else coalesce(u.done, s.done) end as is_complete,
  case when s.domain is null then 0 else coalesce(u.pages, s.pages) end as pages_crawled,
  s.domain is not null and coalesce(u.done, false) as stamped_done, s.domain is null as stamped_start
from s full join u on s.domain = u.domain""")
def k6(spark, d):
    nation = F.col("c_nationkey")
    c = table(spark, d, "customer").withColumn("domain", F.concat(F.lit("d"), F.col("c_custkey")))
    none = F.lit(None)
    state = c.where(nation < 20).select(
        "domain", F.array(F.concat(F.lit("u"), nation)).alias("visited_urls"),
        F.array(F.lit("h")).alias("visited_hashes"), (F.col("c_acctbal") > 5000).alias("is_complete"),
        nation.alias("pages_crawled"), none.cast("timestamp").alias("started_at"),
        none.cast("timestamp").alias("completed_at"))
    updates = c.where(nation > 3).select(
        "domain", F.when(nation > 5, F.array(F.lit("v"), F.lit("w"))).alias("visited_urls"),
        none.cast("array<string>").alias("visited_hashes"), F.when(nation > 10, nation > 15).alias("is_complete"),
        F.when(nation > 8, F.lit(99)).alias("pages_crawled"))
    out = ops.merge_crawl_state(state, updates, F.lit(st.NOW).cast("timestamp"))
    return out.select("domain", F.array_join("visited_urls", "|").alias("visited"), "is_complete", "pages_crawled",
                      F.col("completed_at").isNotNull().alias("stamped_done"),
                      F.col("started_at").isNotNull().alias("stamped_start"))


@query("k7_backfill_relevance", """select o_orderkey, case when o_totalprice > 100000 and o_orderstatus = 'P' then
  'relevant' else case o_orderstatus when 'P' then 'pending' else o_orderstatus end end as relevance_status from orders""")
def k7(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_orderdate")).alias("extracted_at"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus")).alias("relevance_status"))
    return ops.backfill_relevance(df).drop("extracted_at")


@query("k8_set_vetting_decision", """with v as (select s_suppkey as id, 's' || s_suppkey as domain, 'NO' as decision
  from supplier), x as (select 's' || c_custkey as domain from customer where c_nationkey < 10)
select domain, case when domain in (select domain from x) then 'YES' else 'NO' end as decision, true as known from v
union all select domain, 'YES', false from x where domain not in (select domain from v)""")
def k8(spark, d):
    vetting = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("domain"),
                                                 F.lit("NO").alias("decision"))
    decisions = table(spark, d, "customer").where("c_nationkey < 10").select(
        F.concat(F.lit("s"), F.col("c_custkey")).alias("domain"), F.lit("YES").alias("decision"))
    return ops.set_decision(vetting, decisions).withColumn("known", F.lit(True)).unionByName(
        ops.decisions_without_row(vetting, decisions).withColumn("known", F.lit(False)))


@query("k9_expire_rows", f"""select event_id from events
where ts >= timestamp '{st.NOW}' - interval 12 day""")
def k9(spark, d):
    return ops.expire_rows(table(spark, d, "events"), "ts", F.lit(st.NOW).cast("timestamp"), 12).select("event_id")


@query("k11_guarded_transition", f"""with {st.JOBS}, chosen as (select distinct o_custkey from orders
  where o_totalprice > 400000)
select id, case when status in ('queued', 'running') then 'cancelled' else status end as cancelled,
  case when status in ('queued') and user_id in (select * from chosen) then 'generating' else status end as selected
from jobs""")
def k11(spark, d):
    jobs = st.jobs(spark, d).select("id", "user_id", "status")
    chosen = st.jobs(spark, d).where("amount > 400000").select("user_id")
    a = ops.guarded_transition(jobs, ["queued", "running"], "cancelled").select("id", F.col("status").alias("cancelled"))
    b = ops.guarded_transition(jobs, ["queued"], "generating", chosen, ["user_id"]).select(
        "id", F.col("status").alias("selected"))
    return a.join(b, "id")
