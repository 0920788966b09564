"""The registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import (chat, conversation_repair, jaccard_join, license_scan, mixing, packing, periodic_runs,
                          quality_classifier, quality_rules, sharding, token_counts, topk_search, toxicity)
from orgweave.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # long texts: small Arrow batches
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
with d as (select row_number() over () rid, doc_id, coalesce(source, chr(0)) host, coalesce(text, '') t from documents),
w as (select rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) pos from d),
wc as (select rid, count(*) n_words, sum(length(word)) word_chars from w group by rid),
win as (select rid, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o g from w window o as (partition by rid order by pos)),
rep as (select rid, pos from (select rid, pos, count(*) over (partition by rid, g) c from win where g is not null) where c > 1),
rw as (select rid, count(distinct p) n from (select rid, unnest([pos, pos + 1, pos + 2]) p from rep) group by rid),
l as (select rid, unnest(string_split(t, chr(10))) line from d),
dup as (select rid, count(*) - count(distinct line) n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
nl as (select distinct host, t, rid, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) line from l join d using (rid)),
texts as (select host, count(distinct t) docs from d group by host),
common as (select host, line from (select host, line, count(distinct t) n from nl where line <> '' group by host, line)
  join texts using (host) where n > 20 and n > 0.1 * docs),
tot as (select rid, count(*) n_lines, sum(length(line) - length(replace(line, ' ', '')) + 1) words from nl where line <> '' group by rid),
gone as (select rid, count(*) n, sum(length(line) - length(replace(line, ' ', '')) + 1) words from nl join common using (host, line) group by rid),
j as (select doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(word_chars, 0)::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines,
  coalesce(rw.n, 0)::bigint n_repeat_words, coalesce(tot.n_lines, 0)::int n_lines, coalesce(gone.n, 0)::int removed_lines,
  coalesce(gone.words, 0)::bigint removed_words, coalesce(tot.words, 0) total
  from d left join wc using (rid) left join rw using (rid) left join dup using (rid) left join tot using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, removed_lines, removed_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
  (removed_words > 0 and total - removed_words < 0.2 * total) depleted,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and not (removed_words > 0 and total - removed_words < 0.2 * total) kept
from j
"""


@query("op2_line_frequency", OP2_SQL)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.line_frequency(docs).select("doc_id", *quality_rules.RESULTS)


@query("op5_byte_prefix_shards")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs).select("doc_id", *sharding.RESULTS)


@query("op7_residual_packing")
def op7(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_pu_quality")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_classifier.RESULTS)


@query("op4_license_notices")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", *license_scan.RESULTS)


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""


@query("op8_pivot_topk", OP8_SQL)
def op8(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.search(vectors, F.col("vec_id") % 100 == 0)


OP9_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, regexp_matches(t, '\\[\\\[<>]|\[/?INST\]|</?s>|<<SYS |<</SYS>>') hard from c),
f as (select *, length(t) + case when hard then length(regexp_replace(t, '[^\\\[<]', '', 'g')) else 0 end
    + case r when 'user' then 15 when 'assistant' then 9 else 18 + length(r) end n from m)
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  sum(n)::bigint formatted_chars
from f group by conv_id
"""


@query("op9_round_trip_chat", OP9_SQL)
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(chat.planted(spark))))


@query("op1_pfair_mix")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", *mixing.RESULTS)


OP10_SQL = r"""
with recursive d as (select doc_id, array_to_string(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') w from documents),
t as (select w, min(doc_id) copy_id, string_split(w, ' ') l from d where w <> '' group by w),
s as (select distinct copy_id, unnest(case when len(l) < 5 then [w] else
    list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end) g from t),
n as (select copy_id, count(*) n from s group by copy_id),
p as (select a.copy_id x, b.copy_id y, count(*) c from s a join s b on a.g = b.g and a.copy_id < b.copy_id group by all),
k as (select x, y from p join n a on x = a.copy_id join n b on y = b.copy_id where 10000 * c >= 8000 * (a.n + b.n - c)),
e as (select x, y from k union select y, x from k),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select doc_id, coalesce(least(c.copy_id, m.y), c.copy_id) class_id, c.copy_id, coalesce(f.n, 0)::bigint n_links
from d join (select w, min(doc_id) copy_id from d group by w) c using (w)
left join (select x, min(y) y from r group by x) m on m.x = c.copy_id
left join (select x, count(*) n from e group by x) f on f.x = c.copy_id
"""


@query("op10_bayes_jaccard", OP10_SQL)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_classes(docs).select("doc_id", "class_id", "copy_id", "n_links")


@query("op6_separator_scan")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.document_counts(docs).select("doc_id", "n_tokens")


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.detect_runs(periodic_runs.plant(docs)))


@query("op12_lattice_repair")
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.with_empty(conversation_repair.reports(conversation_repair.damage(rows)), rows)


@query("op13_boosted_toxicity")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", *toxicity.RESULTS)


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
