"""The flagship query: hash, first page per hash, count per source, first page of the list."""

from pyspark.sql import functions as F

from orgweave.catalog.base import query, table
from orgweave.operators.ordering import paginate
from orgweave.partitioning import first_n_per_key


@query("minimum_slice", """
with firsts as (select source, sha256(text) as content_hash, min(doc_id) as doc_id from documents
  group by source, sha256(text))
select source, count(*) as unique_pages, min(doc_id) as first_page from firsts group by source
order by unique_pages desc, source limit 10""")
def minimum_slice(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    firsts = first_n_per_key(docs, ["source", "content_hash"], ["doc_id"])
    counted = firsts.groupBy("source").agg(F.count("*").alias("unique_pages"), F.min("doc_id").alias("first_page"))
    return paginate(counted, [F.col("unique_pages").desc(), F.col("source")], limit=10)
