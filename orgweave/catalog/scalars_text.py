"""Text, JSON and number functions."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.functions import contacts, scores, text, urls


@query("f10_sha256_text", "select doc_id, sha256(text) as content_hash from documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha256_text(F.col("text")).alias("content_hash"))


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("f13_tokenize", rf"""
with t as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '[\p{{L}}\p{{N}}_]+')
  as w from documents),
k as (select doc_id, list_filter(w, lambda x: regexp_full_match(x, '[a-z0-9]+') and length(x) > 2
  and x not in ({STOP_SQL})) as w from t)
select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as tokens from k""")
def f13(spark, d):
    w = text.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("tokens"))


@query("f14_ecommerce_terms", f"""
with s as (select page_id, lower({st.SHOP_HTML_SQL}) as low from pages),
f as (select page_id, list_filter(['product', 'cart', 'checkout', 'shop', 'store', 'buy', 'price', 'add to cart'],
  lambda t: contains(low, t)) as terms from s)
select page_id, array_to_string(terms, '|') as terms, len(terms) >= 1 as is_shop from f""")
def f14(spark, d):
    terms = text.ecommerce_terms(st.shop_html(F.col("html"), F.col("url")))
    return table(spark, d, "pages").select("page_id", terms.alias("t")).select(
        "page_id", F.array_join("t", "|").alias("terms"), (F.size("t") >= 1).alias("is_shop"))


KEYWORDS = ["the", "thing", "er the", "gk"]
PADDED_SQL = r"' ' || regexp_replace(lower(text), '([^\p{L}\p{N}_])', '\1\1', 'g') || ' '"
COUNT_SQL = ", ".join(
    r"len(regexp_extract_all(p, '[^\p{L}\p{N}_]" + k.replace(" ", "  ") + r"[^\p{L}\p{N}_]')) as k" + str(i)
    for i, k in enumerate(KEYWORDS))
FOUND_SQL = " + ".join(f"(k{i} > 0)::int" for i in range(len(KEYWORDS)))
TOTAL_SQL = " + ".join(f"k{i}" for i in range(len(KEYWORDS)))


@query("j16_keyword_page_counts", f"""with p as (select doc_id, {PADDED_SQL} as p from documents),
c as (select doc_id, {COUNT_SQL} from p)
select doc_id, kw as keyword, n from (
  {" union all ".join(f"select doc_id, '{k}' as kw, k{i} as n from c" for i, k in enumerate(KEYWORDS))})""")
def j16(spark, d):
    counts = text.keyword_counts(F.lower("text"), KEYWORDS)
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), n.cast("long").alias("n"))
                      for k, n in zip(KEYWORDS, counts)])
    return table(spark, d, "documents").select("doc_id", F.inline(pairs))


@query("f18_keyword_relevance", f"""with p as (select doc_id, {PADDED_SQL} as p from documents),
c as (select doc_id, {COUNT_SQL} from p), s as (select doc_id, {FOUND_SQL} as found, {TOTAL_SQL} as total from c)
select doc_id, found::bigint as found, total::bigint as total,
  round(least(found / 4.0::double, 1.0) * 0.6::double + least(total / 10.0::double, 1.0) * 0.4::double, 3) as score
from s""")
def f18(spark, d):
    counts = text.keyword_counts(F.lower("text"), KEYWORDS)
    df = table(spark, d, "documents").select("doc_id", F.array(*counts).alias("c"))
    found = F.size(F.filter("c", lambda n: n > 0)).cast("long")
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, n: a + n)
    return df.select("doc_id", found.alias("found"), total.alias("total")).withColumn(
        "score", text.relevance_score(F.col("found"), F.col("total"), len(KEYWORDS)))


@query("f19_domain_keyword_score", f"""with {st.SITES}, h as (select site, (contains(lower(site), 'the'))::int +
  (contains(lower(site), 'on'))::int + (contains(lower(site), 'net'))::int + (contains(lower(site), 'zz'))::int as n
  from sites) select site, case n when 0 then 0.0::double when 1 then 0.3::double when 2 then 0.5::double
  else 0.7::double end as score from h""")
def f19(spark, d):
    return st.sites(spark, d).select("site", urls.domain_keyword_score(F.col("site"), ["The", "on", "net", "zz"])
                                     .alias("score"))


@query("f41_edit_similarity", """with p as (select p_partkey, lower(p_name) as a, lower(p_type || ' ' ||
  string_split(p_name, ' ')[2]) as b from part)
select p_partkey, round(case when a = b then 1.0::double else greatest(0.0::double, 1.0::double -
  levenshtein(a, b)::double / greatest(length(a), length(b))) end, 6) as similarity from p""")
def f41(spark, d):
    b = F.concat("p_type", F.lit(" "), F.get(F.split("p_name", " "), F.lit(1)))
    return table(spark, d, "part").select(
        "p_partkey", F.round(text.edit_similarity(F.col("p_name"), b), 6).alias("similarity"))


WORDS_SQL = r"list_distinct(regexp_extract_all(lower({0}), '[^ \t\r\n\x0B\f]+'))"


@query("f42_jaccard_words", f"""with w as (select doc_id, {WORDS_SQL.format('text')} as w from documents),
p as (select a.doc_id, a.w as x, b.w as y from w a join w b on b.doc_id = a.doc_id + 1)
select doc_id, round(case when len(x) = 0 or len(y) = 0 then 0.0::double else
  len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end, 6) as jaccard from p""")
def f42(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(following, "doc_id").select(
        "doc_id", F.round(text.jaccard_words(F.col("text"), F.col("other")), 6).alias("jaccard"))


@query("f43_overlap_signals", """with p as (select p_partkey,
  lower(p_type) || '.com' as ha, [lower(string_split(p_name, ' ')[2]) || '.com', case when p_size > 25 then
  'large.com' else 'promo.com' end] as hb, lower(string_split(p_name, ' ')[1]) as ia,
  case when p_size > 20 then 'red' else 'blue' end as ib, lower(p_type) as ta from part)
select p_partkey, list_contains(hb, ha) as shared_host,
  ((ia = ib)::int + (ta = 'promo')::int)::int as equal_handles from p""")
def f43(spark, d):
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    big = F.col("p_size")
    a = F.array(F.concat(F.lit("a@"), F.lower("p_type"), F.lit(".com")))
    b = F.array(F.concat(F.lit("b@"), word(1), F.lit(".COM")),
                F.when(big > 25, "c@large.com").otherwise("c@promo.com"))
    sa = F.create_map(F.lit("instagram"), word(0), F.lit("twitter"), F.concat(F.lit("@"), F.col("p_type")))
    sb = F.create_map(F.lit("instagram"), F.when(big > 20, "Red ").otherwise("@blue"), F.lit("twitter"), F.lit("promo"),
                      F.lit("youtube"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", scores.email_hosts_overlap(a, b).alias("shared_host"),
                                          scores.equal_handles(sa, sb).alias("equal_handles"))


PRICE_TEXT_SQL = """case when p_size < 10 then 'free' when p_size < 20 then 'Rs.' || p_retailprice
  when p_size < 35 then '$' || p_retailprice else p_retailprice || ' USD' end"""


def price_text():
    size, price = F.col("p_size"), F.col("p_retailprice").cast("string")
    return (F.when(size < 10, F.lit("free")).when(size < 20, F.concat(F.lit("Rs."), price))
            .when(size < 35, F.concat(F.lit("$"), price)).otherwise(F.concat(price, F.lit(" USD"))))


@query("f44_parse_price", f"""with p as (select p_partkey, {PRICE_TEXT_SQL} as t, p_retailprice, p_size from part)
select p_partkey, try_cast(regexp_replace(t, '[^0-9.]', '', 'g') as double) as price,
  case when p_size < 10 then null else p_retailprice end as locale_price from p""")
def f44(spark, d):
    t = price_text()
    comma = F.when(F.col("p_size") >= 10, F.concat(F.lit("EUR "), F.replace(F.col("p_retailprice").cast("string"),
                                                                          F.lit("."), F.lit(","))))
    return table(spark, d, "part").select("p_partkey", text.parse_price(t).alias("price"),
                                          text.parse_price(comma, locale_aware=True).alias("locale_price"))


@query("f54_record_text", r"""select p_partkey, 'Brand: ' || p_brand || chr(10) || 'Name: ' || p_name || chr(10)
  || case when p_size > 25 then 'Category: ' || p_type || chr(10) else '' end
  || 'Specifications: {"size": "' || p_size || '", "kind": "' || p_type || '"}' || chr(10)
  || 'Price: $' || p_retailprice as content from part""")
def f54(spark, d):
    from orgweave.functions.records import product_text
    part = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"), F.lit("").alias("description"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("kind"), F.col("p_type")).alias("specs"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price"),
        F.array().cast("array<string>").alias("reviews"))
    return part.select("p_partkey", product_text().alias("content"))


@query("f57_search_mode", """select p_partkey, case when p_size > 30 or p_type = 'PROMO' then 'lenient'
  else 'aggressive' end as mode from part""")
def f57(spark, d):
    state = lambda ok: F.struct(ok.alias("is_valid"))
    checks = F.when(F.col("p_size") != 1, F.create_map(
        F.lit("a@x.com"), state(F.col("p_size") > 30), F.lit("b@x.com"), state(F.lit(None).cast("boolean")),
        F.lit("c@x.com"), state(F.col("p_type") == "PROMO")))
    promo = F.create_map(F.lit("c@x.com"), state(F.col("p_type") == "PROMO"))
    return table(spark, d, "part").select("p_partkey", contacts.search_mode(F.coalesce(checks, promo)).alias("mode"))


@query("f58_parse_json_or_null", """select event_id, case when event_type = 'error' then null
  else json_extract(props, '$.k')::bigint end as k from events""")
def f58(spark, d):
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("oops "), F.col("props"))).otherwise(F.col("props"))
    return table(spark, d, "events").select(
        "event_id", text.parse_json_or_null(raw, "struct<k:bigint>")["k"].alias("k"))


@query("f59_fenced_json", """select event_id, case when event_type = 'error' then null when event_type = 'click'
  then null else event_type || '|' || user_id end as items from events""")
def f59(spark, d):
    kind = F.col("event_type")
    body = F.concat(F.lit('["'), kind, F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))
    raw = (F.when(kind == "error", F.lit("no list here")).when(kind == "click", F.lit('{"a": 1}'))
           .when(kind == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body))
    return table(spark, d, "events").select("event_id", F.array_join(text.fenced_json_list(raw), "|").alias("items"))


@query("f60_list_lines", r"""
with d as (select doc_id, list_transform(string_split(case lang when 'en' then '1. ' || replace(text, chr(10),
    chr(10) || '2. ') when 'de' then '- ' || replace(text, chr(10), chr(10) || '* ') else text end, chr(10)),
    lambda s: trim(s, ' ' || chr(9) || chr(13))) as l from documents),
p as (select doc_id, l,
  list_filter(list_transform(list_filter(l, lambda s: regexp_matches(s, '^[0-9]+\.[ \t]*(.+)$')),
    lambda s: regexp_extract(s, '^[0-9]+\.[ \t]*(.+)$', 1)), lambda s: length(s) > 10) as numbered,
  list_filter(list_transform(list_filter(l, lambda s: regexp_matches(s, '^[*-][ \t]*(.+)$')),
    lambda s: regexp_extract(s, '^[*-][ \t]*(.+)$', 1)), lambda s: length(s) > 10) as bulleted,
  list_filter(list_filter(l, lambda s: s <> '')[1:10], lambda s: length(s) > 15 and length(s) < 100
    and s not like '%.' and s not like '#%') as short from d),
c as (select doc_id, list_transform(list_filter(list_transform(
  case when len(numbered) > 0 then numbered when len(bulleted) > 0 then bulleted else short end,
  lambda s: regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(s), '[ \t]*\([^)]+\)[ \t]*', '', 'g'),
    '\*\*(.+?)\*\*', '\1', 'g'), '^[''"]+|[''"]+$', '', 'g'), '(?i)^(Subject|Option[ \t]*[0-9]+):[ \t]*', '')),
  lambda s: length(s) > 10), lambda s: trim(s))[1:5] as items from p)
select doc_id, len(items) as n, array_to_string(items, '|') as items from c""")
def f60(spark, d):
    body, lang = F.col("text"), F.col("lang")
    shaped = (F.when(lang == "en", F.concat(F.lit("1. "), F.replace(body, F.lit("\n"), F.lit("\n2. "))))
              .when(lang == "de", F.concat(F.lit("- "), F.replace(body, F.lit("\n"), F.lit("\n* ")))).otherwise(body))
    return table(spark, d, "documents").select("doc_id", text.list_lines(shaped, 5, 10).alias("i")).select(
        "doc_id", F.size("i").cast("long").alias("n"), F.array_join("i", "|").alias("items"))


@query("f61_text_to_html")
def f61(spark, d):
    from orgweave.functions.html import text_to_html
    body = F.concat(F.lit("**Hook:** x\nHi "), F.col("role"), F.lit(",\n\n* **see** www.a.com\n- b@a.com\n\n"),
                    F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text_to_html(body).alias("html"))


@query("f62_question_lines", r"""select conv_id, turn, case when role = 'user' then text else trim(text,
  ' ' || chr(10) || chr(9) || chr(13)) end as answer, case when role = 'user' then '' else
  'What next?|Why ' || turn || '?' end as questions from conversations""")
def f62(spark, d):
    block = F.concat(F.lit("\nSuggested follow Questions: \n1. What next?\n- Why "), F.col("turn").cast("string"),
                     F.lit("?\n* no question\n2. Hm?"))
    full = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.col("text"), block))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", text.answer_part(full).alias("answer"),
        F.array_join(text.question_lines(full, 3), "|").alias("questions"))


@query("f63_relative_time", f"""with m as (select event_id, ts, floor((epoch_us(timestamp '{st.NOW}') - epoch_us(ts))
  / 60000000)::bigint as m from events), a as (select *, m // 60 as h, m // 1440 as dd from m)
select event_id, case when m < 1 then 'just now' when m < 60 then m || ' minute' || case when m > 1 then 's' else ''
  end || ' ago' when h < 24 then h || ' hour' || case when h > 1 then 's' else '' end || ' ago'
  when dd < 7 then dd || ' day' || case when dd > 1 then 's' else '' end || ' ago'
  else strftime(ts + interval 5 hour, '%b %-d, %Y, %I:%M %p') || ' PKT' end as shown from a""")
def f63(spark, d):
    now = F.lit(st.NOW).cast("timestamp")
    return table(spark, d, "events").select("event_id", text.relative_time(F.col("ts"), now).alias("shown"))


@query("f65_progress_pct", """select o_orderkey, floor(l.done / l.total::double * 90)::int as progress from (
  select l_orderkey, count(*) as total, count(*) filter (where l_linestatus = 'F') as done from lineitem
  group by 1) l join orders on o_orderkey = l_orderkey""")
def f65(spark, d):
    steps = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(steps, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", text.progress_pct(F.col("done"), F.col("total")).alias("progress"))


@query("f66_reliability_tier", """select c_custkey, case when n > 0 then 1.0::double else 0.0::double end as confidence
from (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey
  and o_orderpriority = '1-URGENT' group by 1)""")
def f66(spark, d):
    sources = (table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey")
               .agg(F.count("*").alias("n")))
    return table(spark, d, "customer").join(sources, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", text.reliability_tier(F.coalesce("n", F.lit(0))).alias("confidence"))


@query("l4_clamp_limit", "select p_partkey, greatest(1, least(p_size * 3, 100)) as n from part")
def l4(spark, d):
    return table(spark, d, "part").select("p_partkey", text.clamp(F.col("p_size") * 3).alias("n"))


@query("x4_union_terms", rf"""select p_partkey, array_to_string(list_sort(list_distinct(list_filter(
  [lower(p_name), lower(p_type || ' of ' || p_name), lower(p_type), string_split(p_name, ' ')[1],
  string_split(p_name, ' ')[2], 'gk'], lambda x: x not in ({STOP_SQL})))), '|') as terms from part""")
def x4(spark, d):
    from orgweave.operators.setops import union_terms
    given = F.array(F.lit("gk"), F.lower("p_type"))
    words = F.array(F.col("p_name"), F.concat("p_type", F.lit(" of "), F.col("p_name")))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.array_sort(union_terms(given, words)), "|").alias("terms"))
