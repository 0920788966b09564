"""Contacts."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.catalog.scalars_url import SOCIAL_URL_SQL, social_links
from orgweave.functions import contacts as C
from orgweave.operators import contacts as ops
from orgweave.operators import writes


PHONE_PAT_SQL = ", ".join(f"({i}, '(?i){p}')" for i, p in enumerate(C.PHONE_PATTERNS))
WS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PHONES_SQL = rf"""pats(p, pat) as (values {PHONE_PAT_SQL}),
m as (select doc_id, text, p, regexp_extract_all(text, pat) as hits, string_split_regex(text, pat) as gaps from documents, pats),
o as (select *, hits[i] as hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as pos
  from (select *, unnest(range(1, len(hits) + 1)) as i from m)),
c as (select doc_id, p, i, trim(replace(hit, 'tel:', ''), {WS_SQL}) as value, trim(substring(text, greatest(pos - 50, 0) + 1,
  pos - greatest(pos - 50, 0) + length(hit) + 50), {WS_SQL}) as context from o),
f as (select *, row_number() over (partition by doc_id, value order by p, i) as n from c
  where length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7)"""


@query("f27_extract_phones", rf"""with {PHONES_SQL} select doc_id, value, 'phone' as type,
  case when regexp_matches(lower(context), 'phone|tel|call|contact') then 0.9::double
    when regexp_matches(lower(context), 'fax|mobile|office') then 0.8 else 0.5 end as confidence, context, 'text' as source
  from f where n = 1""")
def f27(spark, d):
    found = C.extract_phones(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


PHONE_HITS = ", ".join(f"regexp_extract_all(text, '{p}')" for p in C.PHONE_PATTERNS)


@query("f27_extract_phones_values", rf"""with h as (select doc_id, unnest(flatten([{PHONE_HITS}])) as hit from documents),
v as (select doc_id, trim(replace(hit, 'tel:', ''), ' ' || chr(9) || chr(10) || chr(13)) as value from h)
select distinct doc_id, value from v where length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7""")
def f27_values(spark, d):
    return f27(spark, d).select("doc_id", "value")


def whatsapp_text():
    text = F.col("text")
    return F.concat(text, F.lit(" whatsapp +44 20 7946 "), F.col("doc_id").cast("string"), F.lit(" or wa.me/48601"),
                    F.col("doc_id").cast("string"))


def spans_sql(name: str, rows: str, patterns: list[str], around: int = 50) -> str:
    """CTEs that give (the columns of ``rows``, p, i, hit, context) for every match of the patterns in ``text``."""
    values = ", ".join(f"({i}, '(?i){p}')" for i, p in enumerate(patterns))
    return rf"""{name}_p(p, pat) as (values {values}),
{name}_m as (select *, regexp_extract_all(text, pat) as hits, string_split_regex(text, pat) as gaps from {rows}, {name}_p),
{name}_o as (select *, hits[i] as hit, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as pos
  from (select *, unnest(range(1, len(hits) + 1)) as i from {name}_m)),
{name} as (select *, trim(replace(hit, 'tel:', ''), {WS_SQL}) as value, trim(substring(text, greatest(pos - {around}, 0) + 1,
  pos - greatest(pos - {around}, 0) + length(hit) + {around}), {WS_SQL}) as context from {name}_o)"""


def whatsapp_sql(texts: str) -> str:
    """CTEs up to ``wa`` (key, value, confidence, context, source) for the rows (key, part, text) of ``texts``.

    Part text holds phones and links, part html links only.
    """
    return rf"""{spans_sql('links', texts, C.WHATSAPP_PATTERNS)}, known as (select *, nullif(case
    when contains(hit, 'wa.me/') then regexp_extract(hit, '.*wa\.me/(.*)$', 1)
    when contains(hit, 'phone=') then regexp_extract(hit, '.*phone=(.*)$', 1) end, '') as number from links
  qualify row_number() over (partition by key, hit order by part = 'html', p, i) = 1),
own as (select * from {texts} where part = 'text' and contains(lower(text), 'whatsapp')),
{spans_sql('phones', 'own', C.PHONE_PATTERNS)}, named as (select * from phones
  where length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7
  qualify row_number() over (partition by key, value order by p, i) = 1),
wa as (select key, coalesce(number, hit) as value, case when number is null then 0.8::double else 0.95 end as confidence,
    context, part as source from known
  union all select key, value, 0.85, context, 'keyword_match' from named n where contains(lower(context), 'whatsapp')
    and not exists (select 1 from known k where k.key = n.key and k.hit = n.value))"""


@query("f28_extract_whatsapp", f"""with t as (select doc_id as key, 'text' as part, text || ' whatsapp +44 20 7946 ' || doc_id
  || ' or wa.me/48601' || doc_id as text from documents
  union all select doc_id, 'html', 'api.whatsapp.com/send?phone=' || n_chars from documents), {whatsapp_sql('t')}
select key as doc_id, value, 'whatsapp' as type, confidence, context, source from wa""")
def f28(spark, d):
    found = C.extract_whatsapp(whatsapp_text(), F.concat(F.lit("api.whatsapp.com/send?phone="), F.col("n_chars")))
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


@query("f28_extract_whatsapp_links", """select doc_id, '48601' || doc_id as value, 0.95::double as confidence, 'text' as source
from documents union all select doc_id, n_chars::varchar, 0.95, 'html' from documents""")
def f28_links(spark, d):
    return f28(spark, d).where("source <> 'keyword_match'").select("doc_id", "value", "confidence", "source")


LINK_TEXT_SQL = """text || ' linkedin.com/company/' || source || ', https LinkedIn.com/in/jo-' || doc_id
  || '! www.instagram.com/' || lang || '. x.com/' || source || ' youtu.be/' || lang || '-1 @' || lang"""


def link_text():
    return F.concat("text", F.lit(" linkedin.com/company/"), "source", F.lit(", https LinkedIn.com/in/jo-"),
                    F.col("doc_id").cast("string"), F.lit("! www.instagram.com/"), "lang", F.lit(". x.com/"), "source",
                    F.lit(" youtu.be/"), "lang", F.lit("-1 @"), "lang")


@query("f29_extract_linkedin", rf"""with t as (select doc_id, {LINK_TEXT_SQL} as t from documents),
h as (select doc_id, 'https://' || unnest(list_distinct(list_concat(
  regexp_extract_all(t, '(?i)linkedin\.com/in/[A-Za-z0-9_-]+'),
  regexp_extract_all(t, '(?i)linkedin\.com/company/[A-Za-z0-9_-]+'),
  regexp_extract_all(t, '(?i)linkedin\.com/pub/[A-Za-z0-9_-]+')))) as value from t)
select doc_id, value, case when contains(value, '/company/') then 'linkedin_company' else 'linkedin_individual' end
  as type from h""")
def f29(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(C.extract_linkedin(link_text())).alias("c")).select(
        "doc_id", "c.value", "c.type")


def _social_sql():
    branches = []
    for platform, patterns in C.SOCIAL_PATTERNS.items():
        hits = ", ".join(f"regexp_extract_all(t, '(?i){p}')" for p in patterns)
        hits = hits if len(patterns) == 1 else f"list_concat({hits})"
        branches.append(f"""select doc_id, 'social_{platform}' as type, unnest(list_distinct(list_transform({hits},
  lambda v: regexp_replace(case when contains(lower(v), '{platform}') then 'https://' || v else v end,
    '[^A-Za-z0-9_/:@.-]+$', '')))) as value from t""")
    return " union all ".join(branches)


@query("f30_extract_social", f"""with t as (select doc_id, {LINK_TEXT_SQL} as t from documents),
f as ({_social_sql()})
select doc_id, type, value, case when contains(lower(value), string_split(type, '_')[2]) then 0.9::double
  else 0.6::double end as confidence from f""")
def f30(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(C.extract_social(link_text())).alias("c")).select(
        "doc_id", "c.type", "c.value", "c.confidence")


@query("f31_page_type_boost", """with e as (select event_id, case event_type when 'click' then 'phone'
  when 'view' then 'whatsapp' when 'error' then 'linkedin_company' else 'email' end as kind,
  case when user_id < 50 then 'contact' when user_id < 100 then 'team' else 'homepage' end as page_type,
  least(value, 100) / 100 as c from events)
select event_id, round(least(1.0::double, c + case when kind = 'phone' and page_type = 'contact' then 0.2::double
  when kind = 'whatsapp' and page_type = 'contact' then 0.1::double
  when kind = 'linkedin_company' and page_type = 'team' then 0.1::double else 0.0::double end), 6) as confidence,
  'website_' || page_type as source from e""")
def f31(spark, d):
    event, user = F.col("event_type"), F.col("user_id")
    kind = (F.when(event == "click", "phone").when(event == "view", "whatsapp")
            .when(event == "error", "linkedin_company").otherwise("email"))
    page = F.when(user < 50, "contact").when(user < 100, "team").otherwise("homepage")
    c = F.least("value", F.lit(100.0)) / 100
    return table(spark, d, "events").select(
        "event_id", F.round(C.boost_by_page(kind, c, page), 6).alias("confidence"),
        F.concat(F.lit("website_"), page).alias("source"))


@query("f32_serp_contacts", rf"""with t as (select doc_id as key, source as domain, lang, 'text' as part, lang || ' ' || text as text
  from documents), ph as (select * from t where lang not in ('fr', 'es')), {spans_sql('tel', 'ph', C.PHONE_PATTERNS, 100)},
wt as (select key, part, text from t where lang = 'es'), {whatsapp_sql('wt')}
select key as seq, domain, 'phone' as type, value, 0.7::double as confidence, context, 'google_search' as source from tel
where length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 qualify row_number() over (partition by key, value order by p, i) = 1
union all select key, domain, 'whatsapp', value, 0.75, context, 'google_search' from wa join t using (key)
union all select key, domain, 'linkedin_individual', 'https://linkedin.com/in/' || domain, 0.85, substring(text, 1, 100),
  'google_search' from t where lang = 'fr'""")
def f32(spark, d):
    from orgweave.plans.enrichment import serp_contacts
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("domain"), F.col("lang").alias("title"),
        F.col("text").alias("snippet"),
        F.concat(F.lit("https://linkedin.com/"), F.when(F.col("lang") == "en", "company/").otherwise("in/"),
                 F.col("source")).alias("url"),
        F.when(F.col("lang") == "fr", "linkedin").when(F.col("lang") == "es", "whatsapp").otherwise("phone")
        .alias("query_type"))
    return serp_contacts(docs)


PHONE_NORM_SQL = r"""(case when not starts_with(k, '+') and length(k) >= 10 then '+' || k else k end)"""


@query("f33_normalize_phone", rf"""with {st.PHONES},
k as (select doc_id, phone, regexp_replace(phone, '[^0-9+]', '', 'g') as k from ph),
n as (select *, {PHONE_NORM_SQL} as n from k)
select doc_id, phone, n as normalized, length(regexp_replace(n, '[^0-9]', '', 'g')) between 7 and 15 as ok from n""")
def f33(spark, d):
    phone = F.col("phone")
    n = C.normalize_phone(phone)
    return st.phones(spark, d).select("doc_id", "phone", n.alias("normalized"), C.is_valid_phone(n).alias("ok"))


COUNTRY_SQL = "case " + " ".join(
    f"when starts_with({{0}}, '{code}') then '{name}'" for code, name in C.COUNTRY_CODES.items()) + " end"


def phone_check_sql(source: str) -> str:
    return rf"""k as (select *, regexp_replace(v, '[^0-9+]', '', 'g') as k,
    length(regexp_replace(v, '[^0-9]', '', 'g')) as n from {source}),
f as (select *, case when starts_with(k, '+') then k when n >= 10 then '+' || regexp_replace(k, '[^0-9]', '', 'g') end
  as fx from k),
r as (select *, case when k = '' then 'No digits found'
  when fx is null then 'Invalid format (must start with + or be 10+ digits)'
  when n < 7 then 'Too short (minimum 7 digits)' when n > 15 then 'Too long (maximum 15 digits)' end as why from f)"""


@query("f34_validate_phone", rf"""with {st.PHONES}, s as (select doc_id, phone as v from ph), {phone_check_sql('s')}
select doc_id, v as phone, why is null as is_valid, coalesce(case when k <> '' then fx end, v) as normalized,
  why as reason, case when why is null then {COUNTRY_SQL.format('fx')} end as country,
  case when why is null then n::int end as digit_count from r""")
def f34(spark, d):
    return st.phones(spark, d).select("doc_id", "phone", C.validate_phone(F.col("phone")).alias("r")).select(
        "doc_id", "phone", "r.*")


@query("f35_validate_whatsapp", rf"""with {st.PHONES}, s as (select doc_id, phone, form,
  case form when 'wa' then 'https://wa.me/' || regexp_replace(phone, '[^0-9+]', '', 'g') || '?text=hi'
    when 'api' then 'api.whatsapp.com/send?phone=' || regexp_replace(phone, '[^0-9+]', '', 'g')
    when 'chat' then 'chat.whatsapp.com/abc' else phone end as raw,
  case form when 'chat' then '' when 'plain' then phone else regexp_replace(phone, '[^0-9+]', '', 'g') end as v
  from ph, (values ('wa'), ('api'), ('chat'), ('plain')) as forms(form)), {phone_check_sql('s')},
w as (select *, case when form = 'chat' or (form = 'api' and v = '') then 'Could not extract number from WhatsApp link'
  when why is not null then 'Invalid phone number: ' || why end as reason from r)
select doc_id, raw, reason is null as is_valid, case when reason is null then fx else raw end as normalized, reason,
  case when reason is null then {COUNTRY_SQL.format('fx')} end as country,
  case when reason is null then n::int end as digit_count,
  case when reason is null then case when form = 'wa' then 'link' else 'number' end end as original_format from w""")
def f35(spark, d):
    bare = F.regexp_replace("phone", "[^0-9+]", "")
    raw = F.explode(F.array(F.concat(F.lit("https://wa.me/"), bare, F.lit("?text=hi")),
                            F.concat(F.lit("api.whatsapp.com/send?phone="), bare), F.lit("chat.whatsapp.com/abc"),
                            F.col("phone")))
    return st.phones(spark, d).select("doc_id", raw.alias("raw")).select(
        "doc_id", "raw", C.validate_whatsapp(F.col("raw")).alias("r")).select("doc_id", "raw", "r.*")


@query("f36_validate_linkedin", rf"""with {SOCIAL_URL_SQL}, b as (select site, link,
  regexp_replace(regexp_replace(link, '\?.*$', ''), '/+$', '') as bare from u),
v as (select *, regexp_matches(bare || '/',
  '(?i)^https?://([a-z]+\.)?linkedin\.com/((company|in)/[A-Za-z0-9_-]+|pub/[A-Za-z0-9_/-]+)/?$') as ok from b)
select site, link, ok as is_valid, case when ok then bare else link end as normalized,
  case when not ok then 'Invalid LinkedIn URL format' end as reason,
  case when ok then case when contains(bare, '/company/') then 'company' when contains(bare, '/in/') then 'individual'
    else 'public_profile' end end as profile_type from v""")
def f36(spark, d):
    return social_links(spark, d).select("site", "link", C.validate_linkedin(F.col("link")).alias("r")).select(
        "site", "link", "r.*")


@query("f37_validate_social", rf"""with {SOCIAL_URL_SQL}, b as (select site, link, regexp_replace(link, '\?.*$', '')
  as full_url from u),
p as (select *, case when contains(full_url, 'instagram') then 'instagram'
  when contains(full_url, 'facebook') then 'facebook' when contains(full_url, 'twitter') then 'twitter'
  when contains(full_url, 'youtube') then 'youtube' when contains(full_url, 'tiktok') then 'tiktok'
  when starts_with(full_url, 'https://x.com/') then 'twitter' end as platform from b),
v as (select *, coalesce(regexp_matches(full_url, case platform
  when 'instagram' then '(?i)^https?://(www\.)?instagram\.com/[A-Za-z0-9_.]+/?$'
  when 'facebook' then '(?i)^https?://(www\.)?(facebook|fb)\.com/[A-Za-z0-9_.]+/?$'
  when 'twitter' then '(?i)^https?://(www\.)?(twitter|x)\.com/[A-Za-z0-9_]+/?$'
  when 'youtube' then '(?i)^https?://(www\.)?youtube\.com/([@A-Za-z0-9_]+|channel/[A-Za-z0-9_-]+)/?$'
  when 'tiktok' then '(?i)^https?://(www\.)?tiktok\.com/@[A-Za-z0-9_.]+/?$' end), false) as ok from p)
select site, link, ok as is_valid, case when ok then regexp_replace(full_url, '/+$', '') else link end as normalized,
  case when platform is null then 'Unknown social media platform' when not ok then 'Invalid ' || platform
    || ' URL format' end as reason, case when ok then platform end as platform from v""")
def f37(spark, d):
    return social_links(spark, d).select("site", "link", C.validate_social(F.col("link")).alias("r")).select(
        "site", "link", "r.*")


AVOID_SQL = "case " + " ".join(
    f"when regexp_matches(e, '{p}') then 'Email matches avoid pattern: {p}'" for p in C.AVOID_PATTERNS) + " end"
SYNTAX_SQL = rf"""case when email = '' then 'Empty or invalid email'
  when not regexp_matches(e, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$') then 'Invalid email format'
  when {AVOID_SQL} is not null then {AVOID_SQL}
  when string_split(e, '@')[2] in ('tempmail.com', 'guerrillamail.com', '10minutemail.com', 'throwaway.email',
    'mailinator.com', 'trashmail.com', 'yopmail.com', 'fakeinbox.com') then 'Disposable email domain' end"""


@query("f39_email_syntax", rf"""with {st.MAILS}, v as (select doc_id, unnest([email, ' ' || upper(email),
  'NoReply@' || source || '.com', 'bounce@' || source, source || '@yopmail.com', '']) as email from mails),
e as (select *, trim(lower(email)) as e from v)
select doc_id, email, {SYNTAX_SQL} as reason from e""")
def f39(spark, d):
    email, source = F.col("email"), F.col("source")
    tried = F.explode(F.array(email, F.concat(F.lit(" "), F.upper(email)),
                              F.concat(F.lit("NoReply@"), source, F.lit(".com")),
                              F.concat(F.lit("bounce@"), source), F.concat(source, F.lit("@yopmail.com")), F.lit("")))
    return st.mails(spark, d).select("doc_id", tried.alias("email")).select(
        "doc_id", "email", C.email_syntax(F.col("email")).alias("reason"))


CUSTOMER_MAILS = """cm as (select c_custkey, lower(case when c_nationkey = 7 then 'abuse@' else 'user' || c_custkey || '@'
  end || c_mktsegment || '.com') as email, c_nationkey <> 9 as mx_found,
  case when c_nationkey < 8 then true when c_nationkey < 16 then false end as smtp_result, c_acctbal, c_nationkey
  from customer), wl as (select email from cm where c_acctbal > 9000), bl as (select email from cm where c_acctbal < 0
  or c_acctbal > 9500)"""


def customer_mails(spark, d):
    nation = F.col("c_nationkey")
    email = F.lower(F.concat(F.when(nation == 7, F.lit("abuse@")).otherwise(
        F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@"))), F.col("c_mktsegment"), F.lit(".com")))
    df = table(spark, d, "customer").select(
        "c_custkey", email.alias("email"), (nation != 9).alias("mx_found"),
        F.when(nation < 8, F.lit(True)).when(nation < 16, F.lit(False)).alias("smtp_result"), "c_acctbal")
    return df.drop("c_acctbal"), df.where("c_acctbal > 9000"), df.where("c_acctbal < 0 or c_acctbal > 9500")


@query("f40_email_verdict", f"""with {CUSTOMER_MAILS}, e as (select *, email as e, email in (select email from wl) as w,
  email in (select email from bl) as b from cm), s as (select *, {SYNTAX_SQL} as syn from e)
select c_custkey, email, w or (not b and syn is null and mx_found) as is_valid,
  case when w then 'Email is whitelisted (manually verified)' when b then 'Email is blacklisted (previous bounce)'
    when syn is not null then syn when not mx_found then 'No MX records found'
    when smtp_result is null then 'SMTP verification blocked (assuming valid based on DNS)'
    when not smtp_result then 'SMTP returned rejection code (but may be false negative - server blocks verification)'
    end as reason from s""")
def f40(spark, d):
    mails, white, black = customer_mails(spark, d)
    return ops.verify_mails(mails, white, black).select("c_custkey", "email", "is_valid", "reason")


@query("j13_list_membership", f"""with {CUSTOMER_MAILS} select c_custkey, email, case when email in (select email from wl)
  then 'valid' when email in (select email from bl) then 'invalid' end as listed from cm""")
def j13(spark, d):
    mails, white, black = customer_mails(spark, d)
    return ops.list_membership(mails, white, black).select("c_custkey", "email", "listed")


@query("f48_linkedin_relevance", rf"""with {SOCIAL_URL_SQL}, c as (select site, link, {st.LABEL_SQL} as label,
  case when length(site) > 11 then 'CEO at ' || site else 'nobody' end as context from u), s as (select *,
  0.5::double + case when contains(lower(link), label || ' ltd') or contains(lower(link), label) then 0.3::double
    else 0.0::double end
  + case when contains(lower(context), label || ' ltd') then 0.2::double else 0.0::double end
  + case when contains(lower(context), label) then 0.15::double else 0.0::double end
  + case when contains(string_split(link, '/')[-1], label || '-ltd') or contains(string_split(link, '/')[-1], label)
    then 0.2::double else 0.0::double end as score from c)
select site, link, round(least(score, 1.0), 6) as score, case when contains(link, '/company/')
  then contains(lower(context), label) or contains(lower(link), label)
  else contains(link, '/in/') and contains(lower(context), label) end as accepted from s""")
def f48(spark, d):
    site, link = F.col("site"), F.col("link")
    label = st.label(site)
    context = F.when(F.length(site) > 11, F.concat(F.lit("CEO at "), site)).otherwise(F.lit("nobody"))
    company = F.concat(label, F.lit(" Ltd"))
    return social_links(spark, d).select(
        "site", "link", C.linkedin_relevance(link, context, company, label).alias("score"),
        C.linkedin_gate(link, context, company, label).alias("accepted"))


@query("f49_name_from_slug", r"""select c_custkey, case when c_nationkey = 1 then null else 'User '
  || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) end as name from customer""")
def f49(spark, d):
    url = F.concat(F.when(F.col("c_nationkey") == 1, "https://linkedin.com/company/").otherwise(
        "https://linkedin.com/in/"), F.lit("user-"), F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", C.name_from_slug(url).alias("name"))


@query("f50_brand_variations", rf"""with {st.SITES}, s as (select site, string_split(replace(site, 'th', 'th2'), '.')[1]
  as stem from sites), p as (select site, stem, regexp_extract_all(stem, '[A-Z][a-z]*|[a-z]+|[0-9]+') as parts from s),
v as (select site, list_filter([stem, case when length(stem) > 4 and len(parts) > 1 then array_to_string(parts, ' ') end,
  case when length(stem) > 4 and len(parts) > 1 then array_to_string(parts, '-') end, upper(stem) || ' Co',
  lower(stem) || 'co'], lambda x: x is not null) as v from p)
select site, array_to_string(list_sort(list_distinct(v)), '|') as variations from v""")
def f50(spark, d):
    domain = F.replace(F.col("site"), F.lit("th"), F.lit("th2"))
    stem = F.get(F.split(domain, r"\."), F.lit(0))
    v = C.brand_variations(domain, F.concat(F.upper(stem), F.lit(" Co")))
    return st.sites(spark, d).select("site", F.array_join(F.array_sort(v), "|").alias("variations"))


CONTACT_ARRAY_SQL = """oc as (select o_orderkey, [struct_pack(type := 'email', value := 'a' || o_custkey || '@x.com',
    confidence := 1.0::double), struct_pack(type := 'phone', value := o_orderpriority, confidence := 0.5::double),
  struct_pack(type := case o_orderstatus when 'F' then 'email' when 'O' then 'address' else 'whatsapp' end,
    value := 'v' || o_orderkey, confidence := o_totalprice / 500000)] as contacts from orders)"""


def order_contacts(spark, d):
    c = lambda t, v, conf: F.struct(t.alias("type"), v.alias("value"), conf.alias("confidence"))
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.array(
        c(F.lit("email"), F.concat(F.lit("a"), F.col("o_custkey"), F.lit("@x.com")), F.lit(1.0)),
        c(F.lit("phone"), F.col("o_orderpriority"), F.lit(0.5)),
        c(F.when(status == "F", "email").when(status == "O", "address").otherwise("whatsapp"),
          F.concat(F.lit("v"), F.col("o_orderkey")), F.col("o_totalprice") / 500000)).alias("contacts"))


VALUES_SQL = "array_to_string(list_transform({0}, lambda c: c.value), '|')"


def values_text(col):
    return F.array_join(F.transform(col, lambda c: c["value"]), "|")


@query("p8_filter_confidence", f"""with {CONTACT_ARRAY_SQL} select o_orderkey,
  {VALUES_SQL.format("list_filter(contacts, lambda c: c.confidence >= 0.6)")} as kept from oc""")
def p8(spark, d):
    return order_contacts(spark, d).select("o_orderkey", values_text(C.confident(F.col("contacts"), 0.6)).alias("kept"))


@query("p9_contacts_of_type", f"""with {CONTACT_ARRAY_SQL} select o_orderkey,
  {VALUES_SQL.format("list_filter(contacts, lambda c: c.type = 'email')")} as emails from oc""")
def p9(spark, d):
    return order_contacts(spark, d).select(
        "o_orderkey", values_text(C.contacts_of_type(F.col("contacts"), "email")).alias("emails"))


@query("f64_first_email", f"""with {CONTACT_ARRAY_SQL} select o_orderkey,
  list_filter(contacts[2:], lambda c: c.type = 'email')[1].value as email from oc""")
def f64(spark, d):
    tail = F.expr("slice(contacts, 2, 10)")
    return order_contacts(spark, d).select("o_orderkey", C.first_email(tail).alias("email"))


@query("a14_contacts_by_type", f"""with {CONTACT_ARRAY_SQL} select o_orderkey,
  {VALUES_SQL.format("list_filter(contacts, lambda c: c.type = 'email')")} as email,
  {VALUES_SQL.format("list_filter(contacts, lambda c: c.type = 'phone')")} as phone,
  {VALUES_SQL.format("list_filter(contacts, lambda c: c.type = 'address')")} as address from oc""")
def a14(spark, d):
    df = order_contacts(spark, d).select("o_orderkey", C.values_by_type(F.col("contacts")).alias("v"))
    return df.select("o_orderkey", *[F.array_join(f"v.{k}", "|").alias(k) for k in ("email", "phone", "address")])


@query("f55_contacts_from_profile", """select c_custkey, 'email:' || lower(c_name) || '|email:b@x.com'
  || case when c_nationkey > 5 then '|phone:' || c_nationkey else '' end as contacts,
  case when c_acctbal > 0 then 'twitter:' || c_mktsegment else '' end as socials from customer""")
def f55(spark, d):
    phones = F.when(F.col("c_nationkey") > 5, F.array(F.col("c_nationkey").cast("string")))
    social = F.create_map(F.lit("facebook"), F.lit(""), F.lit("twitter"),
                          F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    made = C.contacts_from_profile(F.array(F.lower("c_name"), F.lit("b@x.com")), phones,
                                   F.lit(st.NOW).cast("timestamp"))
    pair = lambda arr, a, b: F.array_join(F.transform(arr, lambda c: F.concat(c[a], F.lit(":"), c[b])), "|")
    return table(spark, d, "customer").select(
        "c_custkey", pair(made, "type", "value").alias("contacts"),
        pair(C.socials_from_map(social), "platform", "url").alias("socials"))


@query("f56_append_contacts", f"""with {CONTACT_ARRAY_SQL} select o_orderkey, array_to_string(list_transform(contacts,
  lambda c: c.type || ':' || c.value), ',') || ',phone:+1,whatsapp:+2,linkedin:in/' || o_orderkey as contacts from oc""")
def f56(spark, d):
    plain = F.transform("contacts", lambda c: F.struct(c["type"].alias("type"), c["value"].alias("value")))
    full = C.append_contacts(plain, {"phone": F.array(F.lit("+1")), "whatsapp": F.array(F.lit("+2")), "linkedin": F.array(
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string")))})
    return order_contacts(spark, d).select("o_orderkey", F.array_join(F.transform(
        full, lambda c: F.concat(c["type"], F.lit(":"), c["value"])), ",").alias("contacts"))


@query("a17_dedup_contacts", """with c as (select event_id as seq, event_type as type,
  case when value > 60 then 'USER' else 'user' end || user_id as value, round(value / 100, 1) as confidence from events)
select type, value, confidence, seq from (select *, row_number() over (partition by type, lower(value)
  order by confidence desc, seq) as rn from c) where rn = 1""")
def a17(spark, d):
    c = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("type"),
        F.concat(F.when(F.col("value") > 60, "USER").otherwise("user"), F.col("user_id")).alias("value"),
        F.round(F.col("value") / 100, 1).alias("confidence"))
    return ops.dedup_contacts(c)


ENRICH_SQL = """cc as (select event_id as seq, 'd' || user_id as domain,
  case event_type when 'click' then 'phone' when 'view' then 'whatsapp' when 'signup' then 'linkedin_company'
    else 'linkedin_individual' end as type, event_type as source, 'V' || round(value)::bigint as value, value as confidence
  from events where event_type <> 'error'),
so as (select event_id as seq, 'd' || user_id as domain, case when value > 60 then 'twitter' when value > 30 then
  'facebook' else 'instagram' end as platform, case when value > 100 then '' else 'u' || event_id end as url,
  'social' as source from events where event_type = 'error'),
best as (select * from (select *, row_number() over (partition by domain, case when type like 'linkedin%' then 'linkedin'
  else type end, lower(value) order by confidence desc, seq) as rn from cc) where rn = 1),
last as (select * from (select *, row_number() over (partition by domain, platform order by seq desc) as rn from so)
  where rn = 1),
cnt as (select domain, count(*) filter (where type = 'whatsapp') as whatsapp, count(*) filter (where type = 'phone')
  as phones, count(*) filter (where type like '%individual%') as people, count(*) filter (where type like '%company%')
  as companies, count(*) filter (where type like 'linkedin%') as linkedin from best group by domain),
plat as (select domain, list_sort(list(platform)) as platforms from last where url <> '' group by domain),
j as (select coalesce(c.domain, p.domain) as domain, coalesce(whatsapp, 0) as whatsapp, coalesce(phones, 0) as phones,
  coalesce(people, 0) as people, coalesce(companies, 0) as companies, coalesce(linkedin, 0) as linkedin,
  coalesce(platforms, []) as platforms from cnt c full join plat p on c.domain = p.domain)"""
POINTS_SQL = """(case when whatsapp > 0 then 40 else 0 end + case when phones > 0 then 30 else 0 end
  + case when linkedin > 0 then 20 else 0 end + case when len(platforms) >= 3 then 15 when len(platforms) >= 1 then 10
  else 0 end)"""
TIER_SQL = f"case when {POINTS_SQL} >= 70 then 'high' when {POINTS_SQL} >= 40 then 'medium' else 'low' end"
NOTES_SQL = """coalesce(nullif(concat_ws('; ',
  case when whatsapp > 0 then 'Found ' || whatsapp || ' WhatsApp number(s)' end,
  case when phones > 0 then 'Found ' || phones || ' phone number(s)' end,
  case when people > 0 then 'Found ' || people || ' LinkedIn profile(s)' end,
  case when companies > 0 then 'Found ' || companies || ' LinkedIn company page(s)' end,
  case when len(platforms) > 0 then 'Found ' || len(platforms) || ' social media account(s): '
    || array_to_string(platforms, ', ') end), ''), 'No additional contacts found')"""


def enrichment_rows(spark, d):
    ev = table(spark, d, "events")
    kind, value = F.col("event_type"), F.col("value")
    type_ = (F.when(kind == "click", "phone").when(kind == "view", "whatsapp").when(kind == "signup", "linkedin_company")
             .otherwise("linkedin_individual"))
    base = ev.select(F.col("event_id").alias("seq"), F.concat(F.lit("d"), F.col("user_id")).alias("domain"), "event_type",
                     "value")
    found = base.where(kind != "error").select(
        "seq", "domain", type_.alias("type"), F.col("event_type").alias("source"),
        F.when(type_.startswith("linkedin"), "linkedin").otherwise(type_).alias("kind"),
        F.concat(F.lit("V"), F.round(value).cast("long")).alias("value"), value.alias("confidence"))
    social = base.where(kind == "error").select(
        "seq", "domain", F.when(value > 60, "twitter").when(value > 30, "facebook").otherwise("instagram")
        .alias("platform"), F.when(value > 100, "").otherwise(F.concat(F.lit("u"), F.col("seq"))).alias("url"),
        F.lit("social").alias("source"))
    return found, social


@query("a16_merge_enrichment", f"""with {ENRICH_SQL},
src as (select domain, array_to_string(list_sort(list(distinct source)), '|') as sources from (
  select domain, source from cc union all select domain, source from so) group by domain)
select j.domain, whatsapp, phones, people, companies, linkedin, len(platforms) as socials, {TIER_SQL} as contact_score,
  {NOTES_SQL} as notes, sources from j join src on j.domain = src.domain""")
def a16(spark, d):
    merged = ops.merge_enrichment(*enrichment_rows(spark, d))
    sources = merged["sources"].groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("source")), "|")
                                                      .alias("sources"))
    return merged["summary"].join(sources, "domain")


@query("a18_contact_tier", f"with {ENRICH_SQL} select domain, {TIER_SQL} as tier from j")
def a18(spark, d):
    return ops.merge_enrichment(*enrichment_rows(spark, d))["summary"].select("domain", F.col("contact_score").alias("tier"))


@query("a19_contact_notes", f"with {ENRICH_SQL} select domain, {NOTES_SQL} as notes from j")
def a19(spark, d):
    return ops.merge_enrichment(*enrichment_rows(spark, d))["summary"].select("domain", "notes")


@query("k10_whitelist_domain", f"""with {st.MAILS}, wl as (select distinct email from mails where source < 'src14'),
n as (select email, source as domain, doc_id, row_number() over (partition by email order by doc_id) as rn from mails)
select email, 'listed' as reason, null::varchar as domain from wl
union all select email, 'Known working domain', domain from n where rn = 1 and email not in (select email from wl)""")
def k10(spark, d):
    mails = st.mails(spark, d)
    listed = mails.where("source < 'src14'").select("email").distinct().select(
        "email", F.lit("listed").alias("reason"), F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("long").alias("doc_id"))
    profile = mails.select("email", F.col("source").alias("domain"), "doc_id")
    return writes.whitelist_domain(listed, profile, "Known working domain", "doc_id").drop("doc_id")
