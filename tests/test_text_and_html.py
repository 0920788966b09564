import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from orgweave.functions import html as H
from orgweave.functions import scores as S
from orgweave.functions import text as T

L = F.lit


def test_tokenize(value):
    assert value(T.tokenize(L("<b>The</b> Café shop-door at 2024 x"))) == ["shop", "door", "2024"]


def test_edit_similarity(value):
    assert value(T.edit_similarity(L("Acme"), L("Acme Ltd"))) == 0.5
    assert value(T.edit_similarity(L(""), L("x"))) == 0.0
    assert value(T.edit_similarity(L(" A "), L("a"))) == 1.0


def test_jaccard(value):
    assert value(T.jaccard_words(L("a b c"), L("b c d"))) == 0.5
    assert value(T.jaccard_words(L("   "), L("b"))) == 0.0
    assert value(T.jaccard_words(L(None).cast("string"), L("b"))) == 0.0


@pytest.mark.parametrize("text,price", [("$49.99", 49.99), ("Rs.14,600.00", None), ("free", None), ("0", None)])
def test_parse_price(value, text, price):
    assert value(T.parse_price(L(text))) == price


@pytest.mark.parametrize("text,price", [("1.299,00 €", 1299.0), ("Rs.14,600.00", 14600.0), ("$5", 5.0), ("12,5", 12.5)])
def test_parse_price_locale(value, text, price):
    assert value(T.parse_price(L(text), locale_aware=True)) == price


def test_relevance(value):
    assert value(T.relevance_score(L(2), L(5), 4)) == 0.5


def test_keyword_counts_are_whole_words(value):
    counts = T.keyword_counts(L("gk gk. gkx the gk-glove éthe c++"), ["gk", "the", "c++"])
    # a trailing sign has no word boundary after it, as in the usual regex reading
    assert value(F.array(*counts))[:2] == [3, 1]


def test_json_helpers(value):
    assert value(T.parse_json_or_null(L('{"k": 3}'), "struct<k:int>"))["k"] == 3
    assert value(T.parse_json_or_null(L("nope"), "struct<k:int>")) is None
    assert value(T.fenced_json_list(L('```json\n["a", "b"]\n```'))) == ["a", "b"]
    assert value(T.fenced_json_list(L('{"a": 1}'))) is None
    assert value(T.fenced_json_list(L("[broken"))) is None


def test_list_lines(value):
    text = "Intro\n1. First subject line (short)\n2. tiny\n3. **Bold** second subject\n- bullet that is long enough"
    assert value(T.list_lines(L(text))) == ["First subject line", "Bold second subject"]
    assert value(T.list_lines(L("* Subject: bullets here now\n- 'quoted bullet text'"))) == [
        "bullets here now", "quoted bullet text"]
    assert value(T.list_lines(L("A line of middle length\nEnds with a full stop here.\n# heading line here"))) == [
        "A line of middle length"]


def test_question_block(value):
    text = "Answer.\n\nSuggested Follow-up Questions:\n1. What is next?\n- no question\n• Why that one?\n* Who?\n* Third one here?"
    assert value(T.answer_part(L(text))) == "Answer."
    assert value(T.question_lines(L(text), 3)) == ["What is next?", "Why that one?", "Third one here?"]
    assert value(T.question_lines(L("plain"))) == []


@pytest.mark.parametrize("ago,shown", [
    (dt.timedelta(seconds=30), "just now"), (dt.timedelta(minutes=1), "1 minute ago"), (dt.timedelta(minutes=59), "59 minutes ago"),
    (dt.timedelta(hours=5), "5 hours ago"), (dt.timedelta(days=1), "1 day ago"),
    (dt.timedelta(days=7), "Jan 24, 2024, 05:00 AM PKT")])
def test_relative_time(spark, ago, shown):
    now = dt.datetime(2024, 1, 31)
    row = spark.createDataFrame([(str(now - ago), str(now))], "a string, b string").select(
        T.relative_time(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("v")).head()
    assert row["v"] == shown


PAGE = """<html><head><title> Acme &amp; Co | Gloves </title><meta content='All "gloves"' name="description">
<script type="application/ld+json">{"@graph": [{"sameAs": ["https://x.com/acme", 3]}], "url": "https://acme.com"}</script>
<style>p{}</style></head><body><script>var a = "<p>";</script><p>Hello&nbsp;<b>World</b></p><!-- no -->
<a class="x" href="/in">In <i>side</i></a> <a href='https://www.instagram.com/share'>s</a>
<a href="https://instagram.com/acme.gk">ig</a> sales@acme.com sales@acme.com noise@example.com
<span itemprop="url" content="acme.org"></span>
<footer><a href="https://www.facebook.com/acme">f</a><a href="https://fb.com/other">g</a><a href="/x.com/rel">r</a></footer>
</body></html>"""


def test_page_features(value):
    f = value(H.homepage_features(L(PAGE)))
    assert f["title"] == "Acme & Co | Gloves" and f["company_name"] == "Acme & Co"
    assert f["description"] == 'All "gloves"' and f["emails"] == ["sales@acme.com"]
    assert f["social"] == {"instagram": "acme.gk", "facebook": "acme"}


def test_site_name_prefers_meta(value):
    page = '<meta content="Brand" property="og:site_name"><title>A - B</title>'
    assert value(H.site_name(L(page))) == "Brand"
    assert value(H.site_name(L("<title>A – B</title>"))) == "A"
    assert value(H.site_name(L("<p>x</p>"))) == ""


def test_visible_text(value):
    assert value(H.scrape_text(L("<p>a</p><script>x</script><!-- c --><b>b &lt; c</b>"))) == "a b < c"
    assert "f" not in value(H.relevance_text(L("<nav>f</nav><p>a</p><footer>f</footer>")))


@pytest.mark.parametrize("raw,want", [
    ("&eacute;&#233;&#xE9; &amp;lt; &unknown; &amp x", "ééé &lt; &unknown; &amp x"), ("&#128512;&euro;", "😀€"),
    ("&#38;lt;", "&lt;"), ("a&#9999999;&#xD800;&#0;b", "a\ufffd\ufffd\ufffdb"), ("no entity", "no entity"), ("&apos;a&quot;", "'a\"")])
def test_entities(value, raw, want):
    assert value(H.decode_entities(L(raw))) == want


def test_footer_and_links(value):
    socials = value(H.footer_socials(L(PAGE), L("https://acme.com/p")))
    assert socials == {"facebook": "https://www.facebook.com/acme", "twitter": "https://acme.com/x.com/rel"}
    links = value(H.page_links(L(PAGE)))
    assert links["hrefs"][:2] == ["/in", "https://www.instagram.com/share"] and "in  side" in links["link_texts"][0]


def test_jsonld_walk():
    assert H.structured_urls(PAGE) == ["https://x.com/acme", "https://acme.com", "acme.org"]
    assert H.urls_in_json(json.loads('{"a": {"b": [{"link": "x.y"}, {"url": {"url": "no"}}]}, "href": "plain"}')) == ["x.y"]


def test_rule_flags(value):
    assert value(H.rule_yes(L('x "@type":"Product"'), L("https://a.com"))) is True
    assert value(H.rule_yes(L("x"), L("https://a.com/Shop"))) is True
    assert value(H.rule_no(L("nothing here"))) is True and value(H.rule_no(L("a STORE"))) is False


def test_mail_html(value):
    out = value(H.text_to_html(L("**Hook:** drop me\nHi Jo,\n\nsee **this** at www.a.com\nnow\n\n* one <b>\n- two")))
    assert out == ('<p>Hi Jo,</p><p>see <strong>this</strong> at <a href="http://www.a.com">www.a.com</a><br>now</p>'
                   "<ul><li>one &lt;b&gt;</li><li>two</li></ul>")
    assert value(H.text_to_html(L("   "))) == "" and value(H.text_to_html(L(None).cast("string"))) is None
    assert value(H.text_to_html(L("mail a@b.example {x\ny} it's https://c.de/?q=1"))) == (
        '<p>mail <a href="mailto:a@b.example">a@b.example</a>  it&#x27;s '
        '<a href="https://c.de/?q=1">https://c.de/?q=1</a></p>')


@pytest.mark.parametrize("a,b,score", [
    ("acme.com", "acme.us", 0.40), ("a-cme.com", "acme.com", 0.35), ("acme.com", "acmo.com", 0.35),
    ("acme.com", "acmxy.com", 0.30), ("acme.com", "bestacmes.com", 0.25), ("acme.com", "zzzzz.com", 0.0)])
def test_pattern_score(spark, a, b, score):
    from orgweave.operators.similarity import name_parts
    rows = {r["domain"]: r for r in name_parts(spark.createDataFrame([(a,), (b,)], "domain string")).collect()}
    cols = [L(rows[d][c]) for d in (a, b) for c in ("brand", "stem", "tld")]
    assert spark.range(1).select(S.pattern_score(*cols).alias("v")).head()["v"] == score


def test_overlap_and_cosine(value):
    arr = lambda *v: F.array(*[L(x) for x in v])
    assert value(S.email_hosts_overlap(arr("a@X.com"), arr("b@x.COM", "junk"))) is True
    assert value(S.email_hosts_overlap(F.array().cast("array<string>"), arr("b@x.com"))) is False
    m = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (L(k), L(v))])
    assert value(S.equal_handles(m(a="@Jo", b="x"), m(a="jo ", c="x"))) == 1
    assert value(S.cosine(arr(1.0, 0.0), arr(0.0, 0.0))) == 0.0
    assert value(S.cosine(arr(3.0, 4.0), arr(6.0, 8.0))) == pytest.approx(1.0)
