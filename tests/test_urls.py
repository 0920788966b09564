import pytest
from pyspark.sql import functions as F

from orgweave.functions import urls as U

L = F.lit


@pytest.mark.parametrize("given,host", [
    ("https://WWW.Acme.com/x", "acme.com"), ("acme.com/x?y", "acme.com"), ("//cdn.a.com/x", "cdn.a.com"),
    ("http://a.com:8080#t", "a.com:8080")])
def test_url_host(value, given, host):
    assert value(U.url_host(L(given))) == host


def test_canonical_url(value):
    assert value(U.canonical_url(L("https://a.com/x/#top"))) == "https://a.com/x"


@pytest.mark.parametrize("href,want", [
    ("/b", "https://a.com/b"), ("b", "https://a.com/x/b"), ("../b?q#f", "https://a.com/b?q#f"), ("./b/", "https://a.com/x/b/"),
    ("//c.com/d", "https://c.com/d"), ("http://e.f", "http://e.f"), ("mailto:x@y.z", "mailto:x@y.z"),
    ("?p=2", "https://a.com/x/y?p=2"), ("#t", "https://a.com/x/y?q=1#t"), ("../../../z", "https://a.com/z"),
    ("", "https://a.com/x/y?q=1#old")])
def test_resolve_url(value, href, want):
    assert value(U.resolve_url(L("https://a.com/x/y?q=1#old"), L(href))) == want


@pytest.mark.parametrize("given,root", [("www.example.com", "example.com"), ("shop.example.co.uk", "example.co.uk"),
                                        ("localhost", "localhost"), ("a.b", "a.b")])
def test_domain_root(value, given, root):
    assert value(U.domain_root(L(given))) == root


@pytest.mark.parametrize("given,key", [
    ("theoneglove.com.au", "theoneglove"), ("www.theoneglove.com", "theoneglove"), ("shop.com", "shop"),
    ("get.buy.shop.acme.gov.uk", "acme"), ("www.shop.com", "shop"), ("blog.acme.com", "acme"), ("single", "single")])
def test_domain_name_key(value, given, key):
    assert value(U.domain_name_key(L(given))) == key


@pytest.mark.parametrize("given,brand", [
    ("nike.com", "nike"), ("renegade-gk.co.uk", "renegadegoalkeeper"), ("acmestore.com", "acme"),
    ("acmeshopstore.com", "acme"), ("acmestoreshop.com", "acmestore"), ("A_B-C.com", "abc")])
def test_brand_name(value, given, brand):
    assert value(U.brand_name(L(given))) == brand


def test_brand_name_without_expansion(value):
    assert value(U.brand_name(L("renegade-gk.co.uk"), expand_gk=False)) == "renegadegk"


def test_base_domain(value):
    assert value(U.base_domain(L("eu.t1tan.com"))) == "eu.t1tan"
    assert value(U.base_domain(L("plain"))) == "plain"
    assert value(U.base_domain(L(None).cast("string"))) == ""


@pytest.mark.parametrize("domain,hit", [("acme.com", True), ("ACME.co.uk", True), ("acme", True), ("acmes.com", False)])
def test_prefix_match(value, domain, hit):
    assert value(U.prefix_match(L(domain), "acme")) is hit


def test_prefix_is_literal(value):
    assert value(U.prefix_match(L("acme.com"), "a.me")) is False


def test_domain_keyword_score(value):
    assert value(U.domain_keyword_score(L("just-keepers.com"), ["keeper", "gloves"])) == 0.3
    assert value(U.domain_keyword_score(L("gk-keeper-gloves.com"), ["keeper", "gloves", "gk"])) == 0.7
    assert value(U.domain_keyword_score(L(""), ["keeper"])) == 0.0


def test_extensions_and_blacklist(value):
    assert value(U.has_page_extension(L("https://a.com/x.PDF?v=1"))) is False
    assert value(U.has_page_extension(L("https://a.com/x.html"))) is True
    assert value(U.has_page_extension(L("https://a.jpg/"))) is True
    assert value(U.allowed_url(L("https://www.amazon.de/x"))) is False
    assert value(U.allowed_url(L("ftp://acme.com"))) is False
    assert value(U.allowed_url(L("https://acme.com"))) is True


def test_pattern_counts(value):
    assert len(value(U.plain_patterns(L("acme.com")))) == 10
    assert len(value(U.encoded_patterns(L("acme.com")))) == 12
    assert len(value(U.subdomain_patterns(L("acme.com")))) == 24
    assert value(U.fallback_patterns(L("abc.com"))) == []


LIST = """// ===BEGIN ICANN DOMAINS===
com
biz  // a comment behind a rule
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
ak.us
k12.ak.us
co.uk
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
// ===END PRIVATE DOMAINS===
"""

# The test cases that go with the public list, as far as these rules reach; a suffix alone stays whole here.
CASES = {
    "COM": "com", "example.COM": "example.com", "WwW.example.COM": "example.com", "b.example.com": "example.com",
    "a.b.example.com": "example.com", "biz": "biz", "domain.biz": "domain.biz", "b.domain.biz": "domain.biz",
    "a.b.domain.biz": "domain.biz", "jp": "jp", "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": "ac.jp",
    "test.ac.jp": "test.ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": "kyoto.jp", "test.kyoto.jp": "test.kyoto.jp",
    "ide.kyoto.jp": "ide.kyoto.jp", "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp",
    "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp",
    "www.city.kobe.jp": "city.kobe.jp", "ck": "ck", "test.ck": "test.ck", "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck",
    "www.ck": "www.ck", "www.www.ck": "www.ck", "us": "us", "test.us": "test.us", "www.test.us": "test.us", "ak.us": "ak.us",
    "test.ak.us": "test.ak.us", "www.test.ak.us": "test.ak.us", "k12.ak.us": "k12.ak.us", "test.k12.ak.us": "test.k12.ak.us",
    "www.test.k12.ak.us": "test.k12.ak.us", "x.y.unknown": "unknown", "10.0.0.1": "10.0.0.1", "a.blogspot.com": "blogspot.com",
    "example.com.": "example.com", "": "",
}


def test_registrable_domains_follow_the_list(spark, tmp_path):
    (tmp_path / "list.dat").write_text(LIST)
    df = spark.createDataFrame([(h,) for h in [*CASES, None]], "host string")
    rules = U.read_suffix_rules(spark, str(tmp_path / "list.dat"))
    got = {r["host"]: r["registrable"] for r in U.registrable_domain(df, "host", rules).collect()}
    assert got == CASES | {None: None}
    private = U.read_suffix_rules(spark, str(tmp_path / "list.dat"), private=True)
    own = U.registrable_domain(df.where("host = 'a.blogspot.com'"), "host", private).collect()
    assert own[0]["registrable"] == "a.blogspot.com"
    with pytest.raises(ValueError, match="public-suffix"):
        U.registrable_domain(df, "host", spark.createDataFrame([("com",)], "suffix string"))
