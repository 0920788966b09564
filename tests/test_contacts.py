import random
import re
import time

import pytest
from pyspark.sql import functions as F

from orgweave.functions import contacts as C
from orgweave.operators import contacts as ops

L = F.lit


def test_phones_are_scored_by_context(value):
    text = "Call us: +48 601 000 000. " + "x" * 60 + " our fax (555) 010-0199 " + "y" * 60 + " 5550100200 tel:12"
    found = value(C.extract_phones(L(text)))
    assert [(f["value"], f["confidence"]) for f in found][:3] == [
        ("+48 601 000 000", 0.9), ("(555) 010-0199", 0.8), ("5550100200", 0.9)]
    assert found[0]["context"] == text[:74].strip()
    for f in found:
        at = text.index(f["value"])
        assert text[max(0, at - 50):at + len(f["value"]) + 50].strip() == f["context"]
    assert value(C.extract_phones(L("only 123456"))) == [] and value(C.extract_phones(L(None).cast("string"))) == []


def test_phone_digits_of_any_script(value):
    assert [f["value"] for f in value(C.extract_phones(L("tel \u0665\u0665\u0665-\u0660\u0661\u0660-\u0660\u0661\u0669\u0669")))] == [
        "\u0665\u0665\u0665-\u0660\u0661\u0660-\u0660\u0661\u0669\u0669"]


def test_first_of_repeated_phones_stays(value):
    found = value(C.extract_phones(L("a 555-010-0199 and b 555-010-0199"), 2))
    assert [(f["value"], f["context"]) for f in found] == [("555-010-0199", "a 555-010-0199 a")]


def test_contexts_equal_slices_of_the_text(value):
    rng = random.Random(8)
    parts = ["555-010-0199", "+48 601 000 000", "5550100200", " ", "x", "call", "\n", "tel:+1 2", "z" * 30, "(555) 010-0199", "é", "1"]
    for _ in range(8):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))
        for around in (0, 7, 50):
            for pattern in C.PHONE_PATTERNS:
                want = [(m[0], text[max(0, m.start() - around):m.end() + around].strip(C.BLANKS))
                        for m in re.finditer(f"(?i){pattern}", text)]
                assert [(x["hit"], x["context"]) for x in value(C.spans(L(text), pattern, around))] == want


def test_a_text_of_100000_numbers_takes_linear_time(spark):
    rows = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.concat(
        F.lit("555 "), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(" "), F.lpad((F.floor(i / 10)).cast("string"), 4, "0"))),
        ", ").alias("text"))
    start = time.time()
    found = rows.select(F.explode(C.extract_phones(F.col("text"))).alias("c")).select("c.*").collect()
    assert len(found) == len({f["value"] for f in found}) == 100_000 and time.time() - start < 60
    assert found[0]["context"].startswith("555 000 0000, 555 001 0000")


def test_whatsapp(value):
    found = value(C.extract_whatsapp(L("wa.me/48601000000 or chat.whatsapp.com/abc, whatsapp +1 555 010 0199"),
                                     L("<a href='https://api.whatsapp.com/send?phone=4915'>")))
    rows = [(f["value"], f["confidence"], f["source"]) for f in found]
    assert rows[:3] == [("48601000000", 0.95, "text"), ("chat.whatsapp.com/abc", 0.8, "text"), ("4915", 0.95, "html")]
    assert ("+1 555 010 0199", 0.85, "keyword_match") in rows[3:]
    assert {r[2] for r in rows[3:]} == {"keyword_match"} and found[0]["context"].startswith("wa.me/48601000000 or")
    assert value(C.extract_whatsapp(L("a whatsapp 5550100199 b")))[0]["value"] == "5550100199"
    assert value(C.extract_whatsapp(L(None).cast("string"))) == [] and value(C.extract_whatsapp(L(""))) == []


def test_linkedin_and_social(value):
    found = value(C.extract_linkedin(L("see LinkedIn.com/in/jo-doe! and http://linkedin.com/company/acme"),
                                     L("linkedin.com/company/acme")))
    assert [(c["value"], c["type"], c["source"]) for c in found] == [
        ("https://LinkedIn.com/in/jo-doe", "linkedin_individual", "text"),
        ("https://linkedin.com/company/acme", "linkedin_company", "text")]
    social = value(C.extract_social(L("instagram.com/acme. @acme")))
    assert [(c["type"], c["value"], c["confidence"]) for c in social] == [
        ("social_instagram", "https://instagram.com/acme.", 0.9), ("social_instagram", "@acme", 0.6),
        ("social_twitter", "@acme", 0.6), ("social_tiktok", "@acme", 0.6)]


@pytest.mark.parametrize("given,norm,ok", [("(555) 010-0199", "+5550100199", True), ("010-0199", "0100199", True),
                                           ("12", "12", False)])
def test_normalize_phone(value, given, norm, ok):
    assert value(C.normalize_phone(L(given))) == norm
    assert value(C.is_valid_phone(L(norm))) is ok


def test_validate_phone(value):
    bad = value(C.validate_phone(L("010-0199")))
    assert not bad["is_valid"] and bad["normalized"] == "010-0199" and bad["country"] is None
    good = value(C.validate_phone(L("+48 601 000 000")))
    assert good["is_valid"] and good["country"] == "Poland" and good["digit_count"] == 11
    assert value(C.validate_phone(L("abc")))["reason"] == "No digits found"


def test_validate_whatsapp(value):
    ok = value(C.validate_whatsapp(L("https://wa.me/48601000000?text=x")))
    assert ok["is_valid"] and ok["normalized"] == "+48601000000" and ok["original_format"] == "link"
    lost = value(C.validate_whatsapp(L("chat.whatsapp.com/abc")))
    assert lost["reason"] == "Could not extract number from WhatsApp link"


def test_validate_profiles(value):
    ok = value(C.validate_linkedin(L(" www.linkedin.com/company/acme/?trk=1")))
    assert ok["is_valid"] and ok["normalized"] == "https://www.linkedin.com/company/acme" and ok["profile_type"] == "company"
    assert not value(C.validate_linkedin(L("linkedin.com/feed")))["is_valid"]
    assert value(C.validate_social(L("https://x.com/acme")))["platform"] == "twitter"
    assert value(C.validate_social(L("https://netflix.com/acme")))["reason"] == "Unknown social media platform"


@pytest.mark.parametrize("email,reason", [
    ("noreply@a.com", "Email matches avoid pattern: ^noreply@"), ("bad-format@", "Invalid email format"),
    ("u@tempmail.com", "Disposable email domain"), (" Jo@A.com ", None), ("", "Empty or invalid email")])
def test_email_syntax(value, email, reason):
    assert value(C.email_syntax(L(email))) == reason


def test_email_verdict(value):
    v = lambda **kw: value(C.email_verdict(L("jo@a.com"), L(kw.get("white", False)), L(kw.get("black", False)),
                                           L(kw.get("mx", True)), L(kw.get("smtp")).cast("boolean")))
    assert v(smtp=False)["is_valid"] and "rejection" in v(smtp=False)["reason"]
    assert v()["is_valid"] and "blocked" in v()["reason"]
    assert v(smtp=True)["reason"] is None
    assert not v(mx=False)["is_valid"] and not v(black=True)["is_valid"] and v(white=True, black=True)["is_valid"]


@pytest.mark.parametrize("counts,tier", [((1, 1, 0, 0), "high"), ((0, 1, 0, 1), "medium"), ((0, 0, 1, 3), "low")])
def test_contact_tier(value, counts, tier):
    assert value(C.contact_tier(*[L(c) for c in counts])) == tier


def test_contact_notes(value):
    none = F.array().cast("array<string>")
    assert value(C.contact_notes(L(0), L(0), L(0), L(0), none)) == "No additional contacts found"
    assert value(C.contact_notes(L(1), L(2), L(0), L(1), F.array(L("x")))) == (
        "Found 1 WhatsApp number(s); Found 2 phone number(s); Found 1 LinkedIn company page(s); "
        "Found 1 social media account(s): x")


def test_dedup_contacts(spark):
    df = spark.createDataFrame([("phone", "X", 0.5, 1), ("phone", "x", 0.9, 2), ("phone", "X", 0.9, 3)],
                               "type string, value string, confidence double, seq int")
    assert [tuple(r) for r in ops.dedup_contacts(df).collect()] == [("phone", "x", 0.9, 2)]


@pytest.mark.parametrize("url,platform,want", [
    ("https://instagram.com/acme/?x=1", "instagram", "https://instagram.com/acme"),
    ("https://instagram.com/p/1", "instagram", None), ("https://instagram.com", "instagram", None),
    ("https://x.com/a/status/1", "x", None), ("https://facebook.com/acme#a", "facebook", "https://facebook.com/acme"),
    ("https://youtube.com/watch?v=1", "youtube", None), ("https://other.com/a/", "unknown", "https://other.com/a")])
def test_clean_social_url(value, url, platform, want):
    assert value(C.clean_social_url(L(url), L(platform))) == want


def test_names_and_modes(value):
    assert value(C.name_from_slug(L("https://linkedin.com/in/john-doe-123"))) == "John Doe"
    assert value(C.brand_variations(L("solo2gk.com"), L("Solo 2GK"))) == ["solo2gk", "solo 2 gk", "solo-2-gk", "Solo 2GK"]
    assert value(C.search_mode(F.lit(None).cast("map<string,struct<is_valid:boolean>>"))) == "aggressive"


def test_profile_enrichment(spark):
    from orgweave.plans.enrichment import enrich_profile
    rows = [("a.com", "Call +48 601 000 000", ["whatsapp +48 601 000 001"], {"linkedin": "https://l/c", "x": " "},
             {"m": (True,)}), ("b.com", None, [], {}, None)]
    df = spark.createDataFrame(rows, "domain string, description string, notes array<string>, social map<string,string>, "
                                     "verification map<string,struct<is_valid:boolean>>")
    out = enrich_profile(df)
    got = {r["domain"]: r for r in out["summary"].collect()}
    assert got["a.com"]["contact_score"] == "high" and got["a.com"]["search_mode"] == "lenient"
    assert got["b.com"]["contact_score"] == "low" and got["b.com"]["search_mode"] == "aggressive"
    values = {(r["type"], r["value"]) for r in out["contacts"].where("domain = 'a.com'").collect()}
    assert ("phone", "+48601000000") in values and ("linkedin_company", "https://l/c") in values
