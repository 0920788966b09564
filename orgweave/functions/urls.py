"""URL and domain-name column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label and path lists the results depend on.
SECOND_LEVEL = ["co", "com", "net", "org", "ac"]
SECOND_LEVEL_NAME_KEY = ["co", "com", "net", "org", "ac", "gov", "edu"]
COMMON_SUBDOMAINS = ["www", "shop", "store", "web", "online", "buy", "get"]
BRAND_SUFFIXES = ["store", "shop", "direct", "global", "official"]
SHOP_PATHS = ["/cart", "/checkout", "/product", "/products", "/collections", "/shop"]
URL_BLACKLIST = [
    "google.", "youtube.", "facebook.", "linkedin.", "instagram.", "pinterest.", "webcache.", "amazon.", "ebay.",
    "exporthub.", "etradeasia.", "alibaba.", "etsy.", "walmart.", "tiktok.", "temu.", "daraz.", "reddit.",
]
SKIP_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "svg", "ico", "zip", "rar", "7z", "tar", "gz", "pdf",
]
PATTERN_SUBDOMAINS = ["shop", "blog", "store", "www", "mail", "app", "portal", "secure"]
FALLBACK_SUFFIXES = ["com", "co.uk", "io", "net", "org"]
HAS_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def quoted_any(words: list[str]) -> str:
    """An alternation of literal words, safe in Java and RE2 regexes."""
    special = set(r"\.^$|()[]{}*+?-")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def contains_any(col: Column, words: list[str]) -> Column:
    return col.rlike(quoted_any(words))


def url_host(url: Column) -> Column:
    """Lower-case host without a leading www.; scheme-less text up to its path counts as host."""
    netloc = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_extract(url, r"^([^/?#]*)", 1)
    host = F.lower(F.when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), netloc).otherwise(bare))
    return F.regexp_replace(host, r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Drop the fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def _collapse_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(path, "/")
    def step(acc: Column, seg: Column) -> Column:
        return (F.when(seg.isin("", "."), acc)
                .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                .otherwise(F.concat(acc, F.array(seg))))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_open = path.rlike(r"(/|/\.|/\.\.)$") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)

    def joined(path: Column) -> Column:
        # repeated slashes are kept unless there are dot segments to resolve
        clean = F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _collapse_dots(path)).otherwise(path)
        return F.concat(root, clean, tail)

    return (F.when(href == "", base)
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), joined(href_path))
            .when(href.startswith("#"), F.concat(no_fragment, href))
            .when(href.startswith("?"), F.concat(no_query, href))
            .otherwise(joined(F.concat(folder, href_path))))


def domain_root(domain: Column) -> Column:
    """Last two labels, or three after a generic second-level label."""
    labels = F.split(F.lower(domain), r"\.")
    n = F.size(labels)
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    return (F.when((n >= 3) & F.get(labels, n - 2).isin(SECOND_LEVEL), three)
            .when(n >= 2, two).otherwise(domain))


def domain_name_key(domain: Column) -> Column:
    """Brand-level key: the label in front of the top-level part."""
    shops = "|".join(COMMON_SUBDOMAINS)
    trimmed = F.regexp_replace(F.lower(domain), rf"^(?:(?:{shops})\.)*([^.]+\..+)$", "$1")
    labels = F.split(trimmed, r"\.")
    n = F.size(labels)
    return (F.when((n >= 3) & F.get(labels, n - 2).isin(SECOND_LEVEL_NAME_KEY), F.get(labels, n - 3))
            .when(n >= 2, F.get(labels, n - 2)).otherwise(F.get(labels, F.lit(0))))


def suffix_rules(lines: DataFrame, private: bool = False) -> DataFrame:
    """(base, kind) out of the lines of a public-suffix list: plain, wildcard and exception rules.

    ``lines``: a string column ``line`` and, where the order of the file counts, an integer ``at``. A rule ends at the first blank;
    ``//`` begins a comment. Rules between the private section's markers are taken with ``private`` only.
    ``*.ck`` is the wildcard of base ck, ``!www.ck`` an exception of base www.ck.
    """
    text = F.lower(F.regexp_extract("line", r"^[ \t\uFEFF]*([^ \t\r\n]*)", 1))
    kept = lines
    if not private and "at" in lines.columns:
        begins, ends = (lines.where(F.col("line").contains(f"==={word} PRIVATE DOMAINS===")).agg(F.min("at")).scalar()
                        for word in ("BEGIN", "END"))
        outside = (F.col("at") < begins) | (F.col("at") > F.coalesce(ends, F.lit(2 ** 62)))
        kept = lines.where(F.coalesce(outside, F.lit(True)))
    rules = kept.select(text.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain")
    return rules.select(F.regexp_replace("rule", r"^(?:!|\*\.|\.)", "").alias("base"), kind.alias("kind")).distinct()


def read_suffix_rules(spark, path: str, private: bool = False) -> DataFrame:
    """The rules of a public-suffix list file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return suffix_rules(lines, private)


def registrable_domain(df: DataFrame, host: str, rules: DataFrame, name: str = "registrable") -> DataFrame:
    """Add the registrable domain of ``host``: its public suffix and the label before it.

    ``rules`` come from ``suffix_rules``. Of the rules that match, an exception wins and
    its suffix starts one label later; otherwise the longest suffix counts, a wildcard
    taking one label more than its base. A host that is a suffix itself stays whole, one that no
    rule matches is its last label, an IPv4 address stays whole.

    Each distinct host is split into its at most 127 tails, which meet the rules by equality.
    """
    if not {"base", "kind"} <= set(rules.columns):
        raise ValueError("give the rules of a public-suffix list, see suffix_rules")
    hosts = df.select(F.col(host).alias("_host")).where(F.col(host).isNotNull()).distinct()
    labels = F.split(F.regexp_replace(F.lower(F.col("_host")), r"\.$", ""), r"\.")
    tails = hosts.select(
        "_host", F.posexplode(F.transform(
            labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("_at", "_tail"))
    # where the suffix starts: before the base of a wildcard, behind the first label of an exception
    starts = F.col("_at") + F.when(F.col("kind") == "wildcard", -1).when(F.col("kind") == "exception", 1).otherwise(0)
    best = (tails.join(rules.select(F.col("base").alias("_tail"), "kind").distinct(), "_tail", "inner")
            .withColumn("_cut", starts).where("_cut >= 0").groupBy("_host")
            .agg(F.coalesce(F.min(F.when(F.col("kind") == "exception", F.col("_cut"))), F.min("_cut")).alias("_cut")))
    cut = F.when(F.col("_host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 0).otherwise(F.coalesce("_cut", F.size(labels)))
    found = hosts.join(best, "_host", "left").select("_host", F.array_join(F.slice(
        labels, F.greatest(cut, F.lit(1)), F.size(labels)), ".").alias(name))
    return df.join(found, F.col(host) == F.col("_host"), "left").drop("_host")


def site_stem(domain: Column) -> Column:
    """First label without separators."""
    return F.lower(F.regexp_replace(F.get(F.split(domain, r"\."), F.lit(0)), r"[-_]", ""))


def brand_name(domain: Column, expand_gk: bool = True) -> Column:
    """First label without shop suffixes and separators."""
    base = F.get(F.split(domain, r"\."), F.lit(0))
    for suffix in BRAND_SUFFIXES:
        base = F.regexp_replace(base, f"{suffix}$", "")
    base = F.regexp_replace(base, r"[-_]", "")
    if expand_gk:
        base = F.regexp_replace(base, "gk", "goalkeeper")
    return F.trim(F.lower(base))


def base_domain(domain: Column) -> Column:
    """All labels but the last."""
    return F.coalesce(F.regexp_replace(domain, r"\.[^.]*$", ""), F.lit(""))


def has_shop_path(url: Column) -> Column:
    return contains_any(F.lower(url), SHOP_PATHS)


def allowed_url(url: Column) -> Column:
    """http(s) URL that names none of the large platforms."""
    return url.startswith("http") & ~contains_any(url, URL_BLACKLIST)


def has_page_extension(url: Column) -> Column:
    """True unless the path ends in a binary file type."""
    ext = F.regexp_extract(F.lower(url_path(url)), r"[^/.][^/]*\.([a-z0-9]+)$", 1)
    return ~ext.isin(SKIP_EXTENSIONS)


def domain_keyword_score(domain: Column, variants: list[str]) -> Column:
    """0 / 0.3 / 0.5 / 0.7 for none, one, two or more variants in the domain."""
    low = F.lower(domain)
    hits = sum((F.when(low.contains(v.lower()), 1).otherwise(0) for v in variants), F.lit(0))
    return (F.when(domain.isNull() | (domain == "") | (hits == 0), F.lit(0.0))
            .when(hits == 1, F.lit(0.3)).when(hits == 2, F.lit(0.5)).otherwise(F.lit(0.7)))


def valid_url(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}(/.*)?$")


def prefix_match(domain: Column, prefix: str) -> Column:
    """Domain equals ``prefix`` or continues with a dot, whatever the case."""
    return domain.rlike(f"(?i)^(?:{quoted_any([prefix])})(\\.|$)")


def plain_patterns(domain: Column) -> Column:
    base = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    www = F.concat(F.lit("www."), base)
    lead = lambda s, c: F.concat(F.lit(s), c)
    return F.array(base, www, lead("https://", base), lead("http://", base), lead("https://", www),
                   lead("http://", www), lead("//", base), lead("//", www),
                   F.concat(base, F.lit("/")), F.concat(www, F.lit("/")))


# How a redirect link spells a domain.
ENCODED_PATTERNS = [
    "http%3a%2f%2f{0}", "https%3a%2f%2f{0}", "http%3a%2f%2fwww.{0}", "https%3a%2f%2fwww.{0}",
    "http%3A%2F%2F{0}", "https%3A%2F%2F{0}", "http%3A%2F%2Fwww.{0}", "https%3A%2F%2Fwww.{0}",
    "%2f%2f{0}", "%2f%2fwww.{0}", "%2F%2F{0}", "%2F%2Fwww.{0}",
]


def encoded_patterns(domain: Column) -> Column:
    base = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    return F.transform(F.array(*[F.lit(p) for p in ENCODED_PATTERNS]), lambda p: F.replace(p, F.lit("{0}"), base))


def subdomain_patterns(domain: Column) -> Column:
    base = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    return F.array(*[F.concat(F.lit(f"{lead}{sub}."), base)
                     for sub in PATTERN_SUBDOMAINS for lead in ("", "https://", "http://")])


def domain_patterns(domain: Column) -> Column:
    return F.concat(plain_patterns(domain), encoded_patterns(domain), subdomain_patterns(domain))


def fallback_patterns(domain: Column) -> Column:
    """Stem with five common suffixes; empty for stems under five characters."""
    base = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    stem = F.get(F.split(base, r"\."), F.lit(0))
    return F.when(F.length(stem) >= 5, F.array(*[F.concat(stem, F.lit("." + s)) for s in FALLBACK_SUFFIXES])
                  ).otherwise(F.array().cast("array<string>"))
