"""Fuzzy domain matching by blocking keys instead of an all-pairs comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.scores import pattern_score
from orgweave.functions.urls import brand_name, site_stem
from orgweave.operators import name_pairs
from orgweave.operators.name_pairs import equal_names, names_inside, near_names
from orgweave.partitioning import first_n_per_key
from orgweave.session import stored

SHORT, PARTS = 3, 64  # brands of so few characters have their pairs dealt over so many parts
GRAM = 3  # longer brands meet the suffixes that begin with the same characters
GROUP_ROWS = 200_000  # suffixes with one beginning that a task sorts together


def name_parts(df: DataFrame, domain: str = "domain", expand_gk: bool = True) -> DataFrame:
    """Distinct domains with brand, stem and last label."""
    col = F.col(domain)
    return df.select(col.alias("domain")).where(col.isNotNull()).distinct().select(
        "domain", brand_name(F.col("domain"), expand_gk).alias("brand"), site_stem(F.col("domain")).alias("stem"),
        F.substring_index("domain", ".", -1).alias("tld"))


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))


def deletion_keys(brand: Column, edits: int = 2) -> Column:
    """Hashes of the brand and of all forms with one (or two) characters left out.

    Two brands within edit distance ``edits`` share at least one key. Hash clashes
    only add candidates, which are checked afterwards.
    """
    def shorter(text: Column) -> Column:
        return F.when(F.length(text) >= 1, F.transform(
            F.sequence(F.lit(1), F.length(text)), lambda i: _without(text, i))).otherwise(F.array().cast("array<string>"))

    one = shorter(brand)
    forms = [F.array(brand), one] + ([F.flatten(F.transform(one, shorter))] if edits == 2 else [])
    return F.transform(F.array_distinct(F.concat(*forms)), lambda s: F.xxhash64(s))


def _stretches(brand: Column, shortest: int, longest: Column | int) -> Column:
    """The distinct stretches at each place, of ``shortest`` characters to ``longest``, as far as there are so many."""
    places = F.sequence(F.lit(1), F.length(brand) - shortest + 1)
    sizes = lambda i: F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(brand) - i + 1))
    cut = F.flatten(F.transform(places, lambda i: F.transform(sizes(i), lambda n: F.substring(brand, i, n))))
    return F.when(F.length(brand) >= shortest, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def suffixes(brand: Column, shortest: int = GRAM) -> Column:
    """The ends of a brand, ``shortest`` characters at least: one per place."""
    places = F.sequence(F.lit(1), F.length(brand) - shortest + 1)
    return F.when(F.length(brand) >= shortest, F.transform(places, lambda i: F.substring(brand, i, F.length(brand)))).otherwise(
        F.array().cast("array<string>"))


def _dealt(brand: str, other: str) -> Column:
    """Part of a short brand's pairs that a pair goes to: short brands stand in a great many others."""
    return F.when(F.length(brand) <= SHORT, F.pmod(F.xxhash64(other), F.lit(PARTS))).otherwise(0).cast("int")


def _copied(brand: str) -> Column:
    """One row for each part of a short brand's pairs."""
    parts = F.when(F.length(brand) <= SHORT, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return F.explode(parts)


def _begins(rows: DataFrame) -> DataFrame:
    """(x, y) for every suffix of x that begins with the brand y, out of rows (gram, part, key, x); x is null for brands.

    Sorted by key, the brands that a suffix begins with are those on a stack of
    nested beginnings: a row takes off what it doesn't begin with.
    """
    schema = pa.schema([("x", pa.string()), ("y", pa.string())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            xs, ys = [], []
            for gram, part, key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gram, part) != group:
                    group, stack = (gram, part), []
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                if x is None:
                    stack.append(key)
                else:
                    xs += [x] * len(stack)
                    ys += stack
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.string()), pa.array(ys, pa.string())], schema=schema)

    order = ["gram", "part", "key", "x"]  # a brand comes before the suffixes that equal it
    return rows.repartition("gram", "part").sortWithinPartitions(*order).select(*order).mapInArrow(match, "x string, y string")


def containment_pairs(long: DataFrame, short: DataFrame) -> DataFrame:
    """(long, short) for every non-empty brand of ``short`` that stands in a brand of ``long``; a pair may come repeatedly.

    A brand stands in another where it begins one of its suffixes. Suffixes and
    brands are sorted together, a group per first ``GRAM`` characters; a beginning
    that a great many suffixes share is dealt over several groups with copies of its brands. Brands
    shorter than that are looked up among the few characters and pairs of characters of the others.
    """
    (x,), (y,) = long.columns, short.columns
    few = long.select(x, F.explode(_stretches(F.col(x), 1, GRAM - 1)).alias(y)).withColumn("_part", _dealt(y, x))
    few = few.join(short.where(F.length(y) < GRAM).select(y, _copied(y).alias("_part")), [y, "_part"], "left_semi").select(x, y)
    gram = F.substring("key", 1, GRAM).alias("gram")
    ends = long.select(F.col(x).alias("x"), F.explode(suffixes(F.col(x))).alias("key")).select("x", "key", gram)
    brands = short.where(F.length(y) >= GRAM).select(F.col(y).alias("key")).select("key", gram)
    parts = ends.groupBy("gram").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).cast("int").alias("parts")).join(
        brands.select("gram").distinct(), "gram", "left_semi")
    dealt = ends.join(parts, "gram").select("gram", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), "key", "x")
    copies = brands.join(parts, "gram").select(
        "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "key", F.lit(None).cast("string").alias("x"))
    found = _begins(dealt.unionByName(copies))
    return few.unionByName(found.select(F.col("x").alias(x), F.col("y").alias(y)))


def near_pairs(a: DataFrame, b: DataFrame, edits: int = 2) -> DataFrame:
    """(a, b) brands within ``edits`` edits; a pair may come repeatedly."""
    keyed = lambda df, c: df.select(c, F.explode(deletion_keys(F.col(c), edits)).alias("_key"))
    return (keyed(a, "a").join(keyed(b, "b"), "_key")
            .where((F.abs(F.length("a") - F.length("b")) <= edits) & (F.levenshtein("a", "b", edits) >= 0))
            .select("a", "b"))


def domains_of_brands(a: DataFrame, old: DataFrame, brands: DataFrame) -> DataFrame:
    """The rows of ``a`` and ``old`` (its columns named c_) whose brands are a pair (a, b)."""
    dealt = brands.withColumns({"_pa": _dealt("a", "b"), "_pb": _dealt("b", "a")})
    return (a.withColumn("_qa", _copied("brand"))
            .join(dealt, (F.col("brand") == F.col("a")) & (F.col("_qa") == F.col("_pa")))
            .join(old.withColumn("_qb", _copied("c_brand")), (F.col("b") == F.col("c_brand")) & (F.col("_qb") == F.col("_pb")))
            .select(*a.columns, *old.columns))


def score_of_names() -> Column:
    """The name score of a pair of rows of ``name_parts``, the second with its columns named c_."""
    return pattern_score(F.col("brand"), F.col("stem"), F.col("tld"), F.col("c_brand"), F.col("c_stem"), F.col("c_tld"))


def fuzzy_domain_join(new: DataFrame, existing: DataFrame, threshold: float = 0.20, expand_gk: bool = True) -> DataFrame:
    """(domain, candidate, pattern_score) for all pairs with score >= ``threshold``.

    Domains should be registrable domains: a brand then occurs at most once per
    public suffix, which bounds how many domains share it.
    """
    a = stored(name_parts(new, expand_gk=expand_gk), "names")
    b = stored(name_parts(existing, expand_gk=expand_gk), "names")
    found = equal_names(a, b.withColumnsRenamed({c: f"c_{c}" for c in b.columns}), score_of_names())
    if threshold <= 0.35:
        cards = stored(name_pairs.cards(a, b), "cards")
        counts = name_pairs.sizes(cards)
        found = found.unionByName(near_names(cards, counts))
        if threshold <= 0.25:
            found = found.unionByName(names_inside(cards, counts))
    return found.where(F.col("pattern_score") >= threshold)


# the name scores there are, best first, and how their pairs are found among the brands of two tables
NAME_CLASSES = [
    (0.40, lambda a, b: None),
    (0.35, lambda a, b: near_pairs(a, b, 1)),
    (0.30, lambda a, b: near_pairs(a, b, 2)),
    (0.25, lambda a, b: containment_pairs(a, b).unionByName(containment_pairs(b, a))),
]


def pairs_of_class(a: DataFrame, old: DataFrame, score: float) -> DataFrame:
    """The rows of ``a`` and ``old`` whose names score exactly ``score``; a pair may come repeatedly."""
    find = dict(NAME_CLASSES)[score]
    brands = find(a.select(F.col("brand").alias("a")).distinct(), old.select(F.col("c_brand").alias("b")).distinct())
    if brands is None:
        pairs = a.join(old, F.col("brand") == F.col("c_brand"))
    else:
        pairs = domains_of_brands(a, old, brands.distinct())
    if score == 0.35:
        pairs = pairs.unionByName(a.join(old, F.col("stem") == F.col("c_stem")))
    return pairs.where((F.col("domain") != F.col("c_domain")) & (score_of_names() == score))


def best_duplicate(scored: DataFrame) -> DataFrame:
    """Best candidate per domain by total score; the earliest candidate (``seq``) wins ties."""
    total = F.col("pattern_score") + F.col("homepage_score")
    return first_n_per_key(scored.withColumn("total_score", total).where("total_score > 0"), ["domain"],
                           [F.col("total_score").desc(), "seq"])
