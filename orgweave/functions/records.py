"""Labelled text of product and company records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions.text import record_text


def json_string(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\\\\\"), '"', '\\\\\\\\"'),
                    F.lit('"'))


def map_text(specs: Column) -> Column:
    """JSON object text with spaces after the separators; null for an empty map."""
    pairs = F.transform(F.map_entries(specs),
                        lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def joined(values: Column, sep: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def product_text(features: Column | None = None) -> Column:
    """Text of a product row (brand, name, category, description, specs, price, reviews)."""
    if features is not None:
        return record_text([("Product", F.col("name")), ("Brand", F.col("brand")), ("Category", F.col("category")),
                            ("Description", F.col("description")), ("Price", F.col("price")),
                            ("Features", joined(features, ", "))])
    return record_text([("Brand", F.col("brand")), ("Name", F.col("name")), ("Category", F.col("category")),
                        ("Description", F.col("description")), ("Specifications", map_text(F.col("specs"))),
                        ("Price", F.col("price")), ("Reviews", joined(F.col("reviews"), " | "))])


def company_text(by_type: Column | None = None) -> Column:
    """Text of a company row; with ``by_type`` (value arrays per contact type) contacts are appended."""
    bullets = F.transform(F.col("notes"), lambda n: F.concat(F.lit("- "), n))
    notes = F.when(F.size("notes") > 0, F.array_join(bullets, "\n"))
    head = "Key Insights" if by_type is not None else "Key Information"
    parts = [record_text([("Company", F.col("company_name")), ("Description", F.col("description"))]),
             F.concat(F.lit(f"{head}:\n"), notes)]
    if by_type is not None:
        lines = record_text([("Email", joined(by_type["email"], ", ")), ("Phone", joined(by_type["phone"], ", ")),
                             ("Address", joined(by_type["address"], " | "))])
        parts.append(F.when(lines != "", F.concat(F.lit("Contact Information:\n"), lines)))
    parts[0] = F.when(parts[0] != "", parts[0])
    return F.concat_ws("\n", *parts)
