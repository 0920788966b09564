"""Merging the partial profiles of a domain's chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the platforms a profile knows.
PLATFORMS = ["linkedin", "instagram", "twitter", "facebook", "youtube", "tiktok"]


def merge_profiles(chunks: DataFrame) -> dict[str, DataFrame]:
    """Fold chunk profiles into one profile per domain.

    ``chunks``: domain, seq, company, description, notes, main_contacts (struct
    of email, phone, address arrays and contact_page), social_media (map).
    The longest name and description win, earlier chunks on ties; the first
    contact page and the first link per platform win. List members stay rows
    (field, value, first_at) so that a domain with very many of them is not
    gathered into one row; ``first_at``, a struct of chunk and place, orders them by first appearance.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    longest = lambda c: F.max_by(c, F.struct(F.length(text(F.col(c))), -F.col("seq")))
    page = F.col("main_contacts.contact_page")
    profile = chunks.groupBy("domain").agg(
        longest("company").alias("company"), longest("description").alias("description"),
        F.min_by(page, F.when(text(page) != "", F.col("seq"))).alias("contact_page"))
    fields = {"notes": F.col("notes"), **{f: F.col(f"main_contacts.{f}") for f in ("email", "phone", "address")}}
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(v, F.array().cast("array<string>")).alias("members"))
                       for f, v in fields.items()])
    rows = chunks.select("domain", "seq", F.explode(tagged).alias("t")).select(
        "domain", "seq", "t.field", F.posexplode("t.members").alias("at", "value"))
    values = rows.where(text(F.col("value")) != "").groupBy("domain", "field", "value").agg(
        F.min(F.struct("seq", "at")).alias("first_at"))
    links = chunks.select("domain", "seq", F.explode("social_media").alias("platform", "url")).where(
        F.col("platform").isin(PLATFORMS) & (text(F.col("url")) != ""))
    socials = links.groupBy("domain", "platform").agg(F.min_by("url", "seq").alias("url"))
    return {"profile": profile, "values": values, "socials": socials}
