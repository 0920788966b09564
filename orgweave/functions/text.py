"""Text, JSON and number column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists the results depend on.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "been", "be",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "this", "that", "these", "those",
]
ECOMMERCE_TERMS = ["product", "cart", "checkout", "shop", "store", "buy", "price", "add to cart"]

BLANKS = r"[ \t\r\n\x0B\f]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def words(text: Column) -> Column:
    """Whitespace-separated lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^ \t\r\n\x0B\f]+"), F.lit(0))


def squeeze(text: Column) -> Column:
    """Collapse runs of whitespace and trim."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def tokenize(text: Column) -> Column:
    """Lower-case [a-z0-9] words longer than two, without stop words."""
    bare = F.lower(F.regexp_replace(text, r"<[^>]+>", " "))
    return F.filter(F.regexp_extract_all(bare, F.lit(r"(?U)\b[a-z0-9]+\b"), F.lit(0)),
                    lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))


def ecommerce_terms(html: Column) -> Column:
    """Which shop terms occur in the page."""
    low = F.lower(html)
    return F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in ECOMMERCE_TERMS]), lambda t: t.isNotNull())


def keyword_counts(text_lower: Column, keywords: list[str]) -> list[Column]:
    """Whole-word occurrence count of each keyword."""
    def escape(word: str) -> str:
        return "".join(ch if ch.isalnum() or ch in "_ " else "\\" + ch for ch in word)
    return [F.regexp_count(text_lower, F.lit(rf"(?U)\b{escape(k)}\b")) for k in keywords]


def relevance_score(found: Column, mentions: Column, n_keywords: int) -> Column:
    """0.6 x share of keywords found + 0.4 x mentions out of ten, 3 digits."""
    share = F.least(found / F.lit(float(max(n_keywords, 1))), F.lit(1.0)) * 0.6
    often = F.least(mentions / F.lit(10.0), F.lit(1.0)) * 0.4
    return F.round(share + often, 3)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on trimmed lower-case text; 0 when one is empty."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longest = F.greatest(F.length(x), F.length(y))
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return (F.when(empty, F.lit(0.0)).when(x == y, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(x, y) / longest)))


def jaccard_words(a: Column, b: Column) -> Column:
    """Share of common words in the union of both word sets."""
    def score(s: Column) -> Column:
        common = F.size(F.array_intersect(s["x"], s["y"]))
        return F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), F.lit(0.0)).otherwise(
            let(common, lambda n: n / (F.size(s["x"]) + F.size(s["y"]) - n)))

    sets = F.struct(F.array_distinct(words(a)).alias("x"), F.array_distinct(words(b)).alias("y"))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(let(sets, score))


def parse_price(text: Column, locale_aware: bool = False) -> Column:
    """Positive price out of free text, else null.

    The plain form keeps digits and dots, whatever they mean. The locale-aware
    form takes the last separator followed by one or two digits as the decimal
    point and all others as grouping.
    """
    if not locale_aware:
        value = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
        return F.when(value > 0, value)
    number = F.regexp_extract(text, r"([0-9](?:[0-9.,' ]*[0-9])?)", 1)
    whole = F.regexp_extract(number, r"^(.*?)(?:[.,][0-9]{1,2})?$", 1)
    cents = F.regexp_extract(number, r"[.,]([0-9]{1,2})$", 1)
    value = F.concat(F.regexp_replace(whole, r"[^0-9]", ""), F.lit("."),
                     F.when(cents == "", F.lit("0")).otherwise(cents)).try_cast("double")
    return F.when(value > 0, value)


def record_text(parts: list[tuple[str, Column]], sep: str = "\n") -> Column:
    """Labelled lines of the non-empty parts, in the given order."""
    return F.concat_ws(sep, *[
        F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value)) for label, value in parts])


def clip(text: Column, n: int) -> Column:
    """First ``n`` characters and an ellipsis; empty stays empty."""
    return (F.when(text.isNull() | (text == ""), F.lit(""))
            .otherwise(F.concat(F.substring(text, 1, n), F.lit("..."))))


def parse_json_or_null(text: Column, schema: str) -> Column:
    """Struct or map out of JSON text; null for text that is not JSON."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(text).isNotNull(), parsed)


def fenced_json_list(text: Column) -> Column:
    """A JSON list of strings, with or without a code fence; null for anything else."""
    trimmed = F.trim(text, F.lit(" \t\r\n"))
    fenced = F.trim(F.regexp_replace(trimmed, r"```json[ \t\r\n]*|[ \t\r\n]*```", ""), F.lit(" \t\r\n"))
    body = F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)
    is_list = F.try_parse_json(body).isNotNull() & body.startswith("[")
    return F.when(is_list, F.from_json(body, "array<string>"))


def list_lines(text: Column, most: int | None = None, leading: int | None = None) -> Column:
    """List entries: numbered lines, else bullets, else short lines.

    ``most`` cuts the entries; ``leading`` looks for short lines in the first lines only.
    """
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s, F.lit(" \t\r\x0B\f")))
    return let(lines, lambda x: _list_entries(x, most, leading))


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _list_entries(lines: Column, most: int | None, leading: int | None) -> Column:
    def entries(pattern: str) -> Column:
        hit = F.filter(lines, lambda s: s.rlike(pattern))
        body = F.transform(hit, lambda s: F.regexp_extract(s, pattern, 1))
        return F.transform(F.filter(body, lambda s: F.length(s) > 10), lambda s: F.trim(s))

    numbered = entries(r"^[0-9]+\.[ \t]*(.+)$")
    bulleted = entries(r"^[*-][ \t]*(.+)$")
    short = F.filter(_first(F.filter(lines, lambda s: s != ""), leading), lambda s: (F.length(s) > 15) & (F.length(s) < 100)
                     & ~s.endswith(".") & ~s.startswith("#"))
    picked = F.when(F.size(numbered) > 0, numbered).when(F.size(bulleted) > 0, bulleted).otherwise(short)

    def clean(s: Column) -> Column:
        s = F.regexp_replace(s, r"[ \t]*\([^)]+\)[ \t]*", "")
        s = F.regexp_replace(s, r"\*\*(.+?)\*\*", "$1")
        s = F.regexp_replace(s, "^['\"]+|['\"]+$", "")
        return F.regexp_replace(s, r"(?i)^(Subject|Option[ \t]*[0-9]+):[ \t]*", "")

    cleaned = F.filter(F.transform(picked, clean), lambda s: F.length(s) > 10)
    return _first(F.transform(cleaned, lambda s: F.trim(s)), most)


# Fixed value: the heading of a suggested-questions block.
QUESTION_BLOCK = r"(?i)(?:\n|^)(?:Suggested|Follow-up|Recommended)(?:.*)(?:Questions|Queries|Topics)(?:[: \t\r\n]*)(?:\n|$)"


def answer_part(text: Column) -> Column:
    """Text in front of a suggested-questions block; the whole text when there is none."""
    parts = F.split(text, QUESTION_BLOCK)
    return F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(0)), F.lit(" \t\r\n"))).otherwise(text)


def question_lines(text: Column, most: int | None = None) -> Column:
    """Question lines of a suggested-questions block, the first ``most`` if given."""
    parts = F.split(text, QUESTION_BLOCK)
    lines = F.transform(F.split(F.trim(F.get(parts, F.lit(1)), F.lit(" \t\r\n")), "\n"),
                        lambda s: F.regexp_replace(F.trim(s, F.lit(" \t\r")), "^[0-9\\-.•*\\s]+", ""))
    good = F.filter(lines, lambda s: (F.length(s) > 5) & s.contains("?"))
    return F.when(F.size(parts) > 1, _first(good, most)).otherwise(F.array().cast("array<string>"))


def relative_time(ts: Column, now: Column) -> Column:
    """'just now', 'n minutes/hours/days ago' under a week, else a UTC+5 display date."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"),
                                   F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))
    shifted = ts + F.expr("interval 5 hours")
    display = F.concat(F.date_format(shifted, "MMM d, yyyy, hh:mm a"), F.lit(" PKT"))
    return (F.when(ts.isNull(), F.lit(None).cast("string")).when(minutes < 1, F.lit("just now"))
            .when(minutes < 60, ago(minutes, "minute")).when(hours < 24, ago(hours, "hour"))
            .when(days < 7, ago(days, "day")).otherwise(display))


def progress_pct(done: Column, total: Column) -> Column:
    """Whole percent of 90; the last ten are left for the closing steps."""
    return F.coalesce(F.floor(F.try_divide(done, total) * 90).cast("int"), F.lit(0))


def clamp(value: Column | int, low: int = 1, high: int = 100) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def reliability_tier(source_count: Column) -> Column:
    """1.0 when an answer has any source, else 0."""
    return F.when(source_count > 0, F.lit(1.0)).otherwise(F.lit(0.0))
