"""Quality rules: cross-document line frequency, with basic text counts beside it.

Every line is normalised (lower case, runs of anything but letters and digits
become one space) and hashed. A line that stands in more than ``max_share`` of
the different texts of its host, and in more than ``min_docs`` of them, is
boilerplate of that host. A share scales away on a large host: with ``max_docs``,
a line of ``min_words`` words or more that stands in more than so many different
texts of its host is boilerplate too, whatever the share. Such lines are removed,
and a document that keeps
less than ``min_left`` of its words without them is depleted and rejected.

Copies of one text count as one document, so a popular text isn't boilerplate.
All of it is DataFrame functions; what is shuffled is one (host, hash, words)
row per line, never a text.

Odd input: a null or empty text has no words and fails the base rules; a null
host is a host of its own; repeated rows and rows with a null doc_id each get a
row; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import let, without
from orgweave.session import stored

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MAX_DOCS = 40  # limit of the pipeline that doesn't grow with the host
MIN_WORDS = 5  # shorter lines stay under the share alone: headings and list items repeat in clean text
RESULTS = [*BASE, "base_failed", "kept", "n_lines", "removed_lines", "removed_words", "depleted"]

_HOST, _TEXT, _LINES, _GONE = "__llm_host", "__llm_text", "__llm_lines", "__llm_gone"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text."""

    def covered(starts: Column) -> Column:
        # each window covers three words; the next window may begin before those end
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        def starts(pairs: Column) -> Column:
            twin = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(twin, lambda x: x["p"])), covered)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, starts))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, repeated))


def _dup_lines(text: Column) -> Column:
    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def text_counts(text: Column) -> Column:
    """The base counts of a text as one struct, computed in one pass."""
    text = F.coalesce(text, F.lit(""))
    return let(text, lambda t: let(_words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(t).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _line_keys(text: Column) -> Column:
    """(hash, words) of each different normalised line of a text."""
    lines = F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line))
    return F.transform(F.filter(lines, lambda x: x != ""),
                       lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("none"))


def _text_key() -> Column:
    return F.struct(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.length(F.coalesce(F.col("text"), F.lit(""))))


def common_lines(marked: DataFrame, max_share: float, min_docs: int, max_docs: int | None = None,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """(host, line) above the limits; ``marked`` has host, text key and line keys."""
    texts = marked.select(_HOST, _TEXT, _LINES).dropDuplicates([_HOST, _TEXT])
    hosts = texts.groupBy(_HOST).agg(F.count("*").alias("__llm_docs"))
    counts = texts.select(_HOST, F.explode(_LINES).alias("x")).groupBy(_HOST, F.col("x.line").alias("__llm_line")).agg(
        F.count("*").alias("__llm_n"), F.max("x.words").alias("__llm_words"))
    n, often = F.col("__llm_n"), F.lit(False)
    if max_docs is not None:
        often = (n > max_docs) & (F.col("__llm_words") >= min_words)
    above = counts.where((n > min_docs) | often).join(hosts, _HOST)
    return above.where((n > min_docs) & (n > max_share * F.col("__llm_docs")) | often).select(_HOST, "__llm_line")


def line_frequency(docs: DataFrame, host: str = "source", max_share: float = 0.1, min_docs: int = 20,
                   min_left: float = 0.2, max_docs: int | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Base counts, removed lines and verdict per row; all columns of ``docs`` but the text stay."""
    columns = [c for c in without(docs, RESULTS).columns if c != "text"]
    marked = without(docs, RESULTS).select(
        *[F.col(f"`{c}`") for c in columns], _host_key(host).alias(_HOST), _text_key().alias(_TEXT),
        _line_keys(F.col("text")).alias(_LINES), text_counts(F.col("text")).alias("__llm_counts"))
    marked = stored(marked, "line-frequency")
    common = common_lines(marked, max_share, min_docs, max_docs, min_words)
    lines = marked.select(_HOST, _TEXT, _LINES).dropDuplicates([_HOST, _TEXT]).select(
        _HOST, _TEXT, F.explode(_LINES).alias("x")).select(_HOST, _TEXT, F.col("x.line").alias("__llm_line"), "x.words")
    hits = lines.join(common, [_HOST, "__llm_line"]).groupBy(_HOST, _TEXT).agg(
        F.collect_set("__llm_line").alias(_GONE))
    out = marked.join(hits, [_HOST, _TEXT], "left")
    gone = F.coalesce(F.col(_GONE), F.array().cast("array<bigint>"))
    words = F.aggregate(F.filter(_LINES, lambda x: F.array_contains(gone, x["line"])), F.lit(0),
                        lambda a, x: a + x["words"])
    total = F.aggregate(_LINES, F.lit(0), lambda a, x: a + x["words"])
    out = out.select(
        *[F.col(f"`{c}`") for c in columns], "__llm_counts.*", F.size(_LINES).alias("n_lines"),
        F.size(gone).alias("removed_lines"), words.cast("long").alias("removed_words"), total.alias("__llm_total"),
        gone.alias(_GONE), F.col(_HOST), F.col(_TEXT))
    depleted = (F.col("removed_words") > 0) & (
        F.col("__llm_total") - F.col("removed_words") < min_left * F.col("__llm_total"))
    out = out.withColumn("base_failed", base_failed()).withColumn("depleted", depleted)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs`` with the common lines of their host cut out of the text."""
    verdicts = line_frequency(docs.select("text", host), host, **limits)
    kept = verdicts.where("kept").select(_HOST, _TEXT, _GONE).dropDuplicates([_HOST, _TEXT])
    own = docs.withColumn(_HOST, _host_key(host)).withColumn(_TEXT, _text_key()).join(kept, [_HOST, _TEXT])
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(_GONE), F.xxhash64(normal_line(x))))
    text = F.when(F.size(_GONE) == 0, F.col("text")).otherwise(F.array_join(lines, "\n"))
    out = own.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
