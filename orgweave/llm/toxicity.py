r"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of three fixed word lists (insults,
profanity, threats) and of a lexicon learned from the labels, how near the hits
stand to a second person, capitals, punctuation, and how much of the text is
obfuscated (signs or digits inside words, letters set apart, drawn-out letters)
and what it spells.

The learned lexicon holds word beginnings of 3 to 6 characters that far more
toxic than clean training texts hold, so it carries over to languages and coined
words that no list has. It is counted once in two folds by Spark; the rows of
one fold get their features with the lexicon of the other, so that the trees
don't learn from counts of their own rows, and the corpus is scored with the
lexicon of both.

The trees (``pyspark.ml``) are fitted on four fifths of the training rows, the
isotonic curve from their margin to a probability on the rest. The training rows
are those with a label whose id isn't held out: different (id, text) pairs, about
``max_rows`` of each class at most, chosen by a hash. Every whole text is scored.
Labels, language, source and id are no inputs of the score.

Odd input: a null text scores like an empty one; a null label is no label, an id
with labels of both kinds counts as toxic, a null id belongs to the training side
but has no label; without training rows of both classes every score is 0;
repeated rows get the same score each; input columns named like a result are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import without
from orgweave.llm.quality_classifier import held_out
from orgweave.session import stored

RESULTS = ["held_out", "score", "predicted"]
THRESHOLD = 0.3
MAX_ROWS = 10_000  # training rows per class, about
MAX_STEMS = 2_000  # entries of a learned lexicon
STEM_LENGTHS = (3, 4, 5, 6)
NEAR = 5  # words between a hit and a second person
MEMO = 200_000

# Word lists.
INSULTS = """
idiot idiots idiotic moron morons moronic imbecile cretin dumb dumbass dimwit halfwit stupid fool fools foolish clown
clowns loser losers scum scumbag trash garbage filth filthy vermin pig swine rat worm parasite pathetic worthless useless
disgusting repulsive revolting vile despicable coward cowardly liar fraud creep creepy freak weirdo ugly fat lazy brainless
clueless ignorant incompetent ridiculous laughable pitiful retard retarded jerk douche douchebag
idioten dumm dumme dummkopf trottel depp versager abschaum dreck arschloch
idiote idiots crétin imbécile stupide débile abruti minable ordure raclure connard salaud
idiota estúpido estúpida imbécil tonto basura escoria inútil asqueroso patético cabrón
""".split()
PROFANITY = """
ass asshole arse bastard bitch bitches bloody bollocks bullshit crap cunt damn dick dickhead fuck fucked fucker fucking
goddamn hell motherfucker piss pissed prick shit shitty slut twat wanker whore
scheiße scheisse merde putain puta puto mierda joder
""".split()
THREATS = """
kill killed murder die dead death hang hurt beat punch stab shoot burn destroy hunt bleed suffer rot choke strangle smash
hate hated loathe despise
""".split()
SECOND_PERSON = """
you your yours yourself yourselves youre ya u ur
du dich dir dein deine deiner ihr euch euer sie ihnen
tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros
""".split()
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                            "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})

INSULT, PROFANE, THREAT, LEARNED, PERSON, SHOUTED, MASKED, APART, DRAWN, SPELT, LETTER, MARKS = (1 << i for i in range(12))
HIT = INSULT | PROFANE | THREAT | LEARNED
_COUNTED = (INSULT, PROFANE, THREAT, LEARNED, SHOUTED, MASKED, APART, DRAWN, SPELT, MARKS)
_FIXED = {w: kind for words, kind in ((THREATS, THREAT), (PROFANITY, PROFANE), (INSULTS, INSULT), (SECOND_PERSON, PERSON))
          for w in words}
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][0-9@$!|*#+]+[^\W\d_]|^[0-9@$!|+][^\W\d_]")
_APART = re.compile(r"(?:[^\W\d_][.\-_*]){3,}[^\W\d_][^\w]*")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_NO_LETTER = re.compile(r"[\W\d_]+")
_RUNS = re.compile(r"[!?]{2,}")
_ENDS = "!?.,;:*#+|\"'()[]-_"


def _spelt(token: str) -> str:
    """What an obfuscated token spells."""
    return _DRAWN.sub(r"\1", _NO_LETTER.sub("", token.rstrip("!?.,;:*#+|\"')").translate(LOOKALIKES)))


class Lexicon(dict):
    """Token -> None if nothing is to be said of it, else (kinds, weight of a learned beginning).

    Filled as tokens come: a text's tokens are looked up, not searched again. MEMO tokens are kept at most.
    """

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.heads = {stem[:STEM_LENGTHS[0]] for stem in stems}

    def word(self, word: str) -> tuple[int, float]:
        kinds, weight = _FIXED.get(word, 0), 0.0
        if word[:STEM_LENGTHS[0]] in self.heads:
            weight = max(self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS)
        return kinds | (LEARNED if weight else 0), weight

    def token(self, token: str) -> tuple[int, float]:
        low = token.lower()
        core = low.strip(_ENDS)
        if core.isalpha():
            kinds, weight = self.word(core)
            if len(low) == 1:
                kinds |= LETTER
        else:
            kinds, weight = 0, 0.0
            for w in _WORD.findall(low):
                kind, own = self.word(w)
                kinds, weight = kinds | kind, max(weight, own)
            kinds |= (MASKED if _MASKED.search(low) else 0) | (APART if _APART.fullmatch(low) else 0)
        if core != low and _RUNS.search(token):
            kinds |= MARKS
        if _DRAWN.search(core):
            kinds |= DRAWN
        if len(token) > 2 and token.isupper():
            kinds |= SHOUTED
        if kinds & (MASKED | APART | DRAWN):
            kind, own = self.word(_spelt(low))
            if kind & HIT:
                kinds, weight = kinds | kind | SPELT, max(weight, own)
        return kinds, weight

    def __missing__(self, token: str) -> tuple[int, float] | None:
        kinds, weight = self.token(token)
        found = (kinds, weight) if kinds else None
        if len(token) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[token] = found
        return found


def _letters_apart(tokens: list[str], letters: list[int], lexicon: Lexicon) -> tuple[int, int, list[int]]:
    """Of runs of four letters and more that stand alone: how many, how many spell a hit, and where these are."""
    runs, spelt, places, k = 0, 0, [], 0
    while k < len(letters):
        end = k + 1
        while end < len(letters) and letters[end] == letters[end - 1] + 1:
            end += 1
        if end - k >= 4:
            runs += 1
            if lexicon.word(_spelt("".join(tokens[letters[k]:letters[end - 1] + 1]).lower()))[0] & HIT:
                spelt += 1
                places.append(letters[k])
        k = end
    return runs, spelt, places


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one text."""
    text = text or ""
    tokens = text.split()
    n = max(len(tokens), 1)
    counts = dict.fromkeys(_COUNTED, 0)
    hits, persons, letters, heaviest, weights = [], [], [], 0.0, 0.0
    for i, found in enumerate(map(lexicon.__getitem__, tokens)):
        if found is None:
            continue
        kinds, weight = found
        for k in _COUNTED:
            if kinds & k:
                counts[k] += 1
        if kinds & HIT:
            hits.append(i)
            weights += weight
            heaviest = max(heaviest, weight)
        if kinds & PERSON:
            persons.append(i)
        if kinds & LETTER:
            letters.append(i)
    if len(letters) >= 4:
        runs, spelt, places = _letters_apart(tokens, letters, lexicon)
        counts[APART] += runs
        counts[SPELT] += spelt
        hits = sorted(hits + places)
    near = closeness = 0.0
    for i in hits:
        k = bisect_left(persons, i)
        gap = min((abs(i - p) for p in persons[max(k - 1, 0):k + 1]), default=n)
        near += gap <= NEAR
        closeness += 1 / (1 + gap)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    upper, lower = int(raw[65:91].sum()), int(raw[97:123].sum())
    return [*((counts[k] / n) ** 0.5 for k in (INSULT, PROFANE, THREAT, LEARNED)),
            *(float(np.log1p(counts[k])) for k in (INSULT, PROFANE, THREAT, LEARNED)),
            heaviest, weights / n, near / max(len(hits), 1), closeness / max(len(hits), 1), (len(persons) / n) ** 0.5,
            upper / max(upper + lower, 1), counts[SHOUTED] / n, *((int(raw[ord(c)]) / n) ** 0.5 for c in "!?*#$%."),
            counts[MARKS] / n, counts[MASKED] / n, counts[SPELT] / n, float(np.log1p(counts[SPELT])), counts[APART] / n,
            counts[DRAWN] / n, float(np.log1p(len(tokens)))]


N_FEATURES = len(features("", Lexicon({})))


def stems_of(text: str | None) -> set[str]:
    """The beginnings of a text's words."""
    words = set(_WORD.findall((text or "").lower()))
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(key, fold, toxic, text), stored: different labelled rows off the held-out side, about ``max_rows`` per class at most.

    Ids are chosen by a hash, then, where ids have many rows, rows. The chosen ids are few enough to broadcast, so the texts
    stay where they are.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("__llm_id")).agg(F.max("toxic").alias("toxic"))

    def thinned(df: DataFrame, *by: str) -> DataFrame:
        counts = {r["toxic"]: r["count"] for r in df.groupBy("toxic").count().collect()}
        share = [min(max_rows / max(counts.get(c, 1), 1), 1.0) for c in (0, 1)]
        part = F.pmod(F.xxhash64(*by, F.lit(1)), F.lit(1_000_003)) / 1_000_003.0
        return df.where(part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))

    chosen = F.broadcast(thinned(marks, "__llm_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("__llm_id"))
    key = F.xxhash64("doc_id", "text")
    # equal rows become one before they are moved
    once = thinned(rows, "doc_id", "text").select(key.alias("key"), "toxic", "text").dropDuplicates(["key"])
    return stored(once.withColumn("fold", F.pmod("key", F.lit(2))), "toxic-sample")


def learn_lexicons(rows: DataFrame, min_texts: int = 4, min_share: float = 0.01, min_ratio: float = 3.0,
                   max_stems: int = MAX_STEMS) -> list[dict[str, float]]:
    """Learned lexicons of fold 0, of fold 1 and of both: beginning -> log of the toxic to clean ratio.

    A beginning counts once per row. It is taken when at least ``min_texts`` toxic texts and a share of
    ``min_share`` of them hold it, ``min_ratio`` times the share of the clean ones (half a text added).
    """
    names = ["toxic0", "toxic1", "clean0", "clean1"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task holds the counts of its part of the bounded sample
        counts: list[Counter] = [Counter() for _ in names]
        for pdf in batches:
            for fold, toxic, text in zip(pdf["fold"], pdf["toxic"], pdf["text"], strict=True):
                of = counts[fold + (0 if toxic else 2)]
                of.update(stems_of(text))
                of[""] += 1  # the texts themselves
        stems = list(set().union(*counts))
        for i in range(0, len(stems), 20_000):
            some = stems[i:i + 20_000]
            yield pd.DataFrame({"stem": some} | {n: [c[s] for s in some] for n, c in zip(names, counts, strict=True)})

    counted = stored(rows.mapInPandas(count, "stem string, " + ", ".join(f"{n} long" for n in names)).groupBy("stem").agg(
        *[F.sum(n).alias(n) for n in names]), "toxic-stems")
    totals = (counted.where("stem = ''").take(1) or [dict.fromkeys(names, 0)])[0]
    lexicons = []
    for folds in ((0,), (1,), (0, 1)):
        toxic, clean = (sum((F.col(f"{n}{f}") for f in folds), F.lit(0)) for n in ("toxic", "clean"))
        of_toxic, of_clean = (max(sum(totals[f"{n}{f}"] for f in folds), 1) for n in ("toxic", "clean"))
        ratio = (toxic / of_toxic) / ((clean + 0.5) / of_clean)
        good = counted.where(F.col("stem") != "").where((toxic >= min_texts) & (toxic >= min_share * of_toxic)).select(
            "stem", F.log(ratio).alias("weight"), toxic.alias("toxic")).where(ratio >= min_ratio)
        best = good.orderBy(F.desc("toxic"), F.desc("weight"), "stem").limit(max_stems).collect()
        lexicons.append({r["stem"]: r["weight"] for r in best})
    return lexicons


def measured(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """(key, toxic, x) of the training rows; a row is measured with the other fold's lexicon."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Lexicon(lexicons[1]), Lexicon(lexicons[0])]
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "toxic": pdf["toxic"], "x": [
                features(t, own[f]) for f, t in zip(pdf["fold"], pdf["text"], strict=True)]})

    return rows.mapInPandas(measure, "key long, toxic double, x array<double>")


class Model:
    """A lexicon, boosted trees over the features, and the isotonic curve of their margin."""

    def __init__(self, stems: dict[str, float], trees: GBTClassificationModel, curve: IsotonicRegressionModel):
        self.stems, self.trees, self.curve = stems, trees, curve

    def score(self, df: DataFrame, x: str, result: str) -> DataFrame:
        """Add the probability that the features in the array column ``x`` are those of a toxic text."""
        inside = df.withColumn("__llm_x", array_to_vector(x))
        margins = self.trees.transform(inside).withColumn("__llm_margin", vector_to_array("__llm_raw")[1])
        return self.curve.transform(margins).withColumn(
            result, F.least(F.greatest(F.col("__llm_curve"), F.lit(0.0)), F.lit(1.0))).drop(
            "__llm_x", "__llm_raw", "__llm_margin", "__llm_curve")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on the labelled rows that aren't held out; None without both classes."""
    rows = training_rows(docs, labels, max_rows)
    lexicons = learn_lexicons(rows)
    # the sample is bounded by max_rows: in one sorted partition the fit is the same on every cluster
    sample = stored(measured(rows, lexicons), "toxic-features").coalesce(1).sortWithinPartitions("key")
    sample = sample.withColumn("__llm_x", array_to_vector("x"))
    test = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(5)) == 0
    classes = {(r["toxic"], r["test"]) for r in sample.select("toxic", test.alias("test")).distinct().collect()}
    if len({c for c, _ in classes}) < 2:
        return None
    if len(classes) < 4:  # too few rows to keep some apart
        test = F.lit(None).cast("boolean")
    booster = GBTClassifier(featuresCol="__llm_x", labelCol="toxic", maxDepth=3, maxIter=25, stepSize=0.3, maxBins=64,
                            minInstancesPerNode=2, seed=13)
    # of the model's results only the margin is wanted
    booster.setRawPredictionCol("__llm_raw").setPredictionCol("").setProbabilityCol("")
    trees = booster.fit(sample.where(F.coalesce(~test, F.lit(True))))
    margins = trees.transform(sample.where(F.coalesce(test, F.lit(True)))).withColumn(
        "__llm_margin", vector_to_array("__llm_raw")[1])
    curve = IsotonicRegression(featuresCol="__llm_margin", labelCol="toxic", predictionCol="__llm_curve").fit(margins)
    return Model(lexicons[2], trees, curve)


def score_texts(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add held_out, score and predicted to every row."""
    docs = without(docs, RESULTS)
    if model is None:
        scored = docs.withColumn("score", F.lit(0.0))
    else:
        stems = model.stems

        @F.pandas_udf("array<double>")
        def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = Lexicon(stems)
            for texts in batches:
                yield pd.Series([features(t, lexicon) for t in texts])

        scored = model.score(docs.withColumn("__llm_features", measure.asNondeterministic()("text")), "__llm_features",
                             "score").drop("__llm_features")
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score_texts(docs, train(docs, labels, max_rows), threshold)
