"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: density, count and strongest word of a weighted lexicon (a fixed list, and the
words that mark toxic texts in the labelled sample), how many lexicon words stand near a word in
the second person, how many appear only once disguises (digits or signs for letters, letters apart,
letters repeated) are undone, rates of capitals, exclamation marks, punctuation and mixed tokens,
and the length. A text's features need its own row alone.

Spark ML trains the trees on a bounded sample of labelled rows (`max_sample`, those of the least
hash), all from outside the held-out fold; a sixth of the sample is kept from the trees and from
the lexicon and fits the calibration. Scores are computed by Spark ML on the JVM side.

Edge cases: null and empty texts get a score like any other (that of a text without any sign). A
null doc_id is never held out and never labelled. Repeated rows get equal scores. Extra columns
are ignored; without any labelled row, or with labels of one kind only, every score is that share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import giving_back, materialize, pick

MAX_SAMPLE = 12_000
MAX_LEARNED_WORDS = 400
#: Insults of four languages.
INSULTS = (
    "idiot moron stupid trash scum loser clown disgusting worthless vermin pathetic garbage filth imbecile dumb"
    " idioten dummkopf trottel abschaum dreck widerlich wertlos versager"
    " imbécile crétin ordure racaille dégoûtant minable abruti"
    " idiota imbécil basura escoria asqueroso inútil payaso estúpido"
).split()
#: Words in the second person.
SECOND_PERSON = frozenset("you your yours you're youre u ur yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Signs that stand for letters.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
NAMES = (
    "log_words", "density", "log_hits", "strongest", "weight", "distinct", "near_you", "disguised",
    "capitals", "shouts", "punctuation", "mixed",
)
NEAR = 40
_APART_HINT = re.compile(r"[.\-_* ]\w[.\-_* ]\w[.\-_* ]")
_APART = re.compile(r"(?<!\w)\w(?:([.\-_* ])\w)(?:\1\w){1,}(?!\w)")
_REPEATED = re.compile(r"(\w)\1{2,}")
_MIXED = re.compile(r"[a-z][0-9@$!*]+[a-z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

_CLASSES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (_c in " \t\n\r\x0b\x0c", "A" <= _c <= "Z", _b < 128 and _c.isalpha(), _c == "!", _b < 128 and not _c.isalnum() and not _c.isspace(), _c in "0123456789@$*")


def build_matcher(lexicon: dict[str, float]):
    matcher = ahocorasick.Automaton()
    for word, weight in lexicon.items():
        matcher.add_word(word, (len(word), word, weight))
    matcher.make_automaton()
    return matcher


def hits_in(lowered: str, matcher) -> list[tuple[int, int, str, float]]:
    """(start, end, word, weight) of lexicon words that stand as whole words."""
    found = []
    for last, (n, word, weight) in matcher.iter(lowered):
        start, end = last + 1 - n, last + 1
        if (start and lowered[start - 1].isalnum()) or (end < len(lowered) and lowered[end].isalnum()):
            continue
        found.append((start, end, word, weight))
    return found


def features(text: str, matcher) -> list[float]:
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) @ _CLASSES
    spaces, capitals, letters, shouts, punctuation, signs = counts
    words, lowered = spaces + 1.0, text.lower()
    found = hits_in(lowered, matcher)
    near = 0
    for start, end, _, _ in found:
        around = lowered[max(0, start - NEAR) : start] + " " + lowered[end : end + NEAR]
        near += not SECOND_PERSON.isdisjoint(_WORD.findall(around))
    disguised, mixed = 0, 0
    plain = lowered
    if signs or shouts:
        mixed = len(_MIXED.findall(lowered))
        plain = plain.translate(DISGUISE) if mixed else plain
    if _APART_HINT.search(plain):
        plain = _APART.sub(lambda m: m[0].replace(m[1], ""), plain)
    if _REPEATED.search(plain):
        plain = _REPEATED.sub(r"\1", plain)
    if plain is not lowered and plain != lowered:
        disguised = max(0, len(hits_in(plain, matcher)) - len(found))
    total = sum(w for *_, w in found)
    return [
        float(np.log1p(words)),
        100 * len(found) / words,
        float(np.log1p(len(found))),
        max((w for *_, w in found), default=0.0),
        total / float(np.sqrt(words)),
        float(len({w for _, _, w, _ in found})),
        float(near),
        float(disguised),
        capitals / max(1.0, letters),
        shouts / words,
        punctuation / words,
        mixed / words,
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, features and the columns (of longs) to carry for each row."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = build_matcher(lexicon)
        for batch in batches:
            made = {"doc_id": batch.doc_id.astype("Int64"), "features": [features(t or "", matcher) for t in batch.text]}
            yield pd.DataFrame(made | {c: batch[c].astype("Int64") for c in carry})

    return pick(docs, "doc_id", "text", *carry).mapInPandas(giving_back(score), ", ".join(["doc_id bigint, features array<double>", *(f"{c} bigint" for c in carry)]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_sample: int) -> DataFrame:
    """doc_id, text, toxic of at most max_sample labelled rows outside the held-out fold."""
    known = pick(labels, "doc_id", "toxic").filter(~held_out()).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    joined = pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    return materialize(joined.withColumn("text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "text"]), "toxicity-sample")


def learn_lexicon(labelled: DataFrame, max_words: int = MAX_LEARNED_WORDS) -> dict[str, float]:
    """The fixed list, and the words whose share among toxic texts is far above that among others
    (smoothed log ratio at least 1.5, five toxic texts at least); weights are the log ratios."""
    words = labelled.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).filter("length(word) > 2")
    totals = labelled.agg(F.sum((F.col("toxic") == 1).cast("int")), F.sum((F.col("toxic") == 0).cast("int"))).first()
    bad, good = (totals[0] or 0), (totals[1] or 0)
    counted = words.groupBy("word").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("a"), F.sum((F.col("toxic") == 0).cast("int")).alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (good + 1))
    top = counted.filter("a >= 5").withColumn("weight", ratio).filter("weight >= 1.5").orderBy(F.desc(F.col("weight") * F.sqrt("a")), "word").limit(max_words)
    learned = {r["word"]: round(float(r["weight"]), 4) for r in top.collect()}
    return {w: 2.0 for w in INSULTS} | learned


def score(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, trees: int = 20, depth: int = 4, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns (of longs) to carry for each row of docs."""
    labelled = sample(docs, labels, max_sample)
    kinds = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = pick(docs, "doc_id", "text", *carry)
    if set(kinds) != {0, 1}:
        share = float(sum(n for k, n in kinds.items() if k == 1)) / max(1, sum(kinds.values()))
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), *carry)
    lexicon = learn_lexicon(labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    train = materialize(with_features(labelled, lexicon).join(labelled.select("doc_id", "toxic").distinct(), "doc_id"), "toxicity-train")
    train = train.select("doc_id", array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"))
    fold = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, 1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(3)))
    trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.25, seed=seed, maxBins=48).fit(train.filter(fold != 0).repartition(4))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(train.filter(fold == 0)).select("raw", "label"))
    scored = with_features(rows, lexicon, carry).withColumn("features", array_to_vector("features"))
    scored = calibrated.transform(raw(scored)).withColumn("score", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)
