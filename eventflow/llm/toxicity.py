"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon behind the densities is learnt too: words, and beginnings of words, that stand almost only in toxic texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, forget, small_batches, stored, text_groups

SAMPLE = 20_000  # labelled texts that a model is fitted on, at most
PARTS = (7, 10)  # of ten parts of the sample: up to here for the trees, the calibration
FOLDS = 5  # of the lexicon
MAX_LEXICON = 5_000
STEM = 5
NEAR = 4  # words
THRESHOLD = 0.3

# Plain insults and second-person words, so that a lexicon learnt from few labels is not empty.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "clown", "worthless", "pathetic", "disgusting", "fool")
YOU = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "tu", "toi", "te", "ton", "vous", "votre", "tú", "ti", "usted", "vos")
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*.\-_]++[^\W\d_]++)+")  # possessive: linear on long runs
UPPER = bytes(range(65, 91))
PUNCTUATION = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
FEATURES = ("strong", "strong_density", "strong_kinds", "weak", "weak_density", "stems", "stem_density", "insults", "near_you", "capitals",
            "punctuation", "masked", "masked_hits", "length")


class Lexicon(NamedTuple):
    strong: frozenset
    weak: frozenset
    stems: frozenset


class Model(NamedTuple):
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of `FEATURES`; all 0 for an empty one."""
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    at = [i for i, w in enumerate(words) if w in lexicon.strong]
    weak = sum(map(lexicon.weak.__contains__, words))
    stems = sum(w[:STEM] in lexicon.stems for w in words)
    insults = sum(map(INSULT_SET.__contains__, words))
    near = sum(not YOU_SET.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]) for i in at)
    masked = MASKED.findall(text)
    plain = [re.sub(r"[^\w]|_", "", "".join(LEET.get(c, c) for c in m.lower())) for m in masked]
    raw = text.encode()
    share = lambda marks: (len(raw) - len(raw.translate(None, marks))) / max(1, len(raw))
    return [math.log1p(len(at)), len(at) / n, math.log1p(len({words[i] for i in at})), math.log1p(weak), weak / n, math.log1p(stems), stems / n,
            math.log1p(insults), near / n, share(UPPER), share(PUNCTUATION),
            len(masked) / n, math.log1p(sum(p in lexicon.strong or p in INSULT_SET for p in plain)), math.log1p(len(words))]


INSULT_SET, YOU_SET = frozenset(INSULTS), frozenset(YOU)


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`docs` with a vector column `features`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        lexicon = Lexicon(*sent.value)
        for batch in batches:
            rows = [features(t, lexicon) for group in text_groups(batch.column(text)) for t in group]
            yield batch.append_column("features__", pa.array(rows, pa.list_(pa.float64())))

    names = [f"`{c}`" for c in docs.columns if c not in ("features", "features__")]
    docs = docs.select(*names)
    out = docs.mapInArrow(run, docs.withColumn("features__", F.array(F.lit(0.0))).schema)
    return out.select(*names, array_to_vector("features__").alias("features"))


def learn_lexicons(sample: DataFrame, folds: int = FOLDS) -> list[Lexicon]:
    """Words and beginnings of words that stand almost only in toxic texts of the sample (text, toxic, part).

    One lexicon of all parts, then one for each fold, of the parts outside it.
    """
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"))
    # distinct within a text, so counts are numbers of texts
    kinds = F.array_union(F.transform(words, lambda w: F.concat(F.lit("w"), w)),
                          F.transform(F.filter(words, lambda w: F.char_length(w) >= STEM), lambda w: F.concat(F.lit("s"), F.left(w, F.lit(STEM)))))
    rows = sample.select("toxic", (F.col("part") % folds).alias("fold"), F.explode(kinds).alias("kind"))
    inside = [F.col("fold") == f for f in range(folds)]
    counts = rows.groupBy("kind").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"),
                                      F.array(*[F.sum(F.when(f, F.col("toxic")).otherwise(0)) for f in inside]).alias("bad_in"),
                                      F.array(*[F.sum(F.when(f, 1).otherwise(0)) for f in inside]).alias("all_in"))
    rare = counts.filter("bad >= 4 and bad * 10 >= all * 5").orderBy(F.desc("bad"), "kind").limit(2 * MAX_LEXICON).collect()

    def lexicon(seen: list[tuple[str, int, int]]) -> Lexicon:
        known = [(kind, bad, n) for kind, bad, n in seen if bad >= 4 and bad * 10 >= n * 7][:MAX_LEXICON]
        strong = {k[1:] for k, bad, n in known if k[0] == "w" and bad >= 10 and bad * 100 >= n * 97}
        weak = {k[1:] for k, _, _ in known if k[0] == "w"} - strong
        stems = {k[1:] for k, bad, n in known if k[0] == "s" and bad >= 20 and bad * 10 >= n * 9}
        return Lexicon(frozenset(strong | INSULT_SET), frozenset(weak), frozenset(stems))

    return [lexicon([(r.kind, r.bad, r["all"]) for r in rare]),
            *[lexicon([(r.kind, r.bad - r.bad_in[f], r["all"] - r.all_in[f]) for r in rare]) for f in range(folds)]]


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic, part) of at most `size` labelled documents, those whose hashed id is least; part is 0 to 9.

    Rows of one id count once, as toxic if any is; labels without id, label or document are left out.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(10)).alias("part")
    texts = docs.select("doc_id", filled("text").alias("text"))
    # the sample is bounded by `size` rows of two numbers
    return stored(texts.join(F.broadcast(stored(known, "known")), "doc_id").select("text", "toxic", part), "sample").coalesce(8)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Lexicon, trees and calibration.

    The lexicon is that of the whole sample; trees and calibration, each from its own part of the sample, see the features of a text
    by the lexicon of the other folds, so that no text tells about itself.

    Without texts of both labels in the parts for trees and calibration there is no model, and each score is the share of
    toxic texts (0 without any label).
    """
    sample = labelled_sample(docs, labels, size)
    seen = sample.groupBy("part").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).collect()
    base = sum(r.bad for r in seen) / max(1, sum(r["all"] for r in seen))
    of = lambda a, b: (sum(r.bad for r in seen if a <= r.part < b), sum(r["all"] - r.bad for r in seen if a <= r.part < b))
    lexicon, *others = learn_lexicons(sample)
    if not all(min(of(*span)) for span in ((0, PARTS[0]), PARTS)):
        return Model(lexicon, None, None, base)
    folds = [with_features(sample.filter(F.col("part") % FOLDS == f), o) for f, o in enumerate(others)]
    rest = reduce(DataFrame.unionByName, folds).select("part", F.col("toxic").cast("double").alias("label"), "features")
    rest = stored(rest, "features").coalesce(4)
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, seed=1).setProbabilityCol("both").fit(rest.filter(F.col("part") < PARTS[0]))
    raw = trees.transform(rest.filter(F.col("part") >= PARTS[0])).select("label", vector_to_array("both")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
    return Model(lexicon, trees, calibration, base)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score` in 0 to 1; every row gets one, empty and null texts too."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    if model.trees is None:
        return docs.select(*kept).withColumn("score", F.lit(float(model.base)))
    rows = docs.select(F.struct(*kept).alias("row__"), F.col(text).alias("text"))
    out = model.trees.transform(with_features(rows, model.lexicon))
    out = model.calibration.transform(out.withColumn("raw", vector_to_array("both")[1]))
    return out.select("row__.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; fitted on labels of rows that are not held out.

    Only the text is scored.  Null texts are empty.  Rows are kept as they are; a row with null id is not held out.
    """
    model = fit(docs, labels.filter(~held_out()))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold."""
    model = fit(docs, labels.filter(~held_out()))
    return scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text"), model).filter(
        F.col("score") < threshold).select("doc.*")
