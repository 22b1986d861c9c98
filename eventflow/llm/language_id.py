"""Language by interpolated Kneser-Ney models of characters, one per language, in sorted arrays of hashed n-grams.

A word is scored with the blank around it, so the score of a text is the sum over its words, and each distinct word is scored
once.  Counts, continuation counts and probabilities are Spark tables over all training texts; what is left of them is a table of
bounded size that goes to the tasks as plain arrays.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, remembered, small_batches, stored, text_groups

ORDER = 5
LONGEST = 40  # letters; a longer run is scored in pieces of this length
MODEL_GRAMS = 1_000_000  # n-grams of a model, at most (some 100 MB with ten languages)
CALIBRATION = 20_000  # documents that the calibration is fitted on, at most
WORDS = 400_000  # distinct words whose scores a worker remembers; beyond that it starts anew
BLANK, MULTIPLY = 32, np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"
MARGIN = ("margin", "evidence")  # what the calibration sees


class Letters:
    """Which code points are letters (or marks, which only go with letters), as one table."""

    def __init__(self) -> None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        self.letter = np.array([k == "L" for k in kinds])
        marks = np.array([k == "M" for k in kinds])
        # letters and marks stand for themselves, all else is a blank
        self.to = np.where(self.letter | marks, np.arange(0x110000), BLANK).astype(np.uint32)

    def words(self, text: str) -> list[str]:
        """Runs of letters and marks in lower case, cut every `LONGEST`; none if there is no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        if not self.letter[codes].any():
            return []
        words = self.to[codes].tobytes().decode("utf-32-le", "replace").split(" ")
        return [p for w in words if w for p in ([w] if len(w) <= LONGEST else [w[i:i + LONGEST] for i in range(0, len(w), LONGEST)])]


def word_counts(docs: DataFrame, part: Column) -> DataFrame:
    """(lang, part, word, n) over all rows of docs (text, lang); counted within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = remembered(Letters)
        for batch in batches:
            found: dict[tuple, Counter] = {}
            texts = chain.from_iterable(text_groups(batch.column("text")))
            for lang, part, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "part")), texts):
                found.setdefault((lang, part), Counter()).update(letters.words(text))
            rows = [(lang, part, w, n) for (lang, part), words in found.items() for w, n in words.items()]
            for at in range(0, len(rows), 100_000):
                columns = list(zip(*rows[at:at + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                                 ["lang", "part", "word", "n"])

    return (docs.select("lang", part.cast("int").alias("part"), "text").mapInArrow(count, "lang string, part int, word string, n bigint")
            .groupBy("lang", "part", "word").agg(F.sum("n").alias("n")))


def kneser_ney(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(size, lang, gram, n, logp, back) from words with counts: interpolated log probability of a gram's last character after
    the others, and the log weight of the next shorter context after this gram.

    The longest grams have their counts; shorter ones count the distinct characters before them.  Each size and language has
    its own discount n1 / (n1 + 2 n2), from how many grams are counted once and twice.
    """
    padded = F.concat(F.lit(" " * (order - 1)), F.col("word"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))
    counts = {order: stored(words.select("lang", F.explode(grams).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for size in range(order - 1, 0, -1):
        longer = counts[size + 1]
        # written, as each size is read several times: by its own weights, its discount and the next size
        counts[size] = stored(longer.groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"counts{size}")
    # one row per language
    letters = counts[1].groupBy("lang").agg(F.count(F.lit(1)).alias("letters"))
    lower = None
    tables = []
    for size in range(1, order + 1):
        now = counts[size].withColumn("before", F.substring("gram", 1, size - 1))
        once, twice = (F.sum(F.when(F.col("n") == k, 1).otherwise(0)) for k in (1, 2))
        # bounded away from 0 and 1, for languages with hardly any text
        discount = counts[size].groupBy("lang").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.try_divide(once, once + 2 * twice))).alias("d"))
        contexts = now.groupBy("lang", "before").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("follow"))
        weights = contexts.join(discount, "lang").select("lang", "before", "d", "total", (F.col("d") * F.col("follow") / F.col("total")).alias("weight"))
        rows = now.join(weights, ["lang", "before"])
        if lower is None:
            rows = rows.join(letters, "lang").withColumn("shorter", 1 / (F.col("letters") + 1))
        else:
            rows = rows.join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("shorter")), [
                rows["lang"] == lower["lang"], F.substring("gram", 2, size - 1) == F.col("rest")]).drop(lower["lang"])
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("shorter")
        lower = stored(rows.select("lang", "gram", "n", p.alias("p")), f"grams{size}")
        after = weights.filter("before <> ''").select("lang", F.col("before").alias("gram"), F.log("weight").alias("back"))
        tables.append((lower, after))
    out = None
    for size, (rows, _) in enumerate(tables, 1):
        rows = rows.select(F.lit(size).alias("size"), "lang", "gram", "n", F.log("p").alias("logp"))
        # the weight after a gram comes from the contexts of the next size
        rows = rows.join(tables[size][1], ["lang", "gram"], "left") if size < order else rows.withColumn("back", F.lit(None).cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return out


def frequent(grams: DataFrame, most: int) -> DataFrame:
    """The grams that are counted often enough for at most `most` to be left; shorter ones only go when no longer ones are left, and
    single characters always stay."""
    sizes = {(r.size, r.level): r.k for r in grams.groupBy("size", F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}
    kept, least = sum(sizes.values()), {}
    # the longest grams go first, the rarest of them before others
    for size, level in sorted(sizes, key=lambda x: (-x[0], x[1])):
        if kept <= most or size == 1:
            break
        least[size] = 2 ** (level + 1)
        kept -= sizes[size, level]
    keep = F.lit(True)
    for size, n in least.items():
        keep = keep & ((F.col("size") != size) | (F.col("n") >= n))
    return grams.filter(keep)


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each size 1 to `order`, the hash of the characters that end at each place (wrong for the first size - 1 places)."""
    mixed = codes.astype(np.uint64) + np.uint64(1)
    mixed = (mixed ^ (mixed << np.uint64(29))) * MULTIPLY
    mixed ^= mixed >> np.uint64(32)
    out = [mixed]
    for _ in range(order - 1):
        longer = out[-1].copy()
        longer[1:] = out[-1][:-1] * MULTIPLY + mixed[1:]
        longer[0] = 0
        out.append(longer)
    return out


def named(grams: DataFrame) -> DataFrame:
    """(size, lang, name, before, rest, logp, back): grams by their hash, with those of all characters but the last and but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts = batch.column("size").to_numpy(), np.array(batch.column("gram").to_pylist(), object)
            out = np.zeros((3, len(batch)), np.uint64)
            for k in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == k)
                codes = np.frombuffer("".join(texts[at]).encode("utf-32-le"), np.uint32).reshape(-1, k)
                for i, part in enumerate((codes, codes[:, :-1], codes[:, 1:])):
                    if part.shape[1]:
                        out[i, at] = _last(np.ascontiguousarray(part))
            yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("lang"), *[pa.array(x.view(np.int64)) for x in out],
                                              batch.column("logp").cast(pa.float32()), batch.column("back").cast(pa.float32())],
                                             ["size", "lang", "name", "before", "rest", "logp", "back"])

    return grams.select("size", "lang", "gram", "logp", "back").mapInArrow(
        run, "size int, lang string, name bigint, before bigint, rest bigint, logp float, back float")


def tables(grams: DataFrame, order: int = ORDER) -> dict:
    """The model as plain values: languages, log probability of an unseen character, and per size sorted hashes with a row of
    log probabilities and back-off weights per language (no weights with the longest).

    A gram that some language has gets its probability in all of them, those without it by backing off; so the longest gram that
    is known decides a place.
    """
    # every language has single characters
    langs = sorted(r.lang for r in grams.filter("size = 1").select("lang").distinct().collect())
    place = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("smallint")
    grams = named(grams).withColumn("lang", place)
    model = {"langs": langs, "order": order, "sizes": [], "unseen": np.zeros(len(langs), np.float32)}
    for k in range(1, order + 1):
        # one size at a time, numbers only: all sizes together are at most `MODEL_GRAMS` rows; nothing goes on after the longest
        rows = grams.filter(F.col("size") == k).select("lang", "name", "before", "rest", "logp", *(["back"] if k < order else [])).toArrow()
        lang, name, before, rest, logp = (rows.column(c).to_numpy() for c in ("lang", "name", "before", "rest", "logp"))
        keys, first, where = np.unique(name.view(np.uint64), return_index=True, return_inverse=True)
        p, b = np.full((len(keys), len(langs)), np.nan, np.float32), np.zeros((len(keys) if k < order else 0, len(langs)), np.float32)
        p[where, lang] = logp
        if k < order:
            b[where, lang] = np.nan_to_num(rows.column("back").to_numpy(), nan=0.0)
        if k == 1:  # as with the interpolation above: a share of the weight of all characters
            letters = np.bincount(lang, minlength=len(langs))
            model["unseen"] = -np.log(letters + 1.0).astype(np.float32) - 2.0
            missing = np.broadcast_to(model["unseen"], p.shape)
        else:
            shorter, its_p, its_b = model["sizes"][-1]
            missing = its_b[_find(shorter, before[first].view(np.uint64))] + its_p[_find(shorter, rest[first].view(np.uint64))]
        np.copyto(p, missing, where=np.isnan(p))
        model["sizes"].append((keys, p, b))
    return model


def _last(grams: np.ndarray) -> np.ndarray:
    """The hash of each gram, from its characters as a row."""
    n, k = grams.shape
    return hashes(grams.reshape(-1), k)[k - 1].reshape(n, k)[:, -1] if n else np.empty(0, np.uint64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def score_words(model: dict, words: list[str]) -> np.ndarray:
    """Per word and language, the log probability of its characters and the blank after it."""
    order = model["order"]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + order  # blanks before and one behind
    codes = np.frombuffer("".join(" " * (order - 1) + w + " " for w in words).encode("utf-32-le"), np.uint32)
    begin = lengths.cumsum() - lengths
    places = np.ones(len(codes), bool)
    for k in range(order - 1):
        places[begin + k] = False
    places = np.flatnonzero(places)
    ends = hashes(codes, order)
    total = np.zeros((len(places), len(model["langs"])), np.float32)
    open_at = np.arange(len(places))  # places that no gram has decided yet
    for k in range(order, 0, -1):
        keys, p, _ = model["sizes"][k - 1]
        at = _find(keys, ends[k - 1][places[open_at]])
        known = at >= 0
        total[open_at[known]] += p[at[known]]
        open_at = open_at[~known]
        if k > 1 and len(open_at):  # back off: the weight after the context that did not go on
            keys, _, back = model["sizes"][k - 2]
            at = _find(keys, ends[k - 2][places[open_at] - 1])
            total[open_at[at >= 0]] += back[at[at >= 0]]
    total[open_at] += model["unseen"]
    return np.add.reduceat(total, np.concatenate([[0], (lengths - order + 1).cumsum()[:-1]]), axis=0)


class Scorer:
    """Scores texts in a worker; distinct words are remembered."""

    def __init__(self, model: dict) -> None:
        self.model, self.letters = model, remembered(Letters)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.empty((1 << 12, len(self.model["langs"])), np.float32)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the mean log probability of a character, and the number of characters (0 without a letter)."""
        if len(self.place) > WORDS:
            self._forget()
        split = [self.letters.words(t) for t in texts]
        new = list(set().union(*split).difference(self.place))
        if new:
            first, last = len(self.place), len(self.place) + len(new)
            while len(self.known) < last:
                self.known = np.concatenate([self.known, np.empty_like(self.known)])
            self.known[first:last] = score_words(self.model, new)
            self.place.update(zip(new, range(first, last)))
        sizes = np.array([sum(map(len, words)) + len(words) for words in split])
        sums = np.zeros((len(texts), self.known.shape[1]))
        for i, words in enumerate(split):
            if words:
                sums[i] = self.known[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return sums / np.maximum(sizes, 1)[:, None], sizes


def with_scores(docs: DataFrame, sent: Broadcast, text: str = "text") -> DataFrame:
    """From a model that was sent to the tasks: `docs` with `best` (language, null without a letter), `margin` (how much nats a character the next one is behind) and
    `evidence` (the logarithm of margin times length, plus 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(sent.value), np.array(sent.value["langs"], object)
        for batch in batches:
            best, margin, evidence = [], [], []
            for group in text_groups(batch.column(text)):
                scores, sizes = scorer.score(group)
                first = scores.argmax(axis=1)
                top = scores[np.arange(len(group)), first]
                scores[np.arange(len(group)), first] = -np.inf
                behind = np.minimum(top - scores.max(axis=1), 20.0)  # infinite with one language
                best += np.where(sizes > 0, langs[first], None).tolist()
                margin += behind.tolist()
                evidence += np.log1p(behind * sizes).tolist()
            for values, name, kind in ((best, "best", pa.string()), (margin, "margin", pa.float64()), (evidence, "evidence", pa.float64())):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    docs = docs.drop("best", *MARGIN)
    return docs.mapInArrow(run, docs.withColumns({"best": F.lit(None).cast("string"), "margin": F.lit(0.0), "evidence": F.lit(0.0)}).schema)


def calibrated(scored: DataFrame) -> LogisticRegressionModel | None:
    """How likely the best language is right, from margin and evidence; None unless the sample (lang, best, ...) has both kinds."""
    rows = stored(scored.filter("best is not null").select((F.col("best") == F.col("lang")).cast("double").alias("label"),
                                                           array_to_vector(F.array(*MARGIN)).alias("features")), "margins")
    seen = {r.label for r in rows.select("label").distinct().collect()}
    return LogisticRegression(regParam=0.001).fit(rows) if len(seen) == 2 else None


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Identifier:
    """Models of all languages of `docs` (lang, text), with a calibration.

    Rows without language or text teach nothing.  At most `calibration` rows, and at most about one in ten, those with the least hash of
    their id and text, are kept for the calibration; counts and probabilities are over all others.
    """

    def __init__(self, docs: DataFrame, most: int = MODEL_GRAMS, calibration: int = CALIBRATION, order: int = ORDER,
                 doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> None:
        small_batches(docs.sparkSession)
        draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(1_000_000))
        rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
            F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), draw.alias("draw"))
        total = rows.count()
        below = min(100_000, math.floor(1_000_000 * calibration / total)) if total else 0
        counts = word_counts(rows.filter(F.col("draw") >= below), F.lit(0)).select("lang", "word", "n")
        grams = stored(kneser_ney(stored(counts, "words"), order), "model")
        # plain arrays, at most `MODEL_GRAMS` rows; sent once, and not kept in the driver's Python
        self.sent = None if is_empty(grams) else docs.sparkSession.sparkContext.broadcast(tables(frequent(grams, most), order))
        pa.default_memory_pool().release_unused()
        self.calibration = None
        if self.sent:
            self.calibration = calibrated(with_scores(rows.filter(F.col("draw") < below).select("text", "lang"), self.sent))

    @property
    def model(self) -> dict | None:
        """The model as plain values."""
        return self.sent.value if self.sent else None

    def identify(self, docs: DataFrame, reject: float = 0.5, text: str = "text") -> DataFrame:
        """`docs` with `lang_pred` (`und` without a letter, or where nothing was learnt), `score` and `accepted`.

        `score` is the calibrated chance that the language is right, 0 for `und`; without a calibration it is what the margin over all
        characters makes of even chances.  Rows whose score is below `reject` are not accepted.  Every row is kept; columns of
        `docs` with these names are replaced.
        """
        kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
        if self.sent is None:
            out = docs.select(*kept).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
        else:
            out = with_scores(docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text")), self.sent)
            if self.calibration is None:
                chance = 1 / (1 + F.exp(-F.expm1("evidence")))
            else:
                a, b = (float(x) for x in self.calibration.coefficients)
                chance = 1 / (1 + F.exp(-(a * F.col("margin") + b * F.col("evidence") + float(self.calibration.intercept))))
            out = out.select("row.*", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
                             F.when(F.col("best").isNull(), 0.0).otherwise(chance).alias("score"))
        return out.withColumn("accepted", F.col("score") >= reject)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row, learnt from the rows that are not held out.

    Null texts and texts without a letter are `und`.  Rows are kept as they are; a row with null id is not held out.
    """
    learnt = Identifier(docs.filter(~held_out()))
    return learnt.identify(docs.select("doc_id", held_out().alias("held_out"), "text")).drop("text")
