"""Phrases by best-first growth.  A phrase can be no more frequent than its beginning, so what any longer phrase can score is
bounded by the counts of that beginning.  Beginnings are extended from the highest bound down, for each language until enough
surviving phrases score at least as much as anything not looked at could.

The corpus is read as arrays of 64-bit word names (0 where a phrase cannot go on), written once; a round of growth is two or
three passes over them, in which a task looks up its words among the beginnings of that round and counts what follows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, is_empty, small_batches, stored

TOP, LEAST, CONTAINED = 2000, 30, 80
VOCABULARY = 8_000_000  # frequent words that are broadcast (8 bytes each) to leave the others out early; with more, all are counted
FRONTIER = 1_000_000  # beginnings that one pass looks for
MEMORY = 150_000  # words of a language that a worker remembers, and distinct words that it counts at a time
CHUNK = 1 << 19  # words that are counted at a time
BUCKET = 1_000  # of scores, which go up to 1,000,000
WIDER = 4  # how many times more phrases a round looks at than the one before

# What ends a piece, and the blanks between words; capitals A-Z are lower-cased.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
FOLD = bytes(10 if b in ENDS else 32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words, with a line feed between pieces; empty strings between blanks."""
    return text.translate(FOLD).replace(b"\n", b" \n ").split(b" ")


class Names(dict):
    """64-bit names of one language's words: 0 for the end of a piece and for words that are not `known`, 1 for nothing."""

    def __init__(self, lang: str, salt: int, known: np.ndarray | None = None) -> None:
        super().__init__()
        self.known = known
        self.start = hashlib.blake2b(lang.encode() + b"\0", digest_size=8, salt=salt.to_bytes(8, "little"))
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.update({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self._forget()
        name = self.start.copy()
        name.update(word)
        value = int.from_bytes(name.digest(), "little", signed=True) | 2
        if self.known is not None:
            at = self.known.searchsorted(value)
            value = value if at < len(self.known) and self.known[at] == value else 0
        self[word] = value
        return value


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    langs, texts = batch.column("lang"), batch.column("text").cast(pa.binary())
    for lang, text in zip(langs, texts):
        yield lang.as_py(), text.as_py()


def word_counts(texts: DataFrame, salt: int) -> DataFrame:
    """(lang, word, name, n) of texts (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, Names] = {}
        found: dict[str, Counter] = {}

        def counted(lang: str) -> Iterator[pa.RecordBatch]:
            of = names[lang] = names.get(lang) or Names(lang, salt)
            rows = [(w, of[w], n) for w, n in found.pop(lang).items() if w and w != b"\n"]
            for at in range(0, len(rows), 100_000):
                w, name, n = zip(*rows[at:at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w, pa.binary()).cast(pa.string()), pa.array(name, pa.int64()),
                                                  pa.array(n, pa.int64())], ["lang", "word", "name", "n"])

        for batch in batches:
            for lang, text in _texts(batch):
                words = found.setdefault(lang, Counter())
                words.update(tokens(text))
                if len(words) > MEMORY:
                    yield from counted(lang)
        for lang in list(found):
            yield from counted(lang)

    return texts.mapInArrow(count, "lang string, word string, name bigint, n bigint").groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def named_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """The words with counts, and the salt with which no two of them have one name."""
    for salt in range(16):
        words = stored(word_counts(texts, salt), "words")
        if is_empty(words.groupBy("name").count().filter("count > 1")):
            return words, salt
    raise RuntimeError("words share names with every salt")


def encoded(texts: DataFrame, salt: int, known: np.ndarray | None) -> DataFrame:
    """(codes) per text: the names of its words as 64-bit numbers; 0 ends a piece, stands for words not `known`, and ends the text."""
    sent = texts.sparkSession.sparkContext.broadcast(known)  # at most `VOCABULARY` numbers, sorted

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, Names] = {}
        known = sent.value
        for batch in batches:
            rows, size = [], 0
            for lang, text in _texts(batch):
                words = tokens(text)
                words.append(b"\n")
                if lang not in names:
                    names[lang] = Names(lang, salt, known)
                codes = np.fromiter(map(names[lang].__getitem__, words), np.int64, len(words))
                codes = codes[codes != 1]
                codes = codes[(codes != 0) | np.append(True, codes[:-1] != 0)]  # one 0 in a row is enough
                if len(codes) > 1:
                    rows.append(codes.tobytes())
                    size += len(codes)
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["codes"])
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["codes"])

    return texts.mapInArrow(encode, "codes binary")


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Grams:
    """A set of n-grams of names that finds those of a text; a shared hash is looked through to the end, so it is exact."""

    BITS = 22

    def __init__(self, columns: list[np.ndarray], flags: list[np.ndarray]) -> None:
        mixed = _mixed(columns)
        order = np.argsort(mixed, kind="stable")
        self.mixed, self.columns, self.flags = mixed[order], [c[order] for c in columns], [f[order] for f in flags]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self._low(mixed)] = True
        _, runs = np.unique(self.mixed, return_counts=True)
        self.run = int(runs.max(initial=0))  # n-grams of one hash, at most

    def _low(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, grams: list[np.ndarray]) -> np.ndarray:
        """The place in this set of each n-gram, or -1."""
        out = np.full(len(grams[0]), -1)
        mixed = _mixed(grams)
        at = np.flatnonzero(self.maybe[self._low(mixed)])
        place = np.searchsorted(self.mixed, mixed[at])
        for step in range(self.run):
            here = np.minimum(place + step, len(self.mixed) - 1)
            same = reduce(np.logical_and, (c[here] == g[at] for c, g in zip(self.columns, grams)))
            out[at[same]] = here[same]
        return out


def _counted(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct n-grams with counts.  Grams that share a hash may come twice, but never with a wrong count."""
    mixed = _mixed(columns)
    order = np.argsort(mixed)
    columns = [c[order] for c in columns]
    new = np.append(True, reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(order)))
    return pa.RecordBatch.from_arrays([*[pa.array(c[begin]) for c in columns], pa.array(counts.astype(np.int64))], [*NAMES[:len(columns)], "n"])


NAMES = ("a", "b", "c", "d")


def _passed(corpus: DataFrame, size: int, least: int, starts) -> DataFrame:
    """Counts, at least `least`, of the n-grams of `size` words that begin where `starts(codes)` says."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("codes").cast(pa.large_binary())
            if not len(column):
                continue
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            codes = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.int64)
            for begin in range(0, len(codes), CHUNK):
                part = codes[begin:begin + CHUNK + size - 1]  # n-grams that begin in this chunk
                at = starts(part)
                if len(at):
                    yield _counted([part[at + j] for j in range(size)])

    names = NAMES[:size]
    kinds = ", ".join(f"{c} bigint" for c in names)
    return corpus.mapInArrow(count, f"{kinds}, n bigint").groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def pairs(corpus: DataFrame, least: int) -> DataFrame:
    return _passed(corpus, 2, least, lambda codes: np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0)))


def grown(corpus: DataFrame, frontier: DataFrame, size: int, least: int, most: int) -> DataFrame:
    """(a, b, ..., f) of the phrases of size + 1 words whose first words are in the `frontier` (a, b, ..., after, before) with `after`
    or whose last words are with `before`.

    A pass sends at most about `most` rows of the frontier; a larger one takes several passes.
    """
    names = NAMES[:size]
    parts = max(1, -(-frontier.count() // most))
    out = []
    for part in range(parts):
        # rows a part are as even as their hash
        rows = frontier.filter(F.pmod(F.xxhash64(*names), F.lit(parts)) == part).toArrow()
        sent = corpus.sparkSession.sparkContext.broadcast([rows.column(c).to_numpy() for c in (*names, "after", "before")])

        def starts(codes: np.ndarray, sent=sent) -> np.ndarray:
            grams = _grams(sent, size)
            n = len(codes) - size  # phrases of one word more
            if n < 1 or not grams.run:
                return np.empty(0, np.int64)
            at = grams.find([codes[j:n + 1 + j] for j in range(size)])
            after = (at[:-1] >= 0) & grams.flags[0][at[:-1]] & (codes[size:] != 0)
            before = (at[1:] >= 0) & grams.flags[1][at[1:]] & (codes[:n] != 0)
            return np.flatnonzero(after | before)

        out.append(stored(_passed(corpus, size + 1, least, starts), f"grown{size}"))
    return out[0] if parts == 1 else reduce(DataFrame.unionByName, out).dropDuplicates(list(NAMES[:size + 1]))


def exact(corpus: DataFrame, wanted: DataFrame, size: int, most: int) -> DataFrame:
    """(a, b, ..., f) of just the `wanted` phrases."""
    names = NAMES[:size]
    parts = max(1, -(-wanted.count() // most))
    out = []
    for part in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64(*names), F.lit(parts)) == part).toArrow()
        sent = corpus.sparkSession.sparkContext.broadcast([rows.column(c).to_numpy() for c in names])

        def starts(codes: np.ndarray, sent=sent) -> np.ndarray:
            grams = _grams(sent, size)
            n = len(codes) - size + 1
            return np.flatnonzero(grams.find([codes[j:n + j] for j in range(size)]) >= 0) if n > 0 and grams.run else np.empty(0, np.int64)

        out.append(stored(_passed(corpus, size, 1, starts), f"exact{size}"))
    return reduce(DataFrame.unionByName, out)


_current: list = [None, None]


def _grams(sent, size: int) -> Grams:
    """The set that was sent, built once in a worker."""
    columns = sent.value
    if _current[0] is not columns:
        _current[:] = [columns, Grams(list(columns[:size]), [f.astype(bool) for f in columns[size:]])]
    return _current[1]


def scaled(a: str, of: str) -> str:
    """floor(2,000,000 a / of), exact beyond 64 bits."""
    return f"(2000000 * cast({a} as decimal(20, 0))) div cast({of} as decimal(21, 0))"


def bound() -> Column:
    """What a phrase that goes on can score at most: its first cut has `fa` before it, and behind it at least its own count."""
    return F.expr(scaled("f", "fa + f"))


def lowest(*cuts: tuple[str, str]) -> Column:
    """The cut (score, k, l, r) with the lowest score, of those the first."""
    rows = [F.struct(F.expr(scaled("f", f"{before} + {rest}")).alias("score"), F.lit(k).alias("k"), F.col(before).alias("l"), F.col(rest).alias("r"))
            for k, (before, rest) in enumerate(cuts, 1)]
    return F.array_min(F.array(*rows))


def level(counts: dict[int, int], wanted: int) -> int:
    """The lowest score to look at so that about `wanted` phrases are: a multiple of `BUCKET`, 0 for all."""
    seen = 0
    for bucket in sorted(counts, reverse=True):
        seen += counts[bucket]
        if seen >= wanted:
            return bucket * BUCKET
    return 0


def unsurvived(phrases: DataFrame, longer: DataFrame, size: int, percent: int) -> DataFrame:
    """`phrases` without those that a phrase of one word more holds at `percent` of their count or above."""
    names, all_names = NAMES[:size], NAMES[:size + 1]
    ends = [longer.groupBy(*[F.col(c).alias(n) for n, c in zip(names, part)]).agg(F.max("f").alias("within")) for part in (all_names[:-1], all_names[1:])]
    within = ends[0].unionByName(ends[1]).groupBy(*names).agg(F.max("within").alias("within"))
    return phrases.join(within, list(names), "left").filter(F.col("within").isNull() | (100 * F.col("within") < percent * F.col("f"))).drop("within")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, percent: int = CONTAINED, text: str = "text", lang: str = "lang",
                 frontier: int = FRONTIER, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words that occur `least` times or more.

    Texts are cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs, A-Z in lower case.  Cut after its first
    k words, a phrase with count a scores floor(2,000,000 a / (l + r)), l and r the counts of both parts; its lowest cut counts, of
    equal ones the first.  Phrases inside a longer one (up to 4 words) that has `percent` of their count are left out.  Order:
    score, then a, both falling, then the phrase's bytes.

    A null text is empty, a null language `und`; repeated rows count each, ids do not matter, other columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), filled(text).alias("text"))
    words, salt = named_words(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.filter(F.col("n") >= least).select("name", "lang", "word", F.col("n").alias("f"))
    few = often.limit(vocabulary + 1).count() <= vocabulary
    known = np.sort(often.select("name").toArrow().column("name").to_numpy()) if few else None
    corpus = _written(encoded(texts, salt, known))

    first, second = often.select(F.col("name").alias("a"), "lang", F.col("f").alias("fa")), often.select(F.col("name").alias("b"), F.col("f").alias("fb"))
    two = pairs(corpus, least).join(first, "a").join(second, "b").withColumns({"best": lowest(("fa", "fb")), "bound": bound()})
    two = stored(two, "pairs")
    three = four = None  # what has been counted of longer phrases

    buckets: dict[str, dict[int, int]] = {}
    for r in two.groupBy("lang", F.floor(F.col("best.score") / BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("k")).collect():
        buckets.setdefault(r.lang, {})[r.bucket] = r.k  # at most 1,001 a language
    found: list[DataFrame] = []
    floor, wanted = {name: 2_000_000 for name in buckets}, 2 * top
    while floor:
        last, floor = floor, {name: level(buckets[name], wanted) for name in floor}
        levels = F.broadcast(spark.createDataFrame([(name, floor[name], last[name]) for name in floor], "lang string, floor bigint, last bigint"))

        def opened(phrases: DataFrame, names: tuple[str, ...]) -> DataFrame:
            """The beginnings between this round's floor and the last one's, and the phrases that others may hold."""
            new = lambda c: (F.col(c) >= F.col("floor")) & (F.col(c) < F.col("last"))
            rows = phrases.join(levels, "lang").select(*names, new("bound").alias("after"), new("best.score").alias("before"))
            return stored(rows.filter("after or before"), "frontier")

        more = grown(corpus, opened(two, ("a", "b")), 2, least, frontier)
        three = more if three is None else three.unionByName(more).dropDuplicates(["a", "b", "c"])
        begins = two.select("a", "b", "lang", "fa", F.col("f").alias("fab"))
        ends = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc"), F.col("fb").alias("fc"))
        rows = three.join(begins, ["a", "b"]).join(ends, ["b", "c"])
        triples = stored(rows.withColumns({"best": lowest(("fa", "fbc"), ("fab", "fc")), "bound": bound()}), "triples")
        three = triples.select("a", "b", "c", "f")

        more = grown(corpus, opened(triples, ("a", "b", "c")), 3, least, frontier)
        four = stored(more if four is None else four.unionByName(more).dropDuplicates(["a", "b", "c", "d"]), "fours")
        begins = triples.select("a", "b", "c", "lang", "fa", "fab", F.col("f").alias("fabc"))
        ends = two.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("f").alias("fcd"), F.col("fb").alias("fd"))
        whole = ("fa", "fbcd"), ("fab", "fcd"), ("fabc", "fd")
        tails = three.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("f").alias("fbcd"))
        rows = stored(four.join(begins, ["a", "b", "c"]).join(ends, ["c", "d"]).join(tails, ["b", "c", "d"], "left"), "fours_parts")
        # last words that were not counted: looked up for phrases that may still score enough
        hopeful = rows.filter("fbcd is null").withColumn("fbcd", F.col("f")).withColumn("hope", lowest(*whole)["score"])
        asked = stored(hopeful.join(levels, "lang").filter("hope >= floor").select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c")).distinct(), "asked")
        tails = exact(corpus, asked, 3, frontier).select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("f").alias("fbcd"))
        rows = rows.filter("fbcd is not null").unionByName(rows.filter("fbcd is null").drop("fbcd").join(tails, ["b", "c", "d"]))
        fours = rows.withColumn("best", lowest(*whole))

        column = lambda df, size: df.select("lang", F.array(*NAMES[:size]).alias("names"), "f", "best")
        enough = lambda df: df.join(levels, "lang").filter(F.col("best.score") >= F.col("floor")).drop("floor", "last")
        left = (column(unsurvived(enough(two), three, 2, percent), 2).unionByName(column(unsurvived(enough(triples), four, 3, percent), 3))
                .unionByName(column(enough(fours), 4)))
        left = stored(left, "survivors")
        counts = {r.lang: r.k for r in left.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
        settled = [name for name in floor if not floor[name] or counts.get(name, 0) >= top]
        found.append(left.filter(F.col("lang").isin(settled)))
        floor = {name: floor[name] for name in floor if name not in settled}
        wanted *= WIDER

    if not found:
        found = [two.select("lang", F.array("a", "b").alias("names"), "f", "best")]
    rows = reduce(DataFrame.unionByName, found)
    for i in range(4):
        rows = rows.join(often.select(F.col("name").alias(f"name{i}"), F.col("word").alias(f"word{i}")), F.get("names", F.lit(i)) == F.col(f"name{i}"), "left").drop(f"name{i}")
    phrase = F.concat_ws(" ", *[f"word{i}" for i in range(4)])
    rows = rows.select("lang", phrase.alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _written(codes: DataFrame) -> DataFrame:
    """The encoded corpus in the shared folder, compressed for being read several times."""
    spark: SparkSession = codes.sparkSession
    name = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(name)
    spark.conf.set(name, "zstd")
    try:
        return stored(codes, "corpus")
    finally:
        spark.conf.set(name, before)
