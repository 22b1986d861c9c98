"""Line dedup with content-defined chunks of lines.

A line ends where a word hash is the least of some few adjacent ones, so lines are short and the same words are cut alike wherever
they stand.  A rolling hash runs over the hashes of adjacent lines, and each window of `min_words` words is named by the least rolling
hash inside it: where the name changes, a chunk of lines ends.  Chunks are hashed whole; those of an earlier document too lead there.
Only chunks that share a name but differ are compared by windows.  The words are compared as bytes and removed from the later document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, filled, forget, matching, small_batches, stored, text_groups
from .minhash import GROUP, U, _powers, mix

MIN_WORDS = 50
LINE, LINES = 4, 6  # words of a line at most, lines under a rolling hash; less where `min_words` is small
BOUND = 500_000  # ids that may be broadcast
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Chunks(NamedTuple):
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    whole: np.ndarray
    again: np.ndarray


def running(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any stretch follows, and what undoes the place of a stretch."""
    up, down = _powers(1 << max(20, len(hashes).bit_length()))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return sums, down


def stretches(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = (sums[ends] - sums[starts]) * down[starts]
    return mix(total + (ends - starts).astype(U), 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the number of its text."""
    raw = [t.encode() for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(BLANK[joined], prepend=True))  # words begin and end by turns
    starts, ends = edges[::2], edges[1::2]
    sums, down = running(joined + U(1))
    offsets = np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]])
    return stretches(sums, down, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` adjacent values: of the end of one block and the start of the next."""
    n = len(values)
    blocks = np.full((-(-n // width), width), np.iinfo(U).max, U)
    blocks.ravel()[:n] = values
    fore = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], fore[width - 1:n])


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each of the (not empty) ranges: of two powers of two that cover it."""
    level, out = np.frexp(high - low)[1] - 1, np.empty(len(low), U)
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(values[low[here]], values[high[here] - (1 << k)])
        values = np.minimum(values[:-(1 << k)], values[1 << k:])
    return out


def line_begins(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which words begin a line: those whose hash is the least of some `width` adjacent ones, so that no line is longer."""
    begins, smallest = np.zeros(len(hashes), bool), least(hashes, width)
    for k in range(width):
        begins[k:k + len(smallest)] |= hashes[k:k + len(smallest)] == smallest
    return begins


def twice(hashes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Running sums for two independent hashes of a stretch: 128 bits together."""
    return running(hashes), running(mix(hashes, 0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA87))


def chunks_of(texts: list[str], min_words: int = MIN_WORDS) -> Chunks:
    """The chunks of each text: hash, number of the text, first word of the first window, windows, and two hashes of all its words.

    Every `min_words` words in a row are a window of exactly one chunk, whose hash follows from these words alone: whether a word
    begins a line depends on the words less than a line away, so lines that near to the window's ends are left out.
    """
    hashes, doc = words_of(texts)
    n = len(hashes) - min_words + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return Chunks(empty.view(U), *[empty] * 3, empty.view(U), empty.view(U))
    width, group = max(1, min(LINE, min_words // 12)), max(1, min(LINES, min_words // 8))
    begins = np.append(line_begins(hashes, width), True)
    edges = np.flatnonzero(begins)
    (sums, down), more = twice(hashes)
    over_lines, down_lines = running(stretches(sums, down, edges[:-1], edges[1:]))
    at = np.arange(len(edges) - group)
    rolling = stretches(over_lines, down_lines, at, at + group)
    before = np.append(0, begins.cumsum())
    reach = min_words - width + (width == 1)
    names = least_between(rolling, before[width - 1:width - 1 + n], before[reach + 1:reach + 1 + n] - group)
    inside = doc[:n] == doc[min_words - 1:]
    opens = np.append(True, (names[1:] != names[:-1]) | (doc[1:n] != doc[:n - 1])) & inside
    first = np.flatnonzero(opens)
    windows = np.add.reduceat(inside.astype(np.int64), first) if len(first) else first
    ends = first + windows + min_words - 1
    return Chunks(names[first], doc[first], first - np.searchsorted(doc, doc[first]), windows,
                  stretches(sums, down, first, ends), stretches(*more, first, ends))


def _chunk_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, done = batch.column("id"), 0
            for group in text_groups(batch.column("text"), GROUP):
                c = chunks_of(group, min_words)
                at = pa.array(c.doc + done)
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (c.hash, c.whole, c.again)], ids.take(at), batch.column("tag").take(at),
                                                  *[pa.array(x.astype(np.int32)) for x in (c.first, c.windows)]], ["h", "c", "d", "id", "tag", "first", "windows"])
                done += len(group)

    return run


def windows_of(texts: list[str], chunks: list[list[dict]], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the given chunks of each text: two hashes, number of the text, first word."""
    hashes, doc = words_of(texts)
    sums, more = twice(hashes)
    begins = np.searchsorted(doc, np.arange(len(texts) + 1))
    number = np.repeat(np.arange(len(texts)), [len(c) for c in chunks])
    first = np.array([c["first"] for g in chunks for c in g], np.int64)
    windows = np.array([c["windows"] for g in chunks for c in g], np.int64)
    number, ends = np.repeat(number, windows), windows.cumsum()
    pos = np.arange(len(number)) + np.repeat(first - ends + windows, windows)
    fits = pos + min_words <= np.diff(begins)[number]
    number, pos = number[fits], pos[fits]
    at = begins[number] + pos
    return stretches(*sums, at, at + min_words), stretches(*more, at, at + min_words), number, pos


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chunks, done = batch.column("id"), batch.column("chunks").to_pylist(), 0
            for group in text_groups(batch.column("text"), GROUP):
                hashes, again, number, pos = windows_of(group, chunks[done:done + len(group)], min_words)
                at = pa.array(number + done)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(again.view(np.int64)), ids.take(at), batch.column("tag").take(at), pa.array(pos.astype(np.int32))],
                                                 ["w", "v", "id", "tag", "pos"])
                done += len(group)

    return run


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """Stretches of windows that an earlier document has too; `docs` is (id, tag, text).

    (id, tag, keeper, at, words, starts): `words` words from each of `starts` of document `id` seem to stand at word `at` of the
    document `keeper`, the earliest that has them.
    """
    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.filter("id is not null")
    chunks = stored(docs.mapInArrow(_chunk_rows(min_words), f"h bigint, c bigint, d bigint, id {kind}, tag int, first int, windows int"), "chunks")
    several = stored(chunks.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last").select("h"), "several")
    found = stored(chunks.join(several, "h"), "found")
    discard(chunks, several)
    # equal chunks: the earliest document keeps them; a name with different chunks is looked at by windows there
    contents = stored(found.groupBy("h", "c", "d").agg(F.min(F.struct("id", "first")).alias("of")).select("h", "c", "d", F.col("of.id").alias("keeper"), F.col("of.first").alias("at")), "contents")
    mixed = stored(contents.groupBy("h").agg(F.min("keeper").alias("least"), F.max("keeper").alias("last")).filter("least < last").select("h", F.lit(True).alias("mixed")), "mixed")
    placed = found.join(contents.join(mixed, "h", "left"), ["h", "c", "d"]).filter("id > keeper or mixed")
    placed = stored(placed.select("id", "tag", "first", "windows", "keeper", "at").distinct(), "placed")  # rows may be repeated
    discard(found, contents, mixed)
    asked = stored(placed.filter("id = keeper").groupBy("id", "tag").agg(F.collect_set(F.struct("first", "windows")).alias("chunks")), "asked")
    texts = matching(docs, asked.select("id", "tag"), ["id", "tag"], BOUND).join(asked, ["id", "tag"])
    windows = stored(texts.mapInArrow(_window_rows(min_words), f"w bigint, v bigint, id {kind}, tag int, pos int"), "windows")
    earliest = windows.groupBy("w", "v").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last")).filter("first.id < last")
    earliest = stored(earliest.select("w", "v", F.col("first.id").alias("keeper"), F.col("first.pos").alias("at")), "earliest")
    later = windows.join(earliest, ["w", "v"]).filter("id > keeper").select("id", "tag", "pos", F.lit(1).alias("windows"), "keeper", "at").distinct()
    later = later.unionByName(placed.filter("id > keeper").withColumnRenamed("first", "pos"))
    # adjacent windows and chunks from one place of one keeper form a run
    order = Window.partitionBy("id", "tag").orderBy("pos", "windows", "keeper", "at")
    goes_on = (F.lag(F.col("pos") + F.col("windows")).over(order) == F.col("pos")) & (F.lag(F.col("at") + F.col("windows")).over(order) == F.col("at"))
    goes_on &= F.lag("keeper").over(order) == F.col("keeper")
    later = later.withColumn("run", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("run").over(order))
    runs = later.groupBy("id", "tag", "keeper", "run").agg(F.min("pos").alias("start"), F.min("at").alias("at"), (F.sum("windows") + (min_words - 1)).alias("words"))
    runs = stored(runs.groupBy("id", "tag", "keeper", "at", "words").agg(F.collect_list("start").alias("starts")), "runs")
    discard(placed, asked, windows, earliest)
    return runs


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keeper's words for each run."""
    held, words = None, []
    for batch in batches:
        out = []
        for text, at, n in zip(batch.column("text").to_pylist(), *(batch.column(c).to_pylist() for c in ("at", "words"))):
            if text != held:
                held, words = text, text.encode().split()
            out.append(b" ".join(words[at:at + n]))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "tag", "starts")], pa.array(out, pa.binary())], ["id", "tag", "starts", "snippet"])


def repeated_words(words: list[bytes], runs: list[dict]) -> np.ndarray:
    """Which words stand in the snippets of the runs too."""
    mark = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        other = run["snippet"].split()
        for start in run["starts"]:
            if words[start:start + len(other)] == other:
                mark[start] += 1
                mark[start + len(other)] -= 1
    return mark.cumsum()[:-1] > 0


def without(text: str, runs: list[dict], min_words: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without its stretches of at least `min_words` repeated words, and these as (first word, words)."""
    raw = text.encode()
    words = raw.split()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated_words(words, runs), [False]]))).reshape(-1, 2)
    gone = [(int(a), int(b - a)) for a, b in edges if b - a >= min_words]
    if not gone:
        return text, []
    spans = [m.span() for m in WORD.finditer(raw)]
    kept, at = [], 0
    for first, n in gone:
        kept.append(raw[at:spans[first][0]])
        at = spans[first + n][0] if first + n < len(spans) else len(raw)
    return b"".join([*kept, raw[at:]]).decode(), gone


def _rewrite(text: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [without(t, r, min_words) for t, r in zip(batch.column(text).to_pylist(), batch.column("runs__").to_pylist())]
            spans = [[{"start": a, "words": n} for a, n in g] for _, g in done]
            out = batch.set_column(batch.schema.get_field_index(text), text, pa.array([t for t, _ in done], pa.string()))
            yield out.select([c for c in out.schema.names if c != "runs__"]).append_column(
                "removed__", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))))

    return run


def with_removed(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated passages taken out of `text`, and `removed`, what went, as (start, words) in words of the old text.

    A word is ``[^\\x20\\x09-\\x0D]+``.  A word goes when it is one of `min_words` words in a row that a document with a smaller id
    has in a row too; so the first document keeps them.  It is the given texts that count: words that a removal brings together are not looked at again.  White space
    between words is not compared; that behind a passage goes with it.  All else in a text stays byte for byte.  A document that
    is a whole copy keeps its row, with empty text.  Rows under one id never take a passage from each other; rows with null id or null text
    stay as they are, with nothing removed.  A column named `removed` is replaced; others pass through.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "removed"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    frame = docs.select(F.col(doc_id).alias("id"), F.hash(text).alias("tag"), filled(text).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    runs = repeated_runs(frame, min_words)
    keepers = stored(runs.select(F.col("keeper").alias("id")).distinct(), "keepers")
    earlier = matching(frame.select("id", "text"), keepers, ["id"], BOUND).withColumnRenamed("id", "keeper")
    asked = runs.join(earlier, "keeper").select("id", "tag", "starts", "words", "at", "text")
    asked = asked.mapInArrow(_snippets, f"id {kind}, tag int, starts array<int>, snippet binary")
    of_doc = stored(asked.groupBy("id", "tag").agg(F.collect_list(F.struct("starts", "snippet")).alias("runs__")), "of_doc")

    found = of_doc.withColumnsRenamed({"id": doc_id, "tag": "tag__"})
    keys = found.select(doc_id, "tag__")
    tagged = docs.withColumn("tag__", F.hash(text))
    touched = matching(tagged, keys, [doc_id, "tag__"], BOUND).join(found, [doc_id, "tag__"]).select(*[F.col(f"`{c}`") for c in names], "runs__")
    touched = touched.mapInArrow(_rewrite(text, min_words), T.StructType([*docs.schema.fields, T.StructField("removed__", SPANS)]))
    untouched = matching(tagged, keys, [doc_id, "tag__"], BOUND, "left_anti").drop("tag__").withColumn("removed__", F.array().cast(SPANS))
    return touched.unionByName(untouched).withColumnRenamed("removed__", "removed")


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated passages taken out of the texts; each row stays, and so does a column named `removed`."""
    own = docs.withColumnsRenamed({"removed": "own__removed"})
    return with_removed(own, min_words, doc_id, text).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own.columns, docs.columns)])
