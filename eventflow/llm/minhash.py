"""Near-dedup by circulant MinHash.

One permutation spreads the shingles over a ring of 2^64 places; a second one, shifted along the ring by k, gives coordinate k
of the signature.  Bands of coordinates name buckets.  Texts that share a bucket are compared in full, but not all pairs of a
bucket: first each with one pivot; then the texts of buckets that still hold several components are compared across these,
where a prefix filter over their shingles leaves a similar pair possible.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filled, forget, is_empty, matching, small_batches, stored, text_groups
from .components import components

WIDTH = 5  # words of a shingle
BANDS, ROWS = 24, 4  # a pair with similarity 0.85 shares no band once in 5 * 10^7
BOUND = 500_000  # ids that may be broadcast
SLICE = 1 << 15  # shingles hashed at a time, to stay in the processor's cache
GROUP = 1 << 19  # characters hashed at a time
U = np.uint64


def mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the ring of 2^64 places."""
    x = x ^ (x >> U(33))
    x *= U(a)
    x ^= x >> U(33)
    x *= U(b)
    x ^= x >> U(33)
    return x


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    out = []
    for number in (base, inverse):
        steps = np.full(n, number, U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def word_list(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits for each word, from running sums over all bytes at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    joined = np.frombuffer(b"".join(words), np.uint8)
    up, down = _powers(1 << max(20, int(len(joined)).bit_length()))
    sums = np.zeros(len(joined) + 1, U)
    np.cumsum((joined.astype(U) + U(1)) * up[:len(joined)], out=sums[1:])
    ends = sizes.cumsum()
    starts = ends - sizes
    return mix((sums[ends] - sums[starts]) * down[starts], 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def shingle_hashes(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of one text's words; fewer words are one shingle, none are none."""
    n = len(hashes)
    if not n:
        return hashes
    span = min(n, width)
    total = np.full(n - span + 1, span, U)
    for j in range(span):
        total = total * U(0x9FB21C651E98DF25) + hashes[j:n - span + 1 + j]
    return np.unique(mix(total, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: coordinate k is the least of pi(sigma(x) + k)."""
    out = np.full((len(sets), coordinates), np.iinfo(U).max, U)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= SLICE):
            size += len(sets[last])
            last += 1
        ring = mix(np.concatenate(sets[first:last]), 0x87C37B91114253D5, 0x4CF5AD432745937F)
        starts = np.cumsum([0, *map(len, sets[first:last - 1])])
        for at in range(0, len(ring), SLICE) if last == first + 1 else [0]:
            part = ring[at:at + SLICE] if last == first + 1 else ring
            for k in range(coordinates):
                lowest = np.minimum.reduceat(mix(part + U(k), 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), starts)
                np.minimum(out[first:last, k], lowest, out=out[first:last, k])
        first = last
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.tile(np.arange(1, bands + 1, dtype=U), (len(signature), 1))
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + signature[:, j::rows][:, :bands], 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
    return key.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            counts, keys, digests = [], [], []
            for group in text_groups(batch.column("text"), GROUP):
                split = [word_list(t) for t in group]
                hashes = word_hashes([w for ws in split for w in ws])
                ends = np.cumsum([len(ws) for ws in split])
                sets = [shingle_hashes(hashes[e - len(ws):e], width) for ws, e in zip(split, ends)]
                counts += map(len, sets)
                digests += [hashlib.blake2b(b" ".join(ws), digest_size=16).digest() for ws in split]
                full = iter(band_keys(signatures([s for s in sets if len(s)], bands * rows), bands, rows))
                keys += [next(full) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"])

    return run


def similar(a: frozenset, b: frozenset, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingles(text: str, width: int = WIDTH) -> frozenset:
    """The shingles themselves, as bytes."""
    words = word_list(text)
    return frozenset(b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def _compare(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[str, frozenset] = OrderedDict()

        def of(text: str) -> frozenset:
            if text not in recent:
                recent[text] = shingles(text, width)
                while len(recent) > 1 and sum(map(len, recent.values())) > 100_000:
                    recent.popitem(last=False)
            recent.move_to_end(text)
            return recent[text]

        for batch in batches:
            texts = zip(batch.column("text_a"), batch.column("text_b"))
            linked = [bool(a and b) and similar(of(a), of(b), percent) for a, b in ((x.as_py(), y.as_py()) for x, y in texts)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of ids (a stored table) those whose full sets are similar enough; `docs` is (doc_id, text)."""
    if is_empty(pairs):
        return pairs
    most = pairs.count()
    ids = stored(pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select("b").distinct()).distinct(), "ids", 2 * most)
    texts = matching(docs, ids, ["doc_id"], BOUND)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(width, percent), f"a {kind}, b {kind}").distinct(), "confirmed")


def _close(percent: int, n: str, m: str) -> Column:
    """Sizes that a similar enough pair may have."""
    return (100 * F.least(n, m)) >= percent * F.greatest(n, m)


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for group in text_groups(batch.column("text"), GROUP):
                split = [word_list(t) for t in group]
                hashes = word_hashes([w for ws in split for w in ws])
                ends = np.cumsum([len(ws) for ws in split])
                sets = [shingle_hashes(hashes[e - len(ws):e], width) for ws, e in zip(split, ends)]
                at = np.repeat(np.arange(len(group)), [len(s) for s in sets]) + done
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "h"])
                done += len(group)

    return run


def _across(nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of `nodes` (a stored table of node, n, comp) of two components that may be similar enough.

    Every similar pair is among them, by the prefix filter: with shingles ordered from rare to common, two such sets share one
    of their first n - ceil(n * percent / 100) + 1, and enough can follow the first that they share.  What a whole group has in common comes last, so a group of texts that are
    alike but not alike enough gives few pairs.
    """
    texts = matching(docs, stored(nodes.select(F.col("node").alias("doc_id")), "ids"), ["doc_id"], BOUND)
    kind = nodes.schema["node"].dataType.simpleString()
    rows = stored(texts.mapInArrow(_shingle_rows(width), f"node {kind}, h bigint"), "shingles")
    common = stored(rows.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1"), "common")
    by_node = Window.partitionBy("node")
    placed = rows.join(common, "h").withColumns({
        "rank": F.row_number().over(by_node.orderBy("f", "h")), "known": F.count("*").over(by_node)}).join(nodes, "node")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # shingles of no other node come first, so they are counted, not kept
    placed = placed.withColumn("pos", F.col("n") - F.col("known") + F.col("rank")).filter(F.col("pos") <= prefix)
    placed = stored(placed.select("h", "node", "n", "comp", "pos"), "prefixes")
    mixed = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("h")
    left = placed.join(stored(mixed, "mixed"), "h")
    other = left.select("h", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("pos").alias("at"))
    # two sets whose first common shingle is this one have at most it and what comes behind it in common
    most = 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    enough = most * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    pairs = left.join(other, "h").filter((F.col("comp") < F.col("other")) & _close(percent, "n", "m") & enough)
    return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`.

    Two documents are linked when 100 times the size of the intersection of their shingle sets is at least `percent` times that
    of the union.  A text without words (or null) has an empty set and is linked with nothing.  component_id is the least id
    that links reach; `kept` marks the document with that id.  Rows under one id are one document (each with its n_shingles);
    a row with null id is linked with nothing, has a null component and is kept.  Other columns are not read.

    Links are found by shared bands and confirmed on the full sets; texts of the same words are one node.  Of the pairs of a
    bucket only those are left out whose ends are known to be in one component, or that cannot be similar enough.
    """
    frame = docs.select(F.col(doc_id).alias("doc_id"), filled(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    sketches = stored(frame.mapInArrow(_sketch(width, bands, rows), f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>"), "sketches")
    usable = sketches.filter("doc_id is not null and n_shingles > 0")
    nodes = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes, "nodes")

    # which nodes a document's rows are; rows of several texts under one id link these
    owners = stored(usable.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct(), "owners")
    torn = owners.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last").select("doc_id", "b")
    torn = owners.join(torn, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")

    members = nodes.select(F.explode("bands").alias("key"), "node", "n")
    buckets = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    shared = stored(members.join(stored(buckets.select("key", "pivot"), "buckets"), "key"), "shared")
    sizes = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"))
    first = shared.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "n").distinct()
    first = stored(first.join(sizes, "b").filter(_close(percent, "n", "m")).select("a", "b"), "pairs")
    links = confirmed(first, frame, width, percent)
    found = components(links.unionAll(torn))

    comp = F.coalesce("component", "node").alias("comp")
    several = stored(shared.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", comp), "labelled")
    mixed = several.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("mixed")).filter("mixed").select("key")
    open_nodes = stored(several.join(stored(mixed, "mixed"), "key").select("node", "n", "comp").distinct(), "open")
    if is_empty(open_nodes):
        more = links.limit(0)
    else:
        rest = _across(open_nodes, frame, percent, width).join(first, ["a", "b"], "left_anti")
        more = confirmed(stored(rest, "pairs"), frame, width, percent)

    # what the second links join are components, of which there are few
    labels = owners.join(found, "node", "left").select("doc_id", "node", comp)
    ends = labels.select("node", "comp").distinct()
    more = more.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(more).toDF("comp", "component")
    labels = labels.join(joined, "comp", "left").select("doc_id", F.coalesce("component", "comp").alias("component")).distinct()
    component = F.coalesce("component", "doc_id")
    return sketches.join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that `near_duplicates` does not keep."""
    gone = stored(near_duplicates(docs, percent, doc_id=doc_id, text=text).filter("not kept").select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    return matching(docs, gone, [doc_id], BOUND, "left_anti")
