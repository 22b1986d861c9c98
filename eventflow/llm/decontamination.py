"""Benchmark decontamination with suffix arrays of the training text.

Each task sorts the suffixes of its shard of documents, as word sequences, and binary-searches every suffix of the benchmark
items in that order.  This gives all verbatim matches of at least one window, extended to the longest, with their places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import built, small_batches, stored, text_groups

WINDOW = 13
BLOCK_BYTES = 64 << 20  # benchmark text that is sent to the tasks at once
SHARD_WORDS = 2_000_000
JUDGED = ("n_words", "matches", "n_hit", "n_items", "items_sha256", "contaminated")
#: A-Z to a-z, bytes of words as they are, all else to blanks
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = "struct<item_id:string,start:bigint,item_start:bigint,length:bigint>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


class Items:
    """Benchmark items as numbered words, 0 being any word that no item has, and the ranks of their stretches.

    Stretches of 1, 2, 4, ... words that lie in an item are ranked in the order of their words, each by the ranks of its halves;
    so is every window.  The tables are made once in a worker, and a shard looks its own stretches up in them.
    """

    def __init__(self, rows: list[tuple], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.texts, self.sizes = [], [], []
        for item_id, text in sorted(((str(i) if i is not None else "", t) for i, t in rows if t), key=lambda r: r):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if ids:
                self.ids.append(item_id)
                self.texts.append(np.array(ids, np.int64))
                self.sizes.append(min(window, len(ids)))
        if not self.ids:
            return
        lengths = np.array([len(t) for t in self.texts])
        stream = np.concatenate([np.append(t, 0) for t in self.texts])
        at = {1: stream}
        self.tables: dict[int, np.ndarray] = {}
        for step in powers(max(self.sizes))[1:]:
            pairs = followed(at[step // 2], step // 2, self.base(step // 2))
            table, at[step] = np.unique(pairs, return_inverse=True)  # the last place has 0, so 0 is the least
            self.tables[step] = table[1:]
        # the windows of each size: key, item, place in the item
        self.windows = {}
        starts, sizes = np.cumsum(lengths + 1) - lengths - 1, np.array(self.sizes)
        for size in sorted(set(self.sizes)):
            mine = np.flatnonzero(sizes == size)
            n = lengths[mine] - size + 1
            item = np.repeat(mine, n)
            inside = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            self.windows[size] = (self.keys(at, size)[starts[item] + inside], item, inside)

    def base(self, step: int) -> int:
        """One more than the greatest rank of stretches of `step` words."""
        return 1 + (len(self.numbers) if step == 1 else len(self.tables[step]))

    def keys(self, at: dict[int, np.ndarray], size: int) -> np.ndarray:
        """A number for the first `size` words of each suffix, in their order, 0 if no item may have them: two overlapping stretches."""
        half = powers(size)[-1]
        return at[half] if half == size else followed(at[half], size - half, self.base(half))

    def ranks(self, stream: np.ndarray) -> dict[int, np.ndarray]:
        """The ranks of a shard's stretches."""
        at = {1: stream}
        for step, table in self.tables.items():
            at[step] = ranked(followed(at[step // 2], step // 2, self.base(step // 2)), table)
        return at

    @property
    def least(self) -> int:
        return min(self.sizes)


def powers(most: int) -> list[int]:
    """1, 2, 4, ... up to `most`."""
    return [1 << k for k in range(most.bit_length())]


def followed(ranks: np.ndarray, step: int, base: int) -> np.ndarray:
    """For each place its rank and that `step` places on as one number, 0 where either is 0."""
    after = np.zeros_like(ranks)
    after[:-step] = ranks[step:]
    return np.where((ranks > 0) & (after > 0), ranks * base + after, 0)


def ranked(pairs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rank of each pair in a sorted table, from 1; 0 where the table has it not."""
    if not len(table):
        return np.zeros_like(pairs)
    order, at = np.argsort(pairs), np.empty_like(pairs)
    at[order] = np.searchsorted(table, pairs[order])  # in order, as jumps in a large table are slow
    known = (pairs > 0) & (table[np.minimum(at, len(table) - 1)] == pairs)
    return np.where(known, at + 1, 0)


def search(stream: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(item, places in the stream, places in the item, window) of all windows that occur, for each item that has one.

    `stream` holds word numbers with 0 between what is not consecutive.  Its suffixes that may begin with a window are sorted by as
    many words, and all windows of the items are searched by halves there at once.
    """
    at = items.ranks(stream)
    for size, (wanted, item, inside) in items.windows.items():
        keys = items.keys(at, size)
        suffixes = np.flatnonzero(keys)
        suffixes = suffixes[np.argsort(keys[suffixes], kind="stable")]  # the suffix array
        ordered = keys[suffixes]
        low, high = (np.searchsorted(ordered, wanted, side) for side in ("left", "right"))
        found = np.flatnonzero(high > low)
        edges = np.flatnonzero(np.diff(item[found], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            of = found[a:b]
            n = high[of] - low[of]
            yield int(item[of[0]]), suffixes[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low[of], n)], np.repeat(inside[of], n), size


def longest_matches(places: np.ndarray, inside: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Matches of one window joined along their diagonals to the longest ones: (place, place in the item, length)."""
    order = np.lexsort((places, places - inside))
    places, inside = places[order], inside[order]
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (np.diff(places - inside) != 0)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(places)))
    return list(zip(places[first].tolist(), inside[first].tolist(), (runs + size - 1).tolist()))


def match_shard(texts: Iterable[str], items: Items) -> list[tuple[int, int, list[tuple[str, int, int, int]]]]:
    """(words, words hit, longest matches) of each document."""
    least, counts, pieces, where, owner = items.least, [], [], [], []
    for d, text in enumerate(texts):
        found = words(text)
        counts.append(len(found))
        ids = np.fromiter((items.numbers.get(w, 0) for w in found), np.int64, len(found))
        # only runs of item words that a window fits into can match; the rest of the suffixes cannot
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]])))
        for a, b in edge.reshape(-1, 2)[(edge[1::2] - edge[::2]) >= least]:
            pieces.append(np.append(ids[a:b], 0))
            where.append(np.arange(a, b + 1))
            owner.append(np.full(b + 1 - a, d))
    results = [(n, 0, []) for n in counts]
    if not pieces:
        return results
    stream, where, owner = np.concatenate(pieces), np.concatenate(where), np.concatenate(owner)
    hit = np.zeros(len(stream) + 1, np.int64)
    matches: dict[int, list] = {}
    for k, places, inside, size in search(stream, items):
        np.add.at(hit, places, 1)
        np.add.at(hit, places + size, -1)
        for p, j, length in longest_matches(places, inside, size):
            matches.setdefault(int(owner[p]), []).append((items.ids[k], int(where[p]), j, length))
    covered = np.bincount(owner[hit.cumsum()[:-1] > 0], minlength=len(counts))
    return [(n, int(covered[d]), sorted(matches.get(d, []))) for d, n in enumerate(counts)]


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in lists of about `block_bytes` of text each."""
    held = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null")
    total = held.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield [tuple(r) for r in held.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with `n_words` and `matches`, the longest verbatim matches as (item_id, start, item_start, length) in words.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A match has at least `window` words, or all of
    an item that has fewer.  A null text has no words and no matches; items without words match nothing, and a null item id
    counts as empty text.  Rows are kept as they are.  The benchmark is a query set: it goes to the tasks in blocks of
    `block_bytes`, one pass over the documents (and one written table between passes) for each.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_words", "matches")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("n_words", F.lit(0).cast("long")).withColumn("matches", F.array().cast(f"array<{MATCH}>"))
    for k, rows in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        if k:
            out = stored(out, "matches")
        items = docs.sparkSession.sparkContext.broadcast((rows, window))
        out = out.mapInArrow(_pass(items, text), out.schema)
    return out


def _items(plain: tuple) -> Items:
    return Items(*plain)


def _pass(sent, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if size >= SHARD_WORDS * 6:
                yield from finish(held)
                held, size = [], 0
        yield from finish(held)

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        items = built(_items, sent)
        texts = (t for batch in held for group in text_groups(batch.column(text)) for t in group)
        found = match_shard(texts, items) if items.ids else [(len(words(t)), 0, []) for t in texts]
        done = 0
        for batch in held:
            mine = found[done:done + len(batch)]
            done += len(batch)
            kind = batch.schema.field("matches").type
            before = batch.column("matches").to_pylist()
            rows = [(old or []) + [dict(zip(("item_id", "start", "item_start", "length"), m)) for m in new] for old, (_, _, new) in zip(before, mine)]
            out = batch.set_column(batch.schema.get_field_index("n_words"), "n_words", pa.array([n for n, _, _ in mine], pa.int64()))
            yield out.set_column(out.schema.get_field_index("matches"), "matches", pa.array(rows, kind))

    return run


def hit_words(matches: Column) -> Column:
    """How many words lie within any match: the matches by start, each counted from where the ones before end."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(ordered, start, lambda s, m: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(m["a"], s["end"]))).alias("n"), F.greatest(s["end"], m["b"]).alias("end")), lambda s: s["n"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, **names) -> DataFrame:
    """`find_matches` with n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids) and contaminated.

    A document is contaminated when words are hit and they are at least one in `share` of all its words.
    """
    out = find_matches(docs, benchmark, window, **names)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    out = out.withColumn("n_hit", hit_words(F.col("matches"))).withColumn("n_items", F.size(ids).cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(ids, ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, **names) -> DataFrame:
    """`docs` without the contaminated ones; columns that are named like those of `judged` stay as they are."""
    own = docs.withColumnsRenamed({c: f"own__{c}" for c in JUDGED})
    clean = judged(own, benchmark, window, share, **names).filter(~F.col("contaminated"))
    return clean.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own.columns, docs.columns)])

