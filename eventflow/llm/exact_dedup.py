"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of code points.  Distinct blocks are sorted and numbered, so each
block has an integer name; then distinct pairs of adjacent names are sorted and numbered, and so on until a document is one
name.  Names are equal just where the texts are: blocks that share a 128-bit hash are compared as text before they share a
name, and pairs are compared as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, filled, is_empty, stored

BLOCK = 2048
NONE = -1


def normalised(text: str | Column) -> Column:
    """The text without blanks and control space; null counts as empty."""
    return F.regexp_replace(filled(text), ASCII_SPACE + "+", "")


def blocks_of(text: Column, block: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))


def hashed(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2")]


def numbered(distinct: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Distinct keys, sorted within their partition and numbered; written, so that the numbers stay."""
    return stored(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names", most)


def block_names(docs: DataFrame, text: str, block: int) -> tuple[DataFrame, int]:
    """Names of all distinct blocks by hash, and the hash seed under which no two different blocks share a hash."""
    seed = 0
    while True:
        pieces = docs.select(F.explode(blocks_of(normalised(text), block)).alias("block")).select(*hashed(F.col("block"), seed), "block")
        names = numbered(pieces.groupBy("h1", "h2").agg((F.min("block") == F.max("block")).alias("one")), ["h1", "h2"])
        if is_empty(names.filter(~F.col("one"))):
            return names.drop("one"), seed
        seed += 1


def document_names(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """`docs` in the columns (row, doc, level, name): the struct of each row, and its identity (level, name).

    An empty text has level -1.
    """
    names, seed = block_names(docs, text, block)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    norm = normalised(text)
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*kept, F.char_length(filled(text)).alias("n_chars__"), F.sha2(norm, 256).alias("sha__")).alias("doc"),
        F.transform(blocks_of(norm, block), lambda b: F.struct(*hashed(b, seed))).alias("hashes")), "rows")

    nodes = rows.select("row", F.size("hashes").cast("long").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    nodes = nodes.select("row", "n", F.col("pos").cast("long").alias("pos"), "h.h1", "h.h2").join(names, ["h1", "h2"])
    nodes = stored(nodes.select("row", "n", "pos", "name"), "nodes")
    done = nodes.filter("n = 1").select("row", F.lit(0).alias("level"), "name")
    level = 0
    while not is_empty(nodes := nodes.filter("n > 1")):
        level += 1
        most = nodes.count()
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a")
        right = F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b")
        pairs = nodes.groupBy("row", F.ceil(F.col("n") / 2).alias("n"), F.floor(F.col("pos") / 2).alias("pos")).agg(left, right)
        names = numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("uses")).select("a", "b"), ["a", "b"], most)
        nodes = stored(pairs.join(names, ["a", "b"]).select("row", "n", "pos", "name"), "nodes", most)
        done = done.unionAll(nodes.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
    empty = rows.filter(F.size("hashes") == 0).select("row", F.lit(NONE).alias("level"), F.lit(0).cast("long").alias("name"))
    return rows.select("row", "doc").join(done.unionAll(empty), "row")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs`.

    Texts are equal when they are without ``[\\x20\\x09-\\x0D]``; a null text is empty.  Of equal texts the one with the most
    code points before that stays, then the one with the smallest id (null last); of rows that agree in all of this, one.
    `kept` marks exactly one row of each group.  An empty table gives an empty result; other columns are not read.
    """
    named = document_names(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", block)
    named = named.select("row", "level", "name", "doc.*")
    rank = F.struct((-F.col("n_chars__")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("row").alias("row"))
    # written, so that the join with it can be split where a group is large
    groups = stored(named.groupBy("level", "name").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha__").alias("text_sha256"))
