"""Packing by power-of-two decomposition: each document is cut into pieces whose lengths are powers of two, and pieces of
one length form one bucket of sequences.  No sequence crosses documents and none is padded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, forget, give_back, remembered, small_batches, text_groups
from .tokens import Encoder

BUCKET_AT, TASK_AT = 58, 34  # bits of a sequence id: bucket, task, number within the bucket of the task
SLICE_TOKENS = 1 << 20


def binary_lengths(n: int, longest: int) -> list[int]:
    """`n` as falling powers of two: as many of `longest` as fit, then the binary digits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset).

    A document is the ids of its text (tokenizers file at the path `tokenizer`, one that drops space; no special tokens added),
    then `end_id`; a null text is empty, so each row has at least one id.  `ids` is binary, 4 bytes an id, lowest first.  A
    piece is a sequence of its own, so offset is 0; bucket is the binary logarithm of its length, and sequence ids, unique,
    are ordered by bucket.  They follow from the place of the row in its task's input, so a lost task gives the same ones.
    Repeated rows are packed each for itself, a null id stays null, and other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    # the task's number comes with the rows, so that it stays when a caller merges tasks
    frame = docs.select(F.col(doc_id).alias("doc_id"), filled(text).alias("text"), F.spark_partition_id().alias("task"))
    small_batches(docs.sparkSession)
    of_id = frame.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        forget(but=Encoder)
        encoder = remembered(Encoder, tokenizer)
        used = [0] * 64
        for batch in batches:
            task = batch.column("task")[0].as_py() if len(batch) else 0
            names = iter(batch.column("doc_id").to_pylist())
            for group in text_groups(batch.column("text")):
                for ids in encoder.encode(group):
                    ids, name, start = np.append(ids, np.uint32(end_id)).astype("<u4"), next(names), 0
                    for length in binary_lengths(len(ids), longest):
                        bucket = length.bit_length() - 1
                        yield (name, start, length, ids[start:start + length].tobytes(), len(ids), bucket,
                               (bucket << BUCKET_AT) + (task << TASK_AT) + used[bucket], 0)
                        used[bucket] += 1
                        start += length
                give_back()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        held, tokens = [], 0
        for row in rows(all_batches()):
            held.append(row)
            tokens += row[2]
            if tokens >= SLICE_TOKENS or len(held) >= 10_000:
                yield batch_of(held)
                held, tokens = [], 0
        if held:
            yield batch_of(held)

    return frame.mapInArrow(pieces, f"doc_id {of_id}, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int, "
                                    "sequence_id bigint, offset bigint")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so that a reader draws batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def packing_digest(packed: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
