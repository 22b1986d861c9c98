"""Token counts: texts are encoded in Arrow batches and only lengths come back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, remembered, small_batches, text_groups
from .tokens import Counter


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    Tokens are those of the tokenizers file at the path `tokenizer` (the same on every machine), which must be byte-level
    without prefix blank, with no special tokens added; special strings in a text count as their token, the library's default.
    Batches hold about 1 MiB of text; longer texts are cut at blanks that follow no space (see `tokens.Counter`), and each
    distinct part is encoded once a batch.  A null text is empty: no bytes, no tokens.  Rows are kept as they are; null or
    repeated ids and other columns do not matter.
    """
    frame = docs.select(F.col(doc_id).alias("doc_id"), filled(text).alias("text"))
    small_batches(docs.sparkSession)
    of_id = frame.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = remembered(Counter, tokenizer)
        for batch in batches:
            n = [x for group in text_groups(batch.column("text")) for x in counter.count(group)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64()),
                                              pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = frame.mapInArrow(count, f"doc_id {of_id}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
