"""Token counts of whole texts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary`` is the path of a tokenizer (.json for tokenizers, .model for sentencepiece), at the same place on every
    executor. A null text counts as empty: no bytes, no tokens. Special strings inside texts are handled as the
    library does by default; nothing is added, cut or padded. Rows that repeat are counted each; an empty table gives no rows; other columns are ignored.

    Texts reach the library in slices balanced by bytes, and long ones are cut at safe boundaries (see ``tokens``); only ids and
    lengths come back from Python, so nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import SLICE_BYTES, SLICE_ROWS, encoder

        if vocabulary.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            lengths = lambda texts: pa.array([len(x) for x in processor.encode(texts.to_pylist(), num_threads=1)], pa.int64())
            batches = slices(batches)
        else:
            e = encoder(vocabulary)
            lengths = lambda texts: pc.divide(pc.binary_length(e.encode_array(texts)).cast(pa.int64()), e.width)
            batches = slices(batches, SLICE_ROWS, SLICE_BYTES)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), lengths(batch.column("_text"))], ["_id", "n_bytes", "n_tokens"])
        # the worker lives on, beside those of later stages
        pa.default_memory_pool().release_unused()

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    text = text_of(text_col)
    counted = df.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text")).mapInArrow(count, schema)
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
