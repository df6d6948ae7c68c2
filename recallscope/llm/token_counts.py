"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recallscope.llm.arrays import trim
from recallscope.llm.tokenizing import encoder, slices

ADDED = ("n_bytes", "n_tokens", "over_limit")


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """The rows of ``docs`` without the text, with ``n_bytes`` (UTF-8),
    ``n_tokens`` (as the library counts, no special tokens added) and
    ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a tokenizers ``.json`` or a sentencepiece
    ``.model`` on every machine. Each Arrow batch is worked on in slices of equal
    bytes; texts are cut only where the tokenizer cuts anyway, so a very long
    text costs no more memory than its slice and counts are exact. A null or
    empty text has no bytes and no tokens; repeated rows are counted each; an
    empty table gives an empty result; input columns named like an added one are
    replaced. No shuffle: one narrow pass over the text.
    """
    docs = docs.drop(*[c for c in ADDED if c in docs.columns and c != text_col])
    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        tokenizer = encoder(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            n = np.concatenate([np.zeros(0, np.int64), *(tokenizer.counts(texts) for _, texts in slices(column))])
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), n_bytes, pa.array(n), pa.array(n > limit)],
                names=[f.name for f in schema.fields])
            trim()

    return docs.mapInArrow(count, schema)
