"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the vocabulary; the same path must exist on the executors. Never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def encoder(path: str):
    """A tiktoken encoding over a rank file; text is cut into words by the library's own GPT-2 pattern."""
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n): tokens of each whole text; null and empty texts have 0."""
    rows = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n", "long")

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *keep)), pa.array(n)], names=["id", *keep, "n"])

    return rows.mapInArrow(run, schema)
