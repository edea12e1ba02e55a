"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the word pattern this vocabulary was published with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Counts tokens; made once per worker from the bytes of a .tiktoken file."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, n_tokens of every row; null and empty texts have 0. Whole texts are counted, however long.

    The driver reads the vocabulary (under 1 MB) and sends it along, so that
    executors need no copy of the file.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for b in batches:
            n = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens bigint")
