"""Sizes of texts in tokens of a public tokenizer."""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

#: Where the ranks of the byte-level vocabulary lie on every machine; never copied into the repository.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the public byte-level vocabulary of 50k entries splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, out: str, *keep: str, path: str = RANKS) -> DataFrame:
    """The columns ``keep`` and ``out``, the tokens of the whole ``text``; null has none. Strings that look like special tokens
    are ordinary text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = encoding(path)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            n = [len(e.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64())], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{fields}, `{out}` long")
