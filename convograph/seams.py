"""Places where a model or a service answers: one protocol each, run over Arrow batches, with a default that looks answers up or decides by rule.

A seam gets columns of a batch as lists and gives one answer a row; it must not depend on where a batch begins, as tasks may run again."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Seam(Protocol):
    """Columns it reads, and its answers to a batch of them."""

    inputs: Sequence[str]

    def answer(self, *columns: list) -> list: ...


class Embedder:
    """A vector from the text alone: signed counts of hashed words."""

    inputs = ("text",)

    def __init__(self, size: int = 64):
        self.size = size

    def answer(self, texts: list) -> list:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class Threshold:
    """A yes or no by score: the default relevance gate, participation gate, and confirmer of merges and bindings."""

    inputs = ("score",)

    def __init__(self, least: float = 0.88):
        self.least = least

    def answer(self, scores: list) -> list:
        return [s is not None and s >= self.least for s in scores]


class Lookup:
    """Answers stated beforehand by key, null for others: the default extractor, recall, reply, caption and warm-up provider."""

    inputs = ("key",)

    def __init__(self, answers: dict[str, str]):
        self.answers = dict(answers)

    def answer(self, keys: list) -> list:
        return [self.answers.get(k) for k in keys]


class Headline:
    """The default summary: the first line, up to a length."""

    inputs = ("text",)

    def __init__(self, most: int = 200):
        self.most = most

    def answer(self, texts: list) -> list:
        return [None if t is None else (t.splitlines() or [""])[0][: self.most] for t in texts]


def ask(df: DataFrame, seam: Seam, out: str, kind: str, **columns: str) -> DataFrame:
    """The rows with the answers of ``seam`` as ``out`` of SQL type ``kind``; ``columns`` names the column for an input that is not called alike."""
    read = [columns.get(i, i) for i in seam.inputs]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64(), "array<float>": pa.list_(pa.float32())}
        for batch in batches:
            got = seam.answer(*(batch.column(c).to_pylist() for c in read))
            if len(got) != batch.num_rows:
                raise ValueError(f"{type(seam).__name__} gave {len(got)} answers to {batch.num_rows} rows")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, types[kind])], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
