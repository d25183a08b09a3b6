"""Places for models that are passed in: tokenizers, embedders, summarisers.

A port takes a function of a list of texts and calls it once an Arrow batch of
at most ``rows`` texts, on the executors; it is pickled with the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType


def apply(df: DataFrame, text: str, out: str, kind: DataType, model: Callable[[list[str]], list], rows: int = 1024) -> DataFrame:
    """Adds ``out``: what the model makes of each text; null texts stay null and aren't passed on."""
    at, arrow = df.columns.index(text), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), rows):
                batch = whole.slice(lo, rows)
                texts = batch.column(at).to_pylist()
                known = [x for x in texts if x is not None]
                made = iter(model(known)) if known else iter(())
                column = pa.array([None if x is None else next(made) for x in texts], arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, kind)]))


def counted(df: DataFrame, text: str, count: Callable[[str], int], out: str = "tokens") -> DataFrame:
    """Token counts by a tokenizer of the caller's."""
    return apply(df, text, out, LongType(), lambda texts: [count(x) for x in texts])


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], out: str = "vector") -> DataFrame:
    """Vectors by an embedder of the caller's, a batch a call."""
    return apply(df, text, out, ArrayType(DoubleType()), lambda texts: [[float(x) for x in v] for v in embed(texts)])


def summarised(df: DataFrame, texts: str, summarise: Callable[[str], str], fallback: Callable[[str], str], out: str = "summary") -> DataFrame:
    """Summaries by a model of the caller's; where it fails or says nothing, the fallback's."""

    def safe(x: str) -> str:
        try:
            return summarise(x) or fallback(x)
        except Exception:  # noqa: BLE001  a model's failure must not fail a request
            return fallback(x)

    return apply(df, texts, out, StringType(), lambda all_of: [safe(x) for x in all_of])


def reduced(df: DataFrame, text: str, reduce: Callable[[list[str], float], list[str]], keep: float, out: str = "reduced") -> DataFrame:
    """A learned reducer, a batch a call; a failed batch, or a text that would grow, stays as it is."""

    def safe(texts: list[str]) -> list[str]:
        try:
            made = reduce(texts, keep)
        except Exception:  # noqa: BLE001
            return texts
        return [y if y is not None and len(y) <= len(x) else x for x, y in zip(texts, made, strict=True)] if len(made) == len(texts) else texts

    return apply(df, text, out, StringType(), safe)
