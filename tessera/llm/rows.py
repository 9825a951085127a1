"""Functions over whole rows, by position, so that columns of any names pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.wordcodec import release_words

#: Rows, and bytes of their texts, that are Python objects at a time; a longer text is alone.
ROWS, SLICE_BYTES = 512, 1 << 21


def slices(batch: pa.RecordBatch, column: int, rows: int = ROWS, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most ``rows`` texts and about ``limit`` bytes of them."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, before + limit, "right")) - at))
        yield batch.slice(at, n)
        at += n


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ... ."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text passes; ``judge`` is called once a task and returns texts -> booleans."""
    at = docs.columns.index(text_col)
    plain = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()  # what this worker remembers from packing has no use here
        passes = judge()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(passes(part.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def map_text(docs: DataFrame, text_col: str, extra: DataFrame, on: str, change: Callable[[list, list], list]) -> DataFrame:
    """``docs`` with new texts: ``change`` gets texts and what ``extra`` (id, value) has for them, or None.

    A column n_chars, if there is one, follows the new text.
    """
    at, key = docs.columns.index(text_col), docs.columns.index(on)
    plain = numbered(docs)
    schema = plain.schema
    joined = plain.join(extra.toDF("x_id", "x_value"), F.col(f"c{key}") == F.col("x_id"), "left").drop("x_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                new = change(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())
                cols = [pa.array(new, pa.string()) if i == at else part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-1])

    out = joined.mapInArrow(run, schema)
    for i, name in enumerate(docs.columns):
        if name == "n_chars":
            out = out.withColumn(f"c{i}", F.coalesce(F.char_length(f"c{at}"), F.lit(0)).cast(schema[i].dataType))
    return out.toDF(*docs.columns)
