"""Token counts: batch encoding in Arrow functions that return lengths only.

The texts of an Arrow batch are cut into parts and the parts dealt into slices balanced by bytes; each slice is one call
of the library's batch encoding. A text is cut only where it is longer than a slice, at white space that no token of the
tokenizer crosses, and its count is the sum over its parts. Tokenizers that let tokens cross white space get whole texts.
Only two numbers a document leave the worker.

Defined results: a null or empty text has no bytes and no tokens; a text of any length is counted whole; rows that
repeat are counted each; an empty table gives an empty result; other columns of the input are not read, whatever their
names. A null id stays null.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import slices
from tessera.llm.wordcodec import SLICE_BYTES, by_bytes, cut, library, release_words, splits_at_space

#: Tokens beyond which a document is over the limit.
LIMIT = 2048


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens, over_limit; one row for each row of ``docs``.

    ``tokenizer`` is the path of a tokenizers ``.json`` or a sentencepiece ``.model`` file that every executor has.
    """
    dtype = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()  # what this worker remembers from packing has no use here
        counter = _counter(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, limit=SLICE_BYTES):
                texts = part.column(1).to_pylist()
                n = counter(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"doc_id {dtype.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    """texts -> token counts, for this worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        encode, safe = lambda texts: map(len, model.encode(texts, num_threads=1)), False
    else:
        tokenizer = library(path)
        encode, safe = lambda texts: map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False)), splits_at_space(path)

    def count(texts: list[str | None]) -> list[int]:
        owner, parts = [], []
        for k, t in enumerate(texts):
            for part in [t or ""] if not safe or len(t or "") < SLICE_BYTES // 4 else (x.decode() for x in cut(t.encode(), SLICE_BYTES)):
                owner.append(k)
                parts.append(part)
        out = [0] * len(texts)
        of = iter(owner)
        for some in by_bytes(parts):
            for n in encode(some):
                out[next(of)] += n
        return out

    return count
