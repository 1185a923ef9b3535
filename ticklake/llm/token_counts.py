"""Token counts of whole texts; huge ones by overlapping chunks that are spliced."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, utf8_size

CHUNK, OVERLAP = 16_384, 128  # characters


def stable(text: str, at: int) -> bool:
    """Whether every encoding of a text around ``at`` cuts there: a blank after what is no white space."""
    return 0 < at < len(text) and text[at] in " \n\t\r" and not text[at - 1].isspace()


def spliced_count(whole, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` under the library's tokenizer ``whole``, without encoding it in one go.

    Chunks that overlap are encoded with offsets.  In an overlap the two
    encodings are spliced at a place where both begin a token and where the text
    is stable, so what stands left and right cannot change the other side's
    tokens.  If an overlap holds no such place it is widened, doubling, up to the rest
    of the text.
    """
    total = at = 0  # tokens of text[:at] are counted
    while True:
        end = at + chunk
        if end >= len(text):
            return total + len(whole.encode(text[at:], add_special_tokens=False))
        wide = overlap
        while True:
            left = whole.encode(text[at : end + wide], add_special_tokens=False).offsets
            right = {end - wide + a for a, _ in whole.encode(text[max(end - wide, at) : end + wide], add_special_tokens=False).offsets} if end - wide > at else set()
            # a place both begin a token at, not so near the ends that the cut itself shows
            place = next((k for k in range(len(left) - 1, 0, -1) if at + left[k][0] in right and left[k][0] < end + wide - at and stable(text, at + left[k][0])), None)
            if place is not None:
                total, at = total + place, at + left[place][0]
                break
            wide *= 2
            if end - wide <= at:
                end += chunk
            if end + wide >= len(text):
                return total + len(whole.encode(text[at:], add_special_tokens=False))


def token_counts(docs: DataFrame, *, file: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    Texts over ``chunk`` characters go through :func:`spliced_count`; a shorter
    one is a single chunk, whose stretches between proven boundaries are counted from
    a table of frequent ones.  Both give the library's count of the whole text.

    Null text counts as empty (0 tokens); a null doc_id is kept; repeated rows count
    each; other columns are not read; an empty table gives an empty result.
    """
    file = file or tokens.path(tokens.BYTE_BPE)

    def make():
        counter = tokens.piece_counter(file)

        def count(text: str | None) -> int:
            if not text:
                return 0
            return counter.count(text) if len(text) <= chunk else spliced_count(counter.whole, text, chunk, overlap)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [count(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return fn

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), utf8_size("text").alias("n_bytes"))
    return arrow_map(rows, make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
