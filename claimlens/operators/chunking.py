"""Document chunkers.

Both chunkers are a sequential loop over one document, so they run as small
per-row Python helpers inside an Arrow-batched ``pandas_udf``; Spark partitions
the documents and every document is chunked whole.  ``chunk_table`` explodes
the chunk arrays with their ordinal (``posexplode``) into the chunk table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import ship_package, small_batches

SENTENCE_END = ".!?"
RECURSIVE_SEPARATORS = ["\n\n", "\n", " ", ""]


def sentence_spans(text: str, size: int = 1000, overlap: int = 200, reach: int = 100) -> Iterator[tuple[int, int]]:
    """Positions of the windows of G2.  A window covers ``size`` characters; one that ends inside the
    text is cut behind the last sentence end among its final ``reach`` characters (the character
    at its end included).  Each window begins ``overlap`` characters before the end of the last."""
    begin, length = 0, len(text)
    while begin < length:
        limit = begin + size
        if limit < length:
            floor = max(begin, limit - reach) + 1
            found = max(text.rfind(mark, floor, limit + 1) for mark in SENTENCE_END)
            limit = found + 1 if found >= 0 else limit
        yield begin, limit
        begin = limit - overlap


def split_sentences(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """The stripped, non-empty windows of ``sentence_spans``; a text within ``size`` is one chunk."""
    if text is None:
        return None
    if len(text) <= size:
        return [text]
    return [chunk for a, b in sentence_spans(text, size, overlap) if (chunk := text[a:b].strip())]


def _filled(cuts: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Longest windows of at most ``size`` characters between sorted cut positions that lie less than
    ``size`` apart.  The next window starts at the first cut within ``overlap`` characters of the last end
    from which the following piece still fits."""
    left, last = 0, len(cuts) - 1
    while True:
        right = bisect_right(cuts, cuts[left] + size, left) - 1
        yield cuts[left], cuts[right]
        if right == last:
            return
        left = bisect_left(cuts, max(cuts[right] - overlap, cuts[right + 1] - size), left, right)


def recursive_spans(text: str, begin: int, end: int, size: int, overlap: int, separators: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Positions of the chunks of G1 in ``text[begin:end]``.  The text is cut before every occurrence of
    the first separator that occurs in it (the empty one cuts everywhere); runs of pieces shorter than
    ``size`` fill windows, a longer piece is cut by the separators that follow."""
    level = next((i for i, s in enumerate(separators) if text.find(s, begin, end) >= 0), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1:]
    if not sep and size > 1:
        yield from _filled(range(begin, end + 1), size, overlap)
        return
    inner = (m.start() for m in re.compile(re.escape(sep)).finditer(text, begin, end))
    cuts = sorted({begin, end, *inner})
    long = [i for i in range(len(cuts) - 1) if cuts[i + 1] - cuts[i] >= size]
    run = 0
    for i in [*long, len(cuts) - 1]:
        if i > run:
            yield from _filled(cuts[run:i + 1], size, overlap)
        if i < len(cuts) - 1:
            piece = cuts[i], cuts[i + 1]
            yield from recursive_spans(text, *piece, size, overlap, finer) if finer else [piece]
        run = i + 1


def split_recursive(text: str, size: int = 1000, overlap: int = 200,
                    separators: list[str] | None = None) -> list[str]:
    """G1: the stripped, non-empty chunks of ``recursive_spans``."""
    if text is None:
        return None
    seps = RECURSIVE_SEPARATORS if separators is None else separators
    return [chunk for a, b in recursive_spans(text, 0, len(text), size, overlap, seps) if (chunk := text[a:b].strip())]


def sentence_chunks(text: str | Column, size: int = 1000, overlap: int = 200) -> Column:
    ship_package()
    small_batches()

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_sentences(x, size, overlap))
    return _udf(F.col(text) if isinstance(text, str) else text)


def recursive_chunks(text: str | Column, size: int = 1000, overlap: int = 200) -> Column:
    ship_package()
    small_batches()

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_recursive(x, size, overlap))
    return _udf(F.col(text) if isinstance(text, str) else text)


def chunk_table(docs: DataFrame, id_col: str, text: str, method: str = "sentence",
                size: int = 1000, overlap: int = 200, keep: list[str] | None = None) -> DataFrame:
    """Chunk table ``(id, *keep, chunk_id, chunk_size, chunk_uid, text)``; ``chunk_uid`` = ``id:chunk_id``."""
    fn = sentence_chunks if method == "sentence" else recursive_chunks
    keep = keep or []
    if method == "sentence":
        # a text no longer than one chunk is its own single chunk: only longer texts reach Python
        t = F.col(text)
        short = docs.where(F.length(t) <= size).select(id_col, *keep, F.array(t).alias("_chunks"))
        long_ = docs.where(~(F.length(t) <= size) | t.isNull()).select(id_col, *keep, fn(text, size, overlap)
                                                                        .alias("_chunks"))
        arr = short.unionByName(long_)
    else:
        arr = docs.select(id_col, *keep, fn(text, size, overlap).alias("_chunks"))
    ex = arr.select(id_col, *keep, F.posexplode("_chunks").alias("chunk_id", "text"))
    return ex.select(id_col, *keep, "chunk_id", F.length("text").alias("chunk_size"),
                     F.concat_ws(":", F.col(id_col).cast("string"), F.col("chunk_id").cast("string")).alias("chunk_uid"),
                     "text")


def processed_documents(docs: DataFrame, text: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Each document with its chunk array, tags and original content."""
    return docs.select(*[c for c in docs.columns if c != text],
                       sentence_chunks(text, size, overlap).alias("chunks"), F.col(text).alias("original_content"))
