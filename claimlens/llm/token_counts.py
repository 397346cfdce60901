"""Token counts from distinct pre-tokens.

Each task cuts its texts into blocks of a few megabytes.  A block keeps, per document, how often each
of its pre-tokens occurs, and the pre-tokens themselves once, dealt into buckets by a hash of their
text.  Buckets are brought together over all blocks, so the merges of the vocabulary run once per
distinct pre-token of the corpus; the piece counts of a block's part of a bucket go back to the block in
the order of its words and are summed with the frequencies.  No token ids are made.  A frequent
pre-token costs one entry per block, not one per occurrence.  Pre-tokens that are entries of the vocabulary
and encode to that one piece are added up at once.

The count of buckets (by default twice the session's shuffle partitions) sets how many tasks share the
corpus's vocabulary; a task forgets counted pre-tokens beyond ``remembered`` and counts them anew.

Pre-tokens are those of the tokenizers file: a special token's string in a text is one token, each text
between is normalised and split.  Texts of plain Latin characters are split by an equal pattern here,
all others by the library.

Defined results: null text counts as empty and has 0 tokens; repeated rows are counted each for
itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.llm.common import gathered, materialise, pack_ints, plain_id, ready, unpack_ints, utf8

_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The file's own pattern for lower-case text of plain characters (fixed value).
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class PreTokens:
    """Pre-tokens of a text with their frequencies, and how many special strings it holds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        byte = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        self.byte = byte | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in byte)}

    def counts(self, text: str) -> tuple[Counter, int]:
        parts = self.special.split(text)
        found = Counter()
        for part in parts:
            if _PLAIN.fullmatch(part):
                found.update(_SPLIT.findall(part.lower()))
            else:
                found.update(self._slow(part))
        return found, len(parts) - 1

    def _slow(self, text: str) -> list[str]:
        clean = self.tokenizer.normalizer.normalize_str(text)
        return [clean[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]

    def in_bytes(self, word: str) -> str:
        """A pre-token in the vocabulary's byte alphabet."""
        return word if word.isascii() and word.isprintable() else "".join(self.byte[b] for b in word.encode())

    def pieces(self, word: str) -> int:
        """Pieces of one pre-token in the byte alphabet, by the merges of the vocabulary."""
        return len(self.tokenizer.model.tokenize(word))


_SINGLE: dict[str, frozenset[str]] = {}
_LOADED: dict[str, PreTokens] = {}


def loaded(path: str) -> PreTokens:
    """The splitter of a file, read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


def single_pieces(path: str, pre: PreTokens) -> frozenset[str]:
    """Pre-tokens (in the byte alphabet) that are one piece of the vocabulary."""
    if path not in _SINGLE:
        ended = (p[:-4] for p in pre.tokenizer.get_vocab(with_added_tokens=False) if p.endswith("</w>"))
        _SINGLE[path] = frozenset(p for p in ended if p and len(pre.tokenizer.model.tokenize(p)) == 1)
    return _SINGLE[path]


def blocks(docs: DataFrame, tokenizer: str, doc_id: str, text: str, block_bytes: int, buckets: int) -> DataFrame:
    """Blocks: documents, their single-piece and special tokens (``ready``), and for the other
    pre-tokens the steps between a document's ascending word numbers, their frequencies, and the
    words by bucket."""
    own_id, kind = plain_id(docs, doc_id)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, block = loaded(tokenizer), TaskContext.get().partitionId() << 32
        single = single_pieces(tokenizer, pre)
        for part in gathered(batches, "text", block_bytes):
            offs = utf8(part.column(1))[1]
            seen: dict[str, int] = {}
            sizes, special, ids, freq = [], [], [], []
            for t in part.column(1).to_pylist():
                found, n = pre.counts(t or "")
                special.append(n)
                sizes.append(len(found))
                ids += [seen.setdefault(w, len(seen)) for w in found]
                freq += found.values()
            words = [pre.in_bytes(w) for w in seen]
            known = np.array([w in single for w in words], bool)
            bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int64)
            order = sorted(np.flatnonzero(~known).tolist(), key=lambda i: (bucket[i], words[i]))
            number = np.full(len(words), -1, np.int64)
            number[order] = np.arange(len(order))
            ids, freq, doc = np.array(ids, np.int64), np.array(freq, np.int64), np.repeat(np.arange(len(sizes)), sizes)
            at, one = number[ids], known[ids]
            ready = np.bincount(doc[one], weights=freq[one], minlength=len(sizes)).astype(np.int64) + np.array(special)
            at, freq, doc = at[~one], freq[~one], doc[~one]
            by = np.lexsort((at, doc))
            at, freq, doc = at[by], freq[by], doc[by]
            step = np.diff(at, prepend=0)
            begins = np.flatnonzero(np.diff(doc, prepend=-1))
            step[begins] = at[begins]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            parts = [zlib.compress("\n".join(words[i] for i in order[x:y]).encode(), 6) if y > x else b"" for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([part.column(0).to_pylist()], pa.list_(arrow)), pa.array([np.diff(offs)], pa.list_(pa.int64())),
                pa.array([ready], pa.list_(pa.int64())), pa.array([np.bincount(doc, minlength=len(sizes))], pa.list_(pa.int64())),
                pa.array([pack_ints(step)], pa.binary()), pa.array([pack_ints(freq)], pa.binary()), pa.array([parts], pa.list_(pa.binary()))],
                names=["block", "doc_id", "n_bytes", "ready", "sizes", "steps", "freq", "parts"])
            block += 1

    return docs.select(own_id, F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"block long, doc_id array<{kind.simpleString()}>, n_bytes array<long>, ready array<long>, sizes array<long>, steps binary, freq binary, parts array<binary>")


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20,
                 buckets: int | None = None, remembered: int = 250_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row."""
    spark = docs.sparkSession
    ready(spark)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = plain_id(docs, doc_id)[1]
    arrow = to_arrow_type(kind)
    made = materialise(blocks(docs, tokenizer, doc_id, text, block_bytes, buckets), "token-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = loaded(tokenizer), {}
        for b in batches:
            out = []
            for words in b.column(2).to_pylist():
                got = []
                for w in zlib.decompress(words).decode().split("\n"):
                    n = known.get(w)
                    if n is None:
                        if len(known) >= remembered:
                            known.clear()
                        n = known[w] = pre.pieces(w)
                    got.append(n)
                out.append(pack_ints(np.array(got)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(out, pa.binary())], names=["block", "bucket", "pieces"])

    words = made.select("block", F.posexplode("parts").alias("bucket", "words")).filter("length(words) > 0").select("bucket", "block", "words")
    counted = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "block long, bucket int, pieces binary")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [unpack_ints(x) for x in right.sort_by("bucket").column("pieces").to_pylist()]
        pieces = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int64)
        out = []
        for r in left.to_pylist():
            edge = np.r_[0, np.cumsum(r["sizes"], dtype=np.int64)]
            sums = np.cumsum(unpack_ints(r["steps"]), dtype=np.int64)
            # word numbers: sums of a document's steps
            at = sums - np.repeat(np.r_[0, sums][edge[:-1]], r["sizes"])
            n = np.r_[0, np.cumsum(pieces[at] * unpack_ints(r["freq"]))]
            out.append(pa.table({"doc_id": pa.array(r["doc_id"], arrow), "n_bytes": pa.array(r["n_bytes"], pa.int64()),
                                 "n_tokens": pa.array(n[edge[1:]] - n[edge[:-1]] + np.array(r["ready"], np.int64))}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in (("doc_id", arrow), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()))})

    return made.drop("parts").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(total, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
