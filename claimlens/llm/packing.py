"""Best-fit packing of token sequences in bulk-synchronous steps.

Documents are cut into pieces of at most ``capacity`` tokens (only longer ones are cut; the first
piece takes the remainder) and range-sorted by length; every piece has its rank among the pieces of
its length.  Gaps, the free ends of open sequences, are kept sorted by size as ranges of sequence
numbers with one fill level.  A step takes all pieces of one length, longest first, and sweeps the
gaps upwards from the smallest that holds such a piece: the piece of rank r takes the r-th place
found, so no two want the same gap.  What finds no gap opens new sequences.  The gaps that were used
move to their new size, and the next length follows.  This is best-fit-decreasing: a used gap that
still holds a piece of the length is the tightest for the next piece.

Lengths and gap sizes are at most ``capacity``, so the steps work on a table bounded by that square
whatever the number of documents; the pieces themselves are ranked, matched to their range by rank
and placed in the tasks, over all partitions.

Defined results: null text counts as empty; every document ends with token ``end_id`` and so has a
token at least; repeated rows are packed each for itself; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.llm.common import materialise, plain_id, range_ranks, ready, slices

#: Texts of these characters only are cut into words alike by both tokenizer libraries, whatever their Unicode version.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")


class Encoder:
    """Token ids of the byte-level BPE in a tokenizers file, without added tokens at the ends.

    Plain texts go through tiktoken with the ranks and the word pattern of the same file (five times
    as fast); any other text, and one that contains a special token's string, through tokenizers."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        raw = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        raw |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(raw.values()))}
        ranks = {bytes(raw[c] for c in piece): i for piece, i in self.slow.get_vocab(with_added_tokens=False).items() if piece not in self.special}
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, read once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    own_id, kind = plain_id(docs, doc_id)
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                rows, ids = [], []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = np.array([*encode(t or ""), end_id], "<u4")
                    at = 0
                    for k in range(-(-len(tokens) // capacity)):
                        n = (len(tokens) - 1) % capacity + 1 if k == 0 else capacity
                        own = tokens[at:at + n]
                        rows.append((doc, k, at, n, zlib.crc32(own.tobytes())))
                        ids.append(own.astype(np.int32))
                        at += n
                doc, k, at, n, crc = zip(*rows, strict=True)
                cols = [pa.array(doc, arrow), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(own_id, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


Range = tuple[int, int]  # first sequence, number of sequences


def best_fit_steps(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, fill before, pieces in each sequence) that place all
    pieces; a run ends where the next of its length begins, the first rank of which follows."""
    gaps: dict[int, list[Range]] = {}
    order: list[int] = []
    runs, opened = [], 0

    def add(size: int, r: Range) -> None:
        if size:
            if size not in gaps:
                bisect.insort(order, size)
                gaps[size] = []
            gaps[size].append(r)

    for length in sorted(lengths, reverse=True):
        left, rank, used = lengths[length], 0, []
        at = bisect.bisect_left(order, length)
        while left and at < len(order):
            size = order[at]
            each = size // length
            while left and gaps[size]:
                seq, n = gaps[size].pop()
                take = min(n, left // each)
                if take:
                    runs.append((length, rank, seq, capacity - size, each))
                    used.append((size - each * length, (seq, take)))
                    rank, left = rank + take * each, left - take * each
                if take < n and left and left < each:
                    runs.append((length, rank, seq + take, capacity - size, left))
                    used.append((size - left * length, (seq + take, 1)))
                    rank, left, take = rank + left, 0, take + 1
                if take < n:
                    gaps[size].append((seq + take, n - take))
            if not gaps[size]:
                del gaps[size]
                del order[at]
        each = capacity // length
        for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                runs.append((length, rank, opened, 0, k))
                used.append((capacity - k * length, (opened, n)))
                rank, opened = rank + n * k, opened + n
        for size, r in used:
            add(size, r)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset in that sequence."""
    spark = docs.sparkSession
    ready(spark)
    pieces = materialise(cut(docs, tokenizer, capacity, end_id, doc_id, text, with_ids), "pack-pieces")
    ranked, sizes = range_ranks(pieces, "length", ["doc_id", "piece", "ids_crc32"], "pack-ranks")
    runs = best_fit_steps({r["length"]: r["n"] for r in sizes.collect()}, capacity)
    runs.sort()
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = table.value
        firsts = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                row[own] = firsts[n] + np.searchsorted(plan[firsts[n]:firsts[n + 1], 1], rank[own], "right") - 1
            _, low, seq, fill, each = plan[row].T
            keep = [i for i, c in enumerate(b.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(seq + (rank - low) // each), pa.array(fill + (rank - low) % each * length)],
                                             names=[*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, of pieces packed with ``with_ids``; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
