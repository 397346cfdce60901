"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model with interpolated absolute discounting over an add-half unigram model:
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and, for a history h of the training rows,
P(w | h) = (c(hw) - D) / c(h) + back(h) P(w), where back(h) = 1 - sum of the kept (c(hw) - D) / c(h).
As an automaton: the root state reads any token; every training word is a state, its arcs are its kept
bigrams, and its failure arc leads to the root with weight back(h).  A text is read once from left to
right, carrying the state (the last word, or the root); an arc that is missing is replaced by the failure
arc and the root's arc, and log10 probabilities add up.

Every word may be a history and a bigram is kept from ``min_count`` occurrences on, whatever the size of
the corpus; unigram counts cover every word.  The model is never in one place.

Texts are held as blocks of a few megabytes: word numbers per document, and the block's distinct words
once.  Words and bigrams go by 64-bit key: a block sends its sorted keys with their counts, packed, to
the buckets of key ranges, a bucket adds up and answers each block with the sums in the order of
its keys (``_sums``).  Back-off weights go the same way: the first block that holds a kept bigram adds it to
the mass of its history, and the masses are summed by word.

Defined results: null text is empty and has the one token ``end``; a null doc_id falls in the fold of
the empty text; repeated rows count and are scored each for itself; with no training rows every
probability is that of one unknown word; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimlens.llm.common import BLANK_SEPARATED, Words, gathered, gram_hashes, materialise, pack_ints, pack_longs, plain_id, ready, slices, unpack_ints, unpack_longs

END = np.uint64(0x656E640000000001)
RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def blocks(docs: DataFrame, held_out: Column, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """Blocks of documents as word numbers, with the words' hashes and their counts in training rows."""
    own_id, kind = plain_id(docs, doc_id)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in gathered(batches, "text", block_bytes):
            if part.num_rows:
                texts = [Words(data, offs, BLANK_SEPARATED) for _, data, offs in slices(part, "text")]
                h = np.concatenate([np.insert(w.hashes(), w.first[1:], END) for w in texts])
                sizes = np.concatenate([w.counts() + 1 for w in texts])
                values, at, n = np.unique(h, return_inverse=True, return_counts=True)
                by = np.argsort(-n, kind="stable")  # frequent words get small numbers
                number = np.empty(len(by), np.int64)
                number[by] = np.arange(len(by))
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                train = np.bincount(number[at[np.repeat(~held, sizes)]], minlength=len(by))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([part.column(0).to_pylist()], pa.list_(arrow)), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), pa.array([pack_ints(number[at])], pa.binary()),
                    pa.array([values[by].view(np.int64)], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.int64())), pa.array([int(train.sum())])],
                    names=["block", "doc_id", "held_out", "sizes", "tokens", "words", "counts", "trained"])
                block += 1

    return docs.select(own_id, F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"block long, doc_id array<{kind.simpleString()}>, held_out array<boolean>, sizes array<int>, tokens binary, words array<long>, counts array<long>, trained long")


def _pairs(sizes: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that follow another token of the same document, and the key of the bigram ending there."""
    begins = np.zeros(len(tokens), bool)
    begins[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    at = np.flatnonzero(~begins[1:]) + 1
    return at, gram_hashes(words.view(np.uint64)[tokens], 2)[at - 1]


def _requests(block: int, kind: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[dict]:
    """A block's sorted keys and their numbers (one row a number), cut at the borders of the key ranges."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(keys)] if len(keys) else [0]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield {"block": block, "kind": kind, "bucket": int(bucket[i]), "keys": pack_longs(keys[i:j]), "n": pack_longs(n[..., i:j].ravel())}


def _sums(requests: DataFrame, least: dict[int, int], tag: str) -> DataFrame:
    """The sums of every number over all blocks, as one answer a request, in the order of its keys.  An
    answer holds 2 sum + 1 in the first block of a key and 2 sum in the others, 0 where the
    first number's sum is below ``least`` of its kind; ``fresh`` counts the keys that it is the first block of."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").select(["block", "keys", "n"])
        keys = [unpack_longs(x.as_py()) for x in rows.column("keys")]
        n = np.concatenate([unpack_longs(x.as_py()).reshape(-1, len(k)) for x, k in zip(rows.column("n"), keys, strict=True)], axis=1)
        _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = np.array([np.bincount(inverse, x) for x in n.astype(np.float64)]).astype(np.uint64)
        sums[:, sums[0] < np.uint64(least[key[0].as_py()])] = 0
        out = sums[:, inverse] * np.uint64(2)
        out[:, first] += (sums[0] > 0).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        parts = [out[:, j - len(k):j] for k, j in zip(keys, ends, strict=True)]
        return pa.table({"block": rows.column("block"), "kind": pa.array(np.full(len(parts), key[0].as_py(), np.int32)), "bucket": pa.array(np.full(len(parts), key[1].as_py())),
                         "sums": pa.array([pack_longs(x.ravel()) for x in parts], pa.binary()), "fresh": pa.array([int((x[0] % 2).sum()) for x in parts], pa.int64())})

    return materialise(requests.groupBy("kind", "bucket").applyInArrow(add, "block long, kind int, bucket long, sums binary, fresh long"), tag)


def _answers(table: pa.Table, kind: int, numbers: int = 1) -> np.ndarray:
    """The answers of one kind in the order of the block's sorted keys."""
    own = sorted((r["bucket"], r["sums"]) for r in table.select(["kind", "bucket", "sums"]).to_pylist() if r["kind"] == kind)
    return np.concatenate([np.zeros((numbers, 0), np.uint64), *(unpack_longs(x).reshape(numbers, -1) for _, x in own)], axis=1)


WORD, BIGRAM, MASS = 0, 1, 2
REQUEST = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
                min_count: int = 2, discount: float = 0.5, block_bytes: int = 8 << 20, bucket_tokens: int = 2_000_000) -> DataFrame:
    """Score every row under the model learned from the rows that are not ``held_out``."""
    spark = docs.sparkSession
    ready(spark)
    made = materialise(blocks(docs, held_out, doc_id, text, block_bytes), "lm-blocks")
    facts = made.agg(F.sum("trained").alias("trained"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    total, buckets = facts["trained"] or 0, -(-(facts["tokens"] or 1) // bucket_tokens)  # a bucket's keys do not follow the input

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a block at a time, its words as an array
                sizes, words, held, counts = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "words", "held_out", "counts"))
                block, tokens, by = b.column("block")[i].as_py(), unpack_ints(b.column("tokens")[i].as_py()), np.argsort(words.view(np.uint64))
                at, key = _pairs(sizes, tokens, words)
                keys, inverse = np.unique(key, return_inverse=True)
                n = np.bincount(inverse[np.repeat(~held.astype(bool), sizes)[at]], minlength=len(keys))
                for kind, k, c in ((WORD, words.view(np.uint64)[by], counts[by]), (BIGRAM, keys, n)):
                    yield pa.RecordBatch.from_pylist(list(_requests(block, kind, k, c, buckets)), schema=REQUEST)

    schema = "block long, kind int, bucket long, keys binary, n binary"
    counted = _sums(made.select("block", "sizes", "tokens", "words", "held_out", "counts").mapInArrow(ask, schema), {WORD: 1, BIGRAM: min_count}, "lm-counts")
    vocabulary = counted.filter(F.col("kind") == WORD).agg(F.sum("fresh")).first()[0] or 0

    def masses(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in left.to_batches():
            for i in range(b.num_rows):
                sizes, words = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "words"))
                tokens, by = unpack_ints(b.column("tokens")[i].as_py()), np.argsort(words.view(np.uint64))
                at, key = _pairs(sizes, tokens, words)
                _, first = np.unique(key, return_index=True)
                c = _answers(right, BIGRAM)[0]
                own = c % 2 == 1
                history = tokens[at[first[own]] - 1]
                n = np.array([np.bincount(history, minlength=len(words)), np.bincount(history, c[own] // 2, len(words)).astype(np.int64)])
                out += _requests(b.column("block")[i].as_py(), MASS, words.view(np.uint64)[by], n[:, by], buckets)
        return pa.Table.from_pylist(out, schema=REQUEST)

    arcs = made.select("block", "sizes", "tokens", "words").groupBy("block").cogroup(counted.filter(F.col("kind") == BIGRAM).groupBy("block"))
    weighed = _sums(arcs.applyInArrow(masses, schema), {MASS: 1}, "lm-masses")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in left.to_batches():
            for i in range(b.num_rows):
                sizes, words = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "words"))
                tokens, by = unpack_ints(b.column("tokens")[i].as_py()), np.argsort(words.view(np.uint64))
                counts, back = np.empty(len(words)), np.ones(len(words))
                counts[by] = _answers(right, WORD)[0] // 2
                n, c = _answers(right, MASS, 2) // 2
                mass = np.empty(len(words))
                mass[by] = c - discount * n
                np.subtract(1, np.divide(mass, counts, out=np.zeros(len(words)), where=counts > 0), out=back)
                out.append(read(sizes, tokens, words, counts, back, _answers(right, BIGRAM)[0] // 2, total, vocabulary, discount)
                           .append_column("doc_id", b.column("doc_id")[i].values).append_column("held_out", b.column("held_out")[i].values))
        names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
        return pa.concat_tables(out).select(names) if out else pa.table({c: [] for c in names})

    answers = counted.drop("fresh").unionByName(weighed.drop("fresh"))
    return made.select("block", "doc_id", "held_out", "sizes", "tokens", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {plain_id(docs, doc_id)[1].simpleString()}, {RESULT}")


def read(sizes: np.ndarray, tokens: np.ndarray, words: np.ndarray, counts: np.ndarray, back: np.ndarray, arc_count: np.ndarray, total: int, vocabulary: int, discount: float) -> pa.Table:
    """The automaton's reading of a block's documents, all positions at once: the state before a token
    is the token before it in the document.  ``arc_count`` has the block's bigrams in key order, 0 for one not kept."""
    unigram = (counts + 0.5) / (total + 0.5 * (vocabulary + 1))
    p = unigram[tokens]
    base = np.log10(p)
    at, key = _pairs(sizes, tokens, words)
    state = tokens[at - 1]
    p[at] *= back[state]  # the failure arc; 1 where the word is no state
    c = arc_count.astype(np.float64)[np.unique(key, return_inverse=True)[1]]
    arc = c > 0
    p[at[arc]] += (c[arc] - discount) / counts[state[arc]]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    add = lambda x: np.add.reduceat(x, starts)
    return pa.table({"n_tokens": sizes.astype(np.int64), "n_known": add((counts[tokens] > 0).astype(np.int64)), "train_tokens": np.full(len(sizes), total, np.int64),
                     "base_score": add(base), "score": add(np.log10(p))})
