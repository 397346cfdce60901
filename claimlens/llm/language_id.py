"""Language identification by unigrams of pieces, marginalised over all segmentations.

Pieces are the fixed vocabulary of a public SentencePiece model, plus every single byte; texts are cut
into words of letters and digits (lower-cased A-Z), each with the vocabulary's word mark in front.  The
probability of a word under a language is the sum over all ways to write it as pieces of the product of
the pieces' probabilities: a forward pass over the matches of a byte trie, for all distinct words of a batch at
once.  Words of any length are summed whole: every 32 bytes the states that are still reached are scaled
to a largest value of 1 and the logarithm of the scale is kept, so nothing underflows.

Training is one expectation step from equal piece probabilities: the expected count of each piece in
all segmentations of each word, weighted by how often each language has the word, summed over all
training rows.  The model is languages x vocabulary numbers, whatever the corpus.

A word is scored once per batch slice, however often it occurs.  Sums over a text plus the log share of
the language give the prediction; the score is its posterior probability.

Defined results: null text, and text without a letter, is ``und`` with score 0, as is every text when
no training row names a language; on a tie the first language by name wins; rows with a null lang or
null text teach nothing; repeated rows count each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import ALNUM, SLICE_BYTES, Words, ready, slices

#: Bytes between two scalings.
UNIT = 32
#: Offsets whose matches are remembered.
KEPT = 64
MARK = "▁".encode()
_LATIN = re.compile("[A-Za-z]")
_UNIT_BYTES = ALNUM & ~np.isin(np.arange(256), np.arange(65, 91))


class Trie:
    """Byte trie of the vocabulary's pieces: ``step[node, byte]`` and ``piece[node]`` (-1: none)."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        # units hold lower-case letters, digits and longer characters, so other pieces can never match
        fits = (p for p in pieces if _UNIT_BYTES[np.frombuffer(p, np.uint8)].all())
        pieces = sorted({*fits, *(bytes([b]) for b in range(256))})
        edges: dict[tuple[int, int], int] = {}
        piece = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for b in p:
                node = edges.setdefault((node, b), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = k
        self.step = np.zeros((len(piece), 256), np.uint16 if len(piece) < 1 << 16 else np.int32)
        for (node, b), child in edges.items():
            self.step[node, b] = child
        self.size, self.piece, self.longest = len(pieces), np.array(piece, np.int64), max(map(len, pieces))


_TRIES: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    if path not in _TRIES:
        _TRIES[path] = Trie(path)
    return _TRIES[path]


class Units:
    """Distinct words of a slice of texts, each with the word mark, and their matches with the trie.

    Units are numbered by falling length, and a state is a place in a unit: those of one offset lie side by side, in the order of
    the units.  So the units that reach an offset are the first ones, and a pass over the offsets reads and writes rows of memory."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, t: Trie):
        words = Words(data, offs, ALNUM)
        self.first, self.counts = words.first, words.counts()
        _, at, unit = np.unique(words.hashes(), return_index=True, return_inverse=True)
        order = np.argsort(words.start[at] - words.end[at], kind="stable")
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        at, self.unit = at[order], place[unit]
        start, size = words.start[at], words.end[at] - words.start[at]
        digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
        self.plain = digits[words.end[at]] == digits[words.start[at]]  # units without a digit
        low = data.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        self.length = size + len(MARK)
        self.span = int(self.length.max(initial=0))
        self.reach = np.searchsorted(-self.length, -np.arange(self.span + 2), "right")  # units of at least each length
        self.begin = np.r_[0, np.cumsum(self.reach)]  # first state of each offset
        text = np.zeros(self.begin[-1], np.uint8)  # byte that follows each state
        for i, b in enumerate(MARK[:self.span]):
            text[self.begin[i]:self.begin[i] + len(at)] = b
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[self.begin[inner + len(MARK)] + np.repeat(np.arange(len(at)), size)] = low[np.repeat(start, size) + inner]
        self.text, self.trie = text, t
        self.end = self.begin[self.length] + np.arange(len(at))
        self.long = int(self.reach[UNIT]) if self.span >= UNIT else 0  # units that are ever scaled
        self.kept = [self._match(offset) for offset in range(min(self.span, KEPT))]

    def at(self, a: np.ndarray, offset: int, units: int | None = None) -> np.ndarray:
        """The states of ``offset``, of the first ``units`` at most, in the last axis of ``a``."""
        n = self.reach[offset] if units is None else min(units, self.reach[offset])
        return a[..., self.begin[offset]:self.begin[offset] + n]

    def _match(self, offset: int) -> list[tuple[int, np.ndarray | slice, np.ndarray]]:
        """(offset after, units in rising order, piece) of all matches from ``offset`` on, by length."""
        t, out = self.trie, []
        unit, node = np.arange(self.reach[offset + 1]), np.zeros(self.reach[offset + 1], t.step.dtype)
        for d in range(t.longest):
            node = t.step[node, self.at(self.text, offset + d)[unit]]
            more = np.flatnonzero(node)
            if len(more) < len(node):
                unit, node = unit[more], node[more]
            piece = t.piece[node]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                whole = len(hit) == self.reach[offset + 1]  # every unit: no need to pick
                out.append((offset + d + 1, slice(len(hit)) if whole else unit[hit], piece[hit]))
            if offset + d + 1 >= self.span:
                break
            go = np.searchsorted(unit, self.reach[offset + d + 2])  # units that have one more byte
            unit, node = unit[:go], node[:go]
            if not go:
                break
        return out

    def matches(self, offset: int) -> list[tuple[int, np.ndarray | slice, np.ndarray]]:
        """The matches of the first offsets are remembered, those of long words found again."""
        return self.kept[offset] if offset < KEPT else self._match(offset)

    def _rescale(self, a: np.ndarray, scale: np.ndarray, offset: int) -> tuple[range, np.ndarray]:
        """Brings the states from ``offset`` on that a pass still reads to a largest value of 1; ``scale`` of their units
        takes the logarithm.  Returns the offsets and the logarithms."""
        n = int(self.reach[offset])
        read = range(offset, min(offset + self.trie.longest, self.span) + 1)
        most = np.zeros((len(a), n))
        for o in read:
            states = self.at(a, o)
            np.maximum(most[:, :states.shape[1]], states, out=most[:, :states.shape[1]])
        most = np.where(most > 0, most, 1.0)
        for o in read:
            states = self.at(a, o)
            states /= most[:, :states.shape[1]]
        scale[:, :n] += np.log(most)
        return read, np.log(most)

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum over all segmentations up to each state, and the logarithm of its scale; ``p`` is languages x pieces.  Both are languages x
        states; scales are set where a state is one of the ``long`` first units, and 0 elsewhere."""
        a, log = np.zeros((len(p), self.begin[-1])), np.zeros((len(p), self.begin[-1]))
        scale = np.zeros((len(p), len(self.length)))
        a[:, :len(self.length)] = 1.0
        for offset in range(self.span):
            if offset and offset % UNIT == 0:
                self._rescale(a, scale, offset)
            if offset >= UNIT:  # what follows is on the unit's present scale
                states = self.at(log, offset, int(self.reach[offset + 1]))
                states[:] = scale[:, :states.shape[1]]
            for after, unit, piece in self.matches(offset):
                for own, q in zip(a, p, strict=True):
                    self.at(own, after)[unit] += self.at(own, offset)[unit] * q[piece]
        log[:, self.end[:self.long]] = scale[:, :self.long]
        return a, log

    def whole(self, p: np.ndarray) -> np.ndarray:
        """Log-probability of every unit under every language; ``p`` is pieces x languages."""
        a, log = self.forward(np.ascontiguousarray(p.T))
        return (np.log(a[:, self.end]) + log[:, self.end]).T

    def expected(self, p: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(unit, piece, expected count) of matches in the segmentations of each unit, where all pieces have probability ``p``."""
        a, log_a = (x[0] for x in self.forward(np.full((1, self.trie.size), p)))
        z = np.log(a[self.end]) + log_a[self.end]
        share = p / a[self.end]
        share[:self.long] = p  # the long ones have scales
        b, log_b, scale = np.zeros((1, len(a))), np.zeros(len(a)), np.zeros((1, len(self.length)))
        b[0, self.end] = 1.0
        for offset in reversed(range(self.span)):
            if (offset + 1) % UNIT == 0:
                offsets, more = self._rescale(b, scale, offset + 1)
                for o in offsets:
                    states = self.at(log_b, o)
                    states += more[0, :len(states)]
            n = int(self.reach[offset + 1])
            scaled = min(n, self.long)
            self.at(log_b, offset, scaled)[:] = scale[0, :scaled]
            front, own = self.at(a, offset, n) * share[:n], self.at(b[0], offset)
            for after, unit, piece in self.matches(offset):
                back = self.at(b[0], after)[unit]
                count = front[unit] * back
                number = np.arange(len(piece)) if isinstance(unit, slice) else unit
                few = np.searchsorted(number, self.long)
                if few:
                    first = number[:few]
                    count[:few] *= np.exp(self.at(log_a, offset)[first] + self.at(log_b, after)[first] - z[first])
                yield number, piece, count
                own[unit] += back * p


def expected_by_language(u: Units, code: np.ndarray, languages: int) -> np.ndarray:
    """Expected counts (languages x pieces) over the texts of ``u``, of which ``code`` is the language.  The matches of an offset are added up
    before those of the next one are made."""
    spoken = np.repeat(code, u.counts)  # language of each word
    n = [np.bincount(u.unit[spoken == k], minlength=len(u.length)) for k in range(languages)]
    own = np.zeros((languages, u.trie.size))
    for unit, piece, share in u.expected(1.0 / u.trie.size):
        for k in range(languages):
            own[k] += np.bincount(piece, weights=share * n[k][unit], minlength=u.trie.size)
    return own


def learn(docs: DataFrame, vocabulary: str, lang: str, text: str, smoothing: float = 1e-3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log shares of training rows, and piece probabilities (pieces x languages)."""
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(vocabulary)
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for part, data, offs in slices(batch, "text", SLICE_BYTES // 2):
                u = Units(data, offs, t)
                langs, code = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                own = expected_by_language(u, code, len(langs))
                for k, name in enumerate(langs.tolist()):
                    sums[name] = sums.get(name, 0) + own[k]
                    rows[name] = rows.get(name, 0) + int((code == k).sum())
        for name, s in sums.items():
            on = np.flatnonzero(s)
            whole = np.r_[np.round(s[on] * 4096).astype(np.int64), rows[name]]  # whole numbers: any order of adding gives the same sum
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(on) + 1)), pa.array(np.r_[on, -1].astype(np.int32)), pa.array(whole)], names=["lang", "piece", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and text is not null")
    got = rows.mapInArrow(expect, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # languages x vocabulary at most
    langs = sorted(got.lang.unique())
    size = trie(vocabulary).size
    p, share = np.zeros((size, len(langs))), np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = got[got.lang == name]
        share[k] = own[own.piece == -1].n.sum()
        own = own[own.piece >= 0]
        p[own.piece, k] = own.n / max(1, own.n.sum())
    return langs, np.log(share / max(1, share.sum())), (1 - smoothing) * p + smoothing / size


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LATIN.search(text)) or any(map(str.isalpha, text)))


def identify(docs: DataFrame, training: DataFrame, vocabulary: str, lang: str = "lang", text: str = "text", carry: tuple[Column | str, ...] = ("doc_id",),
             language_column: str = "lang_pred", score_column: str = "score", evidence_column: str | None = None) -> DataFrame:
    """The columns in ``carry``, the predicted language and its score for every row of ``docs``; only
    ``training`` is learned from.  ``evidence_column``, if named, holds the log-probability a byte of its words
    without digits under that language (null for ``und``, and without such a word)."""
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(learn(training, vocabulary, lang, text))
    kept = docs.select(*carry)
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + f", `{language_column}` string, `{score_column}` double"
    schema += f", `{evidence_column}` double" if evidence_column else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, share, p = model.value
        for batch in batches:
            for part, data, offs in slices(batch, "__text", SLICE_BYTES // 2):
                texts = part.column(part.num_columns - 1).to_pylist()
                names, score, evidence = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
                known = np.array([has_letter(t) for t in texts])
                if len(langs) and known.any():
                    u = Units(data, offs, trie(vocabulary))
                    unit = u.whole(p)
                    sums = np.vstack([np.zeros((1, len(langs))), np.cumsum(unit[u.unit], axis=0)])
                    total = sums[u.first[1:]] - sums[u.first[:-1]] + share
                    best = total.argmax(1)
                    posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known, posterior, 0.0)
                    if evidence_column:
                        doc, plain = np.repeat(np.arange(len(texts)), u.counts), u.plain[u.unit]
                        sums = np.bincount(doc, weights=unit[u.unit, best[doc]] * plain, minlength=len(texts))
                        size = np.bincount(doc, weights=u.length[u.unit] * plain, minlength=len(texts))
                        evidence = np.where(known & (size > 0), sums / np.maximum(size, 1), np.nan)
                more = [(evidence_column, pa.array(evidence, pa.float64(), from_pandas=True))] if evidence_column else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()), *(c for _, c in more)],
                                                 names=[*part.schema.names[:-1], language_column, score_column, *(n for n, _ in more)])

    return docs.select(*carry, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
