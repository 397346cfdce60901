"""Personal data: patterns for direct identifiers, and corpus statistics for the words that give them away.

E-mail addresses, IP addresses, card and phone numbers are found by patterns (the base spans); each
value is a protected entity.  Further words may reveal an entity though they are no identifiers: a name that only occurs beside
one address.  How much a term t discloses of an entity c is read from the corpus:

    IC(c) = -log2 p(c)            p(c): share of the corpus' words that stand near c
    PMI(t; c) = log2 p(c | t) / p(c)    p(c | t): share of the occurrences of t that stand near c

Near means among the ten words before or after an occurrence of c, words inside base spans left out.  A term discloses
c if PMI(t; c) >= IC(c) - 1 bit (that is, half of its occurrences stand near c) and PMI(t; c) >= IC(c) / 2 (so that words near
an entity found everywhere don't count), on the evidence of three different contexts or more.  Copies are no evidence: equal contexts count
once, and the contexts of an entity of which more than a quarter of the terms pass the two bounds repeat one passage
and count as one together.  A term that occurs nowhere else (PMI = IC) is removed, other disclosing terms are
generalised to their class, wherever they stand.

Plan: one pass finds entities and their contexts (texts without any give no rows); contexts are grouped with partial
sums, so a hot entity or a group of copies is folded before the shuffle; terms near an entity are counted over the corpus in a
second pass whose per-task counts meet the candidates in a semi join; a last pass marks the spans.  Disclosing terms are sent
to the tasks when a count proves them few, otherwise joined to the texts' words by shuffle.

Defined results: null text is empty, without spans (its clean text stays null); rows are independent of ids, so null
and repeated ids are nothing special; texts are read whole, in slices; columns of other names pass through; a table without
entities gives base results only, an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import ALNUM, SLICE_BYTES, Words, by_ids, gathered, materialise, ready, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# only the first digit of a run can begin a match, so the look-behind changes no result but keeps long runs linear
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")

#: Words on either side of an entity that make its context.
REACH = 10
#: Different contexts that a disclosing term needs.
SUPPORT = 3
#: Bits of an entity's information content that a disclosing term may leave open.
OPEN_BITS = 1.0
#: Share of disclosing terms from which on contexts of an entity are taken for one passage.
PASSAGE = 0.25
#: Most disclosing terms that are sent to the tasks (8 bytes each).
BROADCAST_TERMS = 1_000_000


# ---------------------------------------------------------------- base spans

def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @ signs outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if local else None
        if m:
            out.append((at - local, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> int:
    """64-bit key of a protected value: addresses in lower case, numbers by their digits."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else NO_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


# ---------------------------------------------------------------- words of a text

class Terms:
    """Words of a slice of texts with their hashes, and code point places where they are asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words, self.data = Words(data, offs, ALNUM), data
        self.hashes = self.words.hashes().view(np.int64)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (code points of text i) and hashes of the words of text i."""
        w = self.words
        a, b = w.first[i], w.first[i + 1]
        begin, end = w.offs[i], w.offs[i + 1]
        point = np.concatenate([[0], np.cumsum((self.data[begin:end] & 0xC0) != 0x80)])
        return point[w.start[a:b] - begin], point[w.end[a:b] - begin], self.hashes[a:b]


def contexts(spans: list[tuple[str, int, int]], text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[dict]:
    """Contexts of a text's entities: the terms near each occurrence, every place once an entity."""
    edges = sorted((a, b) for _, a, b in spans)
    inside = np.zeros(len(starts), bool)
    for a, b in edges:
        inside[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = True
    free = np.flatnonzero(~inside)
    starts, ends, hashes = starts[free], ends[free], hashes[free]
    out, done = [], {}
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        who = entity(kind, text[a:b])
        seen = done.setdefault(who, set())
        places = [p for p in (*range(max(0, i - REACH), i), *range(j, min(len(starts), j + REACH))) if p not in seen]
        seen.update(places)
        if places:
            near = hashes[places]
            mark = int.from_bytes(hashlib.blake2b(near.tobytes(), digest_size=8).digest(), "little", signed=True)
            terms, n = np.unique(near, return_counts=True)
            out.append({"entity": who, "context": mark, "terms": terms.tolist(), "counts": n.tolist()})
    return out


_CONTEXT = T.StructType([T.StructField("entity", T.LongType()), T.StructField("context", T.LongType()),
                         T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
_ARROW_CONTEXT = pa.schema([("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _scan(text: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offs in slices(b, text):
                found, terms = [], None
                for i, value in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    spans = base_spans(value) if value else []
                    if spans:
                        terms = terms or Terms(data, offs)
                        found += contexts(spans, value, *terms.row(i))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_ARROW_CONTEXT)
    return fn


def _count(text: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, text, 16 * SLICE_BYTES):
            held = [Terms(data, offs).hashes for _, data, offs in slices(b, text)]
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], names=["term", "n"])
    return fn


# ---------------------------------------------------------------- disclosing terms

def disclosing_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Terms (hash) that disclose a protected entity, as a written table (term, removed)."""
    found = docs.select(text).mapInArrow(_scan(text), _CONTEXT).groupBy("entity", "context").agg(
        F.count("*").alias("n"), F.first("terms").alias("terms"), F.first("counts").alias("counts"))
    found = materialise(found, "privacy-contexts")
    near = found.select("entity", "context", "n", F.explode(F.arrays_zip("terms", "counts")).alias("t")) \
        .select("entity", "context", F.col("t.terms").alias("term"), (F.col("n") * F.col("t.counts")).alias("n"))
    likely = near.groupBy("entity", "term").agg(F.sum("n").alias("near"), F.count("*").alias("contexts")).filter(F.col("contexts") >= SUPPORT)
    likely = materialise(likely.drop("contexts"), "privacy-candidates")
    counts = materialise(docs.select(text).mapInArrow(_count(text), "term long, n long"), "privacy-words")
    total = by_ids(counts, materialise(likely.select("term").distinct(), "privacy-terms"), "term", "left_semi") \
        .groupBy("term").agg(F.sum("n").alias("total"))
    reach = near.groupBy("entity").agg(F.sum("n").alias("reach"))
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    number = lambda c: F.col(c).cast("double")
    strong = likely.join(total, "term").join(reach, "entity").crossJoin(F.broadcast(words)) \
        .filter(number("near") * 2.0 ** OPEN_BITS >= number("total")) \
        .filter(number("near") * number("near") * number("words") >= number("total") * number("total") * number("reach"))
    strong = materialise(strong.select("entity", "term", (F.col("near") >= F.col("total")).alias("removed")), "privacy-strong")
    sizes = found.select("entity", "context", F.size("terms").alias("size"))
    hits = near.join(strong, ["entity", "term"]).select("entity", "context", "term", "removed")
    shares = hits.groupBy("entity", "context").agg(F.count("*").alias("strong")).join(sizes, ["entity", "context"])
    passages = shares.select("entity", "context", (F.col("strong") > PASSAGE * F.col("size")).alias("passage"))
    # the contexts of one passage count as one
    proof = hits.join(passages, ["entity", "context"]).groupBy("entity", "term", "removed").agg(
        (F.count_if(~F.col("passage")) + F.max(F.col("passage").cast("int"))).alias("contexts")).filter(F.col("contexts") >= SUPPORT)
    return materialise(proof.groupBy("term").agg(F.max("removed").alias("removed")), "privacy-disclosing")


# ---------------------------------------------------------------- marking and cleaning

def word_class(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def cleaned(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with identifiers replaced by their kind (overlapping ones by the first), and disclosing terms
    removed or replaced by their class."""
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in spans] + [(a, b, "" if gone else word_class(text[a:b])) for a, b, gone in terms]
    out, free = [], 0
    for a, b, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if a >= free:
            out += [text[free:a], mark]
        free = max(free, b)
    return "".join([*out, text[free:]])


def _result(value: str | None, spans: list, terms: list[tuple[int, int, bool]]) -> dict:
    n = Counter(k for k, *_ in spans)
    return {**{f"n_{k}": n[k] for k in KINDS}, "n_term": len(terms), "base": listed(spans),
            "spans": listed([*spans, *(("term", a, b) for a, b, _ in terms)]), "clean_text": None if value is None else cleaned(value, spans, terms)}


RESULT = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "term")), T.StructField("base", T.StringType()),
                       T.StructField("spans", T.StringType()), T.StructField("clean_text", T.StringType())])
_ARROW_RESULT = pa.struct([*((f"n_{k}", pa.int64()) for k in (*KINDS, "term")), ("base", pa.string()), ("spans", pa.string()), ("clean_text", pa.string())])


def _mark(text: str, result: str, known, own: str | None = None):
    """Adds the result struct.  ``known`` is a broadcast (sorted terms, removed), or the column ``own`` holds a row's own."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, removed = known.value if known is not None else (np.zeros(0, np.int64), np.zeros(0, bool))
        for b in batches:
            for part, data, offs in slices(b, text):
                terms = Terms(data, offs) if own or len(hashes) else None
                values = part.column(part.schema.get_field_index(text)).to_pylist()
                listed_terms = part.column(part.schema.get_field_index(own)).to_pylist() if own else None
                out = []
                for i, value in enumerate(values):
                    spans, hits = base_spans(value) if value else [], []
                    if own:
                        mine = sorted((t["term"], t["removed"]) for t in listed_terms[i] or [])
                        hashes, removed = np.array([t for t, _ in mine], np.int64), np.array([r for _, r in mine], bool)
                    if value and len(hashes):
                        a, z = terms.words.first[i], terms.words.first[i + 1]
                        at = np.minimum(np.searchsorted(hashes, terms.hashes[a:z]), len(hashes) - 1)
                        same = np.flatnonzero(hashes[at] == terms.hashes[a:z])
                        if len(same):
                            starts, ends, _ = terms.row(i)
                            hits = [(int(starts[j]), int(ends[j]), bool(removed[at[j]])) for j in same
                                    if not any(s < ends[j] and starts[j] < e for _, s, e in spans)]
                    out.append(_result(value, spans, hits))
                columns = [c for c, f in zip(part.columns, part.schema, strict=True) if f.name != own]
                names = [n for n in part.schema.names if n != own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _ARROW_RESULT)], names=[*names, result])
    return fn


def _own_terms(text: str, key: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offs in slices(b, text):
                t, keys = Terms(data, offs), part.column(part.schema.get_field_index(key)).to_numpy()
                row = np.repeat(np.arange(part.num_rows), t.words.counts())
                pairs = np.unique(np.stack([row, t.hashes]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[pairs[0]]), pa.array(pairs[1])], names=["key", "term"])
    return fn


def sanitise(docs: DataFrame, text: str = "text", result: str = "privacy", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``docs`` with a struct ``result``: counts by kind, the base spans and all spans as lists of
    ``kind:start:end`` (code points, end exclusive), and the clean text."""
    spark = docs.sparkSession
    ready(spark)
    terms = disclosing_terms(docs, text)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, RESULT)])
    if terms.count() <= broadcast_terms:
        rows = terms.toArrow().sort_by("term")  # at most ``broadcast_terms`` rows
        known = spark.sparkContext.broadcast((rows.column("term").to_numpy(), rows.column("removed").to_numpy(zero_copy_only=False)))
        return docs.mapInArrow(_mark(text, result, known), schema)
    keyed = materialise(docs.withColumn("__key", F.monotonically_increasing_id()), "privacy-keyed")
    words = keyed.select("__key", text).mapInArrow(_own_terms(text, "__key"), "key long, term long").join(terms, "term")
    own = words.groupBy("key").agg(F.collect_list(F.struct("term", "removed")).alias("__terms"))
    joined = keyed.join(own, F.col("__key") == F.col("key"), "left").select(*docs.columns, "__terms")
    return joined.mapInArrow(_mark(text, result, None, "__terms"), schema)
