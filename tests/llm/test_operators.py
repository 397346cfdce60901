"""Training-data operators on a small table with nulls, empty and long texts, repeated rows and
clashing column names, against brute-force versions."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimlens.llm import chat, decontaminate, language_id, language_model, near_duplicates, packing, quality, sharding, token_counts, toxicity
from claimlens.llm.common import fold, utf8

WORDS = "the of and river stone lamp winter glass forest signal paper morning harbor engine quiet copper".split()
RNG = np.random.default_rng(5)
BENCH = [(0, " ".join(f"item{i}" for i in range(30))), (1, "short bench text"), (2, None), (3, ""), (1, "short bench text")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, contamination string, score string, shard string"


def sentence(n):
    return " ".join(RNG.choice(WORDS, n))


def make_docs():
    base = sentence(80)
    near = base.split()
    near[40] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t", "one", "a b c d", "A B C D", sentence(3000), "x" * 5000,
             sentence(20) + " " + " ".join(f"ITEM{i}" for i in range(5, 25)) + " " + sentence(10), "Short, bench; text!", "short bench words",
             "<|endoftext|> <|startoftext|> it's 42 ÄÖ ß ǅ é 日本語 ½", "repeat me now please ok " * 12, sentence(40) + "\n" + sentence(5) * 2, "!!! ??? 123"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None, "c", "c", "c", "c") for i, t in enumerate(texts)]
    rows += [(100 + i, sentence(30 + i), "en" if i % 2 else "de", "s", 1, "c", "c", "c", "c") for i in range(30)]
    return rows + [rows[5], rows[9], (None, "no id here at all today", "en", "s", 0, "c", "c", "c", "c")]


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def test_sharding(docs, none):
    got = sharding.assign_shards(docs, shards=4).collect()
    assert len(got) == len(ROWS) and sharding.assign_shards(none, shards=4).count() == 0
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    for shard in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    place = defaultdict(set)
    for r in got:
        if r["size"] > 1:
            place[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    loads = Counter()
    for r in sharding.assign_shards(docs, shards=None, capacity=30_000).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= max(30_000, 2 * (len(ROWS[9][1]) + 1))


def test_best_fit_decreasing_runs_match_single_items():
    sizes = sorted(RNG.integers(1, 400, 300).tolist(), reverse=True)
    gaps, want = [], Counter()
    for s in sizes:
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        i = min(fits)[1] if fits else len(gaps)
        if not fits:
            gaps.append(1000)
        gaps[i] -= s
        want[s, i] += 1
    got = Counter()
    for s, a, b, i in sharding.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 1000):
        got[s, i] += b - a
    assert got == want


def test_chat(spark):
    rows = [(1, 1, "user", "hi <|im_end|> \\ <\\| there"), (1, 2, "assistant", None), (1, 2, "assistant", "same"), (1, 2, "assistant", "same"), (2, 1, None, "a\nb"),
            (2, 2, "ro\\nle\nx", ""), (None, 1, "assistant", "ünï \\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(chat.turns_as_events(turns)))).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    log = [(1, 1, 0, "message", "user", "q"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 2, "message", "user", "next"),
           (1, 5, 0, "edit", "user", "Q"), (1, 6, 1, "regenerate", "assistant", ""), (1, 7, 1, "delta", "assistant", "new"), (1, 8, 2, "message", "user", "later")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    folded = [(r["role"], r["text"]) for r in chat.fold_events(events).orderBy("message").collect()]
    assert folded == [("user", "Q"), ("assistant", "new"), ("user", "later")]
    assert chat.read_back(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def want(text):
        w = rx.findall(lower(text))
        hit, items = set(), set()
        for i, t in BENCH:
            b = rx.findall(lower(t))
            k = min(13, len(b))
            wins = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in wins:
                    hit.update(range(j, j + k))
                    items.add(str(i))
        return len(w), len(hit), sorted(items)

    for most in (64 << 20, 8):  # an index in every task, and a join
        got = decontaminate.find_contamination(docs, bench, index_bytes=most).collect()
        assert len(got) == len(ROWS)
        for r in got:
            c = r["contamination"]
            assert (c["n_words"], c["n_hit"], list(c["items"])) == want(r["text"])
            assert sum(s["end"] - s["start"] for s in c["spans"]) == c["n_hit"]
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("contamination.n_hit > 0").count() == 0


def test_decontamination_of_repeated_words():
    """Repeats on both sides: results of all windows, in time that follows the text."""
    import time
    rng = np.random.default_rng(8)

    def plain(w, items):
        windows = {tuple(t[j:j + min(13, len(t))].tolist()) for t in items for j in range(len(t) - min(13, len(t)) + 1)}
        hit = set()
        for k in {min(13, len(t)) for t in items}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k].tolist()) in windows:
                    hit.update(range(j, j + k))
        return hit

    for words in (1, 2, 3):
        items = [rng.integers(1, words + 1, n).astype(np.uint64) for n in (40, 13, 5, 30)]
        w = rng.integers(1, words + 1, 300).astype(np.uint64)
        starts, ends, _ = decontaminate.search(w, np.array([0, 150, 150, 300]), decontaminate.Index([(str(i), t) for i, t in enumerate(items)], 13))
        assert {p for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for p in range(a, b)} == plain(w[:150], items) | {150 + p for p in plain(w[150:], items)}
    index = decontaminate.Index([("long", np.ones(500, np.uint64))], 13)
    began = time.perf_counter()
    starts, ends, _ = decontaminate.search(np.ones(5000, np.uint64), np.array([0, 5000]), index)
    assert time.perf_counter() - began < 0.1 and starts.min() == 0 and ends.max() == 5000 and len(starts) == 4988


def test_near_duplicates(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    ids = sorted({r[0] for r in ROWS if r[0] is not None})
    sets = {r[0]: shingles(r[1]) for r in ROWS}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = near_duplicates.near_duplicates(docs, block=2).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = root.get(r["doc_id"])
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want, r["doc_id"] == want)
    assert near_duplicates.near_duplicates(none).count() == 0


def test_language_model(docs, none):
    split = re.compile("[^\x20\x09-\x0d]+")
    tokens = [(r[0], split.findall(lower(r[1])) + [None]) for r in ROWS]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c, pairs = Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            c.update(t)
            pairs.update(zip(t, t[1:]))
    total, v = sum(c.values()), len(c)
    pairs = {k: n for k, n in pairs.items() if n >= 2}  # every word is a core word here
    back = defaultdict(lambda: 1.0)
    for (a, _), n in pairs.items():
        back[a] -= (n - 0.5) / c[a]
    want = defaultdict(list)
    for i, t in tokens:
        p = [(c[w] + 0.5) / (total + 0.5 * (v + 1)) for w in t]
        s = math.log10(p[0])
        for a, w, q in zip(t, t[1:], p[1:]):
            s += math.log10((back[a] if c[a] else 1.0) * q + ((pairs[a, w] - 0.5) / c[a] if (a, w) in pairs else 0))
        want[i].append((held(i), len(t), sum(c[w] > 0 for w in t), total, sum(map(math.log10, p)), s))
    got = defaultdict(list)
    for r in language_model.score_texts(docs, fold(F.col("doc_id"), 5) == 1).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)
    assert language_model.score_texts(none, fold(F.col("doc_id"), 5) == 1).count() == 0


def test_language_model_keeps_rare_histories(spark, docs):
    """A bigram of two words that occur twice among 260,000 training tokens is an arc, in any cut of blocks and buckets."""
    held = F.col("doc_id") >= 1000
    rows = [(i, sentence(2600)) for i in range(100)] + [(200, "seldom seen"), (201, "seldom seen"), (1000, "seldom seen")]
    data = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    total, v = 260_000 + 102 + 4, len(WORDS) + 3
    uni = lambda c: (c + 0.5) / (total + 0.5 * (v + 1))
    want = math.log10(uni(2)) + math.log10(0.75 + 0.25 * uni(2)) + math.log10(0.75 + 0.25 * uni(102))
    for cut in ({}, {"block_bytes": 50_000, "bucket_tokens": 9_000}):
        got = [r for r in language_model.score_texts(data, held, **cut).collect() if r["held_out"]]
        assert [(r["n_known"], r["train_tokens"]) for r in got] == [(3, total)] and got[0]["score"] == pytest.approx(want, abs=1e-9)
    whole, cut = ([tuple(r) for r in language_model.score_texts(docs, fold(F.col("doc_id"), 5) == 1, **o).collect()] for o in ({}, {"block_bytes": 300, "bucket_tokens": 50}))
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 6))
    for a, b in zip(sorted(whole, key=order), sorted(cut, key=order), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_token_counts(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path, block_bytes=4000, buckets=7, remembered=3).collect()) == want
    assert token_counts.count_tokens(none, path).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    want = Counter()
    for r in ROWS:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        at = 0
        for k in range(-(-len(ids) // 64)):
            n = (len(ids) - 1) % 64 + 1 if k == 0 else 64
            want[r[0], k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rooms = defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for room in rooms.values():
        end = 0
        for offset, length in sorted(room):
            assert offset == end
            end += length
        assert end <= 64
    assert len(rooms) <= -(-sum(r["length"] for r in got) // 64) * 1.15 + 1
    assert sorted(len(r["ids"]) for r in packing.sequences(packing.pack(docs, path, capacity=64, with_ids=True)).collect()) == sorted(sum(n for _, n in x) for x in rooms.values())
    assert packing.pack(none, path).count() == 0


def test_quality_base_and_verdict(docs, none, spark):
    got = defaultdict(list)
    for r in quality.judge(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t, *_ in ROWS:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(w[j:j + 5]) for j in range(len(w) - 4)]
        n, seen, dup, cover = Counter(grams), set(), 0, set()
        for j, g in enumerate(grams):
            if n[g] > 1:
                cover.update(range(j, j + 5))
        for line in t.split("\n"):
            dup += bool(re.search("[^\x20\x09-\x0d]", line)) and line in seen
            seen.add(line)
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0
    many = [(i, sentence(60), "en", "s") for i in range(200)] + [(1000 + i, " ".join(f"{w}%%%" for w in set(WORDS)), "en", "s") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(many, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(5))


def test_quality_estimate_decides_by_group(spark):
    """The same text of long words is an outlier where word lengths hardly vary and none where they vary."""
    word = lambda n: "".join(RNG.choice(list("abcdefghijklmnop"), n))
    text = lambda n: " ".join(word(n) for _ in range(int(RNG.integers(150, 400))))
    far = text(8)
    rows = [(i, text(5), "en", "even") for i in range(200)] + [(1000 + i, text(3 + i % 6), "en", "mixed") for i in range(200)]
    rows += [(5000, far, "en", "even"), (5001, far, "en", "mixed")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior_rows=1.0).collect()}
    assert all(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200)) and not kept[5000] and kept[5001]


def test_language_id(spark, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    t = language_id.trie(path)
    data = "Hello wörld hello".encode()
    u = language_id.Units(np.frombuffer(data, np.uint8), np.array([0, len(data)]), t)
    p = np.random.default_rng(1).random((t.size, 2)) / 50
    pieces = {}

    def walk(node, text):
        for b in range(256):
            if t.step[node, b]:
                if t.piece[t.step[node, b]] >= 0:
                    pieces[text + bytes([b])] = t.piece[t.step[node, b]]
                if text + bytes([b]) in prefixes:
                    walk(t.step[node, b], text + bytes([b]))

    words = [language_id.MARK + w for w in ("hello".encode(), "wörld".encode())]
    prefixes = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    walk(0, b"")

    def total(w):
        if not w:
            return np.ones(2)
        return sum((p[pieces[w[:k]]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces), np.zeros(2))

    unit = np.exp(u.whole(p))
    assert u.counts.tolist() == [3] and np.allclose(unit[u.unit], [total(words[0]), total(words[1]), total(words[0])], rtol=1e-9)
    rows = [(i, f"the {w} and the {w} with that", "en") for i, w in enumerate(WORDS)] + [(50 + i, f"der {w}chen und die {w}lich nicht", "de") for i, w in enumerate(WORDS)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "with the stranger and that"), (2, "und nicht die fremdlich"), (3, None), (4, "123 !!"), (5, ""), (6, "z" * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(test, train, path).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3][1] == 0 and got[6][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(none, train, path).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, none, path).collect()} == {"und"}


def test_language_of_long_words():
    """Words of any length: sums over all segmentations and expected piece counts, by plain logarithms."""
    t = language_id.trie(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    texts = ["internationalization" * 7, "語言識別" * 11 + "ไทยภาษา" * 9, "ab", "x" * 70 + "ing", "кириллица" * 6, "q" * 33, "w" * 29]
    data = " ".join(texts).encode()
    u = language_id.Units(np.frombuffer(data, np.uint8), np.array([0, len(data)]), t)
    p = rng.random((t.size, 2)) * 10 ** rng.uniform(-9, -2, (t.size, 1)) + 1e-12

    def matches(w, i):
        node = 0
        for j in range(i, len(w)):
            node = t.step[node, w[j]]
            if not node:
                return
            if t.piece[node] >= 0:
                yield j + 1, t.piece[node]

    whole = u.whole(p)
    want = {}
    for n, text in enumerate(texts):
        w = language_id.MARK + text.encode()
        log = np.full((len(w) + 1, 2), -np.inf)
        log[0] = 0
        flat, back = np.full(len(w) + 1, -np.inf), np.full(len(w) + 1, -np.inf)
        flat[0] = back[-1] = 0
        q = -np.log(t.size)
        for i in range(len(w)):
            for j, piece in matches(w, i):
                log[j] = np.logaddexp(log[j], log[i] + np.log(p[piece]))
                flat[j] = np.logaddexp(flat[j], flat[i] + q)
        for i in reversed(range(len(w))):
            for j, _ in matches(w, i):
                back[i] = np.logaddexp(back[i], back[j] + q)
        assert np.allclose(whole[u.unit[n]], log[-1], rtol=1e-10)
        for i in range(len(w)):
            for j, piece in matches(w, i):
                key = (int(u.unit[n]), int(piece))
                want[key] = want.get(key, 0) + np.exp(flat[i] + q + back[j] - flat[-1])
    got = {}
    for unit, piece, share in u.expected(1.0 / t.size):
        for key in zip(unit.tolist(), piece.tolist(), share.tolist(), strict=True):
            got[key[:2]] = got.get(key[:2], 0) + key[2]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def many_words(texts=400, words=130):
    rng = np.random.default_rng(9)
    made = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 12))) for _ in range(20_000)] + ["internationalization" * 7, "q" * 33]
    return [" ".join(made[i] for i in rng.integers(0, len(made), words)) for _ in range(texts)]


def test_language_states_lie_by_offset():
    """The units of an offset are the first ones and their states neighbours, so a pass reads memory in order; each word scores as it does alone."""
    t = language_id.trie(public_tokenizers.path("piece_bpe_32k.model"))
    data, offs = utf8(pa.array([*many_words(20), None, "", "q" * 33 + " a " + "é" * 40]))
    u = language_id.Units(data, offs, t)
    assert (np.diff(u.length) <= 0).all() and u.counts.sum() == len(u.unit)
    for offset in (0, 1, 7, 30, 32, 40):
        assert np.diff(u.begin)[offset] == (u.length >= offset).sum()
        for after, unit, piece in u.matches(offset):
            assert (np.diff(np.arange(len(u.length))[unit]) == 1).all() if isinstance(unit, slice) else (np.diff(unit) > 0).all()
            assert len(piece) <= u.reach[after]
    p = np.random.default_rng(3).random((t.size, 2)) / 50
    whole = u.whole(p)
    words = [w for text in data.tobytes().split(b" ") for w in [text] if w]
    for w in (words[0], words[9], "é".encode() * 40):
        one = language_id.Units(np.frombuffer(w, np.uint8), np.array([0, len(w)]), t)
        assert any(np.array_equal(one.whole(p)[0], x) for x in whole)


def test_language_counts_hold_one_offset():
    """Expected counts by language are the sums over all matches, and adding them up holds those of one offset, not of the whole slice."""
    t = language_id.trie(public_tokenizers.path("piece_bpe_32k.model"))
    texts = many_words()
    data, offs = utf8(pa.array(texts))
    code = np.arange(len(texts)) % 3
    tracemalloc.start()
    try:
        u = language_id.Units(data, offs, t)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        own = language_id.expected_by_language(u, code, 3)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    found = list(u.expected(1.0 / t.size))
    held = sum(x.nbytes for f in found for x in f)
    assert peak < 4 * 8 * u.begin[-1] + held / 2, (peak, held)  # two passes and their scales, one number a state
    unit, piece, share = (np.concatenate([f[i] for f in found]) for i in range(3))
    spoken = np.repeat(code, u.counts)
    for k in range(3):
        n = np.bincount(u.unit[spoken == k], minlength=len(u.length))
        assert np.allclose(own[k], np.bincount(piece, weights=share * n[unit], minlength=t.size))


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 10 == 0
        words = rng.choice(WORDS, 25).tolist() + [f"rare{rng.integers(1e6)}"]
        if bad:
            words[int(rng.integers(25))] = ["nastyword", "vilething", "grossling"][i // 10 % 3]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    held = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(data.filter(~held), marks.filter(~held))
    got = toxicity.score(data.filter(held), model).collect()
    assert all(r["predicted"] == (r["doc_id"] % 10 == 0) for r in got)
    every = toxicity.score(docs, model).collect()
    assert len(every) == len(ROWS) and all(0 <= r["score"] <= 1 for r in every)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(none, marks.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, blank).collect()} == {0}


def test_ids_of_any_type(spark):
    """Text ids give what whole numbers give."""
    base = sentence(60)
    texts = [base, base + " more", base, None, "", sentence(900), "one two", base.replace(base.split()[30], "other")]
    number = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, base)], "doc_id long, text string").repartition(2)
    named = number.withColumn("doc_id", F.format_string("id %05d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "id  null", F.col("doc_id")))
    named = named.withColumn("doc_id", F.when(F.col("doc_id").contains("null"), None).otherwise(F.col("doc_id")))
    name = lambda i: None if i is None else f"id {i:05d}"

    def same(run, ids):
        a = Counter(tuple(name(r[c]) if c in ids else r[c] for c in r.__fields__) for r in run(number).collect())
        b = Counter(tuple(r) for r in run(named).collect())
        assert a == b and len(b) >= 8

    same(lambda d: near_duplicates.near_duplicates(d), ("doc_id", "component_id"))
    same(lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")), ("doc_id",))
    same(lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), ("doc_id",))
    same(lambda d: language_model.score_texts(d, F.col("text").contains("other")), ("doc_id",))
    marks = spark.createDataFrame([("id 00001", 1), ("id 00005", 0)], "doc_id string, toxic int")
    assert toxicity.score(named, toxicity.train(named, marks)).count() == 9


def test_events_without_place_are_left_out(spark):
    rows = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "there"), (1, 3, None, "regenerate", "assistant", "lost"),
            (1, None, 2, "edit", "assistant", "lost"), (1, 4, 2, "delta", None, "!"), (None, 1, 1, None, None, None)]
    got = {(r["conv_id"], r["message"], r["role"], r["text"]) for r in
           chat.fold_events(spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")).collect()}
    assert got == {(1, 1, "user", "hi"), (1, 2, "assistant", "there!"), (None, 1, "", "")}


def test_toxicity_risk_by_plain_code(spark):
    """The fit follows the non-negative risk: its first step has the signs of the plain gradient, and the risk falls."""
    rng = np.random.default_rng(6)
    rows = [sorted(rng.choice(8, rng.integers(0, 5), replace=False).tolist() + ([8] if i < 20 else [])) for i in range(120)]
    positive, prior = np.arange(120) < 20, 0.3
    x = np.zeros((120, 9))
    for i, r in enumerate(rows):
        x[i, r] = 1

    def risk(w, b):
        f = x @ w + b
        loss = lambda m: np.logaddexp(0, -m)
        clean = loss(-f[~positive]).mean() - prior * loss(-f[positive]).mean()
        return prior * loss(f[positive]).mean() + (clean if clean >= 0 else -clean), clean

    def gradient(w, b, e=1e-6):
        out = []
        for j in range(10):
            up, down = np.append(w, b), np.append(w, b)
            up[j], down[j] = up[j] + e, down[j] - e
            # below zero only the second part is stepped on, upwards
            def part(v):
                total, clean = risk(v[:9], v[9])
                return total if clean >= 0 else -clean
            out.append((part(up) - part(down)) / (2 * e))
        return np.array(out)

    w, b = toxicity.fit_nonnegative(rows, positive, 9, prior, steps=1, decay=0.0)
    g = gradient(np.zeros(9), 0.0)
    assert np.allclose(np.append(w, b), -0.1 * np.sign(g), atol=1e-5)
    w, b = toxicity.fit_nonnegative(rows, positive, 9, prior, steps=400, decay=0.0)
    f = x @ w + b
    assert risk(w, b)[1] > -0.02 and risk(w, b)[0] < 0.5 * risk(np.zeros(9), 0.0)[0] and f[positive].min() > np.median(f[~positive])


def test_rare_toxic_words_count_at_any_size(spark):
    """A word of three toxic rows is a feature among 900 as among 30; odd rows in training change nothing."""
    for n in (30, 900):
        rows = [(i, f"plain words {i % 7} here " + ("awfulterm" if i < 3 else "commonslur" if i < n // 3 else "")) for i in range(n)]
        odd = [(None, "awfulterm"), (10 ** 6, None), (10 ** 6 + 1, ""), (0, rows[0][1])]
        marks = spark.createDataFrame([(i, int(i < n // 3)) for i in range(n)] + [(None, 1), (5, None)], "doc_id long, toxic int")
        model = toxicity.train(spark.createDataFrame(rows + odd, "doc_id long, text string"), marks)
        s = {r["text"]: r["score"] for r in toxicity.score(spark.createDataFrame([("awfulterm",), ("plain words",), (None,)], "text string"), model).collect()}
        assert s["awfulterm"] > s["plain words"] and s["awfulterm"] > 0.5
