"""Personal data: base patterns against the plain expressions, disclosing terms against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlens.llm import privacy

RNG = np.random.default_rng(13)
FILL = [f"{a}{b}" for a in "ka lo mi nu re sa ti vo".split() for b in "bar den fil gos hum jet".split()]


def fill(n):
    return " ".join(RNG.choice(FILL, n))


def make_texts():
    texts = [None, "", "  ", "plain words only", *(fill(400) for _ in range(10))]
    # three names: one only ever beside its address, one half of the time, one mostly elsewhere
    for i in range(6):
        texts.append(f"{fill(14)} Zebulon wrote from z.ebulon@mail.example.org {fill(14)} 4111 1111 1111 1111 {fill(3)}")
        texts.append(f"{fill(12)} call Marlow at +44 (20) 7946-0958 {fill(12)}" + f" and {fill(20)} marlow {fill(5)}" * (i < 5))
        texts.append(f"{fill(12)} quint 10.20.30.40 {fill(12)} {'quint ' + fill(25) if i < 3 else ''} quint quint {fill(9)}")
    # copies, exact and near, are no evidence
    one = f"{fill(8)} unusual rarely heard phrases beside once@only.example.com certainly strange wordings here {fill(8)}"
    texts += [one] * 5 + [one.replace("heard", w) for w in ("seen", "told", "read", "sung")]
    # an entity found everywhere gives no common word away
    texts += [f"{fill(9)} info@every.where.net {fill(9)} Info@EVERY.where.net {fill(2)}" for _ in range(40)]
    texts += ["zebulon elsewhere ÄÖ zebulon's 日本 ZEBULON@x.yz", "x" * 50_000, "9" * 30_000, "@" * 20_000, "a@" * 9_000, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004",
              "a@b.c_x@d.ee a@b@c.d .@-.-", "+1 23-4567 89+999999999 5105-1051-0510-5100 12", "ünï@exämple.com ñ@ñ.com"]
    return texts


TEXTS = make_texts()
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) if kind == "card" else 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-_ 12 4+()\nÄ9", max_size=60))
def test_base_patterns(text):
    assert privacy.base_spans(text) == plain_base(text)


def test_luhn():
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112") and privacy.luhn("0" * 13)


def plain_words(text):
    return [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def plain_spans(texts):
    """All spans of every text, by sets of words instead of hashes and joins."""
    total, near, contexts = Counter(), Counter(), defaultdict(lambda: defaultdict(int))
    for t in texts:
        words = plain_words(t or "")
        total.update(w for *_, w in words)
        spans = privacy.base_spans(t or "")
        free = [w for w in words if not any(a < w[1] and w[0] < b for _, a, b in spans)]
        seen = defaultdict(set)
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            who = privacy.entity(kind, t[a:b])
            places = [i for i, w in enumerate(free) if w[1] <= a][-privacy.REACH:] + [i for i, w in enumerate(free) if w[0] >= b][:privacy.REACH]
            places = [p for p in places if p not in seen[who]]
            seen[who].update(places)
            if places:
                contexts[who][tuple(free[p][2] for p in places)] += 1
    words, removed = sum(total.values()), {}
    for found in contexts.values():
        near, proof = Counter(), defaultdict(set)
        for c, n in found.items():
            for w in c:
                near[w] += n
                proof[w].add(c)
        reach = sum(near.values())
        strong = {w for w in near if len(proof[w]) >= 3 and 2 * near[w] >= total[w] and near[w] ** 2 * words >= total[w] ** 2 * reach}
        for w in strong:
            single = {c if len(strong & set(c)) <= 0.25 * len(set(c)) else "passage" for c in proof[w]}
            if len(single) >= 3:
                removed[w] = removed.get(w, False) or near[w] >= total[w]
    out = []
    for t in texts:
        spans = privacy.base_spans(t or "")
        terms = [("term", a, b) for a, b, w in plain_words(t or "") if w in removed and not any(s < b and a < e for _, s, e in spans)]
        out.append((t, privacy.listed(spans + terms)))
    return Counter(out), removed


@pytest.mark.parametrize("most", [privacy.BROADCAST_TERMS, 0])
def test_sanitise(spark, most):
    df = spark.createDataFrame([(i if i % 3 else None, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_term string").repartition(4)
    want, removed = plain_spans(TEXTS)
    assert removed["zebulon"] is False and removed["wrote"] is True and removed["marlow"] is False
    assert not {"quint", "unusual", "strange", *FILL} & set(removed)
    rows = privacy.sanitise(df, broadcast_terms=most).collect()
    assert Counter((r["text"], r["privacy"]["spans"]) for r in rows) == want
    for r in rows:
        base = plain_base(r["text"] or "") if len(r["text"] or "") < 10_000 else privacy.base_spans(r["text"])
        assert r["privacy"]["base"] == privacy.listed(base) and r["n_term"] == "c"
        if r["text"] and "Zebulon" in r["text"]:
            assert "[NAME]" in r["privacy"]["clean_text"] and "[EMAIL]" in r["privacy"]["clean_text"] and "[CARD]" in r["privacy"]["clean_text"]
            assert "ebulon" not in r["privacy"]["clean_text"] and "wrote" not in r["privacy"]["clean_text"]
    assert privacy.sanitise(df.limit(0)).count() == 0
    assert [r["privacy"]["spans"] for r in privacy.sanitise(df.filter("text = 'plain words only'")).collect()] == [""]


def test_cleaned_overlaps():
    assert privacy.cleaned("call +1 4111 1111 now Bob", [("card", 8, 17), ("phone", 5, 17)], [(22, 25, False)]) == "call [PHONE] now [NAME]"
    assert privacy.cleaned("a b c", [], [(2, 3, True)]) == "a  c"
