"""Personal data: fixed patterns beside plain regular expressions, learned ones beside a plain loop."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from helpers import DOCS, ODD, documents, raw

from quillwork.llm import personal_data as pd
from quillwork.llm.base import table
from quillwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == pd.IP:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == pd.CARD:
        doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
    return kind == pd.EMAIL or 9 <= len(digits) <= 15


def plain_base(text):
    found = [(m.start(), m.end(), k) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_fixed_matches_equal_plain_patterns():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@@", ".", "..", "1", "22", "300", "4.5.6.7", " ", "-", "--", "+", "+1 (2", ") ", "555-0100 ", "x@y.z",
              "4111111111111111", "4111 1111-1111 1111", "é", "日", "\n", "0001.2.3.4", "%", "_", "(", "12"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    texts += ["1.2.3.4.5.6.7.8.9", "a@b.c@d.e", "a@b@d.e", "+12 3)", "+1 234 567 890 (", "a" * 50 + "@x.y", "1" * 5000]
    for text in texts:
        got = sorted(((s, e, k) for s, e, k, ok in pd.fixed_matches(text) if ok), key=lambda s: (s[0], s[2]))
        assert got == plain_base(text), text


@pytest.mark.parametrize("text", ["x" * 3_000_000, "1" * 3_000_000, "1." * 1_500_000, "1 " * 1_500_000, "+1" * 1_000_000, "a@" * 1_000_000,
                                  "a@b." * 500_000, "(1" * 1_000_000, " at " * 500_000, "a:" * 1_000_000, "+1((((" * 300_000])
def test_long_texts_take_a_moment(text):
    start = time.time()
    next(iter(pd.text_spans([text])))
    assert time.time() - start < 40


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for i in range(12):
        texts.append(f"{say(5)} please call me: +49 30 {rng.randint(10**6, 10**7)} {say(4)}")
        texts.append(f"{say(5)} write to: {word()}@{word()}.org {say(4)}")
        texts.append(f"{say(3)} built on day {rng.randint(10, 28)}-10-20{i:02d} {say(2)}")
    texts += [f"{say(5)} please call me: 030 {rng.randint(10**6, 10**7)} {say(4)}" for _ in range(3)]
    texts += [f"ring home at: 030 {rng.randint(10**6, 10**7)}" for _ in range(2)]
    texts += [f"{say(5)} write to: {word()} (at) {word()} (dot) org {say(4)}", f"{say(3)} write to: 1234567890123 {say(3)}"]
    return texts


def plain_learning(texts, rounds=3, least=5, share=800):
    """The rounds over dictionaries of (pattern, kind) and (kind, instance)."""
    edges = defaultdict(dict)
    for (spans,) in pd.text_spans(texts):
        for _, _, k, known, instance, patterns in spans:
            for p in patterns:
                edges[p][k, instance] = max(known, edges[p].get((k, instance), -1))
    worth = defaultdict(int)

    def accepted():
        out = {}
        for p, around in edges.items():
            for kind in range(4):
                total = sum(1000 if known == 1 else worth[i] if known == 0 else 0 for i, known in around.items() if i[0] == kind)
                if total >= 1000 * least and total // len(around) >= share:
                    out[p, kind] = total // len(around)
        return out

    for _ in range(rounds):
        good_now, new = accepted(), defaultdict(int)
        for p, around in edges.items():
            for i in around:
                new[i] = max(new[i], good_now.get((p, i[0]), 0))
        worth = new
    final, out = accepted(), []
    for (spans,) in pd.text_spans(texts):
        out.append([(s, e, k) for s, e, k, known, _, ps in spans if known == 0 and any((p, k) in final for p in ps)])
    return out


def test_contexts_find_what_the_patterns_miss(spark):
    texts = corpus()
    got = {r.doc_id: r for r in pd.personal_data(documents(spark, texts, extra="known"), keep=["doc_id", "known"]).collect()}
    expected = plain_learning(texts)
    assert [[tuple(s) for s in got[i + 1].added] for i in range(len(texts))] == expected
    assert [[tuple(s) for s in got[i + 1].base] for i in range(len(texts))] == [plain_base(t) for t in texts]
    found = [t[s:e] for t, spans in zip(texts, expected) for s, e, _ in spans]
    assert len(found) == 4 and any("(dot) org" in f for f in found)  # three calls and the spelled address; no dates, no other number


def test_odd_rows(spark):
    got = pd.personal_data(raw(spark, [(1, "a@b.c"), (1, "a@b.c"), (None, None), (2, "")])).collect()
    assert sorted((r.doc_id or 0, [tuple(s) for s in r.base], r.added) for r in got) == [
        (0, [], []), (1, [(0, 5, 0)], []), (1, [(0, 5, 0)], []), (2, [], [])]
    assert pd.personal_data(spark.createDataFrame([], DOCS)).count() == 0
    odd = {r.doc_id: r for r in pd.personal_data(documents(spark, ODD), keep=["doc_id", "text"]).collect()}
    assert all([tuple(s) for s in odd[i + 1].base] == plain_base(t) for i, t in enumerate(ODD))


def test_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    added = dict(zip(texts, plain_learning(list(texts.values()))))
    for r in QUERIES["op11_identifiers"](spark, SF).collect():
        base = plain_base(texts[r.doc_id])
        name = lambda spans: ",".join(f"{pd.KINDS[k]}:{s}:{e}" for s, e, k in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert r.spans == name(sorted(base + added[r.doc_id], key=lambda s: (s[0], s[2])))
