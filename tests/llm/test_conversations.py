"""Conversation repair beside exhaustive search and a plain version of the contract."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm import conversation_repair as repair

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def walk(word, edits):
    """Cost of ``edits`` on ``word``, or None if they do not fit or do not end in the grammar; the result's roles."""
    for targets in itertools.product("ua", repeat=edits.count("I") + edits.count("R")):
        left, todo, roles, cost = list(word), iter(targets), "", 0
        for e in edits:
            if e == "I":
                roles, cost = roles + next(todo), cost + 3
                continue
            letter = left.pop(0)
            if e == "D":
                cost += 4
            elif letter == "X" or (e == "K" and letter.lower() not in "sua"):
                break
            else:
                roles += letter.lower() if e == "K" else next(todo)
                cost += 3 * letter.isupper() + 3 * (e == "R")
        else:
            if re.fullmatch("(s?(ua)+)?", roles):
                return cost
    return None


def every_edit(word, extra=2):
    for n in range(len(word) + extra + 1):
        for edits in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in edits) == len(word):
                yield "".join(edits)


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_edits_are_cheapest_and_least(length):
    rng = np.random.default_rng(length)
    words = ["".join(w) for w in itertools.product("suaoSUAOX", repeat=length)]
    words = [words[i] for i in rng.permutation(len(words))[:60]]
    endings = repair.Endings()
    for word in sorted(words, key=lambda w: w[::-1]):
        costs = {e: c for e in every_edit(word) if (c := walk(word, e)) is not None}
        assert endings.cheapest(word) == min((c, e) for e, c in costs.items())


def test_endings_are_shared():
    endings = repair.Endings()
    for word in ("XXua", "sXua", "uaua"):
        endings.cheapest(word)
    assert endings.made == 4 + 1 + 2


def plain(rows, conv):
    """The contract for one conversation, turn by turn; the audit by trying all."""
    kept = []
    for c, turn, role, text in rows:
        if c != conv:
            continue
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text, kind = role or " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))
    word, faults, seen = "", defaultdict(int), set()
    for _, role, text in kept:
        body = re.sub("[ \t-\r]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        word += "X" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    numbers = [t for t, _, _ in kept if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    cost, audit = min((c, e) for e in every_edit(word, 3) if (c := walk(word, e)) is not None)
    lines, at, roles = [], 0, ""
    for e in audit:
        want = "assistant" if roles[-1:] == "u" else "user"
        if e == "I":
            lines.append(want + ":")
            roles += want[0]
            continue
        _, role, text = kept[at]
        at += 1
        if e != "D":
            role = role if e == "K" else want
            lines.append(f"{role}:{text}")
            roles += role[0]
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_odd_conversations_match_a_plain_version(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t", "Hello.", "Hello", "é!\x0b", "x" * 70 + "a.", "x" * 70 + "b.", "nul\x00?"]
    roles = [None, "", "system", "user", "assistant", "tool", "User"]
    rows = [(int(c) if c else None, None if rng.random() < .1 else int(rng.integers(0, 6)),
             roles[rng.integers(0, 7) if rng.random() < .4 else rng.integers(2, 5)], texts[rng.integers(0, len(texts))])
            for c in range(40) for _ in range(rng.integers(1, 6))]
    table = spark.createDataFrame(rows, ROWS).withColumn("digest", F.lit("clash")).withColumn("signature", F.lit(1))
    table = table.repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(
        repair.repair_conversations(repair.damaged(table), table)).collect()}
    assert got == {c: plain(rows, c) for c in {r[0] for r in rows}}


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "So."), (2, 0, "assistant", "No")], ROWS)
    got = [tuple(r)[:5] for r in repair.repair_conversations(rows).filter("place > 0").orderBy("conv_id", "place").collect()]
    assert got == [(1, 1, "user", "Hi.", "K"), (1, 2, "assistant", "So.", "R")]
    assert repair.repair_conversations(spark.createDataFrame([], ROWS)).count() == 0
    texts = spark.createDataFrame([("k", "one.")], "doc string, text string").selectExpr("doc", "1 as turn", "'user' as role", "text")
    assert repair.repair_conversations(texts, conv="doc").count() == 3


def test_one_conversation_over_many_partitions(spark):
    """A conversation that holds most rows is cut into runs; its result is that of one long word."""
    n = 6000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
                                     "concat('line ', id, if(id % 3 = 0, '.', '')) as text")
    head = repair.repair_conversations(rows.unionByName(rows.limit(5).withColumn("conv_id", F.lit(8).cast("long")))).filter(
        "place = 0 and conv_id = 7").collect()
    word = "".join(("u" if i % 2 == 0 else "a") if i % 3 == 0 else ("U" if i % 2 == 0 else "A") for i in range(n))
    assert len(head) == 1 and head[0].signature == word and head[0].gaps == 0
    assert (head[0].cost, head[0].audit) == repair.Endings().cheapest(word)
