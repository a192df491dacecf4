"""Personal data: fixed patterns as seeds, and contexts learned from them that find what the patterns cannot.

One pass over the texts finds the seeds (matches that pass their checks) and candidates: strings of a like shape, such as
numbers without a country code or addresses spelled out. Each has lexical patterns, the words around it. Patterns and
identifiers are the two sides of a graph with one edge for each pair that occurs. Spark scores it in rounds: a pattern is
as good as the share of its identifiers that are known to be of a kind, an identifier as good as its best accepted
pattern. Candidates in the patterns accepted at the end are added.

What a check rejects (a number with a wrong check digit) is known not to be personal data: it counts against its
patterns and is never added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column, free_names, register, stored, table, with_results

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

AROUND = 80  # characters on either side that a pattern is taken from
LONGEST = 24  # characters of a word in a pattern; longer ones are only known to be long

# Fixed patterns, written so that no text makes them look at a character more than a few times.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Shapes of candidates.
_AT = re.compile(r" ?[\[({<] ?(?:at|AT|At) ?[\])}>] ?| (?:at|AT) ")
_SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|Dot) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}){1,8}")
_HOST = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+@_-])[(0-9][0-9 ()./-]{5,24}[0-9](?![0-9A-Za-z@_])")
_WORD = re.compile(r"\w+|[^\w\s]")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _before(text: str, at: int, least: int) -> int:
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


def fixed_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, end, kind, passes its check): leftmost, not overlapping within a kind, kinds one after the other."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = _before(text, m.start(), end)
        if start < m.start():
            end = m.end()
            yield start, end, EMAIL, True
    for m in _DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        numbers, at = chain.split("."), m.start()
        for i in range(0, len(numbers) - 3, 4):  # matches follow each other within a longer chain
            four = numbers[i:i + 4]
            size = sum(map(len, four)) + 3
            yield at, at + size, IP, all(len(x) < 4 and int(x) < 256 for x in (n.lstrip("0") or "0" for n in four))
            at += size + 1
    for m in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19:
            yield m.start(), m.end(), CARD, passes_luhn(digits)
    for m in _CALL.finditer(text):
        n = len(_NOT_DIGIT.sub("", m.group()))
        yield m.start(), m.end(), PHONE, 9 <= n <= 15


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of strings that look like a kind without matching its fixed pattern."""
    for m in _AT.finditer(text):
        start, rest = _before(text, m.start(), max(0, m.start() - 64)), _SPELLED.match(text, m.end())
        if start < m.start() and rest:
            yield start, rest.end(), EMAIL
    for m in _HOST.finditer(text):
        yield m.start(), m.end(), IP
    for m in _NUMBER.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            yield m.start(), m.end(), CARD
        elif 7 <= len(digits) <= 15:
            yield m.start(), m.end(), PHONE


def words_around(words: list[str]) -> list[str]:
    return ["<long>" if len(w) > LONGEST else re.sub("[0-9]", "0", w.lower()) for w in words]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: two words before, three words before, one on either side."""
    left = words_around(_WORD.findall(text[max(0, start - AROUND):start])[-3:])
    left = ["<s>"] * (3 - len(left)) + left
    right = words_around(_WORD.findall(text[end:end + AROUND])[:1]) or ["<e>"]
    return [f"{left[1]} {left[2]} *", f"{left[0]} {left[1]} {left[2]} *", f"{left[2]} * {right[0]}"]


SPAN = "struct<start:int,end:int,kind:int,known:int,instance:string,patterns:array<string>>"


def text_spans(texts: Iterable[str | None]) -> Iterator[tuple]:
    """Of each text the seeds (known 1), rejected matches (known -1) and candidates (known 0) with their patterns."""
    for text in texts:
        out, taken = [], []
        if text:
            for start, end, kind, good in fixed_matches(text):
                out.append((start, end, kind, 1 if good else -1))
                taken.append((start, end))
            taken.sort()
            free, last = [], 0
            for start, end in taken:
                if start > last:
                    free.append((last, start))
                last = max(last, end)
            free.append((last, len(text)))
            found, upto, gap = sorted(candidates(text), key=lambda s: (s[0], -s[1], s[2])), 0, 0
            for start, end, kind in found:  # leftmost longest, clear of all fixed matches
                while free[gap][1] <= start:
                    if gap + 1 == len(free):
                        break
                    gap += 1
                if start >= upto and free[gap][0] <= start and end <= free[gap][1]:
                    out.append((start, end, kind, 0))
                    upto = end
        yield ([(s, e, k, known, hashlib.sha256(f"{k}:{text[s:e].lower()}".encode("utf-8", "surrogatepass")).hexdigest()[:32],
                 patterns(text, s, e)) for s, e, k, known in out],)


def learned_patterns(spans: DataFrame, rounds: int, least: int, share: int) -> DataFrame:
    """(pattern, kind, score) of the accepted patterns; ``spans`` has one column ``spans`` of what ``text_spans`` gives.

    Scores are whole thousandths, so that they do not depend on the order of a sum.
    """
    edges = (spans.select(F.explode("spans").alias("s"))
             .select("s.kind", "s.instance", "s.known", F.explode("s.patterns").alias("pattern"))
             .groupBy("pattern", "kind", "instance").agg(F.max("known").alias("known"))
             .withColumn("worth", F.when(F.col("known") == 1, 1000).otherwise(0)))
    edges = stored(edges, "identifier-edges")

    def accepted() -> DataFrame:
        sums = [F.sum(F.when(F.col("kind") == k, F.col("worth")).otherwise(0)).alias(f"w{k}") for k in range(len(KINDS))]
        totals = edges.groupBy("pattern").agg(F.count("*").alias("n"), *sums)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"w{k}").alias("worth")) for k in range(len(KINDS))]))
        rows = totals.select("pattern", "n", each.alias("k")).select("pattern", "n", "k.*")
        rows = rows.withColumn("score", F.expr("worth div n").cast("int"))
        return rows.filter((F.col("worth") >= least * 1000) & (F.col("score") >= share)).select("pattern", "kind", "score")

    for _ in range(rounds):
        good = stored(accepted(), "identifier-patterns")
        unknown = edges.filter("known = 0")
        best = unknown.join(good, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        worth = F.when(F.col("known") == 0, F.coalesce("score", F.lit(0))).otherwise(F.col("worth"))
        edges = stored(edges.join(best, ["instance", "kind"], "left")
                       .select("pattern", "kind", "instance", "known", worth.cast("int").alias("worth")), "identifier-edges")
    return stored(accepted(), "identifier-patterns")


def personal_data(docs: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",), rounds: int = 3, least: int = 5,
                  share: int = 800) -> DataFrame:
    """Columns ``keep`` plus ``base`` and ``added``: arrays of (start, end, kind), in code points, ordered by start, kind.

    ``kind`` counts ``KINDS``. ``base`` holds the matches of the fixed patterns that pass their checks, ``added`` the
    candidates of accepted patterns; those overlap no match and each other nowhere. A pattern is accepted if it is worth
    ``least`` known identifiers, different ones, and ``share`` thousandths of all it occurs with.

    A null or empty text has no spans. Documents are kept as rows, so repeated rows, repeated and null ids and an empty
    table need no care; a string that occurs many times is one identifier. Kept columns may have any names but ``base``
    and ``added``. The patterns found by a text and the results are joined by a row number, written once.
    """
    keep = list(keep)
    row, spans = free_names(docs.select(*[column(c) for c in keep]), "__row", "__spans")
    found = with_results(docs, text, f"`{spans}` array<{SPAN}>", text_spans, keep)
    found = stored(found.withColumn(row, F.monotonically_increasing_id()), "identifiers")
    good = learned_patterns(found.select(F.col(spans).alias("spans")), rounds, least, share)
    open_spans = found.select(F.col(row).alias("row"), F.explode(F.filter(spans, lambda s: s["known"] == 0)).alias("s"))
    hits = (open_spans.select("row", "s.start", "s.end", "s.kind", F.explode("s.patterns").alias("pattern"))
            .join(good.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
            .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("added")))
    base = F.array_sort(F.transform(F.filter(spans, lambda s: s["known"] == 1),
                                    lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
                        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                        .otherwise(a["kind"] - b["kind"]))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return found.join(hits, found[row] == hits["row"], "left").select(
        *[found[f"`{c}`" if "." in c else c] for c in keep], base.alias("base"), F.coalesce("added", none).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


@register("op11_identifiers")
def op11_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    both = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] < b["start"], -1)
                        .when(a["start"] > b["start"], 1).otherwise(a["kind"] - b["kind"]))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"))
