"""Repair of conversations at least cost, over one automaton of all signatures.

A conversation is reduced to its signature: one letter a turn for the role and the first fault. What an ending of a
signature costs depends on nothing before it but the grammar state it is entered in. So all distinct signatures are
sorted from their end and run through an acyclic automaton whose nodes are the distinct endings: signatures with the
same ending share its nodes, and cost-to-go and best edit are computed once per node and grammar state. Sorted order
means that a node left is never met again, so a task holds one path at a time, however many signatures it reads; a
path is computed twice only where a range of signatures ends.

Grammar of a repaired conversation: nothing, or an optional system turn and one or more pairs of user and assistant.
Edits: Delete, Insert, Keep, Rerole; a turn that is blank or was said before must be deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column, free_names, register, table

BLANKS = " \t\n\x0b\x0c\r"
HEAD = 64  # characters of a text that order turns before its digest does

#: One letter for each role initial (s, u, a, another) and fault: clean, truncated, blank, duplicate.
CLEAN, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"

DELETE, REROLE, INSERT, LATE = 4, 3, 3, 3

# Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
ASKED = (2, 2, 3, 2)  # the state after an inserted or rerolled turn
TURN = ("user", "user", "assistant", "user")  # ... and its role
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

#: A node: per grammar state the cost to go, the edits up to and with its turn, and the state after them.
Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]

END: Node = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""), (0, 3, 3, 3))


def node(letter: str, after: Node) -> Node:
    """The node of ``letter`` followed by the ending ``after``; among equal costs the least letters win."""
    to_go = after[0]
    own = []  # cheapest edit that uses up the turn
    for q in range(4):
        ways = [(DELETE + to_go[q], "D", q)]
        if letter != "X":
            late = LATE if letter.isupper() else 0
            kept = KEPT.get(letter.lower(), {}).get(q)
            if kept is not None:
                ways.append((late + to_go[kept], "K", kept))
            ways.append((REROLE + late + to_go[ASKED[q]], "R", ASKED[q]))
        own.append(min(ways))
    cost = [way[0] for way in own]
    for _ in range(3):  # more insertions in a row come back to a state passed before
        cost = [min(c, INSERT + cost[ASKED[q]]) for q, c in enumerate(cost)]
    edits, states = [], []
    for q in range(4):
        inserted = ""
        while own[q][0] > cost[q] or (own[q][1] > "I" and INSERT + cost[ASKED[q]] == cost[q]):
            inserted, q = inserted + "I", ASKED[q]
        edits.append(inserted + own[q][1])
        states.append(own[q][2])
    return tuple(cost), tuple(edits), tuple(states)


class Endings:
    """The automaton as far as it is needed: the nodes on the path of the last word, from its end."""

    def __init__(self):
        self.path, self.last, self.made = [END], "", 0

    def cheapest(self, word: str) -> tuple[int, str]:
        """Cost and edits of ``word``; the nodes of the ending it shares with the word before are there already."""
        letters, same = word[::-1], 0
        for a, b in zip(letters, self.last):
            if a != b:
                break
            same += 1
        del self.path[same + 1:]
        for letter in letters[same:]:
            self.path.append(node(letter, self.path[-1]))
        self.made += len(letters) - same
        self.last = letters
        state, out = 0, []
        for _, edits, states in reversed(self.path):
            out.append(edits[state])
            state = states[state]
        return self.path[-1][0][0], "".join(out)


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    endings = Endings()
    for batch in batches:
        words = batch.column(0)
        found = [endings.cheapest(word) for word in words.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [words, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=["word", "cost", "audit"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation in sorted rows: place of the run, its letters, first and last turn, distinct turns."""
    fields = None
    run: list | None = None
    place = 0

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)],
                                          schema=fields)

    for batch in batches:
        conv, turn, letters = (batch.column(i) for i in range(3))
        if fields is None:
            fields = pa.schema([("conv", conv.type), ("place", pa.int64()), ("letters", pa.string()),
                                ("low", turn.type), ("high", turn.type), ("turns", pa.int64())])
        done = []
        for c, t, x in zip(conv.to_pylist(), turn.to_pylist(), letters.to_pylist()):
            if run is None or c != run[0]:
                if run is not None:
                    done.append((run[0], place, "".join(run[2]), *run[3:]))
                place += 1
                run = [c, place, [], None, None, 0]
            run[2].append(x)
            if t is not None:
                if run[3] is None:
                    run[3] = t
                if t != run[4]:
                    run[4], run[5] = t, run[5] + 1
        if done:
            yield made(done)
    if run is not None:
        yield made([(run[0], place, "".join(run[2]), *run[3:])])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads and their turns in order: the heads as they are, then the repaired turns."""
    left, state, place, conv, schema = "", 0, 0, None, None

    def written(role, text, edit):
        nonlocal place
        place += 1
        return (conv, place, role, text, edit, *[None] * 8)

    def inserted(out, count):
        nonlocal state
        for _ in range(count):
            out.append(written(TURN[state], "", "I"))
            state = ASKED[state]

    at = 0
    for batch in batches:
        if schema is None:
            names = ["conv", "place", "role", "text", "edit", "signature", "gaps", "blank", "duplicate", "truncated",
                     "illegal", "cost", "audit"]
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
                     *[pa.int64()] * 6, pa.string()]
            schema = pa.schema(list(zip(names, types)))
        out: list[tuple] = []
        for c, head, role, text, *facts in zip(*[x.to_pylist() for x in batch.columns]):
            if head:
                inserted(out, len(left) - at)
                conv, left, at, state, place = c, facts[-1], 0, 0, 0
                out.append((c, 0, None, None, None, *facts))
                continue
            upto = at
            while left[upto] == "I":
                upto += 1
            inserted(out, upto - at)
            edit, at = left[upto], upto + 1
            if edit == "K":
                state = KEPT[role[:1]][state]
                out.append(written(role, text, edit))
            elif edit == "R":
                out.append(written(TURN[state], text, edit))
                state = ASKED[state]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    if schema is not None and at < len(left):
        out = []
        inserted(out, len(left) - at)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def letter_of(role: Column, fault: Column) -> Column:
    """The signature letter of a turn; ``fault`` is 0 clean, 1 truncated, 2 blank, 3 duplicate."""
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring(role, 1, 1)) * F.least(F.length(role), F.lit(1)),
                               F.lit(0)), F.lit(4))
    return F.substring(F.lit(CLEAN + TRUNCATED + BLANK + DUPLICATE), fault * 4 + kind, F.lit(1))


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Findings and repaired turns: per conversation one row with ``place`` 0, then its repaired turns from 1 on.

    Head rows have ``signature``, ``gaps`` (turn numbers missing between the first and the last), the counts ``blank``,
    ``duplicate``, ``truncated`` (first fault of each turn) and ``illegal`` (neighbours whose role initials are not su,
    ua or au), the least ``cost`` and its ``audit`` (initials of the edits). Turns have ``role``, ``text``, ``edit``.
    The rows of a conversation are consecutive and in order within a partition.

    ``conversations`` may name (column ``conv``) conversations to report even if they have no rows. Null ids form one
    conversation; a null role or text is one blank. Turns are ordered by number, nulls first; equal numbers by role,
    first 64 characters and SHA-256 of the text, so equal rows are neighbours and all but the first are duplicates.
    An empty table gives none; columns with other names are ignored, whatever they are called.

    Only letters and digests are collected per conversation, from sorted runs, so a conversation may hold any share of
    the rows; its texts then pass through one task as a stream, because its repaired turns are one ordered sequence.
    """
    keys = [column(conv).alias("conv"), column(turn).alias("turn"),
            F.coalesce(column(role).cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(column(text).cast("string"), F.lit(" ")).alias("text")]
    turns = rows.select(*keys).withColumn("head", F.substring("text", 1, HEAD)).withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = ["turn", "role", "head", "digest"]

    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    lean = turns.groupBy("conv", *order, fault.alias("fault")).agg(F.count("*").alias("n"))
    again = (lean.groupBy(F.col("conv").alias("conv2"), F.col("role").alias("role2"), F.col("digest").alias("digest2"))
             .agg(F.min(F.struct("turn")).alias("first"), F.sum("n").alias("said")).filter("said > 1"))
    same = F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("role") == F.col("role2")) & (F.col("digest") == F.col("digest2"))
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    again_fault = F.when(F.col("fault") == 2, 2).otherwise(3)
    letters = F.concat(letter_of(F.col("role"), F.when(later, again_fault).otherwise(F.col("fault"))),
                       F.repeat(letter_of(F.col("role"), again_fault), (F.col("n") - 1).cast("int")))
    marked = lean.join(again, same, "left").select("conv", "turn", letters.alias("letters"), "role", "head", "digest")
    types = dict(marked.dtypes)
    pieces = (marked.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order).select("conv", "turn", "letters")
              .mapInArrow(_pieces, f"conv {types['conv']}, place long, letters string, low {types['turn']}, "
                                   f"high {types['turn']}, turns long"))
    # a conversation that crosses borders is a run in each of several partitions, which follow each other by number
    runs = F.array_sort(F.collect_list(F.struct("part", "place", "letters", "low", "high", "turns")))
    whole = pieces.withColumn("part", F.spark_partition_id()).groupBy("conv").agg(runs.alias("runs"))
    dated = F.filter("runs", lambda r: r["low"].isNotNull())
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size(dated)), lambda i: (i > 1) & (
        F.get(dated, i - 1)["low"] == F.get(dated, i - 2)["high"])))
    distinct = F.aggregate(dated, F.lit(0).cast("long"), lambda s, r: s + r["turns"]) - shared
    gaps = F.when(F.size(dated) == 0, 0).otherwise(
        F.element_at(dated, -1)["high"] - F.element_at(dated, 1)["low"] + 1 - distinct)
    signed = whole.select("conv", F.array_join(F.transform("runs", lambda r: r["letters"]), "").alias("signature"),
                          gaps.cast("long").alias("gaps"))
    named = rows if conversations is None else conversations
    signed = signed.unionByName(named.select(column(conv).alias("conv"), F.lit("").alias("signature"),
                                             F.lit(0).cast("long").alias("gaps")).distinct())
    signed = signed.groupBy("conv").agg(F.max("signature").alias("signature"), F.max("gaps").alias("gaps"))

    def count(chars: str) -> Column:
        return F.length("signature") - F.length(F.translate("signature", chars, ""))

    roles = F.translate("signature", CLEAN + TRUNCATED + BLANK + DUPLICATE, "suao" * 4)
    legal = F.length(roles) - F.length(F.regexp_replace(roles, "(?=su|ua|au).", ""))
    heads = signed.select(
        "conv", F.lit(True).alias("is_head"), "signature", "gaps", count(BLANK).cast("long").alias("blank"),
        count(DUPLICATE).cast("long").alias("duplicate"), count(TRUNCATED).cast("long").alias("truncated"),
        F.greatest(F.length("signature") - 1 - legal, F.lit(0)).cast("long").alias("illegal"),
        F.translate("signature", BLANK + DUPLICATE, "X" * 8).alias("word"))
    words = heads.select("word").distinct()
    edits = (words.repartitionByRange(F.reverse("word")).sortWithinPartitions(F.reverse("word"))
             .mapInArrow(_edit_batches, "word string, cost long, audit string"))
    heads = heads.join(edits, "word").drop("word")

    stream = heads.select("conv", "is_head", *[F.lit(None).cast(types.get(c, "string")).alias(c) for c in order],
                          F.lit(None).cast("string").alias("text"), "signature", "gaps", "blank", "duplicate",
                          "truncated", "illegal", "cost", "audit")
    facts = stream.columns[7:]
    stream = stream.unionByName(turns.withColumn("is_head", F.lit(False)), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", F.desc("is_head"), *order)
    return stream.select("conv", "is_head", "role", "text", *facts).mapInArrow(
        _applied, f"conv {types['conv']}, place long, role string, text string, edit string, signature string, gaps long, "
                  "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    ).withColumnRenamed("conv", conv)


FINDINGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: its findings and the SHA-256 of its repaired lines, hashed as they pass."""
    head, digest, names = None, None, None

    def made(rows):
        arrays = [pa.array([r[0][0] for r in rows], types[0])]
        arrays += [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(1, 7)]
        arrays += [pa.array([r[0][7] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        types = [batch.schema.field(0).type]
        names = [batch.schema.field(0).name, *FINDINGS, "audit", "repaired_sha256"]
        done = []
        for c, place, role, text, *facts in zip(*[x.to_pylist() for x in batch.columns]):
            if place == 0:
                if head is not None:
                    done.append((head, digest.hexdigest()))
                head, digest = (c, *facts), hashlib.sha256()
            else:
                digest.update(f"{chr(10) * (place > 1)}{role}:{text}".encode())
        if done:
            yield made(done)
    if head is not None:
        yield made([(head, digest.hexdigest())])


def repair_digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_conversations``: findings, audit, SHA-256 of its ``role:text`` lines."""
    conv = repaired.columns[0]
    return repaired.select(column(conv), "place", "role", "text", *FINDINGS, "audit").mapInArrow(
        _digests, f"`{conv}` {dict(repaired.dtypes)[conv]}, " + ", ".join(f"{f} long" for f in FINDINGS)
        + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20; nulls become one blank first."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind, = free_names(rows, "__kind")
    rows = rows.select("conv_id", "turn", "role", "text").withColumn(
        kind, F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).filter(F.col(kind) != 0)
    text = F.when(F.col(kind) == 1, "").when(F.col(kind) == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(F.col(kind) == 4, "user").otherwise(known("role"))
    copies = F.when(F.col(kind) == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


#: The contract in SQL. ``crc`` is the table of CRC-32 made from its polynomial; ``ending`` holds, from the last turn to
#: the first, the least (cost, audit) per grammar state; ``walk`` applies the audit.
SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
known AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
dealt AS (
  SELECT known.*, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM known, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
                               ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN said > 1 THEN 'duplicate'
                 WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'clean' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
ending AS (
  SELECT conv_id, n AS pos, {'c': 0, 'a': ''} AS e0, {'c': 6, 'a': 'II'} AS e1, {'c': 3, 'a': 'I'} AS e2,
         {'c': 0, 'a': ''} AS e3
  FROM facts
  UNION ALL
  SELECT conv_id, pos, list_min([o0, {'c': 3 + r2.c, 'a': 'I' || r2.a}]), list_min([o1, {'c': 3 + r2.c, 'a': 'I' || r2.a}]),
         r2, r3
  FROM (SELECT *, list_min([o2, {'c': 3 + o3.c, 'a': 'I' || o3.a}]) AS r2,
               list_min([o3, {'c': 3 + o2.c, 'a': 'I' || o2.a}]) AS r3
    FROM (SELECT conv_id, pos,
        list_min([{'c': 4 + e0.c, 'a': 'D' || e0.a}, CASE WHEN live THEN {'c': 3 + late + e2.c, 'a': 'R' || e2.a} END,
                  CASE WHEN live AND initial = 's' THEN {'c': late + e1.c, 'a': 'K' || e1.a}
                       WHEN live AND initial = 'u' THEN {'c': late + e2.c, 'a': 'K' || e2.a} END]) AS o0,
        list_min([{'c': 4 + e1.c, 'a': 'D' || e1.a}, CASE WHEN live THEN {'c': 3 + late + e2.c, 'a': 'R' || e2.a} END,
                  CASE WHEN live AND initial = 'u' THEN {'c': late + e2.c, 'a': 'K' || e2.a} END]) AS o1,
        list_min([{'c': 4 + e2.c, 'a': 'D' || e2.a}, CASE WHEN live THEN {'c': 3 + late + e3.c, 'a': 'R' || e3.a} END,
                  CASE WHEN live AND initial = 'a' THEN {'c': late + e3.c, 'a': 'K' || e3.a} END]) AS o2,
        list_min([{'c': 4 + e3.c, 'a': 'D' || e3.a}, CASE WHEN live THEN {'c': 3 + late + e2.c, 'a': 'R' || e2.a} END,
                  CASE WHEN live AND initial = 'u' THEN {'c': late + e2.c, 'a': 'K' || e2.a} END]) AS o3
      FROM (SELECT e.conv_id, e.pos - 1 AS pos, e0, e1, e2, e3, j.initial, j.fault IN ('clean', 'truncated') AS live,
                   CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END AS late
            FROM ending e JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos)))),
best AS (SELECT conv_id, e0.c AS cost, e0.a AS audit FROM ending WHERE pos = 0),
walk AS (
  SELECT conv_id, audit AS todo, CAST(1 AS BIGINT) AS pos, '0' AS state, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT w.conv_id, todo[2:], CASE WHEN todo[1] = 'I' THEN w.pos ELSE w.pos + 1 END,
         CASE WHEN todo[1] = 'D' THEN state WHEN todo[1] = 'K' THEN initial WHEN state = 'u' THEN 'a' ELSE 'u' END,
         CASE todo[1] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
              ELSE list_append(lines, CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END
                                      || CASE WHEN todo[1] = 'R' THEN text ELSE '' END) END
  FROM walk w LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos
  WHERE todo <> '')
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM walk WHERE todo = '') w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""


@register("op13_conversations", SQL)
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_digests(repair_conversations(damaged(rows), rows))
