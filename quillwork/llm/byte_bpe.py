"""Byte-level BPE by recursive queries: token rows join the merge table until nothing is left to contract.

Each task opens an in-memory DuckDB. Texts are cut into words by the vocabulary's pattern; the distinct words of a
group of texts that were not met before become rows (word, position, token), first one row a byte. A recursive
query then pairs every token with the next one, joins the pairs with the merge table, and contracts the minimum-rank
pair of every word, the leftmost first, until no pair of the word can be merged. Decoding joins token rows with the
vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import register, table, with_results

RESULT = "n_tokens long, ids binary, decoded binary"

#: A token row knows where the next one of its word begins. In each step pairs become ranks, and rank and place
#: together make the key whose minimum is the word's leftmost pair of the lowest rank. Words without a pair are done.
_STEP = """
WITH RECURSIVE state(step, w, pos, nxt, tok, done) AS (
  SELECT 0, w, pos, pos + 1, tok, false FROM letters
  UNION ALL
  (WITH live AS (SELECT * FROM state WHERE NOT done AND step < {steps}),
   ranked AS (
     SELECT s.step, s.w, s.pos, s.nxt, n.nxt AS over, s.tok, merged::BIGINT * 4294967296 + s.pos AS key
     FROM live s LEFT JOIN live n ON s.nxt = n.pos AND s.w = n.w LEFT JOIN merges ON s.tok = l AND n.tok = r),
   least AS (SELECT w, min(key) AS low, arg_min(nxt, key) AS gone FROM ranked WHERE key IS NOT NULL GROUP BY w)
   SELECT step + 1, w, pos, CASE WHEN key = low THEN over ELSE nxt END,
          CASE WHEN key = low THEN (low >> 32)::INTEGER ELSE tok END, low IS NULL
   FROM ranked LEFT JOIN least USING (w) WHERE gone IS NULL OR pos <> gone)
)
SELECT w, pos, tok, NOT done AS more FROM state WHERE done OR step = {steps} ORDER BY w, pos
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """The tables of one vocabulary in one task."""

    def __init__(self, path: str, pattern: str, steps: int = 48, cached: int = 200_000, memory: str = "300MB"):
        import duckdb
        import regex

        self.ranks, self.cut = read_ranks(path), regex.compile(pattern).findall
        self.runs = re.compile(r"\s\s").search
        self.byte_rank = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.words: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}  # what was known before the caches were last emptied
        self.old_pieces: dict[str, bytes] = {}
        self.cached, self.steps = cached, steps
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() if len(t) > 1
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*pairs)) if pairs else ([pa.array([], pa.int32())] * 3)
        self.db.register("made_pairs", pa.table({"l": left, "r": right, "merged": merged}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM made_pairs").fetchall()
        # one character a byte, so that text aggregates carry any bytes
        self.db.register("made_tokens", pa.table({
            "tok": pa.array(list(self.ranks.values()), pa.int32()),
            "piece": pa.array([t.decode("latin-1") for t in self.ranks])}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM made_tokens").fetchall()
        self.query = _STEP.format(steps=steps)

    def _contract(self, words: list[str]) -> None:
        """Learn the tokens of new words."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        hard = []
        for i, b in enumerate(data):
            rank = self.ranks.get(b)
            if rank is None:
                hard.append(i)
            else:
                self.words[words[i]] = rank.to_bytes(4, "little")
        if not hard:
            return
        sizes = np.array([len(data[i]) for i in hard])
        w = np.repeat(np.array(hard, np.int32), sizes)
        pos = np.arange(len(w), dtype=np.int32)
        tok = self.byte_rank[np.frombuffer(b"".join(data[i] for i in hard), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(w):
            self.db.register("letters", pa.table({"w": w, "pos": pos, "tok": tok}))
            out = self.db.sql(self.query).to_arrow_table()
            w, pos, tok, more = (out[c].to_numpy() for c in ("w", "pos", "tok", "more"))
            done.append((w[~more], tok[~more]))
            w, tok = w[more], tok[more]
            pos = np.arange(len(w), dtype=np.int32)
        for ws, toks in done:
            cuts = np.flatnonzero(np.diff(ws)) + 1
            firsts = np.concatenate([np.zeros(min(1, len(ws)), np.int64), cuts])
            values = toks.astype("<u4").tobytes()
            for i, a, b in zip(ws[firsts].tolist(), firsts.tolist(), [*cuts.tolist(), len(ws)]):
                self.words[words[i]] = values[4 * a:4 * b]

    def _pieces(self, text: str) -> list[str]:
        """Parts of the text, each but the first after a blank at which the pattern certainly cuts.

        A single blank between two non-blanks can only begin a match. Other runs of white space stay in a part.
        """
        parts = text.split(" ")
        if not self.runs(" " + text + " "):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            if out[-1] and part and not out[-1][-1].isspace() and not part[0].isspace():
                out.append(part)
            else:
                out[-1] += " " + part
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.words) > self.cached or len(self.pieces) > self.cached:  # two generations bound the memory
            self.old_words, self.old_pieces, self.words, self.pieces = self.words, self.pieces, {}, {}
        words, pieces = self.words, self.pieces  # pieces: what follows a blank -> tokens, the blank included
        parts = [self._pieces(t) for t in texts]
        firsts = [self.cut(p[0]) for p in parts]
        fresh = set(chain.from_iterable(p[1:] for p in parts)).difference(pieces)
        for p in self.old_pieces.keys() & fresh:
            pieces[p] = self.old_pieces[p]
        fresh.difference_update(pieces)
        found = {p: self.cut(" " + p) for p in fresh}
        unseen = {w for ws in chain(firsts, found.values()) for w in ws}.difference(words)
        for w in self.old_words.keys() & unseen:
            words[w] = self.old_words[w]
        unseen.difference_update(words)
        if unseen:
            self._contract(sorted(unseen))
        for p, ws in found.items():
            pieces[p] = words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))
        return [b"".join(chain(map(words.__getitem__, first), map(pieces.__getitem__, islice(p, 1, None))))
                for first, p in zip(firsts, parts)]

    def decode(self, ids: Sequence[bytes]) -> list[bytes]:
        sizes = [len(i) // 4 for i in ids]
        if not sum(sizes):
            return [b""] * len(ids)
        self.db.register("tokens", pa.table({
            "doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
            "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
            "tok": np.frombuffer(b"".join(ids), "<i4")}))
        out = [b""] * len(ids)
        rows = self.db.execute("SELECT doc, array_to_string(list(piece ORDER BY pos), '') FROM tokens "
                               "JOIN vocabulary USING (tok) GROUP BY doc").fetchall()
        for doc, text in rows:
            out[doc] = text.encode("latin-1")
        return out


def worker_coder(path: str, pattern: str) -> Coder:
    """The coder of this Python worker. Functions reach a worker by value, once a task; what tasks of one worker are
    to share, here the words already contracted, must hang on something that the worker imports once."""
    import duckdb

    made = duckdb.__dict__.setdefault("_coders_of_this_worker", {})
    if (path, pattern) not in made:
        made[path, pattern] = Coder(path, pattern)
    return made[path, pattern]


def code_texts(texts: Iterable[str | None], path: str, pattern: str, group_chars: int) -> Iterator[tuple]:
    coder = worker_coder(path, pattern)

    def coded(group: list[str]) -> Iterator[tuple]:
        ids = coder.encode(group)
        for i, d in zip(ids, coder.decode(ids)):
            yield len(i) // 4, i, d

    group, chars = [], 0
    for text in texts:
        group.append(text or "")
        chars += len(group[-1])
        if chars >= group_chars:
            yield from coded(group)
            group, chars = [], 0
    yield from coded(group)


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text",
                  keep: Sequence[str] = ("doc_id",), group_chars: int = 2_000_000) -> DataFrame:
    """Columns ``keep`` plus ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` of each whole text.

    ``path`` is a rank file (token in base 64 and rank a line) and ``pattern`` the expression that cuts words; by
    default those of the installed public vocabulary. A null text counts as empty: no ids, no bytes. Texts are coded
    one by one whatever their length; repeated rows give repeated results, an empty table none. ``group_chars``
    bounds how much text meets in one query.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return with_results(docs, text, RESULT, lambda texts: code_texts(texts, path, pattern, group_chars), keep)


@register("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
