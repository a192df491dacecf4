"""Text encodings, told apart by engine expressions.

A file is named by its mark, by where its zero bytes stand, or as UTF-8 if it is valid. What is left is judged by the
likelihood of its pairs of neighbouring bytes under each encoding. Bytes fall into a few classes, the likelihoods come
from sentences encoded with each codec, and the sum over a text is a sum of pair counts, so lines of one file add up.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks at the start of a file with the names reported for them, the sample looked at for zero bytes, the
# share of it from which a file without a mark is 16-bit text, and what is tried when nothing else decodes.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
ZERO_SAMPLE, ZERO_SHARE = 4096, 1 / 3
LAST = "latin-1"

#: Sentences whose bytes show what text in an encoding looks like.
SAMPLES = {
    "cp1252": ("Les élèves français ont déjà reçu les résultats; où êtes-vous allés cet été, à Noël? L’hôtel était complet. "
               "Über die Größe der Häuser läßt sich streiten – schöne Grüße aus München. Das Gemüse wächst für alle „früh“. "
               "El niño pequeño comió una manzana mañana; ¿dónde está la estación? Così è più facile, perché no? "
               "São Paulo não é tão longe, informações e opções. Smörgåsbord på svenska, kräftskiva för två. Café, naïve, €5. "),
    "cp1251": ("Съешь же ещё этих мягких французских булок, да выпей чаю. Дом стоит на берегу реки, где летом много людей. "
               "Первый отчёт за год был готов в понедельник; цена выросла на 5 процентов. Они живут в Москве и работают вместе. "
               "Все счастливые семьи похожи друг на друга. Київ — столиця України, її населення зростає. Имя, адрес, Телефон. "),
    "shift_jis": ("これは日本語の文章です。東京都の人口は多いと言われています。私は毎日コーヒーを飲みながら新聞を読みます。"
                  "データの処理を始める前に、ファイルの名前を確認してください。カタカナとひらがな、漢字が混ざっています。123円、番号。"
                  "名前, 住所, 電話番号 会社の製品についてのお問い合わせはこちらへ。山田さんは昨日、大阪へ行きました。"),
    "gb18030": ("这是一个用中文写的句子。北京的人口很多,我们每天都在学习新的知识。请在处理数据之前检查文件的名称。"
                "公司的产品非常受欢迎,价格也不贵。他昨天去了上海,今天回到家里。姓名, 地址, 电话号码 第123号。"
                "天气很好,大家都出去散步了。我们应该更加努力地工作,为了更好的生活。"),
}
#: Plain words stand in text of every encoding, apart from its own letters.
PLAIN = ("The table has a name, an address and a phone number in each of its rows; some values are missing, others are not. "
         "Please read the first lines of this file before you use the numbers in it. Total 100, price 25.50, code A7. ") * 2
#: Classes of bytes: control and blank, digits and signs, letters, and the upper half in sixteenths.
CLASSES = "bsl" + "89ABCDEF"


def class_of(byte: int) -> str:
    if byte >= 0x80:
        return f"{byte >> 4:X}"
    return "b" if byte <= 0x20 else "l" if chr(byte).isalpha() else "s"


@cache
def pair_weights() -> dict[str, dict[str, float]]:
    """Log likelihood of each pair of classes with an upper byte in it, by encoding."""
    out = {}
    for name, text in SAMPLES.items():
        kinds = "".join(map(class_of, (text + PLAIN).encode(name)))
        seen, pairs = Counter(kinds[:-1]), Counter(zip(kinds, kinds[1:]))
        out[name] = {a + b: math.log((pairs[a, b] + 0.2) / (seen[a] + 0.2 * len(CLASSES)))
                     for a in CLASSES for b in CLASSES if not (a in "bsl" and b in "bsl")}
    return out


def bytes_as_chars(content: Column) -> Column:
    """A string with one character for each byte."""
    return F.decode(content, "ISO-8859-1")


def pair_scores(content: Column) -> Column:
    """Struct of the log likelihoods of the bytes under each encoding, to be added up over lines.

    Pairs are counted by taking them out, each once: a pair of two classes cannot overlap itself, and of a class with
    itself a run of n holds n - 1.
    """
    edges = F.regexp_replace(bytes_as_chars(content), r"([\x00-\x7f])[\x00-\x7f]*([\x00-\x7f])", "$1$2")  # of runs away from upper bytes
    kinds = F.translate(edges, "".join(map(chr, range(256))), "".join(map(class_of, range(256))))

    def count(k: Column, pair: str) -> Column:
        if pair[0] != pair[1]:
            return (F.length(k) - F.length(F.replace(k, F.lit(pair), F.lit("")))) / 2
        return F.length(k) - F.length(F.regexp_replace(k, f"{pair[0]}(?={pair[0]})", ""))

    weights = pair_weights()
    pairs = list(next(iter(weights.values())))
    # one element, so that the classes are made once and the counts are, too
    counted = F.transform(F.array(kinds), lambda k: F.array(*[count(k, p).cast("double") for p in pairs]))
    added = F.transform(counted, lambda c: F.struct(*[
        F.aggregate(F.zip_with(c, F.array(*[F.lit(w[p]) for p in pairs]), lambda n, x: n * x), F.lit(0.0), lambda t, x: t + x).alias(n)
        for n, w in weights.items()]))
    return F.get(added, F.lit(0))


def likeliest(scores: dict[str, Column], lead: float = 10.0) -> Column:
    """The encoding with the highest score; the first one needs no evidence, the others a ``lead`` over it."""
    ranked = F.array(*[F.struct((s - F.lit(lead if i else 0.0)).alias("score"), F.lit(-i).alias("turn"), F.lit(n).alias("name"))
                       for i, (n, s) in enumerate(scores.items())])
    return F.array_max(ranked)["name"]


def likeliest_of(content: Column) -> Column:
    found = F.transform(F.array(pair_scores(content)), lambda s: likeliest({n: s[n] for n in SAMPLES}))
    return F.get(found, F.lit(0))


def zeros(content: Column, odd: bool) -> Column:
    """Zero bytes at odd or at even places of the sample."""
    pairs = F.regexp_extract_all(F.hex(F.substring(content, 1, ZERO_SAMPLE)), F.lit("(..)(..)"), F.lit(2 if odd else 1))
    return F.size(F.filter(pairs, lambda b: b == "00"))


def marked(content: Column) -> Column:
    """The name that belongs to the mark a file begins with, or null."""
    name = None
    for mark, known in MARKS:
        starts = F.substring(content, 1, len(mark)) == F.lit(bytearray(mark))
        name = F.when(starts, known) if name is None else name.when(starts, known)
    return name


def encoding_name(content: Column) -> Column:
    """The name of the encoding of whole files: a mark, 16-bit text without one, UTF-8, or the likeliest other one."""
    even, odd = zeros(content, False), zeros(content, True)
    sample = F.least(F.length(content), F.lit(ZERO_SAMPLE))
    wide = F.contains(content, F.lit(bytearray(b"\x00"))) & ((even + odd) > sample * F.lit(ZERO_SHARE))
    other = (F.when(wide & (odd >= even), "utf-16-le (no BOM)").when(wide, "utf-16-be (no BOM)")
             .when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise(likeliest_of(content)))
    return F.coalesce(marked(content), other)


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


DECODED = 256  # files whose text is held beside their bytes


@F.arrow_udf(_TEXT)
def _decoded(content: pa.Array, name: pa.Array) -> pa.Array:
    """Text by the codec named; where that fails UTF-8, where that fails Latin-1, which never does."""
    parts = []
    for begin in range(0, len(content), DECODED):
        rows = []
        for raw, first in zip(content.slice(begin, DECODED).to_pylist(), name.slice(begin, DECODED).to_pylist()):
            row = (None, None)
            for known in (first, "utf-8", LAST) if raw is not None else ():
                try:
                    text = raw.decode(known.removesuffix(" (no BOM)"))
                except UnicodeDecodeError:
                    continue
                row = (text.replace("\x00", ""), known)
                break
            rows.append(row)
        parts.append(pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["text", "encoding"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("encoding", pa.string())]))


def decode_bytes(content: Column) -> Column:
    """Struct (text, encoding) of whole files; UTF-8 without a mark stays in the engine, only the rest goes to Python."""
    plain = marked(content).isNull() & F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(bytearray(b"\x00")))
    other = _decoded(F.when(~plain, content), F.when(~plain, encoding_name(content)))
    return F.when(content.isNull(), F.lit(None)).when(
        plain, F.struct(content.cast("string").alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(other)


@cache
def upper_half(name: str) -> str:
    """The characters of the bytes 80 to FF in a codec of single bytes; bytes it does not know are those of Latin-1."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(0x80, 0x100))


def decode_lines(value: Column, name: Column) -> Column:
    """Lines whose bytes are in the encoding ``name``, as text; single-byte encodings stay in the engine."""
    raw = value.cast("binary")
    chars = bytes_as_chars(raw)
    text = F.when(name == "utf-8", value)
    for single in ("cp1252", "cp1251"):
        known = [(chr(b), c) for b, c in zip(range(0x80, 0x100), upper_half(single)) if chr(b) != c]
        met = F.translate(chars, "".join(a for a, _ in known), "".join(c for _, c in known))
        # most lines have none of the characters that differ from Latin-1, and need no step for each character
        text = text.when(name == single, F.when(F.regexp_like(chars, F.lit("[" + "".join(f"\\x{ord(a):02x}" for a, _ in known) + "]")), met).otherwise(chars))
    others = ~name.isin("utf-8", "cp1252", "cp1251")
    return text.otherwise(_decoded(F.when(others, raw), F.when(others, name))["text"])
