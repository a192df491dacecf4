"""Quoted line breaks and encodings of tabular files, read in small splits."""

import csv
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillwork.sources import delimited as D
from quillwork.sources import encodings as E
from quillwork.sources import files as Fl
from quillwork.sources import quoting as Q

MAX = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set(MAX, str(size))

    before = spark.conf.get(MAX)
    yield use
    spark.conf.set(MAX, before)


def table(rng, rows):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "note", "more"])
    for i in range(rows):
        words = [rng.choice(["plain", "a,b", 'say "hi"', "two\nlines", "\n", '"', "", "end\n\n", "é", ",\n,"]) for _ in range(rng.randint(1, 4))]
        writer.writerow([i, "".join(words), rng.choice(["x", "y\nz", '"q"'])])
    return out.getvalue()


@pytest.mark.parametrize("split", [64, 200, 4096, 1 << 27])
def test_quoted_line_breaks_equal_another_reader(spark, tmp_path, small_splits, split):
    path = tmp_path / "t.csv"
    path.write_text(table(random.Random(split), 400), newline="")
    small_splits(split)
    got = D.read_delimited(spark, str(path), ",", infer=False).collect()
    expected = duckdb.sql(f"SELECT * FROM read_csv('{path}', header=true, all_varchar=true, quote='\"', escape='\"', delim=',')").fetchall()

    def missing(v):
        return None if v in D.MISSING else v

    assert sorted((int(r.id), r.note, r.more) for r in got) == sorted((int(a), missing(b), missing(c)) for a, b, c in expected)
    if split == 64:
        assert D.read_lines(spark, str(path)).rdd.getNumPartitions() > 20 and D.read_lines(spark, str(path)).select("block").distinct().count() > 20


def test_cell_longer_than_a_block_and_files_apart(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}, \"\"quoted\"\"" for i in range(500))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,x\n')
    (tmp_path / "b.csv").write_text('k,v\n3,"a\nb"\n4,y')
    small_splits(100)
    got = {r.k: r.v for r in D.read_delimited(spark, str(tmp_path), ",", ".csv", infer=False).collect()}
    assert got == {"1": long.replace('""', '"'), "2": "x", "3": "a\nb", "4": "y"}


def test_quotes_that_are_not_quotes(spark, tmp_path, small_splits):
    lines = ["k,v", '1,5" pipe', "2,x", '3,"never closed', "4,y", "5,z"]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    for size in (20, 1 << 27):
        small_splits(size)
        got = {r.k: r.v for r in D.read_delimited(spark, str(tmp_path / "s.csv"), ",", infer=False).collect()}
        assert got == {"1": '5" pipe', "2": "x", "3": '"never closed', "4": "y", "5": "z"}


def plain_end(line, inside):
    """The state at the end of a line, character by character."""
    begins, i = True, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    inside, begins = False, False
        elif c == '"' and begins:
            inside = True
        elif c == ",":
            begins = True
        else:
            begins = False
        i += 1
    return inside


def test_steps_equal_a_plain_automaton(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice(['a', ',', '"', '""', ',"', '",']) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    # a doubled quote outside of a quoted cell that begins one is an empty cell; text may follow it only unquoted
    frame = spark.createDataFrame([(x,) for x in lines], "v string").select("v", Q.quote_step(F.col("v"), ",").alias("s"))
    table = {(False, True): Q.STAY, (True, False): Q.SWITCH, (False, False): Q.OUTSIDE, (True, True): Q.INSIDE}
    bad = [(r.v, r.s) for r in frame.collect() if table[plain_end(r.v, False), plain_end(r.v, True)] != r.s]
    assert bad == []


def test_plain_files_take_no_further_pass(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    lines = D.read_lines(spark, str(tmp_path / "p.csv"))
    assert Q.whole_records(lines, ",") is lines


WORDS = {"cp1252": "Straße façade élève", "cp1251": "Привет, как дела сегодня", "shift_jis": "今日はとても良い天気です",
         "gb18030": "今天天气很好我们出去玩"}


@pytest.mark.parametrize("name", list(WORDS))
def test_encodings_of_files_and_tables(spark, tmp_path, name):
    text = "".join(f"{i};{WORDS[name].replace(',', '')};{i}.5\n" for i in range(40))
    (tmp_path / "t.txt").write_bytes(("n;word;x\n" + text).encode(name))
    row = Fl.read_text_files(spark, str(tmp_path)).first()
    assert (row.encoding, row.content) == (name, "n;word;x\n" + text)
    got = D.read_delimited(spark, str(tmp_path / "t.txt"), extension=".csv")
    assert dict(got.dtypes) == {"n": "bigint", "word": "string", "x": "double"}
    assert {r.word for r in got.collect()} == {WORDS[name].replace(",", "")}


def test_wide_tables(spark, tmp_path):
    for i, name in enumerate(["utf-16", "utf-16-le"]):
        path = tmp_path / f"{i}.csv"
        path.write_bytes('k,v\r\n1,"ਊĀ\r\nb"\r\n2,c'.encode(name))
        assert sorted(tuple(r) for r in D.read_delimited(spark, str(path), ",", infer=False).collect()) == [("1", "ਊĀ\nb"), ("2", "c")]


def test_plain_text_stays_in_the_engine(spark):
    rows = spark.createDataFrame([(bytearray("naïve".encode()),), (None,)], "c binary")
    assert [r.d and tuple(r.d) for r in rows.select(E.decode_bytes(F.col("c")).alias("d")).collect()] == [("naïve", "utf-8"), None]


def test_report_of_a_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('made by hand\nfor a test\nID,b,id\n1,"x\ny",3\n1,"x\ny",3\n2,null,4\n3,z\n')
    row = D.check_delimited(spark, str(path)).first()
    assert (row.row_count, row.inconsistent_rows, row.null_cells, row.duplicate_rows) == (4, 1, 1, 1)
    assert row.problems == ["duplicate column name id"] and row.columns == ["ID", "b", "id"]
    assert row.sample == [["1", "x\ny", "3"], ["1", "x\ny", "3"], ["2", "null", "4"], ["3", "z"]]
    assert tuple(Fl.validate_file(spark, str(path)).first()) == (4, 1, 1, 1)
