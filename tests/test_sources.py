import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators.masks import png_bytes
from quillwork.plans import flows
from quillwork.scratch import materialise, scratch_dir
from quillwork.sources import delimited as D
from quillwork.sources import files as Fl
from quillwork.sources import records as R
from quillwork.streaming.incremental import embed_stream


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_file(spark, tmp_path, sep):
    lines = ["about this file", "made by hand", sep.join(["id", "code", "name", "x"])]
    lines += [sep.join(["1", "007", f'"a{sep}b"', "1.5"]), sep.join(["2", "008", "c", ""]), sep.join(["3", "009", "d"]),
              sep.join(["4", "010", "e", "2", "extra"]), "", sep.join(["5", "011", "NA", "3"])]
    df = D.read_delimited(spark, write(tmp_path, "t.txt", "\n".join(lines)), sep)
    assert dict(df.dtypes) == {"id": "bigint", "code": "string", "name": "string", "x": "double"}
    got = {r["id"]: (r["code"], r["name"], r["x"]) for r in df.collect()}
    assert got == {1: ("007", f"a{sep}b", 1.5), 2: ("008", "c", None), 3: ("009", "d", None), 5: ("011", None, 3.0)}


def test_headers_go_by_their_place(spark, tmp_path):
    for name, rows in (("a.csv", ["k,v", "1,x", "k,v", "2,y"]), ("b.csv", ["k,v", "3,z"])):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    rows = D.read_delimited(spark, str(tmp_path), ",", ".csv", infer=False).collect()
    assert sorted((r["k"], r["v"]) for r in rows) == [("1", "x"), ("2", "y"), ("3", "z"), ("k", "v")]


def test_sniffing(spark, tmp_path):
    for sep, ext in ((";", ".csv"), ("|", ".txt"), ("\t", ".tsv"), (",", ".csv")):
        path = write(tmp_path, f"s{ord(sep)}{ext}", sep.join("abc") + "\n" + sep.join("123") + "\n")
        assert D.sniff_delimiter(D.read_lines(spark, path), ext).first()["delimiter"] == sep
        assert Fl.read_any(spark, path).first()[:] == (1, 2, 3)
    one = spark.createDataFrame([(0, "single")], "line_no int, value string")
    assert D.sniff_delimiter(one, ".tsv").first()["delimiter"] == "\t"


def test_prelude(spark):
    def start(lines):
        df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
        return D.data_start(df, ",").first()["start"]

    assert start(["note", "", "a,b", "1,2", "3,4"]) == 2 and start(["a,b", "1,2", "3,4"]) == 0
    assert start(["x", "a,b"]) == 0 and start(["note", "a,b", "1,2"]) == 0


def test_header_checks():
    assert D.header_names('a,"b,c",a', ",") == ["a", "b,c", "a.1"]
    assert D.header_problems(["A", " a"]) == ["duplicate column name a"] and D.header_problems(["", " "])


def test_validation(spark, tmp_path):
    path = write(tmp_path, "v.csv", "a,b\n1,x\n1,x\n2,null\n3\n4,5,6\n")
    assert tuple(Fl.validate_file(spark, path).first()) == (5, 2, 1, 1)
    records = [{"a": 1, "b": " "}, {"b": "y", "a": 2}, {"a": 1, "b": " "}, {"a": None, "c": {"d": 1}}]
    path = write(tmp_path, "v.jsonl", "\n".join(map(json.dumps, records)) + "\n[1]\n")
    row = Fl.validate_file(spark, path).first()
    assert (row["row_count"], row["skipped"], row["columns"], row["duplicate_records"], row["different_keys"]) == (4, 1, ["a", "b", "c"], 1, 1)
    assert row["null_cells"] == 4 * 3 - (3 + 1 + 1)
    path = write(tmp_path, "v.json", json.dumps([{"a": 1}, {"a": 2}]))
    assert Fl.validate_file(spark, path).first()["row_count"] == 2 and Fl.read_any(spark, path).count() == 2
    assert Fl.validate_file(spark, write(tmp_path, "v.txt", "a\nb\n")).first()["row_count"] == 2
    with pytest.raises(ValueError):
        Fl.validate_file(spark, write(tmp_path, "v.xlsx", "a"))


def test_schema_hash(spark):
    import hashlib
    got = spark.range(1).select(D.schema_hash(F.array(F.lit(" B"), F.lit("a")))).first()[0]
    assert got == hashlib.sha256(b"a|b").hexdigest()


def test_encodings(spark, tmp_path):
    texts = {"utf-8": "naïve".encode(), "utf-8-sig": b"\xef\xbb\xbfabc", "utf-16": "abc".encode("utf-16"),
             "utf-16-le (no BOM)": "abcdef".encode("utf-16-le"), "utf-16-be (no BOM)": "abcdef".encode("utf-16-be"),
             "cp1252": "caf\xe9 \x80".encode("latin-1"), "latin-1": b"\xe9\x81"}
    for i, raw in enumerate(texts.values()):
        write(tmp_path, f"{i}.txt", raw)
    got = {r["name"]: (r["encoding"], r["content"]) for r in Fl.read_text_files(spark, str(tmp_path)).collect()}
    assert [got[f"{i}.txt"][0] for i in range(len(texts))] == list(texts)
    assert got["5.txt"][1] == "café €" and got["3.txt"][1] == "abcdef"


def test_images(spark, tmp_path):
    write(tmp_path, "a.png", png_bytes(np.zeros((5, 4), np.uint8)))
    write(tmp_path, "b.png", b"broken")
    write(tmp_path, "c.txt", png_bytes(np.zeros((5, 4), np.uint8)))
    got = {r["name"]: (r["width"], r["height"], r["mode"], r["problem"]) for r in Fl.read_image_metadata(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (4, 5, "L", None), "b.png": (None, None, None, "unreadable image"), "c.txt": (4, 5, "L", "unsupported extension")}


def test_json_safe(spark):
    df = spark.sql("select double('nan') a, array(double('inf'), 1d) b, named_struct('c', float('nan')) s, map('k', double('-inf')) m")
    row = Fl.json_safe(df).first()
    assert (row["a"], row["b"], row["s"]["c"], row["m"]) == (None, [None, 1.0], None, {"k": None})


def test_small_queries(spark):
    df = spark.createDataFrame([(1, "b", True), (2, "A", False), (3, None, True), (4, "b", None)], "k int, s string, f boolean")
    assert Fl.column_types(df) == [("k", True), ("s", False), ("f", False)] and Fl.column_names(df) == ["k", "s", "f"]
    assert [tuple(r) for r in Fl.column_values(df, "s", "k").collect()] == [("A", False), ("b", False)]
    assert [tuple(r) for r in Fl.column_values(df, "s", "k", 1).collect()] == [("b", True)]
    assert tuple(Fl.column_range(df, "k").first()) == (1.0, 4.0, 2.5)


def test_scratch_is_the_sessions_folder(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert materialise(spark.range(5)).count() == 5


def test_stream_embeds_each_asset_once(spark, tmp_path):
    source, store = tmp_path / "assets", str(tmp_path / "vectors")
    spark.range(5).write.parquet(str(source))

    def run():
        stream = spark.readStream.schema("id long").parquet(str(source))
        query = embed_stream(stream, store, str(tmp_path / "cp"), "id", "vec_id",
                             lambda df: df.select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v")))
        query.awaitTermination(120)

    run()
    spark.range(3, 8).write.mode("append").parquet(str(source))
    run()
    assert sorted(r["vec_id"] for r in spark.read.parquet(store).collect()) == list(range(8))


def test_stream_by_state_embeds_each_asset_once(spark, tmp_path):
    from quillwork.streaming.incremental import embed_stream_by_state, state_size

    source, store = tmp_path / "in", str(tmp_path / "vectors")

    def run(lose=None):
        def embed(df):
            if lose:
                raise RuntimeError(lose)
            return df.select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v"))

        query = embed_stream_by_state(spark.readStream.schema("id long").parquet(str(source)), store, str(tmp_path / "cp"), "id", embed)
        query.awaitTermination(120)
        return query

    spark.range(0, 6).union(spark.range(0, 3)).write.parquet(str(source))
    run()
    spark.range(4, 9).write.mode("append").parquet(str(source))
    with pytest.raises(Exception, match="power cut"):
        run("power cut")  # in the middle of the second batch
    spark.range(8, 12).write.mode("append").parquet(str(source))
    size = state_size(run())
    assert sorted(r["vec_id"] for r in spark.read.parquet(store).collect()) == list(range(12))
    assert size["rows"] == 12 and size["bytes"] > 0


def test_recorded_path_comes_first(spark, tmp_path):
    for name, rows in (("cleaned_a.csv", "a\n9\n"), ("b.csv", "a\n1\n"), ("c.csv", "a\n2\n")):
        (tmp_path / name).write_text(rows)
    assert Fl.read_recorded(spark, str(tmp_path), str(tmp_path / "c.csv")).first().a == 2
    assert Fl.read_recorded(spark, str(tmp_path), str(tmp_path / "gone.csv")).first().a == 1
    with pytest.raises(FileNotFoundError):
        Fl.read_recorded(spark, str(tmp_path / "nothing"))


def test_rules_on_missing_columns_are_reported(spark):
    from quillwork.operators import rules

    found = rules.load_rules([{"label": "x", "column": "gone", "operator": "equals", "value": 1},
                              {"label": "y", "column": "id", "operator": "equals", "value": 1}])
    rows = [tuple(r) for r in rules.rule_report(spark.range(3), found).filter("section = 'warning'").collect()]
    assert rows == [("warning", "rule 0: columns ['gone'] do not exist, their conditions never match", 1)]


def test_steps(spark):
    handlers = {"structuring": lambda df, c: df.filter("id > 1"), "export": lambda df, c: 1 / 0}
    steps = [{"step_type": "structuring", "name": "a", "config": {}}, {"step_type": "labeling", "name": "b", "config": {}},
             {"step_type": "export", "name": "c", "config": {}}, {"step_type": "structuring", "name": "d", "config": {}}]
    out, report = flows.run_steps(spark.range(4), steps, handlers)
    assert out.count() == 2 and [r[2] for r in report] == ["completed", "skipped", "failed"]
    for bad in ([], [{"step_type": "magic", "name": "a", "config": {}}], [{"step_type": "eda", "config": {}}], [{"step_type": "eda", "name": "a"}]):
        with pytest.raises(ValueError):
            flows.check_steps(bad)


def test_records(spark):
    lines = spark.createDataFrame([(0, '{"a": 1}'), (1, "[1]"), (2, '{"a": null}')], "line_no int, value string")
    assert [r["a"] for r in R.parse_records(lines, "a int").orderBy("line_no").collect()] == [1, None]


def test_headed_lines_fill_many_files_that_each_have_the_head(spark, tmp_path):
    from bindings.sources import headed

    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("r"), "id").alias("value"))
    headed(rows, "made for\nkey").write.text(str(tmp_path / "many"))
    headed(rows.limit(0), "key").write.text(str(tmp_path / "none"))
    texts = [p.read_text() for p in sorted((tmp_path / "many").glob("part*"))]
    assert len(texts) == 5 and all(t.startswith("made for\nkey\n") and t.count("key") == 1 for t in texts)
    assert sorted("".join(texts).split()) == sorted([f"r{i}" for i in range(40)] + 5 * ["made", "for", "key"])
    assert [p.read_text() for p in (tmp_path / "none").glob("part*")] == ["key\n"]


def test_pair_scores_are_those_of_all_pairs(spark):
    import math
    from collections import Counter

    from quillwork.sources import encodings as E

    texts = [b"", b"plain only", "é".encode("latin-1"), "caf\xe9 \xfc, a\xe9\xe9 b 12 \xdf".encode("latin-1") * 3, b"\xe9 " + b"word " * 4000 + b"\xff"]
    found = [r["s"] for r in spark.createDataFrame([(bytearray(t),) for t in texts], "b binary").select(E.pair_scores(F.col("b")).alias("s")).collect()]
    for t, row in zip(texts, found):
        kinds = "".join(map(E.class_of, t))
        counted = Counter(zip(kinds, kinds[1:]))
        for name, weights in E.pair_weights().items():
            assert math.isclose(row[name], sum(counted[a, b] * w for (a, b), w in weights.items()), abs_tol=1e-6)


def test_pair_scores_keep_no_long_runs(spark, monkeypatch):
    """What pairs are counted in holds two characters at most of a run without upper bytes."""
    from quillwork.sources import encodings as E

    seen = []
    translate = F.translate
    monkeypatch.setattr(E.F, "translate", lambda c, a, b: seen.append(c) or translate(c, a, b))
    E.pair_scores(F.col("b"))
    df = spark.createDataFrame([(bytearray(b"\xe9" + b"word " * 400 + b"\xff" + b"tail " * 400),)], "b binary")
    assert len(df.select(seen[0]).first()[0]) == 6


def test_files_are_decoded_in_slices_of_a_batch():
    import pyarrow as pa

    from quillwork.sources import encodings as E

    texts = [None if i % 7 == 0 else f"é {i}" for i in range(2 * E.DECODED + 3)]
    raw = pa.array([None if t is None else t.encode("utf-16") for t in texts], pa.binary())
    found = E._decoded.func(raw, pa.array(["utf-16"] * len(texts)))
    assert found.field("text").to_pylist() == texts and set(found.field("encoding").to_pylist()) == {None, "utf-16"}
    assert E._decoded.func(pa.array([b"\xff\xe9"]), pa.array(["cp1251"])).to_pylist()[0]["text"] == "яй"
    assert len(E._decoded.func(raw[:0], pa.array([], pa.string()))) == 0
