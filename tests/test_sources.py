import io
import zipfile

import pytest

from quern.sources import files as S


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "t": "a"}\n\n[1]\n{bad\n{"id": 2}\n')
    good, bad = S.read_jsonl(spark, str(p), "id long, t string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "a"), (2, None)] and bad.count() == 2
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.read_jsonl(spark, str(p), "id long, t string", strict=True)[0].collect()
    with pytest.raises(ValueError, match="null"):
        S.required(good, ("id", "t"))


def test_gold_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cases": [{"id": "x"}, {"id": "y"}]}')
    (tmp_path / "b.json").write_text('[{"id": "z"}]')
    assert [r["id"] for r in S.read_gold(spark, str(tmp_path / "a.json")).collect()] == ["x", "y"]
    assert [r["id"] for r in S.read_gold(spark, str(tmp_path / "b.json")).collect()] == ["z"]


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "_template": true}\n{"id": "2"}\n')
    (tmp_path / "b.csv").write_text('id,note\n3,"two\nlines"\n')
    got = {r["id"]: (r["note"], r["_file"]) for r in S.read_mixed(spark, str(tmp_path)).collect()}
    assert got == {"2": (None, "a.jsonl"), "3": ("two\nlines", "b.csv")}


def test_dated_texts(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "20230405.txt").write_text("one\ntwo")
    r = S.read_texts(spark, str(tmp_path)).first()
    assert r["text"] == "one\ntwo" and str(r["time"]) == "2023-04-05 19:00:00"


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S.MAIN[1:-1]}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{S.MAIN[1:-1]}"><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="C1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(workbook())
    (tmp_path / "~$x.xlsx").write_bytes(b"lock")
    assert [r["cells"] for r in S.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()] == [["bc", "", "5"], ["", "x"]]


def test_promotion_and_rollback(spark, tmp_path):
    staged, official, backup = (f"{tmp_path}/{n}" for n in ("staged", "official", "backup"))
    spark.range(3).write.parquet(official)
    spark.range(5).write.parquet(staged)
    with pytest.raises(PermissionError):
        S.promote(spark, staged, official, backup, confirm="")
    with pytest.raises(ValueError, match="blockers"):
        S.promote(spark, staged, official, backup, confirm="promote", blockers=spark.range(1))
    report = S.promote(spark, staged, official, backup, confirm="promote")
    assert spark.read.parquet(official).count() == 5
    S.roll_back(spark, report, confirm="rollback")
    spark.catalog.clearCache()
    assert spark.read.parquet(official).count() == 3


def test_sinks(spark, tmp_path):
    S.write_jsonl(spark.range(3), f"{tmp_path}/j", single=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    S.write_sections({"s": spark.createDataFrame([("a", 1)], "label string, n int")}, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["section"] == "s"
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, part string")
    S.overwrite_part(df, f"{tmp_path}/p", "part")
    S.overwrite_part(df.filter("part = 'y'").selectExpr("v + 10 as v", "part"), f"{tmp_path}/p", "part")
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 12]


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n[1]\n' + '{"id": 2}\n' * 3000 + "{bad\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, errors = S.read_jsonl_errors(spark, str(tmp_path / "x.jsonl"), "id long")
        assert [tuple(r) for r in errors.orderBy("line").collect()] == [("x.jsonl", 3, "line 3: not an object"), ("x.jsonl", 3004, "line 3004: not an object")]
        assert sorted(r["_line"] for r in rows.collect()) == [1, *range(4, 3004)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_discovery(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for n in ("gold_a.jsonl", "deep/gold_longer.jsonl", "other.jsonl", "other.csv", "~$2021.csv", "t2021.csv", "t2020.csv"):
        (tmp_path / n).write_text("x")
    names = [p.rsplit("/", 1)[1] for p in S.discovered(spark, str(tmp_path), ["*.jsonl", "o*.jsonl"], prefer="Gold")]
    assert names == ["gold_a.jsonl", "gold_longer.jsonl", "other.jsonl"]
    got = S.by_year(spark, str(tmp_path), [2021], "*.csv").select("path").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["t2021.csv"]
    assert S.by_year(spark, str(tmp_path), [1999], "*.csv").count() == 0


def test_targets(spark, tmp_path):
    df, path = spark.sql("SELECT 1 AS id, array(1.0, 2.0) AS v"), f"{tmp_path}/t"
    with pytest.raises(ValueError, match="length 3"):
        S.target(df, path, dimension=("v", 3))
    S.target(df, path, dimension=("v", 2))
    with pytest.raises(Exception, match="(?i)exist"):
        S.target(df, path)
    S.target(df, path, append=True)
    assert spark.read.parquet(path).count() == 2
    S.target(df, path, recreate=True)
    assert spark.read.parquet(path).count() == 1


def test_cached_results(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    get = lambda at: S.cached(spark, f"{tmp_path}/c", "news:1", make, seconds=60, now=at).count()
    assert [get(1000.0), get(1059.0), get(1060.5), get(1061.0)] == [1, 1, 2, 2]
    S.drop_cached(spark, f"{tmp_path}/c", "news:1")
    assert get(1062.0) == 3
    (tmp_path / "file").write_text("")
    assert S.cached(spark, f"{tmp_path}/file", "k", make).count() == 4  # a folder that cannot be written: made, not kept


def test_promotion_that_broke_off(spark, tmp_path):
    staged, official, backup = (f"{tmp_path}/{n}" for n in ("staged", "official", "backup"))
    spark.range(3).write.parquet(f"{official}.replaced")
    spark.range(5).write.parquet(staged)
    report = S.promote(spark, staged, official, backup, confirm="promote")
    assert (spark.read.parquet(official).count(), spark.read.parquet(backup).count()) == (5, 3)
    S.roll_back(spark, report, confirm="rollback")
