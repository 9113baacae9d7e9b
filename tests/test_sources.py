from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tabsmith.sources import delimited
from tabsmith.sources.audit import FileRejected, audit_folder, check_file
from tabsmith.sources.delimited import TableLoadError, file_encodings, read_csv
from tabsmith.sources.tables import load_table


def write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def test_tiny_csv(spark, tmp_path):
    df = load_table(spark, write(tmp_path / "t.csv", b"col1,col2\n1,2\n3,4\n"))
    assert df.columns == ["col1", "col2"] and df.count() == 2 and dict(df.dtypes) == {"col1": "bigint", "col2": "bigint"}


def test_long_rows_go_and_short_rows_are_padded(spark, tmp_path):
    text = b'a,b,c\n1,x,1\n2,y\n3,"q,""z",2,extra\n4,"q,z",3\n5,w,4,\n6,v,5,,\n'
    got = sorted((r["a"], r["b"], r["c"]) for r in read_csv(spark, write(tmp_path / "t.csv", text)).collect())
    assert got == [(1, "x", 1), (2, "y", None), (4, "q,z", 3)]


def test_missing_tokens_and_types(spark, tmp_path):
    text = b"i,d,s,f\n1,1.5,x,True\nNA,nan,null,False\n3,2,N/A,None\n"
    df = read_csv(spark, write(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "s": "string", "f": "boolean"}
    assert [r["s"] for r in df.orderBy("i").collect()].count(None) == 2
    assert dict(read_csv(spark, str(tmp_path / "t.csv"), infer=False).dtypes)["i"] == "string"


def test_bom_and_latin1_are_told_apart_per_file(spark, tmp_path):
    one = write(tmp_path / "one.csv", b"\xef\xbb\xbfname,n\ncaf\xc3\xa9,1\n")
    two = write(tmp_path / "two.csv", "name,n\nnaïve,2\n".encode("latin-1"))
    assert set(file_encodings(spark, [one, two])) == {"UTF-8", "ISO-8859-1"}
    assert sorted(r["name"] for r in read_csv(spark, [one, two]).collect()) == ["café", "naïve"]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(TableLoadError):
        load_table(spark, write(tmp_path / "empty.csv", b""))
    with pytest.raises(TableLoadError, match="Unsupported"):
        load_table(spark, write(tmp_path / "x.json", b"{}"))
    with pytest.raises(TableLoadError):
        load_table(spark, str(tmp_path / "none.parquet"))


def test_parquet_with_caps(spark, tmp_path):
    spark.range(50).withColumnRenamed("id", "x").write.parquet(str(tmp_path / "t.parquet"))
    path = str(tmp_path / "t.parquet")
    assert sorted(r["x"] for r in load_table(spark, path, max_rows=3, key=["x"]).collect()) == [0, 1, 2]
    assert load_table(spark, path, sample=7, key=["x"]).count() == 7
    with pytest.raises(ValueError, match="key"):
        load_table(spark, path, sample=7)


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows: str) -> str:
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets><sheet name="A" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>name</t></si><si><t>v</t></si><si><r><t>bo</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


def test_workbooks(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    one = workbook(tmp_path / "a.xlsx", head + '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c></row><row r="3"><c r="B3"><v>2</v></c></row>')
    workbook(tmp_path / "b.xlsx", head + '<row r="2"><c r="A2" t="inlineStr"><is><t>eve</t></is></c></row>')
    df = load_table(spark, one)
    assert sorted((r["v"], r["name"]) for r in df.collect()) == [(1.5, "bob"), (2.0, None)]
    assert load_table(spark, str(tmp_path), "xlsx").count() == 3


def test_audit(spark, tmp_path):
    write(tmp_path / "ok.csv", b"a,b\n1,2\n")
    write(tmp_path / "binary.csv", b"\x00\x01" * 50)
    write(tmp_path / "few.csv", b"a,b\n" * 50 + b"\x00" * 4)
    write(tmp_path / "some.csv", b"a,b\n" * 50 + b"\x00" * 5)
    write(tmp_path / "fake.parquet", b"nope")
    write(tmp_path / "fake.xlsx", b"nope")
    write(tmp_path / "old.xls", b"\xd0\xcf\x11\xe0rest")
    write(tmp_path / "notes.txt", b"x")
    write(tmp_path / "big.csv", b"a\n" * 700_000)
    got = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in audit_folder(spark, str(tmp_path), max_mb=1).collect()}
    assert got["ok.csv"] is None and got["old.xls"] is None
    assert got["binary.csv"] == "Holds bytes that no text has"
    assert got["fake.parquet"] == "Does not begin like a Parquet file" and got["fake.xlsx"] == "Does not begin like an .xlsx workbook"
    assert got["notes.txt"].startswith("Extension is none of") and got["big.csv"] == "1.3 MB, above the limit of 1 MB"
    names_only = audit_folder(spark, str(tmp_path), max_mb=1, content=False)
    assert names_only.filter("status = 'ok'").count() == 7
    assert got["few.csv"] is None and got["some.csv"] == got["binary.csv"]


def test_single_file_checks(spark):
    with pytest.raises(FileRejected, match="300.0 MB, above the limit"):
        check_file(spark, "large.csv", 300 * 1024 * 1024, "text/csv", max_mb=200)
    with pytest.raises(FileRejected, match="is not one of a table"):
        check_file(spark, "a.csv", 10, "image/png")
    check_file(spark, "a.csv", 10, "text/csv", head=b"a,b")
    check_file(spark, "a.parquet", 10, "image/png", head=b"PAR1")


def test_every_text_that_casts_to_a_number_is_tested(spark):
    """Only texts of this form are cast, as a failed cast costs an exception a row."""
    texts = ["1", "-1.5", "+.5", "5.", "1e5", "1E-3", "1d", "2F", "0x1p3", "-0X1.8P-2", "NaN", "-nan", "inf", "+Infinity", "-INF", "\t12\n", "\u000112", "1_0", "x", "",
             ".", "1-2", "5-LOW", "1998-02-06", "e5", "١"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.selectExpr("t", "try_cast(t as double) is not null as number").collect()
    assert sum(r["number"] for r in rows) >= 14
    guarded = {r["t"] for r in df.filter(F.col("t").rlike(delimited.MAY_BE_NUMBER)).collect()}
    assert all(r["t"] in guarded for r in rows if r["number"])
    assert not guarded & {"x", "", "5-LOW", "1998-02-06", "1-2", "e5"}
    whole = df.filter("try_cast(t as bigint) is not null and not contains(t, '.')").collect()
    guarded = {r["t"] for r in df.filter(F.col("t").rlike(delimited.MAY_BE_INTEGER)).collect()}
    assert guarded == {r["t"] for r in whole} == {"1", "\t12\n", "\u000112"}
    kinds = spark.createDataFrame([("5-LOW", "1.5", "0x1p3", "-Infinity"), (None, " 2 ", "7", "3")], "a string, b string, c string, d string")
    assert dict(delimited.infer_types(kinds).dtypes) == {"a": "string", "b": "double", "c": "double", "d": "double"}
