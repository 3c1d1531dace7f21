import zipfile

import pytest

from tabwright.sources.files import admit_files, load_file, read_csv_auto, read_excel


def test_csv_encodings_and_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("x,y\n1,é\n2,b\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("x;y\n1;é\n2;b\n".encode("utf-8"))
    (tmp_path / "c.csv").write_bytes("n;e\n1;\xe9\n".encode("latin-1"))
    a = read_csv_auto(spark, str(tmp_path / "a.csv"))
    b = read_csv_auto(spark, str(tmp_path / "b.csv"))
    c = read_csv_auto(spark, str(tmp_path / "c.csv"))
    assert a.columns == ["x", "y"] and a.where("y = 'é'").count() == 1
    assert b.columns == ["x", "y"] and b.count() == 2
    assert c.columns == ["n", "e"] and c.first()["e"] == "é"


def test_unsupported_extension(spark, tmp_path):
    with pytest.raises(ValueError):
        load_file(spark, str(tmp_path / "x.parquet"))


def _xlsx(path):
    ss = ('<?xml version="1.0"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
          '<si><t>name</t></si><si><t>v</t></si><si><t>ab</t></si></sst>')
    sh = ('<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
          '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
          '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>3.5</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", ss)
        z.writestr("xl/worksheets/sheet1.xml", sh)


def test_excel(spark, tmp_path):
    _xlsx(tmp_path / "w.xlsx")
    df = read_excel(spark, str(tmp_path / "w.xlsx"))
    r = df.first()
    assert df.columns == ["name", "v"] and r["name"] == "ab" and r["v"] == 3.5


def test_admit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.txt").write_text("x\n1\n")
    got = {r.extension: r.accepted for r in admit_files(spark, str(tmp_path)).collect()}
    assert got == {"csv": True, "txt": False}


def test_jdbc_derby_roundtrip(spark):
    from tabwright.sources.jdbc import read_jdbc
    url = "jdbc:derby:memory:twtest;create=true"
    df = spark.createDataFrame([(i, float(i) * 2) for i in range(50)], "id int, v double")
    df.write.format("jdbc").option("url", url).option("dbtable", "T1").option(
        "driver", "org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    back = read_jdbc(spark, url, table="T1", driver="org.apache.derby.jdbc.EmbeddedDriver",
                     partition_column="ID", lower_bound=0, upper_bound=50, num_partitions=4)
    assert back.count() == 50
    q = read_jdbc(spark, url, query='SELECT * FROM T1 WHERE "id" < 10', driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert q.count() == 10


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"two\nlines",1\n"say ""hi"", ok",2\n')
    got = [tuple(r) for r in read_csv_auto(spark, str(tmp_path / "q.csv")).orderBy("b").collect()]
    assert got == [("two\nlines", 1), ('say "hi", ok', 2)]


def test_workbook_headers_dates_and_sheet_order(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(ref, v, style=0, text=False):
        return (f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if text else f'<c r="{ref}" s="{style}"><v>{v}</v></c>')

    sheet = (f'<worksheet xmlns="{ns}"><sheetData><row r="1">{cell("A1", "b", text=True)}{cell("C1", "b", text=True)}'
             f'{cell("D1", "day", text=True)}</row><row r="2">{cell("A2", 1)}{cell("B2", 2)}{cell("C2", 3)}{cell("D2", 45292, 1)}'
             f'{cell("E2", 9)}</row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "h.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="x" sheetId="2" r:id="r2"/>'
                   '<sheet name="y" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", sheet)
    df = read_excel(spark, str(tmp_path / "h.xlsx"), infer_types=False)
    assert df.columns == ["b", "Unnamed: 1", "b.1", "day", "Unnamed: 4"]
    assert tuple(df.first()) == ("1", "2", "3", "2024-01-01", "9")
