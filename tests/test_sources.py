import io
import zipfile

import pytest
from pyspark.sql import functions as F

from logveil.operators import ledger, vault, verdicts
from logveil.sources import audit, text, xlsx
from logveil.streaming import ledger as streams


@pytest.mark.parametrize(
    "raw,encoding,out",
    [
        (b"", "utf-8", ""),
        ("﻿a\r\nb".encode(), "utf-8", "a\nb"),
        ("a\rb".encode("utf-16"), "utf-16-le", "a\nb"),
        ("plain words here".encode("utf-16-be"), "utf-16-be", "plain words here"),
        ("x".encode("utf-32"), "utf-32-le", None),
        (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", "utf-8", None),
        ("漢字かな交じり".encode(), "utf-8", "漢字かな交じり"),
    ],
)
def test_decoding(raw, encoding, out):
    got, name, error = text.decode(raw)
    assert (got, name) == (out, encoding) and (error is None) == (out is not None)


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("eins\r\nzwei".encode("utf-16"))
    (tmp_path / "b.bin").write_bytes(b"\0\1\2")
    got = {r.path.rpartition("/")[2]: r for r in text.read(spark, str(tmp_path)).collect()}
    assert got["a.log"].text == "eins\nzwei" and got["b.bin"].error == "binary"


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="urn:r"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>user</t></si><si><r><t>an</t></r><r><t>na</t></r></si></sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"/></row><row><c r="B3" t="inlineStr"><is><t>x, y</t></is></c><c r="C3"><v>1.5</v></c><c t="b"><v>1</v></c></row>'
    assert xlsx.to_csv(workbook({"One": rows})) == 'user,,7\r\n,"x, y",1.5,True\r\n'
    two = xlsx.to_csv(workbook({"One": '<row><c t="s"><v>1</v></c></row>', "Two": '<row><c><v>3</v></c></row>'}))
    assert two == "# --- Sheet: One ---\nanna\r\n\n# --- Sheet: Two ---\n3\r\n"
    (tmp_path / "a.xlsx").write_bytes(workbook({"S": rows}))
    (tmp_path / "b.xlsx").write_bytes(b"no")
    spark.dataSource.register(xlsx.XlsxSource)
    got = {r.path.rpartition("/")[2]: r for r in spark.read.format("xlsx").load(str(tmp_path)).collect()}
    assert got["a.xlsx"].csv.startswith("user") and got["b.xlsx"].error
    with pytest.raises(ValueError):
        xlsx.to_csv(workbook({"Bomb": "<row/>" * 2_000_000}))


def test_workbooks_by_sheets(spark, tmp_path, monkeypatch):
    rows = '<row><c t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row/><row><c t="inlineStr" r="B3"><is><t>x, y</t></is></c></row>'
    books = {"a.xlsx": {"One": rows}, "b.xlsm": {"One": rows, "Two &amp; more": "", "Three": rows * 40}, "sub/c.XLSX": {"S": '<row><c t="s"><v>9</v></c></row>'}, "d.xlsx": {}, "e.xlsx": {"A": rows, "B": "<row"}}
    (tmp_path / "sub").mkdir()
    for name, sheets in books.items():
        (tmp_path / name).write_bytes(workbook(sheets))
    packed = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook({"One": rows, "Two": rows * 3000}))) as a, zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as b:
        for name in a.namelist():
            b.writestr(name, a.read(name))
    (tmp_path / "f.xlsx").write_bytes(packed.getvalue())
    (tmp_path / "g.xlsx").write_bytes(b"no")
    (tmp_path / "h.xlsx").write_bytes(b"P" * ((10 << 20) + 1))
    (tmp_path / "notes.txt").write_text("no spreadsheet")

    def wanted(path):
        try:
            return xlsx.to_csv(path.read_bytes()), None
        except ValueError as e:
            return None, str(e)

    want = {p.name: wanted(p) for p in tmp_path.rglob("*.*") if p.suffix.lower() in (".xlsx", ".xlsm")}
    assert {r.path.rpartition("/")[2]: (r.csv, r.error) for r in xlsx.workbooks(spark, str(tmp_path)).collect()} == want
    assert len(want) == 8 and sum(e is not None for _, e in want.values()) == 4
    files = spark.read.format("binaryFile").load(f"{tmp_path}/b.xlsm")
    assert [(r.k, r.name, r.sheets) for r in xlsx.sheets(files).orderBy("k").collect()] == [(0, "One", 3), (1, "Two & more", 3), (2, "Three", 3)]


def test_a_packed_sheet_that_grows_too_much_is_refused(monkeypatch):
    import zlib

    monkeypatch.setattr(xlsx, "EXPANDED", 1 << 20)
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = pack.compress(b" " * (3 << 20)) + pack.flush()
    with pytest.raises(ValueError):
        list(xlsx._unpacked(data, zipfile.ZIP_DEFLATED))


def test_appended_lines(spark, tmp_path):
    log, state = tmp_path / "log.jsonl", str(tmp_path / "state")
    log.write_text('{"seq": 1, "ok": true, "provider": "openai", "model": "o3", "time": "2024-01-02T00:00:00", "response": "abcdefgh"}\nbroken\n{"seq": 2, "ok": tr')
    stream = streams.running_buckets(streams.read_appended(spark, str(log)))
    assert [r.requests for r in streams.drain(stream, state).collect()] == [1]
    with log.open("a") as f:
        f.write('ue, "provider": "openai", "model": "o3", "time": "2024-01-03T00:00:00"}\n')
    reader = audit._Appended(str(log))
    rows, end = reader.read({"at": 0})
    assert len(list(rows)) == 3 and end == {"at": log.stat().st_size}
    assert list(reader.readBetweenOffsets({"at": 0}, end))[1][0] == "broken"


def test_ledger_edges(spark):
    rows = [
        (1, "", "openai", "o3", "c1", None, None, None, True, None),
        (2, "2024-01-02T00:00:00", "", "", "c1", "sys", [("user", None), ("user", "abc")], "abcd", True, None),
        (3, "2024-01-03T00:00:00", "openai", "o3", "c1", None, None, "x", False, None),
        (4, "2024-01-04T00:00:00", "openai", "o3", None, None, None, "x", True, (5, None, "p")),
    ]
    schema = "seq long, time string, provider string, model string, conversation_id string, system string, messages array<struct<role:string,content:string>>, response string, ok boolean, usage struct<input_tokens:long,output_tokens:long,source:string>"
    log = spark.createDataFrame(rows, schema)
    got = {r.seq: (r.provider, r.model, r.tokens_in, r.tokens_out, r.estimated) for r in ledger.entries(log).collect()}
    assert got == {1: ("openai", "o3", 0, 0, 1), 2: ("unknown", "(unspecified)", 1, 1, 1), 4: ("openai", "o3", 5, 0, 0)}
    talk = ledger.conversations(log).collect()[0]
    assert (talk.provider, talk.started, talk.last, talk.unpriced) == ("openai", "2024-01-02T00:00:00", "2024-01-02T00:00:00", "(unspecified)")


def test_vault_saved_and_encrypted(spark, tmp_path):
    seen = spark.createDataFrame([("i1", "2024-01-01", "[USER_1]", "ann", 1), ("i1", "2024-01-01", "bad", "x", 2), ("", "t", "[USER_2]", "y", 3)], "incident_id string, time string, placeholder string, value string, ord long")
    v, new = vault.record(vault.empty(spark), seen)
    assert [(r.incident_id, r.n_new) for r in new.collect()] == [("i1", 1)]
    vault.save(v, str(tmp_path / "v"), key="0123456789abcdef")
    stored = spark.read.parquet(str(tmp_path / "v" / "version=1" / "entities")).first().value
    assert stored != "ann"
    back = vault.load(spark, str(tmp_path / "v"), key="0123456789abcdef")
    assert back.entities.first().value == "ann" and vault.search(back, "ANN").count() == 1
    left = vault.forget(back, spark.createDataFrame([("[USER_1]",)], "placeholder string"))
    assert left.entities.count() == 0 and left.counters.first().n == 1


def test_verdicts():
    assert verdicts.split(None) == (None, None)
    assert verdicts.split("no json") == ("no json", None)
    assert verdicts.split('{"verdict": "inconclusive"}')[1]["verdict"] == "inconclusive"
    prose, got = verdicts.split('a ```json\n{"verdict": 1}\n``` b ```\n{"verdict": "benign true-positive", "mitre": "T1", "iocs": ["1.2.3.4", ""], "next_steps": "x"}\n``` c ```json\n{broken}\n```')
    assert got["verdict"] == "benign_true_positive" and got["mitre"][0]["technique"] == "T1" and got["iocs"] == [{"type": "other", "value": "1.2.3.4", "context": ""}] and got["next_steps"] == ["x"]
    assert prose.startswith("a ```json")


def test_vault_is_saved_where_it_was_loaded_from(spark, tmp_path):
    path = str(tmp_path / "again")
    seen = spark.createDataFrame([("i1", "2024", "[USER_1]", "ann", 1)], "incident_id string, time string, placeholder string, value string, ord long")
    vault.save(vault.record(vault.empty(spark), seen)[0], path)
    more = spark.createDataFrame([("i2", "2025", "[USER_2]", "bob", 2)], "incident_id string, time string, placeholder string, value string, ord long")
    vault.save(vault.record(vault.load(spark, path), more)[0], path)
    back = vault.load(spark, path)
    assert {r.value for r in back.entities.collect()} == {"ann", "bob"} and vault.load(spark, path, version=1).entities.count() == 1

    class Broken(Exception):
        pass

    @F.udf("string")
    def fail(_):
        raise Broken

    with pytest.raises(Exception, match="Broken"):
        vault.save(vault.Vault(back.entities, back.incidents, back.bridge, back.counters.withColumn("label", fail("label"))), path)
    assert vault.load(spark, path).entities.count() == 2
    vault.save(vault.clear(back), path)
    empty = vault.load(spark, path)
    assert empty.entities.count() == empty.bridge.count() == 0 and empty.counters.first().n == 2
    with pytest.raises(FileNotFoundError):
        vault.load(spark, str(tmp_path / "nowhere"))
