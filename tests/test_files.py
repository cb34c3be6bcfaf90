import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lograph.sources import files as S
from lograph.sources import readers as R

EVENTS = (b"\x00\x01noise<event name=\"e1\" id='7'><data unit=\"ms\">5 &amp; 6</data><a><b>deep</b><b> </b></a><!-- c --></event>\xff"
          b"<event name=\"e2\">\n<v/>\n</event><event><x></event>tail")


def document(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", "<w><p>" + "</p> tail <p>".join(parts) + "</p></w>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    put("a.log", b"one\ntwo\xff\r\n\nlast")
    put("UP.LOG", b"upper\n")
    put("sub/a.log", b"same name\n")
    put("sub/rows.csv", b'h1,h2\n1,2\n3\n4,5,6\n"x, y","line\nbreak"\n')
    put("ev.xel", EVENTS)
    put("raw.xel", b"\x00printable one\x01no\x02printable two")
    put("tree.xel", b"<root v='1'><child>text</child><child a='b'/></root>")
    put("doc.docx", document("first", "second"))
    put("bad.docx", b"not a zip")
    put("empty.log", b"")
    put("big.log", b"x" * 5000)
    put("note.md", b"unsupported")
    put(".hidden.log", b"hidden")
    return str(tmp_path)


def names(frame):
    return sorted(r["path"].rsplit("/", 1)[-1] for r in frame.select("path").collect())


def lines_of(frame, name):
    rows = frame.where(F.col("path").endswith(name)).orderBy("line_no").collect()
    return [r["line"] for r in rows]


def test_scan_finds_supported_files_in_any_case(spark, folder):
    assert names(S.scan_files(spark, folder)) == [
        "UP.LOG", "a.log", "a.log", "bad.docx", "big.log", "doc.docx", "ev.xel", "raw.xel", "rows.csv", "tree.xel"]


def test_scan_reads_no_content(spark, folder):
    plan = S.scan_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan


def test_size_gate_is_part_of_the_scan(spark, folder):
    found = S.scan_content(spark, folder, limit=1000)
    assert "big.log" not in names(found) and "empty.log" not in names(found)
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1]
    assert "GreaterThan(length,0), LessThanOrEqual(length,1000)" in pushed
    assert "big.log" in names(S.scan_content(spark, folder, limit=5000))


def test_first_per_name_and_glob(spark, folder):
    assert names(S.first_per_name(S.scan_files(spark, folder))).count("a.log") == 1
    assert names(S.scan_files(spark, folder, glob="*.md")) == ["note.md"]


def test_modified_since_is_inclusive(spark, folder):
    for name, at in (("a.log", 1000), ("UP.LOG", 2000), ("big.log", 3000)):
        os.utime(f"{folder}/{name}", (at, at))
    for name in ("sub/a.log", "sub/rows.csv", "ev.xel", "raw.xel", "tree.xel", "doc.docx", "bad.docx", "empty.log"):
        os.utime(f"{folder}/{name}", (10, 10))
    since = F.lit(dt.datetime.fromtimestamp(2000, dt.UTC))
    assert names(S.modified_since(S.scan_files(spark, folder), since)) == ["UP.LOG", "big.log"]


def test_discovery_survives_a_missing_source(spark, folder):
    refs, status = S.discover(spark, [
        {"source_type": "local_file", "identifier": folder + "/nowhere"},
        {"source_type": "local_file", "identifier": folder, "prefix": "*.log"}])
    got = {r["key"]: r for r in refs.collect()}
    assert set(got) == {"a.log", "sub/a.log", "big.log"}
    assert got["sub/a.log"]["unique_id"] == f"local_file:{folder}:sub/a.log" and got["big.log"]["size_bytes"] == 5000
    assert [r["reachable"] for r in status.collect()] == [False, True]


def test_all_formats_as_lines(spark, folder):
    found = S.scan_content(spark, folder)
    lines = R.file_lines(spark, folder).cache()
    assert lines_of(lines.where(~F.col("path").contains("/sub/")), "/a.log") == ["one", "two�", "", "last"]
    assert lines_of(lines, "/UP.LOG") == ["upper"]
    assert lines_of(lines, "rows.csv") == ["h1 | h2", "-------", "h1=1 | h2=2", "h1=3", "h1=4 | h2=5 | 6", "h1=x, y | h2=line\nbreak"]
    assert lines_of(lines, "/ev.xel") == [
        "[Event 1] event {'name': 'e1', 'id': '7'}", "  data: 5 & 6", "  data attrs: {'unit': 'ms'}", "    b: deep",
        "[Event 2] event {'name': 'e2'}", "[Event 3] <event><x></event>"]
    assert lines_of(lines, "raw.xel") == ["printable one", "printable two"]
    assert lines_of(lines, "tree.xel") == ["root {'v': '1'}", "  child: text", "  child {'a': 'b'}"]
    assert lines_of(lines, "doc.docx") == ["first", "second", "tail"] or lines_of(lines, "doc.docx") == ["first", "tail", "second"]
    assert names(R.unreadable(found, lines)) == ["bad.docx"]


def test_document_texts_keep_document_order(spark, folder):
    lines = R.document_lines(S.scan_content(spark, folder, [".docx"]))
    assert lines_of(lines, "doc.docx") == ["first", "tail", "second"]


def test_csv_without_quoted_breaks_needs_no_shuffle(spark, folder):
    lines = R.csv_lines(S.scan_content(spark, folder, [".csv"]))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert lines_of(lines, "rows.csv")[:5] == ["h1 | h2", "-------", "h1=1 | h2=2", "h1=3", "h1=4 | h2=5 | 6"]


def test_scan_lines_splits_plain_logs(spark, folder):
    lines = R.scan_lines(spark, folder)
    assert sorted(r["line"] for r in lines.where(F.col("path").endswith("a.log")).collect()) == ["", "last", "one", "same name", "two�"]
    assert "upper" in [r["line"] for r in lines.collect()]


def test_typed_events(spark, tmp_path):
    (tmp_path / "e.xml").write_text("<r><event><id>1</id><n>a</n></event><event><id>2</id></event></r>")
    rows = R.typed_events(spark, str(tmp_path), "id bigint, n string").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (2, None)]


def test_quotes_open_at_the_start_of_a_cell_only(spark, tmp_path):
    long = "x" * 100_000
    (tmp_path / "a.csv").write_text(f'h1,h2\n5" disk,ok\n1,2\n"a\n""b"", c\nd",3\n"{long}",4\n6,"7\n8" tail\n9,"" \n')
    lines = R.csv_lines(S.scan_content(spark, str(tmp_path), [".csv"]), quoted_breaks=True)
    got = [r["line"] for r in lines.orderBy("line_no").collect()][2:]
    assert got == ['h1=5" disk | h2=ok', "h1=1 | h2=2", 'h1=a\n"b", c\nd | h2=3', f"h1={long} | h2=4", "h1=6 | h2=7\n8 tail", "h1=9 | h2= "]


def test_xml_sections_entities_and_unsound_text(spark):
    blobs = spark.createDataFrame([
        ("a", "<event><data><![CDATA[x < <y> & z]]></data><n>&#65;&#x42;&#128512;&amp;#67;</n></event>"), ("b", "<event><a>1</b></event>"),
        ("c", "\x01login failed <b>x</b> and more"), ("d", "<doc><k v='1'>t</k></doc>")], "path string, text string")
    got = {}
    for row in R.xml_event_lines(blobs).orderBy("path", "event_no", "line_no").collect():
        got.setdefault(row["path"], []).append(row["line"])
    assert got == {"a": ["[Event 1] event {}", "  data: x < <y> & z", "  n: AB\U0001f600&#67;"], "b": ["[Event 1] <event><a>1</b></event>"],
                   "d": ["doc", "  k {'v': '1'}: t"]}



def test_unsound_blocks_keep_their_whole_text(spark):
    far = "x" * 2000 + " arn:aws:s3:::late-bucket"
    blobs = spark.createDataFrame([("a", f"<event><a>{far}\nsecond line</b></event>")], "path string, text string")
    got = [r["line"] for r in R.xml_event_lines(blobs).orderBy("event_no", "line_no").collect()]
    assert got == [f"[Event 1] <event><a>{far}", "second line</b></event>"]
