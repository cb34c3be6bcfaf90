"""Archives, main text, toxicity and the pipeline."""

import hashlib
import random

import pyarrow.fs
import pytest
import zstandard
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from lograph.llm import html_diff, queries, toxicity, warc

PAGES = "page_id bigint, url string, html string, digest string"


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    long = "é" * 80
    rows = [(5, "http://a/5", long), (3, "http://a/3", long), (9, None, long), (1, "u\nv", None), (2, "", "small"), (4, "x", "small"), (7, "y", "z" * 5000), (7, "y", "z" * 5000), (None, "n", long)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    folder = str(tmp_path / "archive")
    index = warc.write_archive(pages, folder)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(index, folder).collect()), key=str)
    def want(page_id, html):
        data = (html or "").encode()
        first = 3 if html == long and page_id != 3 else None
        return page_id, "revisit" if first else "response", first, len(data), hashlib.sha256(data).hexdigest()
    assert got == sorted((want(i, h) for i, _, h in rows), key=str)
    one = warc.read_records(index.filter("page_id = 2"), folder).first()
    assert bytes(one["payload"]) == b"small" and one["url"] == ""
    for file in (tmp_path / "archive" / "bundles").iterdir():  # any decoder reads a bundle from end to end
        with zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True) as plain:
            assert plain.read().startswith(b"WARC/1.1\r\n")
        system, path = pyarrow.fs.FileSystem.from_uri(f"file://{file}")
        with system.open_input_file(path) as opened:
            assert len(warc.read_seek_table(opened)) >= 1
    assert warc.read_records(warc.write_archive(pages.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = html_diff.common(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found) and found == sorted(set(found)) and len(found) == subsequence(a, b)
    assert len(html_diff.common(list(range(3000)), list(range(1500, 4500)))) == 1500


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a\n b<br>c<p>d<b>e</b>f", "a b c def"),
    ("<nav>m</nav><article><header><h1>T</h1></header><p>one<aside>x</aside><p>two</article><footer>f</footer>", "T one two"),
    ("<body><div class='site-header'>h</div><main><p>x</p><div id=comments><p>c</p></div></main></body>", "x"),
    ("<p>x<script>var a='</p><p>no';</script>y<!-- z --></p><form>q</form>", "xy"), ("<article>a<style>p{}</style> b</article", "a b"),
    ("<p title='a>b'>q</p><script>never closed", "q"), ("<p>&lt;b&gt; &#233;&nbsp;x</p>", "<b> é x"), ("a<!-- open", "a"), ("<div hidden>x</div><p>y", "y"),
    ("<div class='with-sidebar content'><p>z</p></div>", "z"), ("1 < 2 <p>3", "1 < 2 3"),
])
def test_main_text(page, want):
    assert html_diff.main_text(html_diff.visible_lines(page), []) == want


def test_shared_lines_of_near_addresses_go(spark):
    page = lambda *lines: "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
    rows = [(1, "http://h/a/1", page("Top", "one", "own one", "End")), (2, "http://h/a/2?x", page("Top", "two", "End")), (3, "http://other/a/3", page("Top", "three")),
            (4, None, page("Top", "four")), (5, "http://h/b", "<article><p>Top</p><p>kept</p></article>"), (6, "bad address", page("six")),
            (7, "http://same/x", page("copy", "copy 2")), (8, "http://same/y", page("copy", "copy 2")), (9, "http://h/a/1", None)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1]], PAGES.replace("digest", "lines"))
    got = sorted((r["page_id"], r["text"]) for r in html_diff.extracted(frame).collect())
    assert got == sorted([(1, "one own one"), (1, "one own one"), (2, "two"), (3, "Top three"), (4, "Top four"), (5, "Top kept"), (6, "six"), (7, "copy copy 2"),
                          (8, "copy copy 2"), (9, "")]) or dict(got)[9] == ""
    assert html_diff.extracted(frame.limit(0)).count() == 0


def test_lines_that_all_pages_around_share_go_inside_an_article(spark, monkeypatch):
    rows, quoted = [], {3: "a quote", 4: "a quote"}
    for i in range(9):
        own = [f"first {i}", quoted.get(i, f"second {i}"), "Subscribe now", f"third {i}"]
        rows.append((i, f"http://h/a/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in own) + "</article>", "x"))
    rows += [(20 + i, f"http://copies/{i}", "<article><p>one</p><p>two</p><p>three</p></article>", "x") for i in range(6)]
    for block in (1024, 4):
        monkeypatch.setattr(html_diff, "BLOCK", block)
        got = {r["page_id"]: r["text"] for r in html_diff.extracted(spark.createDataFrame(rows, PAGES)).collect()}
        assert all(got[i] == f"first {i} {quoted.get(i, f'second {i}')} third {i}" for i in range(1, 8))
        assert all(got[20 + i] == "one two three" for i in range(6))


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(["scumbag", "moronic", "trashy"]))
        rows.append((i, " ".join(words), int(i % 4 == 0), "x"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score string")
    labels = frame.filter("doc_id < 300").select("doc_id", "toxic")
    model = toxicity.train(frame, labels.union(labels.limit(10)).union(spark.createDataFrame([(None, 1), (9999, 0)], "doc_id bigint, toxic int")))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(frame.select("doc_id", "text"), model).collect()}
    held = [(got[i] >= 0.3) == (i % 4 == 0) for i in range(300, 400)]
    assert sum(held) >= 95 and all(0 <= s <= 1 for s in got.values())
    more = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 40000 + "scumbag")], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(more, model).collect()}
    assert scores[1] == scores[2] and 0 <= scores[1] < 0.5
    one = toxicity.train(frame, labels.filter("toxic = 0"))
    assert {round(r["score"], 6) for r in toxicity.scored(frame.limit(5).select("doc_id", "text"), one).collect()} == {round(1 / 227, 6)}
    assert toxicity.scored(more.limit(0), toxicity.train(frame, labels.limit(0))).count() == 0


def test_every_operator_has_one_query():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 120")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0)], docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "personal_data", "mixing", "tokens"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs.union(odd), SF_DIR)
    assert good.columns == corpus_pipeline.COLUMNS and good.filter("doc_id > 9000").count() == 0 and good.count() > 80
    text = good.filter("length(text) > 400").orderBy("doc_id").first()
    copies = stages["near_copies"](spark, good.union(good.filter(F.col("doc_id") == text["doc_id"]).withColumn("doc_id", F.lit(8000).cast("bigint"))), SF_DIR)
    assert copies.filter("doc_id = 8000").count() == 0 and copies.filter(F.col("doc_id") == text["doc_id"]).count() == 1
    marked = copies.withColumn("text", F.concat("text", F.lit(" mail me@here.org"))).union(odd)
    clean = stages["personal_data"](spark, marked, SF_DIR)
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == marked.count() and clean.filter("text like '%me@here.org%'").count() == 0
    mixed = stages["mixing"](spark, clean, SF_DIR)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    coded = stages["tokens"](spark, mixed, SF_DIR)
    assert coded.count() == mixed.count() and coded.filter("not decodes").count() == 0


def test_stages_judge_rows_that_share_an_id(spark):
    """A rejected row goes although another row of its id stays; copies of rows of one id add up to what the mix takes."""
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(1, good, "en", "a", 1), (1, "short", "en", "a", 1), (None, good, "en", "a", 1), (None, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.kept(spark, docs, SF_DIR)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, good), (1, good)]
    from lograph.llm import mixing

    many = spark.createDataFrame([(i // 3, f"x{i % 3} " + "w " * (5 + i // 3 % 4), "en", "abc"[i % 7 % 3], 1) for i in range(240)], docs.schema)
    wanted = {(r["doc_id"], r["source"], r["size"]): r["n"] for r in mixing.mix(mixing.sized(many)).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    taken = corpus_pipeline.mixed(spark, many, SF_DIR).withColumn("size", mixing.n_words(F.col("text")))
    assert {(r["doc_id"], r["source"], r["size"]): r["count"] for r in taken.groupBy("doc_id", "source", "size").count().collect()} == wanted
