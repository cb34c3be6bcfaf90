import pytest
from pyspark.sql import functions as F

from lograph.functions import arn as A
from lograph.functions import checks as C
from lograph.functions import tabular as B
from lograph.functions import text as T
from lograph.operators.usage import resolve_model

X = "x"


@pytest.mark.parametrize("arn,kind,name,region", [
    ("arn:aws:lambda:us-east-1:1:function:fn", "lambda:function", "fn", "us-east-1"),
    ("arn:aws:dynamodb:us-west-2:1:table/t", "dynamodb:table", "t", "us-west-2"),
    ("arn:aws:s3:::bucket/logs/x/", "s3:bucket", "bucket", "us-east-1"),
    ("arn:aws:ec2::1:instance/i-1/", "ec2:instance", "i-1", "us-east-1"),
    ("arn:aws:ec2:eu-west-1:1:///", "ec2:", "///", "eu-west-1"),
    ("just-a-name", "unknown", "just-a-name", "us-east-1"),
    ("a:b:c:d", "unknown", "a:b:c:d", "d"),
])
def test_arn_fields(one, arn, kind, name, region):
    x = F.col(X)
    assert one(A.resource_type(x), x=arn) == kind
    assert one(A.resource_name(x), x=arn) == name
    assert one(A.region(x), x=arn) == region


@pytest.mark.parametrize("message,label", [
    ("Invoked by target", "invokes"), ("target unhealthy", "reads_from"), ("slow QUERY", "reads_from"),
    ("input rejected", "writes_to"), ("latency high", "depends_on"), ("Forbidden", "access_denied_to"),
    ("backend down", "routes_to"), ("notify failed", "publishes_to"), ("clock skew", "blocks"),
    ("replica lag", "replicates_to"), ("nothing special", "connected_to"), ("", "connected_to"),
])
def test_relationship_takes_the_first_word_that_fits(one, message, label):
    assert one(A.relationship(F.col(X)), x=message) == label


def test_arns_in_a_line(one):
    line = "x arn:aws:s3:::b/k. y arn:aws-cn:s3:::c arn:aws:iam::12:role/r,"
    assert one(A.find_arns(F.col(X)), x=line) == ["arn:aws:s3:::b/k.", "arn:aws:iam::12:role/r"]


def test_normalised_arns_are_distinct_in_order(spark):
    frame = spark.createDataFrame([(["arn:aws:s3:::b/y", "q", "arn:aws:s3:::b/x", None, "q"],)], "a array<string>")
    assert frame.select(A.normalize_arns(F.col("a")).alias("v")).first()["v"] == ["arn:aws:s3:::b", "q"]


@pytest.mark.parametrize("identifier,prefix,want", [
    ("s3://b/p/q", "other", ("b", "p/q")), ("b", "p", ("b", "p")), ("s3://b", None, ("b", "")), ("b/", "p", ("b", "")),
])
def test_bucket_and_prefix(one, identifier, prefix, want):
    got = one(F.struct(A.bucket_of(F.col(X)), A.prefix_of(F.col(X), F.col("p"))), x=identifier, p=prefix)
    assert tuple(got) == want


def test_ids_and_names(one):
    assert one(A.reference_id(F.lit("t"), F.lit("i"), F.col(X)), x="k/a") == "t:i:k/a"
    assert one(A.reference_id(F.lit("t"), F.lit("i"), F.col(X)), x=None) is None
    assert one(A.safe_name(F.col(X)), x="a:b/c") == "a_b_c"


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1280, 1331, 1305, 1792, 5_000_000, 1024**3 * 3, 1024**5 * 7])
def test_human_size_rounds_as_python_does(one, size):
    value, want = float(size), None
    for unit in ("B", "KB", "MB", "GB"):
        if value < 1024:
            want = f"{value:.1f}{unit}"
            break
        value /= 1024
    assert one(T.human_size(F.col(X)), x=size) == (want or f"{value:.1f}TB")


@pytest.mark.parametrize("text", ["", "a", "abcdef", "abcdefg", "äöü€xyz"])
def test_chunks(one, text):
    want = [text[i:i + 3] for i in range(0, len(text), 3)] or [""]
    assert one(T.chunks(F.col(X), 3), x=text) == want


@pytest.mark.parametrize("raw,want", [
    ("\x1b[32m> one\x1b[0m\ntwo\n> three\n▸ Credits: 1\nlost", "one\ntwo\nthree"), ("  plain \n", "plain"), ("", ""),
    ("noise\n> a\nCredits: 2", "a"), ("> \n> b", "b"), ("> a\n> Credits: in answer\nb", "a\nCredits: in answer\nb"),
])
def test_reply_text(one, raw, want):
    assert one(T.reply_text(F.col(X)), x=raw) == want


def test_usage_marks(one):
    assert one(T.credits_in(F.col(X)), x="▸ Credits: 1.25 Time: 12s") == 1.25
    assert one(T.seconds_in(F.col(X)), x="▸ Credits: 1.25 Time: 12s") == 12
    assert one(T.credits_in(F.col(X)), x="Credits: 1.2.3") == 0.0
    assert one(T.seconds_in(F.col(X)), x="none") == 0


def test_strip_ansi(one):
    assert one(T.strip_ansi(F.col(X)), x="\x1b[1;31mred\x1b[0m \x1b[?25lx") == "red x"


@pytest.mark.parametrize("name,good", [
    ("us-east-1", True), ("ap-southeast-12", True), ("us-gov-west-1", False), ("us-east", False), ("xx-east-1", False), (None, False),
])
def test_region(one, name, good):
    assert one(C.valid_region(F.col(X)), x=name) is good


@pytest.mark.parametrize("value,good", [
    ("12345678-1234-5678-1234-567812345678", True), ("{12345678123456781234567812345678}", True),
    ("urn:uuid:12345678-1234-5678-1234-567812345678", True), ("12345678", False), ("", False), (None, False),
    ("g2345678-1234-5678-1234-567812345678", False),
])
def test_uuid(one, value, good):
    assert one(C.valid_uuid(F.col(X)), x=value) is good


def test_blank(one):
    assert [one(C.not_blank(F.col(X)), x=v) for v in ("a", " ", "", "\t\n", None)] == [True, False, False, False, False]


def test_rejects_name_the_broken_rules(spark):
    frame = spark.createDataFrame([("a", 1), (" ", -1)], "id string, n int")
    good, bad = C.split_valid(frame, {"blank": C.not_blank(F.col("id")), "negative": F.col("n") >= 0})
    assert [r["id"] for r in good.collect()] == ["a"]
    assert [r["errors"] for r in bad.collect()] == [["blank", "negative"]]


@pytest.mark.parametrize("line,want", [
    ("a,b", ["a", "b"]), (",b,", ["", "b", ""]), ('"x, y",z', ["x, y", "z"]), ('"say ""hi""",2', ['say "hi"', "2"]),
    ('a"b,c', ['a"b', "c"]), ("", []), ('"",x', ["", "x"]),
])
def test_cells(one, line, want):
    assert one(B.cells(F.col(X)), x=line) == want


@pytest.mark.parametrize("row,want", [("1,2", "a=1 | b=2"), ("1", "a=1"), ("1,2,3,4", "a=1 | b=2 | 3 | 4"), ("", "")])
def test_key_values(one, row, want):
    assert one(B.key_values(B.cells(F.lit("a,b")), B.cells(F.col(X))), x=row) == want


@pytest.mark.parametrize("name,want", [
    ("opus", "claude-opus-4-6"), ("", "claude-sonnet-4-6"), (None, "claude-sonnet-4-6"), ("mine", "mine"), ("auto", "claude-sonnet-4-6"),
])
def test_model_names(one, name, want):
    assert one(resolve_model(F.col(X)), x=name) == want


def test_printable_runs(spark):
    blob = b"\x00\x01abcdefgh\x02short\x03tab\tand\nline\xff\xc3\xa4eight888"
    frame = spark.createDataFrame([(bytearray(blob),)], "b binary")
    assert frame.select(T.printable_runs(F.col("b")).alias("v")).first()["v"] == ["abcdefgh", "tab\tand\nline", "eight888"]


def test_human_sizes_beyond_64_bits(spark, tmp_path):
    from lograph.plans.work_queries import human_sizes

    rows = [(9_000_000, 1, 1_200_000), (3, 2, 5)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["line"]: (r["size"], r["shown"]) for r in human_sizes(spark, str(tmp_path)).collect()}
    assert got[2] == (45, "45.0B")
    assert got[1] == (None, "%.1fTB" % (9_000_000 * 9_000_000 * 1_200_000 / 1024**4))
