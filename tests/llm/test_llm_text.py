"""Quality rules, personal data, byte-pair encoding and mixing against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lograph.llm import bpe, mixing, pii, quality
from lograph.llm.text import let, matches, sums_before

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, spans int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, langs=None, sources=None):
    """Documents with two extra columns whose names clash with results."""
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", None, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [
    None, "", " \n\t ", "one", "a b c a b c a b c", "x\n\nx\nx \n  x", "été ünder 你好 \U0001f600 #*$ 5 < 6 | &", "word " * 3000,
    "one two three four " * 20 + "five", "a\x0bb\x0cc\x85d\xa0e", "same line\nsame line\nother\nsame line",
]


def plain_features(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_features_match_plain_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "cc ", "\n", "#", "é "]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    got = quality.features(docs(spark, texts).drop("kept", "spans")).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == plain_features(text)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 200, 0.02), (0, 5000, 0.01), (40, 5000, 0.01), (900, 100000, 0.01)])
def test_binomial_tail_is_exact(spark, k, n, p):
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    want = max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))
    frame = spark.range(1).select(F.lit(k).cast("bigint").alias("k"), F.lit(n).cast("bigint").alias("n"))
    got = frame.select(quality.log_binomial_cdf(F.col("k"), F.col("n"), p).alias("v")).first()["v"]
    assert got == pytest.approx(want, abs=1e-6)


def test_cutoffs_are_certified_where_labels_suffice(spark):
    good = " ".join(f"w{i}" for i in range(60))
    texts = [good] * 2000 + [good + " $$$$$$$$$$" * 20] * 50 + [good] * 30
    langs = ["en"] * 2050 + ["de"] * 30
    measured = quality.features(docs(spark, texts, langs).drop("kept", "spans")).drop("text")
    labels = spark.range(2080).select(F.col("id").alias("doc_id"), F.when((F.col("id") >= 2000) & (F.col("id") < 2050), 0).otherwise(1).alias("quality"))
    cuts = {r["stratum"]: r for r in quality.cutoffs(measured, labels.union(labels.limit(5))).collect()}
    assert cuts["en"]["good"] == 2000 and cuts["en"]["cut_symbols"] == 0.02 and cuts["de"]["cut_symbols"] is None
    kept = quality.judged(measured, quality.cutoffs(measured, labels))
    assert kept.filter("kept").count() == 2030 and kept.filter("not kept and doc_id between 2000 and 2049").count() == 50
    none = quality.cutoffs(measured, labels.limit(0))
    assert none.count() == 0 and quality.judged(measured, none).filter("not kept").count() == 0
    assert quality.judged(measured.limit(0), none).count() == 0


PATTERNS = {k: re.compile(v) for k, v in {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_entities_match_plain_python(spark):
    rng = random.Random(2)
    parts = ["a@b.co", "a.b+c@d.e.f+g@h.i", "é", "1.2.3.4", "999.1.1.1.2.3", "4111 1111 1111 1111", "4111111111111111", "+1 (255) 555-8013", "+", "@", ".", " ", "-", "7",
             "000255.1.1.1", "\U0001f600", "x" * 50, "+49 30 1234567890123456", "a@b", "12345678901234567890123"]
    texts = [None, "", "a" * 20000 + "@", "1" * 20000, "+1" + " " * 5000, "1 " * 5000, "a@b.c " * 1500] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    frame = docs(spark, texts).select("doc_id", "text")
    got = {r["doc_id"]: r["s"] for r in pii.entities(frame).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_spans(text), text[:80]


def test_terms_that_disclose_an_entity_are_found_and_replaced(spark):
    filler = ["red green blue", "cold warm hot", "up down left", "cat dog cow"]
    texts = [f"{filler[i]} of Zebulon reach him at zeb@mail.org or {filler[i][::-1]}" for i in range(4)]
    texts += [f"of him at reach or {i} plain text number" for i in range(400)] + [None, "", "zeb@mail.org"]
    frame = docs(spark, texts)
    rows = {r["doc_id"]: r["s"] for r in pii.marked(frame.select("doc_id", "text")).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()}
    for i in range(4):
        start = texts[i].index("Zebulon")
        assert f"term:{start}:{start + 7}" in rows[i] and "email" in rows[i] and rows[i].count("term") == 1
    assert all(not rows[i] for i in range(4, 404)) and rows[404] == rows[405] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame).collect()}
    assert clean[0] == "red green blue of [TERM] reach him at [EMAIL] or eulb neerg der" and clean[404] is None and clean[406] == "[EMAIL]" and clean[10] == texts[10]
    assert pii.sanitised(frame).columns == frame.columns and pii.sanitised(frame.limit(0)).count() == 0


def test_rare_entities_have_disclosing_terms(spark):
    texts = ["plain words of Zebulon reach him at zeb@mail.org", "plain words of Quentin at q@mail.org", "plain Quentin, q@mail.org"]
    texts += [f"plain words of him at reach or {i}" for i in range(400)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, texts)).collect()}
    assert clean[0] == "plain words of [TERM] reach him at [EMAIL]"
    assert clean[1] == "plain words of [TERM] at [EMAIL]" and clean[2] == "plain [TERM], [EMAIL]" and clean[9] == texts[9]


def test_terms_disclose_at_any_distance(spark):
    plain = "plain words of him at reach or so " * 20
    texts = [f"Zebulon {plain} zeb@mail.org {plain} said zebulon", f"{plain} but {plain} Zebulon of zeb@mail.org", plain + "zeb@mail.org"]
    texts += [f"{plain} said but {i}" for i in range(400)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, texts)).collect()}
    assert clean[0] == f"[TERM] {plain} [EMAIL] {plain} said [TERM]"
    assert clean[1] == f"{plain} but {plain} [TERM] of [EMAIL]" and clean[2] == plain + "[EMAIL]" and clean[9] == texts[9]


def test_long_texts_are_replaced_piece_by_piece(spark):
    text = "é" * 4090 + " a@b.co " + "x" * 5000 + " 1.2.3.4 " * 700
    got = pii.sanitised(docs(spark, [text])).first()["text"]
    assert got == "é" * 4090 + " [EMAIL] " + "x" * 5000 + " [IP] " * 700


def test_positions_of_matches(spark):
    frame = spark.createDataFrame([("aXbbXXc" * 300,), ("",), ("none",)], "t string")
    for row in frame.select("t", matches(F.col("t"), "X+").alias("m")).collect():
        assert [(m["start"], m["end"], m["value"]) for m in row["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("X+", row["t"])]
    sums = spark.range(1).select(let(F.sequence(F.lit(1).cast("bigint"), F.lit(1000).cast("bigint")), sums_before).alias("s")).first()["s"]
    assert sums == [i * (i + 1) // 2 for i in range(1000)]


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    known = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = [chr(i) for i in [*range(0x21, 0x250), 0x1C, 0x85, 0xA0, 0x2003, 0x4E00, 0x2160, 0xBD, 0x1F600, 0x301]] + [" "] * 120 + ["\n"] * 30 + ["ed", "'s", "é"] * 30
    texts = [*ODD, "banded ededed edededed", "a" * 3000, "  a  b \n c", "x <|endoftext|> y  <|endoftext|>z\n <|endoftext|>", "don't 'tis we'll"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = bpe.encoded(docs(spark, texts).repartition(3), path).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = known.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == ",".join(map(str, want)) and row["n_tokens"] == len(want)
        assert row["decoded"] == known.decode(want, skip_special_tokens=False) == (texts[row["doc_id"]] or "")
    assert bpe.encoded(docs(spark, texts).limit(0), path).count() == 0


def targets(sizes):
    """The contract's targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    names = ["big"] * 600 + ["b", "a", None, "tiny", "c"] * 60 + ["tiny"] * 3
    rows = [(i, s, 0 if s == "c" else rng.choice([1, 3, 10, 50, 400]) if s != "tiny" else 1) for i, s in enumerate(names)] + [(5000, "b", None), (None, "a", 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").repartition(7)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    for s, n in want.items():
        assert abs(taken[s] - n) <= 400 + 1e-6, (s, taken[s], n)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(frame.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    assert mixing.mix(frame.limit(0)).count() == 0


def test_digest_of_nothing(spark):
    row = pii.entities(docs(spark, [None]).select("doc_id", "text")).select(F.sha2(pii.span_list(F.col("spans")), 256).alias("d")).first()
    assert row["d"] == hashlib.sha256(b"").hexdigest()


TERM = re.compile(r"[^\W\d_]{3,}")


def plain_surprise(k, given):
    return k * (given - 1) + math.log(2 * math.pi * k) / 2


def test_candidate_pairs_match_plain_python(spark):
    """PMI and surprise of every pair of entity and term, by definition, with copies and entities of one text."""
    rng = random.Random(8)
    words = [f"{c}{d}{e}" for c in "abcdef" for d in "ghij" for e in "klm"]
    texts = []
    for i in range(260):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            who = rng.choice("xyzuvw")
            text += f" {who}@mail.org {who * 3} {rng.choice([who * 4, 'abc'])}" if rng.random() < 0.8 else f" q{i}@mail.org own{chr(97 + i % 26)}{chr(97 + i // 26)}"
        texts.append(text)
    texts += texts[:40] + [None, "", "only@mail.org"]
    docs_ = docs(spark, texts).select("doc_id", "text")
    found = pii.entities(docs_).drop("text")
    held = pii.holding(found)
    got = {}
    for r in pii.near_pairs(held.withColumn("decoy", F.lit(False)), docs_).collect():
        got.setdefault((r["entity"], r["term"]), set()).add(r["digest"])
        got.setdefault(("surprise", r["entity"], r["term"]), r["surprise"])
    total = len(texts)
    terms = [set(t.lower() for t in TERM.findall(x or "")) for x in texts]
    mails = [{m.lower() for m in PATTERNS["email"].findall(x or "")} and {m.group().lower() for m in PATTERNS["email"].finditer(x or "")} for x in texts]
    df_term, df_mail = Counter(t for own in terms for t in own), Counter(m for own in mails for m in own)
    together, support = Counter(), {}
    for x, own, found_ in zip(texts, terms, mails):
        for m in found_:
            for t in own:
                together[m, t] += 1
                support.setdefault((m, t), set()).add(x)
    want = {}
    for (m, t), n in together.items():
        given, held_ = math.log(n * total / (df_term[t] * df_mail[m])), math.log(total / df_mail[m])
        surprise = plain_surprise(len(support[m, t]), given)
        if given >= pii.DISCLOSED * held_ and surprise >= -math.log(pii.CHANCE):
            want["email:" + m, t] = {hashlib.sha256(x.encode()).hexdigest() for x in support[m, t]}
            assert got["surprise", "email:" + m, t] == pytest.approx(surprise)
    assert {k: v for k, v in got.items() if len(k) == 2} == want and len(want) > 5


def test_least_surprise_holds_false_discoveries(spark):
    rng = random.Random(2)
    for share in (0.0, 0.02, 0.5, 1.0):
        pairs = [(f"e{i}", f"t{i}", rng.random() < share, rng.choice([5.0, 6.0, 9.5, 20.0, 4000.0])) for i in range(400)]
        frame = spark.createDataFrame(pairs, "entity string, term string, decoy boolean, surprise double")
        least = pii.least_surprise(frame.union(frame.limit(7)), 1.5).first()["least"]
        good = [s for s in {p[3] for p in pairs} if (r := sum(not p[2] and p[3] >= s for p in pairs)) and 1.5 * sum(p[2] and p[3] >= s for p in pairs) <= pii.FALSE * r]
        assert (least is None) == (not good)
        if good:
            assert {p for p in pairs if p[3] >= least} == {p for p in pairs if p[3] >= min(good)}


def test_words_of_single_texts_tell_nothing_by_themselves(spark):
    """Every text has words of its own; only those that come back with an entity disclose it."""
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}xx" for j in range(20))
    texts = [f"{own(i)} plain words here" + (f" u{i}@mail.org" if i % 10 == 0 else "") for i in range(500)]
    texts += [f"{own(500 + i)} Zebulon zeb@mail.org" for i in range(5)]
    rows = pii.marked(docs(spark, texts).select("doc_id", "text")).select("doc_id", F.expr("size(spans) - size(base_spans)").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: int(i >= 500) for i in range(505)}
    all_hold = pii.marked(docs(spark, [f"{own(i)} u{i}@mail.org" for i in range(30)]).select("doc_id", "text"))
    assert all_hold.count() == 30  # no text is left for a decoy


def test_every_text_without_entities_may_be_a_decoy(spark):
    rows = [(i, f"plain words of text number {i}") for i in range(32)] + [(99, "mail me at a.b@example.org"), (100, None)]
    found = {r["doc_id"]: r["free"] for r in pii.entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == f"plain words of text number {i}" for i in range(32))
    assert found[99] is None and found[100] is None
