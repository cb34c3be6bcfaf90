"""Near copies, repeated strings and near-duplicate vectors against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lograph.llm import hnsw, jaccard, suffixes
from lograph.llm.components import components

DOCS = "doc_id bigint, text string, component_id int, rep string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def smallest(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    want = smallest(linked, [x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_copy_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, passage = [], [word() for _ in range(40)]
    for n in (1, 2, 3, 4, 5, 8, 12, 20, 33, 60, 150, 400, 1500):
        base = [word() for _ in range(n)]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08):
            rows.append(" ".join(word() if rng.random() < share else w for w in base))
        rows += [" ".join(base[: max(1, int(n * 0.9))]), " ".join(base).upper().replace(" ", "\n", 3)]
    rows += [" ".join([word() for _ in range(rng.randint(0, 20))] + passage + [word() for _ in range(rng.randint(0, 20))]) for _ in range(60)]
    rows += ["é ü ß", None, "", "  ", "one two three four five"]
    rows = list(enumerate(rows)) + [(3, rows[100]), (None, rows[0]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_near_copies_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copy_rows()
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    want = smallest({i for i, _ in sets}, links)
    got = jaccard.near_copies(docs(spark, rows).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        (str(i), len(shingles(t)), str(want.get(i))) for i, t in rows)
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("rule", [jaccard.OPERATOR, jaccard.STAGE])
def test_unrelated_sets_share_no_band_and_linked_ones_share_one(rule):
    rng = np.random.default_rng(11)
    some = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for n in (280, 460, 720, 1160, 3000):
        keys = np.concatenate([jaccard.band_keys(some(n), rule) for _ in range(100)])
        assert len(np.unique(keys)) == len(keys)
    for n in range(1, 900, 3):
        one = some(n)
        more = some(rng.integers(0, n * (rule.part - rule.share) // rule.share + 1))
        gone = n - -(-rule.share * (n + len(more)) // rule.part)  # the most that leaves a link
        two = np.sort(np.concatenate([rng.permutation(one)[gone:], more]))
        assert gone >= 0 and len(np.intersect1d(jaccard.band_keys(one, rule), jaccard.band_keys(two, rule)))


def test_stage_takes_five_words_and_four_fifths(spark):
    rng, rows = random.Random(8), []
    for k in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(500)]
        other = list(words)
        for place in range(20, 20 + 40 * (11 + k % 2), 40):
            other[place] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    five = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    links = [(2 * k, 2 * k + 1) for k in range(12) if 100 * len(five[2 * k] & five[2 * k + 1]) >= 80 * len(five[2 * k] | five[2 * k + 1])]
    assert len(links) == 6 and not any(100 * len(shingles(a) & shingles(b)) >= 85 * len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.without_copies(spark, frame, "").collect()}
    assert kept == set(range(24)) - {b for _, b in links}


def test_empty_table_has_no_copies(spark):
    assert jaccard.near_copies(docs(spark, [])).count() == 0
    assert jaccard.near_copies(docs(spark, [(1, "alone in the world"), (2, None)])).count() == 2


def test_tree_join_finds_every_pair_that_may_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (12, jaccard.DIMS))
    counts = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.15)) for _ in range(9)]).astype(np.int32)
    sizes = counts.sum(axis=1).astype(np.int64)
    tree = jaccard.Tree(counts, sizes, np.arange(len(counts)))
    got = {tuple(sorted(p)) for i, j in jaccard.tree_join(counts, sizes, tree, tree) for p in zip(i.tolist(), j.tolist())}
    for a in range(len(counts)):
        for b in range(a):
            if jaccard.may_link(np.minimum(counts[a], counts[b]).sum(), sizes[a] + sizes[b]):
                assert (b, a) in got
    assert 0 < len(got) < len(counts) ** 2 / 4


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(2000):
        text = [rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def without(rows):
    """The contract, string by string."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            string = data[s:s + 100]
            if string in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(string)
        left = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_strings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passage, base = some(180), some(900)
    texts = [None, "", some(99), "ab" * 400, "ü" * 300, base, base, base[:400] + "X" + base[401:], base[50:700], some(300), "x" * 3000]
    texts += [some(rng.randint(0, 90)) + passage + some(rng.randint(0, 90)) for _ in range(25)] + [some(30) + passage[20:140] + some(40) + passage[20:140]]
    rows = dict(enumerate(texts))
    frame = docs(spark, [*rows.items(), (5, base), (None, base)]).repartition(4)
    got = [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in suffixes.without_repeats(frame).collect()]
    want = without(rows)
    assert len(got) == len(rows) + 2
    for i, row in got:
        assert row == (want[i] if i is not None else (len(base.encode()), 0, 0, hashlib.sha256(base.encode()).hexdigest())), i
    assert suffixes.without_repeats(frame.limit(0)).count() == 0


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    vectors = np.concatenate([rng.normal(size=(400, 16)), *[c + 0.25 * rng.normal(size=(15, 16)) for c in centres], np.repeat(centres[:1], 6, axis=0)])
    given = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [1e300] * 16), (9006, [1e-300] * 16),
           (9007, [1.0] * 8), (None, [1.0] * 16), (9008, [float("inf")] * 16)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in given + odd], "vec_id bigint, embedding array<double>, n_links int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_vectors(frame).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = smallest(range(len(vectors)), [tuple(p) for p in np.argwhere(near).tolist()])
    assert near.sum() > 200
    for i in range(len(vectors)):
        assert got[i] == (near[i].sum(), want[i], want[i] == i)
    assert got[9005] == (1, 9005, True) and got[9006] == (1, 9005, False) and got[None] == (0, None, False)
    assert all(got[i] == (0, i, True) for i in (9000, 9001, 9002, 9003, 9004, 9007, 9008))
    assert hnsw.near_vectors(frame.limit(0)).count() == 0


def test_no_row_holds_the_graph_of_a_shard(spark, monkeypatch):
    """Rows with whole shards were sorted and shuffled, once per block of queries."""
    monkeypatch.setattr(hnsw, "LEAST_SHARDS", 2)
    write, longest = hnsw.written, {}

    def spied(frame, name, keep=False):
        out = write(frame, name, keep)
        longest.update({(name, c): out.agg(F.max(F.length(c))).first()[0] or 0 for c, kind in out.dtypes if kind == "binary"})
        return out

    monkeypatch.setattr(hnsw, "written", spied)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(200, 16))
    vectors[150:] = vectors[:50] * 3 + 0.01 * rng.normal(size=(50, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist())]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    want = {i: (2 if i in (7, 157) else 1, i % 150, i < 150) if i % 150 < 50 else (0, i, True) for i in range(200)}
    assert got == want
    assert longest and max(longest.values()) <= 8 * 16


def test_blocks_of_a_shard_are_read_from_its_files(tmp_path, monkeypatch):
    monkeypatch.setattr(hnsw, "BLOCK", 100)
    rng = np.random.default_rng(9)
    names, given = [], []
    for shard in range(2):
        vectors = rng.normal(size=(350, 8)).astype(np.float32)
        reps = np.arange(350) * 2 + shard
        rows = pa.table({"rep": reps, "digest": [bytes([i % 256]) for i in reps], "mark": rng.integers(0, 2**62, 350), "raw": [v.tobytes() for v in vectors]})
        index = hnsw.build_shard((8, shard), rows, f"file://{tmp_path}", np.float32).to_pylist()[0]
        assert (index["dim"], index["n"]) == (8, 350)
        names.append(index["name"])
        given += zip(reps.tolist(), vectors.astype(np.float64))
    asked = pa.RecordBatch.from_pylist([{"name": a, "other": b, "block": k} for a in names for b in names for k in range(4)])
    got = {(r["a"], r["b"]) for batch in hnsw.query_shards(iter([asked]), f"file://{tmp_path}") for r in batch.to_pylist()}
    ids, unit = np.array([i for i, _ in given]), np.array([v / np.linalg.norm(v) for _, v in given])
    near = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    want = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in near}
    assert len(want) > 20 and got == want


def test_graph_search_recall():
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(3000, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph, order = hnsw.Graph.build(vectors, rng.integers(0, 2**63, 3000).astype(np.uint64))
    queries = vectors[order][::100].astype(np.float32)
    entries = graph.descend(queries, graph.levels[:-1])
    ids, _ = hnsw.search(graph.vectors, graph.levels[-1], queries, entries, 100)
    exact = np.argsort(-(queries @ graph.vectors.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) for a, b in zip(ids, exact)]) >= 9


@pytest.mark.parametrize("chunk,marks", [(4, 3), (4096, 1 << 20)])
def test_tiles_hold_all_sets_of_each_key(monkeypatch, chunk, marks):
    """Random batch borders, large tiles in several rows; only tiles of the same sets may be left out."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "MARKS", marks)
    rng = random.Random(chunk)
    for _ in range(60):
        rows = sorted((rng.randrange(-6, 6), rng.randrange(rng.choice([2, 30]))) for _ in range(rng.randrange(120)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(4))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([s for _, s in p], pa.int64())], names=["key", "sid"]) for p in parts]
        got, mark = {}, {}
        for batch in jaccard.list_tiles(iter(batches)):
            for row in batch.to_pylist():
                got.setdefault(row["key"], []).extend(row["members"])
                mark[row["key"]] = (row["size"], row["low"], row["high"])
        want = {key: sorted({s for k, s in rows if k == key}) for key in {k for k, _ in rows}}
        want = {key: sets for key, sets in want.items() if len(sets) > 1}
        assert all(sorted(sets) == want[key] and mark[key] == (len(sets), min(sets), max(sets)) for key, sets in got.items())
        assert {tuple(sets) for sets in want.values()} == {tuple(sorted(sets)) for sets in got.values()}
