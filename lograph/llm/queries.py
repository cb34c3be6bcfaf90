"""Registered queries of this subpackage, each over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.llm import bpe, hnsw, html_diff, jaccard, mixing, pii, quality, runs, secrets, suffixes, toxicity, trie, warc
from lograph.llm.text import let, words
from lograph.session import configure, scratch_path, written

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read every record back."""
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    index = warc.write_archive(pages, folder)
    return warc.read_records(index, folder).drop("payload", "url")


OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest as d, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on d = payload_digest and payload_bytes >= 100
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base checks and the rules whose cutoffs the labels certify, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = written(quality.features(docs).drop("text"), "quality")
    cuts = written(quality.cutoffs(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.judged(measured, cuts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def quality_sql() -> str:
    """Features, exact binomial tests along each grid, and the verdict."""
    grids = ", ".join(
        f"('{rule}', {quality.RISK * share!r}, {i}, {cut!r})" for rule, (share, grid) in quality.RULES.items() for i, cut in enumerate(grid)
    )
    values = " union all ".join(
        f"select doc_id, lang, base_failed, '{rule}' as rule, {value} as v from feats" for rule, value in {
            "symbols": "coalesce(n_symbols / nullif(word_chars, 0), 0.0)", "dup_lines": "coalesce(n_dup_lines / nullif(n_lines, 0), 0.0)",
            "repeats": "coalesce(n_repeat_words / nullif(n_words, 0), 0.0)", "word_length": "coalesce(word_chars / nullif(n_words, 0), 0.0)",
        }.items()
    )
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
hit as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
covered as (select doc_id, count(*) as n_repeat_words from (select distinct doc_id, i + unnest([0, 1, 2]) as p from hit) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
feats as (
  select d.doc_id, lang, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(w) < {quality.LEAST_WORDS} or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed
  from d join lines using (doc_id) left join covered using (doc_id)
),
vals as ({values}),
good as (select doc_id from labels where quality is not null and doc_id is not null group by doc_id having min(quality) = 1),
held as (select vals.* from vals join good using (doc_id) where not base_failed),
grid(rule, p, i, cut) as (values {grids}),
strata as (select lang as stratum, count(*) as n from held where rule = 'symbols' group by lang),
ks as (
  select stratum, grid.rule, grid.i, any_value(cut) as cut, any_value(p) as p, any_value(n) as n, sum((v > cut)::int)::bigint as k
  from strata join held on lang is not distinct from stratum join grid on grid.rule = held.rule group by stratum, grid.rule, grid.i
),
tests as (
  select *, coalesce(k < p * n and list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - case when j = 0 then 0 else lgamma(j + 1.0) end
    - lgamma(n - j + 1.0) + j * ln(p) + (n - j) * ln(1 - p)))) <= {quality.DELTA} / ((select count(*) from strata) * {len(quality.RULES)}), false) as ok from ks
),
runs as (select *, bool_and(ok) over (partition by stratum, rule order by i) as certified from tests),
cuts as (select stratum, rule, min(cut) as cut from runs where certified group by stratum, rule),
bad as (select distinct doc_id from vals join cuts on vals.rule = cuts.rule and lang is not distinct from stratum where v > cut)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept
from feats left join bad using (doc_id)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and disclosing terms of all documents."""
    marked = pii.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return marked.select(
        "doc_id", *[count(kind) for kind in pii.PATTERNS], F.sha2(pii.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels that are not held out, score all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic"))
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    texts = html_diff.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return jaccard.near_copies(table(spark, sf_dir, "documents"), rule=jaccard.OPERATOR)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that start earlier."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as tokens, and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, tokenizer_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies",
    )


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation with the first turns of the one whose id is its own without the rest by five."""
    whole, own = F.col("conv_id"), F.col("path")
    heads = lists.filter(whole % 5 == 0).select(whole.alias("of"), F.slice("path", 1, 8).alias("head"))
    h = (F.crc32(whole.cast("string").cast("binary")) % 9).cast("int")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice(own, 1, 0))
    joined = lists.join(heads, whole - whole % 5 == F.col("of"), "left")
    return joined.select("conv_id", F.concat(head, F.slice(own, h + 1, F.greatest(F.size(own), F.lit(0)))).alias("path"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return trie.prefix_trie(rebuilt(written(trie.paths(table(spark, sf_dir, "conversations")), "turns")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a source is an owner, a document a repository of it."""
    found = secrets.marked(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in secrets.PATTERNS], F.sha2(pii.span_list(F.col("base_spans")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def with_period(docs: DataFrame) -> DataFrame:
    """Documents, in every tenth of which (by a hash of its id) the words from some place on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(own: Column) -> Column:
        n = F.size(own)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.when(n > 0, F.array_join(F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, a + (i - a) % p))), " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words(F.col("text")), repeated)).otherwise(F.col("text")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, some of which were given one."""
    docs = with_period(table(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"),
    )))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    start, length, period = (longest["start"] * -1, longest["length"], longest["period"] * -1)
    return runs.with_runs(docs).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc, "op2_quality": op2_quality, "op3_pii": op3_pii, "op4_toxicity": op4_toxicity, "op5_html": op5_html, "op6_vectors": op6_vectors, "op7_jaccard": op7_jaccard, "op8_repeats": op8_repeats, "op9_bpe": op9_bpe, "op10_mix": op10_mix,
    "op11_trie": op11_trie, "op12_secrets": op12_secrets, "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op2_quality": quality_sql()}
