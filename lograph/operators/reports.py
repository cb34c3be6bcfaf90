"""Root-cause reports: fields, chain roles, labels, evidence, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import REPORT_HEAD, UNKNOWN, UNPARSED_CONFIDENCE, USAGE_HEAD
from lograph.functions import replies as R
from lograph.functions.arn import last_part, normalize_arn
from lograph.operators.replies import parsed


def report_fields(replies: DataFrame, iterations: Column | None = None) -> DataFrame:
    """One report per reply. A reply that does not parse becomes the hypothesis, with low confidence.

    ``iterations``: how many rounds of the investigation led to the reply, a column of ``replies``. The findings that support a report are
    rows of their own, see :func:`supporting_findings`.
    """
    data, missing = F.col("data"), F.col("data").isNull()
    no_texts = F.expr("cast(array() as array<string>)")
    remedy = F.try_variant_get(data, "$.suggested_remediation", "variant")

    def texts(path: str) -> Column:
        return F.when(missing, no_texts).otherwise(R.texts_at(data, path))

    rounds = F.lit(0) if iterations is None else F.coalesce(iterations, F.lit(0))
    return parsed(replies.withColumn("__rounds", rounds.cast("bigint"))).select(
        "response_id", (~missing).alias("parsed"),
        F.when(missing, F.lit(UNPARSED_CONFIDENCE)).otherwise(R.confidence(data)).alias("confidence"),
        F.when(missing, F.col("response"))
        .otherwise(F.coalesce(R.text_at(data, "$.hypothesis"), F.lit(""))).alias("hypothesis"),
        texts("$.root_cause_chain").alias("root_cause_chain"),
        texts("$.narrative").alias("narrative"),
        texts("$.affected_resources").alias("affected_resources"),
        F.when(R.kind(remedy) == "ARRAY", F.array_join(R.texts_at(data, "$.suggested_remediation"), "\n"))
        .otherwise(R.text_at(data, "$.suggested_remediation")).alias("suggested_remediation"),
        R.items_at(data, "$.source_evidence").alias("source_evidence"),
        F.col("__rounds").alias("iterations_used"),
    )


def supporting_findings(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings on resources of each report's chain: ``response_id``, then the columns of ``findings`` but its resources.

    A finding supports a report once, however many of its resources are in the chain. ``findings`` has ``seq`` and ``resource_arns``.
    """
    steps = reports.select("response_id", F.explode(F.array_distinct("root_cause_chain")).alias("arn"))
    named = findings.select("seq", F.explode(F.array_distinct(F.transform("resource_arns", normalize_arn))).alias("arn"))
    pairs = named.join(steps, "arn").select("response_id", "seq").distinct()
    return pairs.join(findings.drop("resource_arns"), "seq").select("response_id", *[c for c in findings.columns if c != "resource_arns"])


def role(position: Column, length: Column) -> Column:
    return F.when(position == 0, "ROOT CAUSE").when(position == length - 1, "SURFACE").otherwise("PROPAGATION")


def chain_roles(reports: DataFrame) -> DataFrame:
    """One row per step of a root-cause chain, root first."""
    return reports.select(
        "response_id", F.size("root_cause_chain").alias("n"), F.posexplode("root_cause_chain").alias("pos", "arn")
    ).select("response_id", "pos", "arn", role(F.col("pos"), F.col("n")).alias("role"))


def with_labels(rows: DataFrame, nodes: DataFrame, arn: str = "arn") -> DataFrame:
    """Name and type of a resource; unknown ones show the last part of the id and ``unknown``."""
    known = nodes.select(F.col("arn").alias(arn), F.col("name").alias("__name"), F.col("resource_type").alias("__type"))
    return rows.join(known, arn, "left").select(
        *rows.columns, F.coalesce("__name", last_part(F.col(arn))).alias("label"),
        F.coalesce("__type", F.lit(UNKNOWN)).alias("service"),
    )


def shortened(text: Column, chars: int | None) -> Column:
    """The text, cut for display if a length is given."""
    return text if chars is None else F.substring(text, 1, chars)


def _evidence(item: Column, excerpt_chars: int | None) -> Column:
    """Fields of an evidence item, which may be a text (its excerpt) or an object."""
    plain = R.kind(item) == "STRING"
    excerpt = F.when(plain, R.text_at(item, "$")).otherwise(F.coalesce(R.text_at(item, "$.excerpt"), F.lit("")))
    return F.struct(
        plain.alias("plain"),
        F.when(~plain, F.coalesce(R.text_at(item, "$.source_file"), F.lit(UNKNOWN))).alias("source_file"),
        shortened(excerpt, excerpt_chars).alias("excerpt"),
        F.when(~plain, F.coalesce(R.text_at(item, "$.relevance"), F.lit(""))).alias("relevance"),
        F.when(~plain, F.to_json(F.try_variant_get(item, "$.line_numbers", "variant"))).alias("line_numbers"),
        F.when(~plain, R.text_at(item, "$.links_to")).alias("links_to"),
    )


def evidence_rows(reports: DataFrame, excerpt_chars: int | None = None) -> DataFrame:
    """Evidence items in order. ``excerpt_chars`` cuts the excerpts for display."""
    items = reports.select("response_id", F.posexplode("source_evidence").alias("pos", "item"))
    return items.select("response_id", "pos", _evidence(F.col("item"), excerpt_chars).alias("e")).select("response_id", "pos", "e.*")


def result_summary(reports: DataFrame, entries: int | None = None, chars: int | None = None) -> DataFrame:
    """Report in one row: chain joined by arrows, narrative, remedy. For display ``entries`` of the narrative and ``chars`` of the remedy."""
    narrative = F.col("narrative") if entries is None else F.slice("narrative", 1, entries)
    return reports.select(
        "response_id", "confidence", F.array_join("root_cause_chain", " → ").alias("chain"),
        F.array_join(narrative, "\n").alias("story"),
        shortened(F.col("suggested_remediation"), chars).alias("remediation"),
        F.size("source_evidence").cast("bigint").alias("evidence_count"),
    )


def _numbered(section: int, item: Column, lines: Column) -> Column:
    """Lines as structs that carry their place in the report."""
    return F.transform(lines, lambda line, i: F.struct(
        F.lit(section).alias("section_no"), item.cast("int").alias("item_no"), i.cast("int").alias("line_no"),
        line.alias("line")))


def _block(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _evidence_lines(item: Column, pos: Column, excerpt_chars: int | None) -> Column:
    proof = _evidence(item, excerpt_chars)
    title = F.concat(F.lit("### Evidence "), pos.cast("string"))
    nothing = F.expr("cast(array() as array<string>)")
    return F.when(proof["plain"], _block(title, "", proof["excerpt"], "")).otherwise(F.concat(
        _block(F.concat(title, F.lit(": `"), proof["source_file"], F.lit("`")), ""),
        F.when(proof["relevance"] != "", _block(F.concat(F.lit("**Relevance:** "), proof["relevance"]), "")).otherwise(nothing),
        F.when(proof["excerpt"] != "", _block("```", proof["excerpt"], "```", "")).otherwise(nothing),
    ))


USAGE = ("sessions", "credits", "seconds")


def with_usage(reports: DataFrame, usage: DataFrame) -> DataFrame:
    """Reports with what the run took: one row (``sessions``, ``credits``, ``seconds``), as the total of :func:`lograph.operators.usage.run_usage` gives it."""
    return reports.withColumns({f"__{name}": F.coalesce(usage.select(F.col(name).cast("string")).scalar(), F.lit("0")) for name in USAGE})


def _usage_block() -> Column:
    row = lambda title, name, unit="": F.concat(F.lit(f"| {title} | "), F.col(f"__{name}"), F.lit(f"{unit} |"))
    return _block(*USAGE_HEAD, row("Sessions", "sessions"), row("Credits", "credits"), row("Time", "seconds", "s"), "")


def report_lines(
    reports: DataFrame, nodes: DataFrame, excerpt_chars: int | None = None, generated_at: Column | None = None, usage: DataFrame | None = None,
) -> DataFrame:
    """Report text as rows, to be read in the order (section_no, item_no, line_no) per report.

    ``reports`` as from :func:`report_fields`. With ``generated_at`` the head tells when and after how many iterations the report was made; with
    ``usage`` (see :func:`with_usage`) a last section tells what it took. One pass gives all lines but those that show a
    resource's name; a second one joins the names. The topology overview is the same for every
    report; :func:`topology_lines` gives it once.
    """
    before, here = F.lit(-1), F.lit(0)
    has_story, has_chain = F.size("narrative") > 0, F.size("root_cause_chain") > 0
    impacted, proven = F.size("affected_resources"), F.size("source_evidence") > 0
    none = F.expr("cast(array() as array<string>)")
    made, depth = [], []
    if generated_at is not None:
        made = [F.concat(F.lit("Generated: "), F.date_format(generated_at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))]
        depth = [F.concat(F.lit("Investigation depth: "), F.col("iterations_used").cast("string"), F.lit(" iterations"))]
    fixed = (reports if usage is None else with_usage(reports, usage)).select("response_id", F.inline(F.concat(
        _numbered(1, here, _block(REPORT_HEAD, "", *made, F.concat(F.lit("Confidence: "), F.col("confidence").cast("string")), *depth, "")),
        _numbered(2, here, F.concat(
            _block("## Incident Timeline", ""),
            F.when(has_story, F.col("narrative")).otherwise(_block("No narrative could be constructed.")), _block(""))),
        _numbered(3, before, F.when(has_chain, _block("## Root Cause Chain", "")).otherwise(
            _block("## Root Cause Chain", "", "No root cause chain identified.", ""))),
        _numbered(4, before, F.when(impacted > 0, _block("## Affected Resources", "")).otherwise(none)),
        _numbered(4, impacted, F.when(impacted > 0, _block("")).otherwise(none)),
        _numbered(5, here, _block(
            "## Recommended Action", "",
            F.coalesce(F.nullif("suggested_remediation", F.lit("")), F.lit("No specific remediation suggested.")), "")),
        _numbered(6, before, F.when(proven, _block("## Source Evidence", "")).otherwise(none)),
        F.flatten(F.transform("source_evidence", lambda item, pos: _numbered(6, pos, _evidence_lines(item, pos, excerpt_chars)))),
        *([] if usage is None else [_numbered(7, here, _usage_block())]),
    )))
    length = F.size("root_cause_chain")
    mentions = reports.select("response_id", F.inline(F.concat(
        F.transform("root_cause_chain", lambda arn, pos: F.struct(
            F.lit(3).alias("section_no"), pos.cast("int").alias("item_no"), arn.alias("arn"), role(pos, length).alias("role"))),
        F.transform("affected_resources", lambda arn, pos: F.struct(
            F.lit(4).alias("section_no"), pos.cast("int").alias("item_no"), arn.alias("arn"), F.lit("").alias("role"))),
    )))
    shown = with_labels(mentions, nodes).select("response_id", "section_no", "item_no", F.posexplode(
        F.when(F.col("section_no") == 3, _block(
            F.concat(F.lit("### "), (F.col("item_no") + 1).cast("string"), F.lit(". "), "label", F.lit(" — "), "role"),
            F.concat(F.lit("- ID: `"), "arn", F.lit("`")), ""))
        .otherwise(_block(F.concat(F.lit("- "), "label", F.lit(" — `"), "arn", F.lit("`"))))
    ).alias("line_no", "line"))
    return fixed.unionByName(shown)


def topology_lines(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """Topology overview of a report: a table of resources, then one of labelled edges.

    ``nodes``: arn, name, resource_type, status. Rows sort by (part, sort_key).
    """
    def fixed(part: int, *lines: str) -> DataFrame:
        rows = ", ".join(f"({part}, '{i}', '{line}')" for i, line in enumerate(lines))
        return nodes.sparkSession.sql(f"select * from values {rows} as t(part, sort_key, line)")

    resources = nodes.select(
        F.lit(2).alias("part"), F.col("arn").alias("sort_key"),
        F.concat(F.lit("| "), "name", F.lit(" | "), "resource_type", F.lit(" | "), "status", F.lit(" |")).alias("line"))
    edges = labelled.select(
        F.lit(4).alias("part"), F.concat_ws("|", "source_arn", "target_arn", "relationship").alias("sort_key"),
        F.concat(F.lit("| "), "source_label", F.lit(" | "), "relationship", F.lit(" | "), "target_label", F.lit(" |"))
        .alias("line"))
    return (
        fixed(1, "## Topology Overview", "", "| Resource | Type | Health |", "|----------|------|--------|")
        .unionByName(resources)
        .unionByName(fixed(3, "", "| Source | Relationship | Target |", "|--------|-------------|--------|"))
        .unionByName(edges)
    )
