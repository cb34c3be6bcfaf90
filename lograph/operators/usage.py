"""Usage accounting: per call, per session, per run. Money is decimal, so sums do not depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import (
    CHARS_PER_TOKEN, CONTEXT_WINDOW, CREDIT_CONTEXT_WINDOWS, CREDIT_MULTIPLIERS, DEFAULT_MODEL, DEFAULT_PRICE,
    MODEL_ALIASES, MODEL_PRICES, TOKENS_PER_CREDIT,
)
from lograph.functions import text as T

MONEY = "decimal(28,10)"


def _lookup(key: Column, table: dict[str, object], default: Column) -> Column:
    """Value from a short fixed table, as a literal map inside the plan."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def resolve_model(name: Column, aliases: dict[str, str] = MODEL_ALIASES, default: str = DEFAULT_MODEL) -> Column:
    """Full model name: blank gives the default, a name without an alias stays."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).otherwise(_lookup(name, aliases, name))


def call_cost(
    given: Column, model: Column, tokens_in: Column, tokens_out: Column,
    prices: dict[str, tuple[str, str]] = MODEL_PRICES, default: tuple[str, str] = DEFAULT_PRICE,
) -> Column:
    """The given cost, or an estimate from the tokens where it is zero or missing."""
    def price(i: int) -> Column:
        return _lookup(model, {m: p[i] for m, p in prices.items()}, F.lit(default[i])).cast("decimal(10,6)")

    estimate = (tokens_in.cast("decimal(18,0)") * price(0) + tokens_out.cast("decimal(18,0)") * price(1)) / F.lit(1000)
    return F.when(F.coalesce(given, F.lit(0.0)) != 0, given.cast(MONEY)).otherwise(estimate.cast(MONEY))


def call_rows(outputs: DataFrame) -> DataFrame:
    """Usage of each call out of its JSON output. An output that does not parse counts a turn and characters only.

    ``outputs``: label, model, raw, prompt_chars, and the reply text in ``text``.
    """
    data = F.try_parse_json(T.strip_text(T.strip_ansi(F.col("raw"))))
    rows = outputs.withColumn("data", data)

    def number(path: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get("data", path, kind), F.lit(0).cast(kind))

    return rows.select(
        *[c for c in outputs.columns if c not in ("raw", "text", "prompt_chars")],
        number("$.usage.input_tokens", "bigint").alias("input_tokens"),
        number("$.usage.output_tokens", "bigint").alias("output_tokens"),
        number("$.duration_ms", "bigint").alias("duration_ms"),
        number("$.total_cost_usd", "double").alias("total_cost_usd"),
        F.col("prompt_chars").alias("input_chars"), F.length("text").cast("bigint").alias("output_chars"),
    )


def with_cost(calls: DataFrame) -> DataFrame:
    model = resolve_model(F.col("model"))
    return calls.withColumns({
        "model": model,
        "cost": call_cost(F.col("total_cost_usd"), model, F.col("input_tokens"), F.col("output_tokens")),
    })


def session_usage(calls: DataFrame) -> DataFrame:
    """Turns, cost, whole seconds per call, tokens and characters per session."""
    return with_cost(calls).groupBy("label", "model").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("cost").alias("cost"),
        F.sum(F.expr("duration_ms div 1000")).alias("total_time_secs"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("input_chars").alias("input_chars"), F.sum("output_chars").alias("output_chars"),
    )


def context_use(sessions: DataFrame, windows: dict[str, int] | None = None, default: int = CONTEXT_WINDOW) -> DataFrame:
    """Tokens used, by count or else by characters, and the share of the model's window in percent."""
    window = _lookup(F.col("model"), windows, F.lit(default)) if windows else F.lit(default)
    counted = F.col("input_tokens") + F.col("output_tokens")
    by_chars = F.expr(f"(input_chars + output_chars) div {CHARS_PER_TOKEN}")
    used = F.when(counted != 0, counted).otherwise(by_chars)
    return sessions.withColumns({
        "tokens_used": used, "context_window": window.cast("bigint"),
        "context_pct": F.when(window > 0, F.bround(used * 100.0 / window, 1)).otherwise(F.lit(0.0)),
    })


def run_usage(sessions: DataFrame) -> DataFrame:
    """Totals over sessions: per session label, per model and for the run. Sessions without turns stay out."""
    return sessions.where("turns > 0").rollup("model", "label").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.sum("cost"), 2).cast("double").alias("credits"),
        F.sum("total_time_secs").alias("seconds"), F.sum("turns").alias("turns"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def usage_lines(sessions: DataFrame) -> DataFrame:
    """Usage report as lines, to be read in the order (part, label, model): totals, then one line per session."""
    def shown(cost: Column) -> Column:
        """Four decimals, rounded by the exact binary value, as C and Python print a double."""
        return F.replace(F.format_number(cost.cast("double"), 4), F.lit(","), F.lit(""))

    counted = sessions.where("turns > 0")
    total = counted.agg(
        F.count(F.lit(1)).alias("n"), shown(F.coalesce(F.sum("cost"), F.lit(0))).alias("cost"),
        F.coalesce(F.sum("total_time_secs"), F.lit(0)).alias("secs"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))
    head = total.select(F.posexplode(F.array(
        F.format_string("  Total sessions: %d", "n"), F.format_string("  Total cost:     $%s", "cost"),
        F.format_string("  Total time:     %ds", "secs"), F.format_string("  Total turns:    %d", "turns"),
    )).alias("part", "line")).select("part", F.lit("").alias("label"), F.lit("").alias("model"), "line")
    each = counted.select(
        F.lit(9).alias("part"), "label", "model",
        F.format_string("  %s (%s): $%s, %d turns, %ds, %din/%dout tokens", "label", "model", shown(F.col("cost")),
                        "turns", "total_time_secs", "input_tokens", "output_tokens").alias("line"))
    return head.unionByName(each)


def credit_calls(outputs: DataFrame) -> DataFrame:
    """Credits, seconds and reply of calls that report on the terminal.

    ``outputs``: label, model, stdout, stderr, prompt_chars.
    """
    marks = T.strip_ansi(F.col("stderr"))
    return outputs.select(
        "label", "model", T.credits_in(marks).alias("credits"), T.seconds_in(marks).alias("seconds"),
        F.col("prompt_chars").alias("input_chars"), F.length(T.reply_text(F.col("stdout"))).cast("bigint").alias("output_chars"),
    )


def credit_sessions(calls: DataFrame) -> DataFrame:
    """Sessions priced in credits: the larger of the credit and the character estimate of tokens."""
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("auto"))
    sums = calls.withColumns({"model": model, "credits": F.col("credits").cast(MONEY)}).groupBy("label", "model").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("credits").alias("total_credits"),
        F.sum("seconds").alias("total_time_secs"),
        F.expr(f"sum(input_chars + output_chars) div {CHARS_PER_TOKEN}").alias("by_chars"),
    )
    multiplier = _lookup(F.col("model"), CREDIT_MULTIPLIERS, F.lit(1.0))
    window = _lookup(F.col("model"), CREDIT_CONTEXT_WINDOWS, F.lit(CONTEXT_WINDOW))
    by_credits = F.floor(F.col("total_credits").cast("double") / multiplier * TOKENS_PER_CREDIT)
    return sums.withColumn("est_tokens_used", F.greatest(by_credits, F.col("by_chars"))).select(
        "label", "model", multiplier.alias("credit_multiplier"), "turns",
        F.round("total_credits", 2).cast("double").alias("total_credits"), "total_time_secs", "est_tokens_used",
        window.cast("bigint").alias("context_window"),
        F.bround(F.col("est_tokens_used") * 100.0 / window, 1).alias("context_pct"),
    )
