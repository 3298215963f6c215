"""Requests, tokens and costs from an append-only log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.registry import JsonStore

AUDIT = (
    "seq long, time string, kind string, provider string, model string, conversation_id string, system string, "
    "messages array<struct<role:string,content:string>>, response string, error string, ok boolean, duration_ms long, "
    "usage struct<input_tokens:long,output_tokens:long,source:string>, "
    "leakguard struct<warnings:array<struct<type:string,severity:string,value:string,count:long,detail:string>>,acknowledged:boolean>"
)
# Fixed values: (pattern at the start of a model's name, USD for a million tokens in, out); the first that fits counts.
RATES = [
    ("claude.*opus", 15.00, 75.00),
    ("claude.*sonnet", 3.00, 15.00),
    ("claude.*haiku", 1.00, 5.00),
    ("(gpt|chatgpt).*nano", 0.05, 0.40),
    ("(gpt|chatgpt).*mini", 0.25, 2.00),
    ("(gpt|chatgpt)", 1.25, 10.00),
    (r"o\d", 1.10, 4.40),
    ("gemini.*flash.*lite", 0.10, 0.40),
    ("gemini.*flash", 0.30, 2.50),
    ("gemini.*pro", 1.25, 10.00),
]
FREE, LICENSED, UNPRICED = ("ollama",), ("m365copilot",), ("azure",)


def estimate(text: Column) -> Column:
    """A token for four characters; at least one for any text."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0).cast("long")


def entries(audit: DataFrame) -> DataFrame:
    """Requests that went through, with month, tokens and whether they are estimated."""
    sent = F.concat(F.coalesce("system", F.lit("")), F.array_join(F.transform(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.coalesce(m["content"], F.lit(""))), ""))
    exact = F.col("usage").isNotNull()
    return audit.where("ok").select(
        "seq",
        F.coalesce("time", F.lit("")).alias("time"),
        F.substring("time", 1, 7).alias("month"),
        F.coalesce(F.nullif("provider", F.lit("")), F.lit("unknown")).alias("provider"),
        F.coalesce(F.nullif("model", F.lit("")), F.lit("(unspecified)")).alias("model"),
        "conversation_id",
        F.when(exact, F.coalesce("usage.input_tokens", F.lit(0))).otherwise(estimate(sent)).cast("long").alias("tokens_in"),
        F.when(exact, F.coalesce("usage.output_tokens", F.lit(0))).otherwise(estimate(F.coalesce("response", F.lit("")))).cast("long").alias("tokens_out"),
        (~exact).cast("long").alias("estimated"),
    )


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("estimated").alias("estimated")]


def buckets(audit: DataFrame) -> DataFrame:
    """Sums by ``provider, model, month``."""
    return entries(audit).groupBy("provider", "model", "month").agg(*_sums())


def rate(provider: Column, model: Column, overrides: DataFrame | None = None) -> Column:
    """Struct ``rate_in, rate_out, source`` of a model, null where there is nothing to price it by; overrides are joined by :func:`priced`."""
    key = F.lower(F.trim(model))
    kind = "struct<rate_in:double,rate_out:double,source:string>"

    def made(a: float, b: float, source: str) -> Column:
        return F.struct(F.lit(float(a)).alias("rate_in"), F.lit(float(b)).alias("rate_out"), F.lit(source).alias("source"))

    out = F.when(provider.isin(*FREE), made(0, 0, "free")).when(provider.isin(*LICENSED), made(0, 0, "licensed"))
    if overrides is not None:
        out = out.when(F.col("own_in").isNotNull(), F.struct(F.col("own_in").alias("rate_in"), F.col("own_out").alias("rate_out"), F.lit("custom").alias("source")))
    out = out.when(provider.isin(*UNPRICED) | (key == ""), F.lit(None).cast(kind))
    for pattern, a, b in RATES:
        out = out.when(key.rlike(f"^{pattern}"), made(a, b, "default"))
    return out


def priced(sums: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ``rate_in, rate_out, rate_source, cost``. ``overrides (model, own_in, own_out)`` is a small table of exact names in lower case."""
    if overrides is not None:
        sums = sums.join(overrides.withColumnRenamed("model", "own_model"), F.lower(F.trim("model")) == F.col("own_model"), "left")
    out = sums.withColumn("r", rate(F.col("provider"), F.col("model"), overrides))
    cost = F.coalesce(F.col("tokens_in") / 1e6 * F.col("r.rate_in") + F.col("tokens_out") / 1e6 * F.col("r.rate_out"), F.lit(0.0))
    return out.select(*[c for c in sums.columns if not c.startswith("own_")], F.col("r.rate_in").alias("rate_in"), F.col("r.rate_out").alias("rate_out"), F.col("r.source").alias("rate_source"), cost.alias("cost"))


def _rolled(when: Column, suffix: str) -> list[Column]:
    out = [F.sum(F.when(when, F.col(c)).otherwise(0)).alias(f"{c}_{suffix}") for c in ("requests", "tokens_in", "tokens_out", "estimated", "cost")]
    missing = F.when(when & F.col("rate_source").isNull() & (F.col("requests") > 0), F.col("model"))
    return [*out, F.array_join(F.array_sort(F.collect_set(missing)), ",").alias(f"unpriced_{suffix}")]


def summary(audit: DataFrame, month: str, overrides: DataFrame | None = None) -> DataFrame:
    """By provider: requests, tokens, cost and models without a rate, in ``month`` and in all. ``collect_set`` holds a provider's models."""
    return priced(buckets(audit), overrides).groupBy("provider").agg(*_rolled(F.col("month") == month, "month"), *_rolled(F.lit(True), "all"))


def credits(registry: DataFrame, audit: DataFrame, month: str, overrides: DataFrame | None = None) -> DataFrame:
    """Every provider of ``registry (provider, label)`` with its sums, noughts where it has none, and how it is charged."""
    sums = summary(audit, month, overrides)
    model = F.when(F.col("provider").isin(*FREE), "free").when(F.col("provider").isin(*LICENSED), "licensed").otherwise("metered")
    noughts = {c: (0.0 if c.startswith("cost") else "" if c.startswith("unpriced") else 0) for c in sums.columns if c != "provider"}
    return registry.join(sums, "provider", "left").fillna(noughts).withColumn("cost_model", model)


def conversations(audit: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """By conversation: sums, cost, models, first and last time, both in the order of the log. The provider is that of its first request."""
    rows = entries(audit).where("conversation_id is not null and conversation_id <> ''")
    by_model = rows.groupBy("conversation_id", "model").agg(
        *_sums(),
        F.min_by("provider", "seq").alias("provider"),
        F.min("seq").alias("first_seq"),
        F.min_by("time", F.when(F.col("time") != "", F.col("seq"))).alias("started"),
        F.min(F.when(F.col("time") != "", F.col("seq"))).alias("start_seq"),
        F.max_by("time", "seq").alias("last"),
        F.max("seq").alias("last_seq"),
    )
    first = by_model.groupBy("conversation_id").agg(F.min_by("provider", "first_seq").alias("provider"), F.coalesce(F.min_by("started", "start_seq"), F.lit("")).alias("started"), F.max_by("last", "last_seq").alias("last"))
    cost = priced(by_model.drop("provider", "started", "last").join(first, "conversation_id"), overrides)
    return cost.groupBy("conversation_id", "provider", "started", "last").agg(
        *[F.sum(c).alias(c) for c in ("requests", "tokens_in", "tokens_out", "estimated", "cost")],
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("rate_source").isNull(), F.col("model")))), ",").alias("unpriced"),
    )


def latest(audit: DataFrame, n: int = 200) -> DataFrame:
    """The last requests of the log."""
    return audit.orderBy(F.desc("seq")).limit(n)


def in_range(audit: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Requests of a span of time; the minute of ``high`` is part of it, and times that can't be read are not."""
    at = F.coalesce(F.try_to_timestamp("time"), F.try_to_timestamp("time", F.lit("yyyy-MM-dd HH:mm:ss")))
    if low:
        audit = audit.where(at >= F.to_timestamp(F.lit(low)))
    if high:
        audit = audit.where(at <= F.to_timestamp(F.lit(high)) + F.expr("interval 59.999 seconds"))
    return audit


def compact(n: Column) -> Column:
    """Token counts as people read them: 950, 1.2K, 34K, 5.6M."""
    out = F.when(n >= 10_000_000, F.format_string("%.0fM", n / 1e6)).when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6))
    return out.when(n >= 10_000, F.format_string("%.0fK", n / 1e3)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def money(n: Column) -> Column:
    """Dollars: whole ones from a thousand on, four digits below a cent, a dash for null."""
    digits = F.when(F.abs(n) >= 1000, F.format_string("$%.0f", n)).when((F.abs(n) > 0) & (F.abs(n) < 0.01), F.format_string("$%.4f", n))
    return F.when(n.isNull(), "\u2014").otherwise(digits.otherwise(F.format_string("$%.2f", n)))


def relevant(cards: DataFrame, configured: list[str] = (), active: str | None = None) -> DataFrame:
    """Of ``credits`` the providers worth a card: used, set up or selected, and not free."""
    worth = (F.col("requests_all") > 0) | F.col("provider").isin([*configured, active or ""])
    return cards.where((F.col("cost_model") != "free") & worth)


class RateStore:
    """Rates that a user has set, by a model's exact name, in one file."""

    def __init__(self, path: str):
        self._file = JsonStore(path, {})

    def rates(self) -> dict[str, tuple[float, float]]:
        return {m: (float(r.get("in", 0)), float(r.get("out", 0))) for m, r in sorted(self._file.load().get("rates", {}).items()) if isinstance(r, dict)}

    def _save(self, rates: dict[str, tuple[float, float]]) -> None:
        self._file.save({"rates": {m: {"in": a, "out": b} for m, (a, b) in sorted(rates.items())}})

    def set_rate(self, model: str, rate_in: float, rate_out: float) -> None:
        name = (model or "").strip().lower()
        if not name or min(rate_in, rate_out) < 0:
            raise ValueError("A rate needs a model's name and amounts of nought or more.")
        self._save(self.rates() | {name: (float(rate_in), float(rate_out))})

    def clear_rate(self, model: str) -> None:
        name = (model or "").strip().lower()
        self._save({m: r for m, r in self.rates().items() if m != name})

    def overrides(self, spark: SparkSession) -> DataFrame:
        """``model, own_in, own_out``, as :func:`priced` takes them."""
        return spark.createDataFrame([(m, *r) for m, r in self.rates().items()], "model string, own_in double, own_out double")

    def table(self, spark: SparkSession) -> DataFrame:
        """``ord, model, rate_in, rate_out, source, pattern``: the patterns of models in their order, then the models set by name."""
        rows = [(p, a, b, "default", True) for p, a, b in RATES] + [(m, a, b, "custom", False) for m, (a, b) in self.rates().items()]
        return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, model string, rate_in double, rate_out double, source string, pattern boolean")


def usage_of(block: Column, provider: str) -> Column:
    """``input_tokens, output_tokens`` from a provider's own usage block (a JSON string); null where both are absent."""
    names = {"google": ("promptTokenCount", "candidatesTokenCount"), "openai": ("prompt_tokens", "completion_tokens"), "azure": ("prompt_tokens", "completion_tokens"), "ollama": ("prompt_eval_count", "eval_count")}
    a, b = names.get(provider, ("input_tokens", "output_tokens"))
    got = [F.get_json_object(block, f"$.{n}").cast("long") for n in (a, b)]
    return F.when(got[0].isNotNull() | got[1].isNotNull(), F.struct(F.coalesce(got[0], F.lit(0)).alias("input_tokens"), F.coalesce(got[1], F.lit(0)).alias("output_tokens"), F.lit("provider").alias("source")))
