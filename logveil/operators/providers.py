"""What is data about model providers: the registry, lists of models, endpoints, answers, settings. Nothing here calls them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (provider, name, how it authenticates, settings it needs besides).
PROVIDERS = [
    ("anthropic", "Claude (Anthropic)", "apikey", ""),
    ("openai", "ChatGPT (OpenAI)", "apikey", ""),
    ("google", "Gemini (Google)", "apikey", ""),
    ("m365copilot", "Microsoft 365 Copilot", "oauth", "m365_tenant_id,m365_client_id"),
    ("ollama", "Local model (Ollama)", "none", "ollama_endpoint"),
    ("azure", "Microsoft Copilot (Azure OpenAI)", "apikey", "azure_endpoint,azure_deployment,azure_api_version"),
]
# Fragments of the names of models that don't chat, hosts of metadata services, and marks in answers.
NOT_CHAT = {
    "openai": "audio realtime transcribe tts image embedding search moderation dall whisper".split(),
    "google": "image tts embedding aqa vision live computer-use robotics nano-banana lyria deep-research".split(),
}
CHAT = {"openai": r"^(?:gpt|chatgpt|o\d)", "google": r"^(?:gemini|gemma)"}
TAGS, FOOTNOTES = r"</?(?:Person|Event|File|Email|Phone|Time)>", r"\[\^\d+\^\]"
METADATA_HOSTS = ["metadata.google.internal", "metadata.goog", "instance-data", "metadata.azure.com", "metadata"]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "provider string, label string, auth string, extra_fields string").withColumn("needs_key", F.col("auth") == "apikey")


def chat_models(rows: DataFrame) -> DataFrame:
    """Of ``rows (provider, model)`` those that chat; names of models lose the prefix ``models/``."""
    name = F.regexp_replace("model", "^models/", "")
    low = F.lower(name)
    keep = F.lit(True)
    for provider, words in NOT_CHAT.items():
        keep = keep & ((F.col("provider") != provider) | (low.rlike(CHAT[provider]) & ~low.rlike("|".join(words))))
    return rows.where(keep & ~F.col("provider").isin("azure", "m365copilot") & (name != "")).select("provider", name.alias("model")).distinct()


def refusal(url: Column) -> Column:
    """Why an endpoint isn't used: ``missing``, ``scheme``, ``host``, ``metadata`` or ``network`` (link-local and carrier NAT); null where it may be."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r"^\[([^\]]*)\].*$|:\d*$", "$1"))
    octet = F.regexp_extract(host, r"^100\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", 1)
    return (
        F.when(u == "", "missing")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "host")
        .when(host.isin(*METADATA_HOSTS), "metadata")
        .when(host.rlike(r"^169\.254\.\d{1,3}\.\d{1,3}$") | host.rlike("^fe[89ab][0-9a-f]:") | ((octet != "") & octet.try_cast("int").between(64, 127)), "network")
    )


def cleaned(answer: Column) -> Column:
    """An answer without annotation tags and footnote marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(answer, TAGS, ""), FOOTNOTES, ""))


def merged_settings(saved: dict, defaults: dict) -> dict:
    """Saved settings over defaults; models are merged by provider, and a single ``model`` of old becomes the one of its provider."""
    out = defaults | {k: v for k, v in saved.items() if k not in ("model", "provider_models")}
    own = saved.get("provider_models") or {}
    out["provider_models"] = defaults.get("provider_models", {}) | own
    provider = out.get("provider", "")
    if saved.get("model") and not own.get(provider):
        out["provider_models"][provider] = saved["model"]
    return out


def system_prompt(settings: dict, default: str, use_system: bool = True, instructions: str | None = None, schema: str = "") -> str:
    """The prompt as sent: the saved one or the default, further instructions, the schema of verdicts."""
    parts = (settings.get("system_prompt") or "").strip() or default if use_system else ""
    if instructions and instructions.strip():
        parts += ("\n\nAdditional user instructions:\n" if parts else "") + instructions.strip()
    return parts + schema
