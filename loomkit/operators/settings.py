"""Settings from key-value rows, and the routing of providers to clients."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.functions.strings import is_truthy, or_default, py_strip

# Defaults of settings, switches, and where the compatible service of some names lives.
DEFAULTS = {
    "openai_model": "gpt-4o-mini",
    "google_model": "gemini-1.5-flash",
    "anthropic_model": "claude-3-5-haiku-latest",
    "openai_compatible_model": "qwen-plus",
}
SWITCHES = ["agent_enable_human_approval", "agent_enable_shell_commands", "agent_enable_web_search", "agent_enable_browser_tools"]
DEFAULT_TEMPERATURE = "0.2"
HOSTED = ["dashscope", "bailian", "aliyun"]
HOSTED_URL = "https://dashscope.aliyuncs.com/compatible-mode/v1"
SUPPORTED = "openai, google, anthropic, openai-compatible, dashscope, bailian, aliyun"

KEYS = ["MODEL_PROVIDER", "MODEL_TEMPERATURE", "OPENAI_COMPATIBLE_API_KEY", "DASHSCOPE_API_KEY", "OPENAI_COMPATIBLE_BASE_URL", "AGENT_WORKSPACE_ROOT", *map(str.upper, DEFAULTS), *map(str.upper, SWITCHES)]


def settings_from_rows(rows: DataFrame) -> DataFrame:
    """One row of settings (schemas.SETTINGS) for each profile, from rows (profile, key, value).

    The provider is trimmed and lower-cased; a temperature that isn't a number is null (try_cast) rather than an end
    of the query. An empty first API key gives way to the second.
    """
    wide = rows.groupBy("profile").pivot("key", KEYS).agg(F.first("value"))
    columns = {
        "model_provider": F.lower(py_strip(F.coalesce("MODEL_PROVIDER", F.lit("openai")))),
        "model_temperature": py_strip(F.coalesce("MODEL_TEMPERATURE", F.lit(DEFAULT_TEMPERATURE))).try_cast("double"),
        **{name: F.coalesce(name.upper(), F.lit(value)) for name, value in DEFAULTS.items()},
        "openai_compatible_api_key": or_default(F.col("OPENAI_COMPATIBLE_API_KEY"), F.col("DASHSCOPE_API_KEY")),
        "openai_compatible_base_url": F.col("OPENAI_COMPATIBLE_BASE_URL"),
        "agent_workspace_root": F.col("AGENT_WORKSPACE_ROOT"),
        **{name: is_truthy(F.col(name.upper())) for name in SWITCHES},
    }
    return wide.select("profile", *[c.alias(name) for name, c in columns.items()])


def route(provider: Column, base_url: Column) -> Column:
    """Struct (client, base_url, error) of a provider name that is trimmed and lower-cased already."""
    hosted = provider.isin(HOSTED)
    url = F.when(hosted, or_default(base_url, HOSTED_URL)).when(provider == "openai-compatible", F.nullif(base_url, F.lit("")))
    client = F.when(provider.isin("openai", "google", "anthropic"), provider).when(url.isNotNull(), F.lit("openai-compatible"))
    error = (
        F.when(client.isNotNull(), F.lit(None).cast("string"))
        .when(provider == "openai-compatible", F.lit("OPENAI_COMPATIBLE_BASE_URL is required for openai-compatible provider."))
        .otherwise(F.concat(F.lit("Unsupported MODEL_PROVIDER='"), provider, F.lit(f"'. Supported providers: {SUPPORTED}")))
    )
    return F.struct(client.alias("client"), url.alias("base_url"), error.alias("error"))


def routed(settings: DataFrame) -> DataFrame:
    """Adds client, model, base_url and error to settings rows."""
    r = route(F.col("model_provider"), F.col("openai_compatible_base_url"))
    model = F.when(F.col("r.client").isNotNull(), F.coalesce(
        *[F.when(F.col("model_provider") == p, F.col(f"{p}_model")) for p in ("openai", "google", "anthropic")], F.col("openai_compatible_model")))
    return settings.withColumn("r", r).withColumn("model", model).select(*settings.columns, "r.client", "model", "r.base_url", "r.error")


def settings_from_env(spark: SparkSession, env: Mapping[str, str] | None = None) -> DataFrame:
    """One row of settings from the driver's environment, or from the mapping given."""
    env = os.environ if env is None else env
    rows = [("env", key, env.get(key)) for key in KEYS]
    return settings_from_rows(spark.createDataFrame(rows, "profile string, key string, value string"))
