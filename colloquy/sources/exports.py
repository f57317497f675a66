"""Row shapes of calibration exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALIBRATION = ("idx", "goals", "human_label", "human_note", "llm_label", "llm_reason", "llm_error")


def calibration_rows(items: DataFrame) -> DataFrame:
    """The exported columns; those that the items lack are null."""
    return items.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in CALIBRATION))


def stored_config(config: dict, now: str, environment: dict[str, str]) -> dict:
    """A run's configuration with what is known when it is queued; the configuration itself stays as it is."""
    base, model = environment.get("LITELLM_API_BASE", ""), environment.get("LITELLM_MODEL_NAME", "")
    meta = {"saved_at_utc": now, "litellm_model_name_env": model, "litellm_api_base_env": base}
    return {**config, "litellm_api_base": base.strip(), "enqueue_meta": meta}
