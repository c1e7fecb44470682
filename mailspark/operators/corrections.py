"""Human corrections (K6): append-only JSON lines, read back tolerantly (S3) and de-duplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_corrections(df: DataFrame, path: str) -> None:
    """K6: append correction rows (message_id, human_label, prompt_version, model_labels, corrected_at)."""
    cols = ["message_id", "human_label", "prompt_version", "model_labels", "corrected_at"]
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols])
    out.write.mode("append").json(path)
