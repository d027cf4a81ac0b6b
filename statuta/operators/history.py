"""Conversation history as it may enter a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip
from .ordered import top_per_key


def clean_history(turns: DataFrame) -> DataFrame:
    """Last messages of each conversation, known roles, trimmed and clipped, blanks out."""
    last = top_per_key(turns, ["conv_id"], [F.desc("turn")], V.MAX_HISTORY_MESSAGES, "_rn").drop("_rn")
    role = F.when(F.col("role").isin(V.HISTORY_ROLES), F.col("role")).otherwise("assistant")
    text = F.substring(strip(F.coalesce("text", F.lit(""))), 1, V.MAX_HISTORY_CONTENT_LENGTH)
    return last.withColumn("role", role).withColumn("text", text).where(F.col("text") != "")
