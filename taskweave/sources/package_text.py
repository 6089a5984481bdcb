"""Facts read from a package's config text and Dockerfile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.functions import packages as K


def package_facts(texts: DataFrame, key: str) -> DataFrame:
    """connector, services, basis, task_name and image per package."""
    return texts.select(
        key,
        K.connector_facts(F.col("toml")).alias("f"),
        K.declared_task_name(F.col("toml")).alias("task_name"),
        K.from_image(F.col("dockerfile")).alias("image"),
    ).select(key, "f.*", "task_name", "image")
