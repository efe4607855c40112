"""Project configuration JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotlake.schema import PROJECT_CONFIG


def parse_config(projects: DataFrame) -> DataFrame:
    return projects.withColumn("parsed", F.from_json("config", PROJECT_CONFIG))


def input_folder(projects: DataFrame) -> DataFrame:
    return projects.select("id", F.get_json_object("config", "$.input_folder").alias("input_folder"))


def read_task_defs(projects: DataFrame) -> DataFrame:
    """Task name, classes, kind and index (-1 for the multilabel task) per project."""
    parsed = parse_config(projects)
    many = parsed.select(F.col("id").alias("project_id"), F.posexplode("parsed.classification_tasks").alias("task_index", "t"))
    many = many.where(F.col("t.name").isNotNull() & F.col("t.classes").isNotNull())
    one = parsed.where(
        F.col("parsed.multilabel_task.name").isNotNull() & F.col("parsed.multilabel_task.classes").isNotNull()
    )
    return many.select(
        "project_id", "task_index", F.col("t.name").alias("name"), F.col("t.classes").alias("classes"), F.lit(False).alias("is_multilabel")
    ).unionByName(
        one.select(
            F.col("id").alias("project_id"),
            F.lit(-1).alias("task_index"),
            F.col("parsed.multilabel_task.name").alias("name"),
            F.col("parsed.multilabel_task.classes").alias("classes"),
            F.lit(True).alias("is_multilabel"),
        )
    )
