"""CSV and JSON writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from annotlake.functions.paths import safe_file_name  # noqa: F401


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; quotes only where needed, inner quotes doubled, nothing trimmed."""
    (
        df.write.mode("overwrite")
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(folder)
    )


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
