"""Writing result rows as files."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = {
    "parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "orc": "orc", "txt": "text",
}


def write_files(df: DataFrame, prefix: str, extension: str, mode: str = "errorifexists") -> str:
    """Write under a prefix in the format the extension names; returns the folder."""
    kind = FORMATS.get(extension.lstrip(".").lower())
    if kind is None:
        raise ValueError(f"no writer for extension {extension!r}")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", "true")
    folder = prefix.rstrip("/")
    writer.format(kind).save(folder)
    return folder
