"""Documents stored as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

CORRUPT = "_corrupt_record"


def parse_documents(df: DataFrame, column: str, schema: str | T.StructType, into: str = "doc") -> DataFrame:
    """Parse to a fixed schema. Unknown fields drop; text that does not parse is an
    error of that row only: ``{into}_error`` holds it and the document is null."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType(wanted.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.col(column), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    bad = F.col("_doc").getField(CORRUPT)
    fields = F.struct(*[F.col("_doc").getField(f.name).alias(f.name) for f in wanted.fields])
    return (
        df.withColumn("_doc", parsed)
        .withColumn(into, F.when(bad.isNull() & F.col(column).isNotNull(), fields))
        .withColumn(f"{into}_error", bad)
        .drop("_doc")
    )
