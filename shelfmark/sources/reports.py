"""Report sinks.  A report is never overwritten silently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Report name -> format.
REPORTS = {
    "series-identity-audit": "csv",
    "source-provenance": "csv",
    "decision-resolution": "csv",
    "identity-normalization-member-integrity": "csv",
    "skipped-items": "csv",
    "bangumi-review": "csv",
    "plan": "json",
    "chapter-boundaries": "json",
    "reorganization": "json",
}


def write_report(df: DataFrame, name: str, root: str) -> str:
    """Write ``df`` as the named report below ``root``; fails if it exists.  Returns the folder."""
    target = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode("errorifexists")
    if REPORTS[name] == "json":
        writer.option("ignoreNullFields", False).json(target)
    else:
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        flat.write.mode("errorifexists").option("header", True).csv(target)
    return target
