"""Schemas of JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_schema(df: DataFrame, text: Column) -> str:
    """DDL of a column of JSON objects, by an aggregation in the JVM."""
    found = df.select(F.schema_of_variant_agg(F.try_parse_json(text))).first()[0] or "VOID"
    found = re.sub(r"DECIMAL\(\d+,\s?\d+\)", "DOUBLE", found).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return found if found.startswith("STRUCT<") and found != "STRUCT<>" else "STRUCT<value: STRING>"
