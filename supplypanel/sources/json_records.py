"""JSON lines whose fields and types change from record to record, parsed once.

Every line becomes one VARIANT value; which fields there are, of which kinds, and the typed
columns are all taken from the parsed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplypanel.functions.parsing import type_columns
from supplypanel.sources.yearly import BAD_RECORD

RECORD = "record"


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that is not blank: ``record``, the parsed object, and ``BAD_RECORD``,
    the text of a line that is no object (broken, another kind of value, a field twice).
    One of the two is NULL."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.try_parse_json("value").alias(RECORD))
    whole = F.coalesce(F.schema_of_variant(RECORD).startswith("OBJECT"), F.lit(False))
    return parsed.select(
        F.when(whole, F.col(RECORD)).alias(RECORD), F.when(~whole, F.col("value")).alias(BAD_RECORD)
    )


def json_fields(records: DataFrame) -> DataFrame:
    """Which fields the records have: field, kind (of the value, as SQL type; VOID for null)
    and the number of records. Counted in tasks before the shuffle."""
    fields = records.sparkSession.tvf.variant_explode(F.col(RECORD).outer())
    return (
        records.select(RECORD)
        .lateralJoin(fields)
        .groupBy(F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def field_names(records: DataFrame) -> list[str]:
    """The names of all fields, in order of name; as many as the table will have columns."""
    found = json_fields(records).select("field").where("field is not null").distinct()
    return sorted(r.field for r in found.collect())


def typed_records(
    records: DataFrame, columns: Sequence[str], types: Mapping[str, str] | None = None
) -> DataFrame:
    """One column per field, typed by its name as in delimited files (or by ``types``),
    whatever kind a record has it in: 7, 7.0 and "7" are the same count. A field that a record
    lacks is missing, objects and lists are their JSON text. Bad records are left out."""
    whole = records.where(F.col(RECORD).isNotNull())
    return type_columns(
        whole.select(
            *[F.try_variant_get(RECORD, f'$["{_escaped(c)}"]', "string").alias(c) for c in columns]
        ),
        types,
    )


def _escaped(name: str) -> str:
    if '"' in name:
        raise ValueError(f"a field name with a double quote cannot be looked up: {name}")
    return name
