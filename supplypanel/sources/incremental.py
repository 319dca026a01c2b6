"""A stored panel that follows its yearly files.

``refresh_panel`` keeps a panel partitioned by year and a manifest of the files that each year
was read from (path, length, time of change). A call lists the files and reads only years whose
files are new or differ; their partitions are replaced, those of years whose files are gone are
deleted, all others are left alone. The manifest is written last, so a run that fails is taken
up by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from supplypanel.functions.parsing import type_columns
from supplypanel.sources.yearly import (
    PATH_TEMPLATE,
    YearlyPanel,
    discover_years,
    read_text_table,
    stack_years,
    year_path,
)

MANIFEST = "_manifest"


@dataclass(frozen=True)
class Refresh:
    """The panel, and which years were written or deleted by this call."""

    panel: YearlyPanel
    written: tuple[int, ...]
    removed: tuple[int, ...]


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of a file, or of the files of a folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(conf).listFiles(folder, True)
    out = []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def read_manifest(spark: SparkSession, path: str) -> dict[int, dict]:
    """By year: ``files`` and ``schema``; empty where nothing was stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not folder.getFileSystem(conf).exists(folder):
        return {}
    rows = spark.read.schema("year int, files string, schema string").json(f"{path}/{MANIFEST}").collect()
    return {r.year: {"files": json.loads(r.files), "schema": json.loads(r.schema)} for r in rows}


def _write_manifest(spark: SparkSession, path: str, years: Mapping[int, dict]) -> None:
    rows = [(y, json.dumps(e["files"]), json.dumps(e["schema"])) for y, e in sorted(years.items())]
    df = spark.createDataFrame(rows, "year int, files string, schema string")
    df.coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def stored_panel(spark: SparkSession, path: str) -> YearlyPanel:
    """The panel as it was last stored. A column that a year lacks is NULL there."""
    years = read_manifest(spark, path)
    if not years:
        raise ValueError(f"no panel stored under {path}")
    fields: dict[str, object] = {}
    for _, entry in sorted(years.items()):
        for one in StructType.fromJson(entry["schema"]).fields:
            known = fields.setdefault(one.name, one)
            if known.dataType != one.dataType:
                raise ValueError(f"column {one.name} changes its type between years; store the panel anew")
    schema = StructType(list(fields.values())).add("year", IntegerType())
    data = spark.read.schema(schema).parquet(path)
    listed = data.where(F.col("year").isin(sorted(years)))
    columns = {y: StructType.fromJson(e["schema"]).names for y, e in years.items()}
    return YearlyPanel(listed, tuple(sorted(years)), columns)


def refresh_panel(
    spark: SparkSession,
    root: str,
    path: str,
    template: str = PATH_TEMPLATE,
    fmt: str = "csv",
    multiline: bool = False,
    types: Mapping[str, str] | None = None,
    columns: Sequence[str] | None = None,
) -> Refresh:
    """Bring the panel stored under ``path`` up to date with the files under ``root``."""
    path = path.rstrip("/")
    known = read_manifest(spark, path)
    now = {y: _files(spark, year_path(root, y, template)) for y in discover_years(spark, root, template)}
    if not now:
        raise ValueError(f"no yearly file found under {root}")
    changed = [y for y, files in now.items() if known.get(y, {}).get("files") != [list(f) for f in files]]
    removed = [y for y in known if y not in now]
    after = {y: e for y, e in known.items() if y in now and y not in changed}
    if changed:
        tables: dict[int, DataFrame] = {}
        for year in changed:
            text = read_text_table(spark, year_path(root, year, template), fmt, multiline, columns)
            tables[year] = text
            typed = type_columns(text, types)
            after[year] = {"files": [list(f) for f in now[year]], "schema": json.loads(typed.schema.json())}
        stacked = type_columns(stack_years(tables), {"year": "keep"} | dict(types or {}))
        # only the partitions of these years are replaced
        stacked.hint("rebalance", "year").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("year").parquet(path)
    for year in removed:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if changed or removed:
        _write_manifest(spark, path, after)
    return Refresh(stored_panel(spark, path), tuple(sorted(changed)), tuple(sorted(removed)))
