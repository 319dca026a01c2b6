"""Storing named results, one by one or as a set that is committed as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def save_results(
    results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite"
) -> dict[str, str]:
    """Write every result under ``folder/name`` and return the paths."""
    paths = {}
    for name, result in results.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        writer = result.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(paths[name])
    return paths


def read_results(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return {name: reader.load(path) for name, path in paths.items()}


COMMITS = "_commits"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, folder: str) -> list[str]:
    place, files = _file_system(spark, f"{folder}/{COMMITS}")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(n for n in names if n.endswith(".json"))


def save_result_set(
    results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", keep: int = 2
) -> dict[str, str]:
    """Write all results to a folder of their own and then commit them together; the paths.

    The commit is a manifest, written aside and renamed into place when every result is there.
    Readers follow the latest manifest, so a run that fails leaves the earlier set whole. The
    last ``keep`` sets stay, for readers that began before; older ones are deleted.
    """
    spark = next(iter(results.values())).sparkSession
    folder = folder.rstrip("/")
    staged = f"{folder}/set-{uuid.uuid4().hex}"
    try:
        paths = save_results(results, staged, fmt, "errorifexists")
    except Exception:
        place, files = _file_system(spark, staged)
        files.delete(place, True)
        raise
    before = _commits(spark, folder)
    number = int(before[-1].split(".")[0]) + 1 if before else 1
    manifest = {name: path.removeprefix(f"{folder}/") for name, path in paths.items()}
    aside, files = _file_system(spark, f"{folder}/{COMMITS}/{uuid.uuid4().hex}.tmp")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps({"format": fmt, "results": manifest}).encode()))
    out.close()
    target, _ = _file_system(spark, f"{folder}/{COMMITS}/{number:09d}.json")
    if not files.rename(aside, target):
        raise RuntimeError(f"another run committed {target.getName()} first")
    for name in before[: max(len(before) + 1 - keep, 0)]:
        for old in {p.split("/")[0] for p in _manifest(spark, folder, name)["results"].values()}:
            files.delete(_file_system(spark, f"{folder}/{old}")[0], True)
        files.delete(_file_system(spark, f"{folder}/{COMMITS}/{name}")[0], False)
    return paths


def _manifest(spark: SparkSession, folder: str, name: str) -> dict:
    text = spark.read.text(f"{folder}/{COMMITS}/{name}", wholetext=True).first()
    return json.loads(text[0])


def read_result_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The results that were committed last."""
    folder = folder.rstrip("/")
    found = _commits(spark, folder)
    if not found:
        raise ValueError(f"no results committed under {folder}")
    manifest = _manifest(spark, folder, found[-1])
    paths = {name: f"{folder}/{path}" for name, path in manifest["results"].items()}
    return read_results(spark, paths, manifest["format"])
