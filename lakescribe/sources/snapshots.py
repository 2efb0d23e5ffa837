"""Versions of a stored thing, each a small JSON document that names the folders it consists of.

A writer puts new data into folders that no version names, then publishes the next document in one step; readers take the newest document, so they see the old version or the new one
and never half of either. What was written by a run that ended before it published is named by nothing and only takes space until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions published at ``path``, ascending; empty where there are none."""
    fs, p = _fs(spark, f"{path}/{FOLDER}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict] | None:
    """(version, document): the newest, or the one asked for. None where nothing is published."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, p = _fs(spark, f"{path}/{FOLDER}/{version:010d}.json")
    stream = fs.open(p)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, version: int, document: dict) -> int:
    """Makes ``document`` version ``version``: written under another name and renamed, so it is there whole or not at all. ``Conflict`` where that version exists."""
    fs, target = _fs(spark, f"{path}/{FOLDER}/{version:010d}.json")
    _, draft = _fs(spark, f"{path}/{FOLDER}/_{version:010d}-{uuid.uuid4().hex}")
    if fs.exists(target):
        raise Conflict(f"version {version} of {path} exists")
    out = fs.create(draft, False)
    out.writeBytes(json.dumps(document))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {path} exists")
    return version


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
