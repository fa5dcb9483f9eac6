"""Fitted models as folders of tables that are published at once.

A version is a folder of its own with a table for each part; it counts from the moment its manifest, written under another name, is
renamed to the next number. Readers take the manifest of the highest number and read that version, so one that reads while a model is
fitted anew sees the old model or the new one, whole, and one that has begun goes on with its own. Manifests hold each part's schema
and rows, and a small value for what isn't a table.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import remove


class _Store:
    """The file system of a folder, by Spark's own interface to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = folder

    def numbers(self) -> list[int]:
        """Numbers of the published versions, the latest first."""
        there = self.path(f"{self.folder}/manifests")
        if not self.fs.exists(there):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(there)]
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))), reverse=True)

    def publish(self, number: int, text: str) -> bool:
        """Put a manifest in place under its number; False if another writer was there first."""
        draft = self.path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.path(f"{self.folder}/manifests/{number:08d}.json")
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def manifest(self, number: int) -> dict:
        own = self.fs.open(self.path(f"{self.folder}/manifests/{number:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(own, "UTF-8"))
        finally:
            own.close()


def publish(tables: dict[str, DataFrame], folder: str, value: Any = None, keep: int = 3, split: tuple[str, ...] = (), by: str = "label") -> int:
    """Write a version (each part a table, those in `split` by a column) and make it the current one; returns its number.

    value is anything that JSON can hold. Of earlier versions the last `keep` - 1 stay for readers that have begun with them.
    """
    spark = next(iter(tables.values())).sparkSession
    store, version = _Store(spark, folder), uuid.uuid4().hex
    parts = {}
    for name, table in tables.items():
        writer = table.write.partitionBy(by) if name in split else table.write
        writer.parquet(f"{folder}/versions/{version}/{name}")
        written = spark.read.schema(table.schema).parquet(f"{folder}/versions/{version}/{name}")
        parts[name] = {"schema": table.schema.jsonValue(), "rows": written.count()}
    text = json.dumps({"version": version, "parts": parts, "value": value})
    number = max(store.numbers(), default=0) + 1
    while not store.publish(number, text):
        number += 1
    for old in store.numbers()[keep:]:
        gone = store.manifest(old)["version"]
        store.fs.delete(store.path(f"{folder}/manifests/{old:08d}.json"), False)
        remove(spark, f"{folder}/versions/{gone}")
    return number


def load(spark: SparkSession, folder: str, parts: tuple[str, ...] | None = None, number: int | None = None, check: bool = True) -> tuple[dict[str, DataFrame], Any]:
    """The parts asked for (all) of the current version, or of a number, and its value. check: each must have the rows of its manifest."""
    store = _Store(spark, folder)
    numbers = store.numbers()
    if not numbers or (number is not None and number not in numbers):
        raise FileNotFoundError(f"no such model in {folder}")
    own = store.manifest(number or numbers[0])
    if missing := [p for p in parts or () if p not in own["parts"]]:
        raise KeyError(f"the model lacks {', '.join(missing)}")
    out = {}
    for name in parts or own["parts"]:
        told = own["parts"][name]
        schema = StructType.fromJson(told["schema"])
        # Columns by which a table is split come last in a folder, so the order is given back.
        table = spark.read.schema(schema).parquet(f"{folder}/versions/{own['version']}/{name}").select(*schema.names)
        if check and table.count() != told["rows"]:
            raise ValueError(f"{name} hasn't the rows of its manifest")
        out[name] = table
    return out, own["value"]
