"""Stages that a later run finds again: a table, and a marker written after it.

A stage's digest covers its name, its parameters, the digests of the stages that
it follows and the content of its input tables. The marker is put in place by a
rename after the table is written, so a stage without a marker, or with another
digest, is torn or stale, and is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coopspark.plans.stage import written


def content_digest(df: DataFrame) -> str:
    """A digest of schema and rows, whatever their order: one aggregate over the table."""
    row = F.xxhash64(*df.columns) if df.columns else F.lit(0).cast("bigint")
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), row))).first()
    return hashlib.sha256(f"{df.schema.json()}|{n}|{a}|{b}".encode()).hexdigest()


class Ledger:
    """Stages under one folder. Without a folder, every stage is written to the session's scratch folder and nothing is kept."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self.digests: dict[str, str] = {}
        self.skipped: list[str] = []

    def _file(self, path: str):
        """(file system, path) of Hadoop, so that any store will do."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _marker(self, name: str) -> dict | None:
        fs, at = self._file(f"{self.path}/_ledger/{name}.json")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, name: str, digest: str, schema: StructType) -> None:
        fs, at = self._file(f"{self.path}/_ledger/{name}.json")
        _, draft = self._file(f"{self.path}/_ledger/{name}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"digest": digest, "schema": schema.json()}).encode()))
        stream.close()
        fs.delete(at, False)
        if not fs.rename(draft, at):
            raise RuntimeError(f"the marker of stage {name} can't be put in place")

    def stage(self, name: str, build: Callable[[], DataFrame], parameters: dict | None = None, after: tuple[str, ...] = (), inputs: tuple[DataFrame | None, ...] = ()) -> DataFrame:
        """The stage's table: read, if its marker has the same digest, else built and written."""
        if self.path is None:
            return written(build())
        parts = [name, json.dumps(parameters or {}, sort_keys=True, default=str), *[self.digests[a] for a in after]]
        parts += ["none" if df is None else content_digest(df) for df in inputs]
        digest = self.digests[name] = hashlib.sha256("|".join(parts).encode()).hexdigest()
        target = f"{self.path}/{name}"
        marker = self._marker(name)
        if marker is not None and marker["digest"] == digest and self._file(f"{target}/_SUCCESS")[0].exists(self._file(f"{target}/_SUCCESS")[1]):
            self.skipped.append(name)
            return self.spark.read.schema(StructType.fromJson(json.loads(marker["schema"]))).parquet(target)
        if marker is not None:  # while the table is replaced, nothing vouches for it
            fs, at = self._file(f"{self.path}/_ledger/{name}.json")
            fs.delete(at, False)
        df = build()
        df.write.mode("overwrite").parquet(target)
        self._commit(name, digest, df.schema)
        return self.spark.read.schema(df.schema).parquet(target)
