"""Incremental scoring of motif files: single ablation without state, pairs with the state of each region."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from coopspark.operators.ablation import Predictor, Sequences, pair_ablation, single_ablation
from coopspark.plans.stage import written

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(spark: SparkSession, source: str, schema: str, target: str, files_per_trigger: int, stateful: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``stateful`` to the stream of files in ``source`` and ``score`` to each micro-batch; a batch that is run again replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = stateful(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    # An empty part gives the target its schema, also where no file has come yet.
    empty = score(spark.createDataFrame([], stream.schema))
    empty.write.mode("ignore").parquet(f"{target}/batch=none")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}__checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(target)


def run_incremental(spark: SparkSession, source: str, schema: str, target: str, predictor: Predictor, tracks: list[int], files_per_trigger: int = 1, sequences: Sequences | None = None) -> DataFrame:
    """Single ablation of all files now in ``source``, added to ``target``; files seen before are not scored again.

    Without ``sequences`` the files' rows hold their region's sequence in ``seq``.
    """

    def score(df: DataFrame) -> DataFrame:
        if sequences is not None:
            return single_ablation(df, sequences, predictor, tracks)
        # A region's rows carry its sequence: it is scored once in the batch, not once a motif.
        return single_ablation(df.drop("seq"), df.select("region", "seq").distinct(), predictor, tracks)

    return _run(spark, source, schema, target, files_per_trigger, lambda stream: stream, score)


class RegionMotifs(StatefulProcessor):
    """Keeps the motifs of a bucket of regions; gives all motifs of each region that a batch has some of, those of the batch with ``came``.

    The state is a list, an Arrow table in compressed bytes for each batch: a
    call or a state row a region would cost more than its motifs. A ``seq``
    stays with one motif of its region, the first that came with one.
    """

    def __init__(self, kept: StructType):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "part binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names, schema = self.kept.names, to_arrow_schema(self.kept)
        came = pd.concat([r[names] for r in rows], ignore_index=True)
        regions = pa.Array.from_pandas(came["region"], type=schema.field("region").type).unique()
        old = [pa.ipc.open_stream(part).read_all() for (part,) in self.parts.get()]
        old = [t.filter(pc.is_in(t["region"], value_set=regions)) for t in old]
        if "seq" in names:
            known = pa.concat_arrays([c for t in old for c in t.filter(t["seq"].is_valid())["region"].chunks] or [regions.slice(0, 0)]).to_pylist()
            first = came.dropna(subset=["seq"]).groupby("region")["seq"].min()
            came["seq"] = came["region"].map(first).astype(object).where(~came["region"].duplicated() & ~came["region"].isin(known), None)
        new = pa.Table.from_pandas(came, schema=schema, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(new)
        self.parts.appendValue((out.getvalue().to_pybytes(),))
        for t, flag in [*((t, False) for t in old), (new, True)]:
            if len(t):
                yield t.to_pandas().assign(came=flag)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State variables need this store; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_incremental_pairs(spark: SparkSession, source: str, schema: str, target: str, predictor: Predictor, tracks: list[int], max_distance: int, files_per_trigger: int = 1, sequences: Sequences | None = None, buckets: int = 1024) -> DataFrame:
    """Pair ablation of all files now in ``source``, added to ``target``.

    A region may come in any number of files: each pair is scored in the batch
    in which its second motif comes. The state, kept in the checkpoint, is the
    motifs by buckets of regions, whose number stays what it was at the first
    run. Without ``sequences`` the files' rows hold their region's sequence in
    ``seq``, and the state keeps one for each region.
    """
    own = StructType.fromDDL(schema)
    carried = [f"pass_threshold_t{k}" for k in tracks]
    kept = StructType([own["region"], StructField("start_rel", LongType()), StructField("end_rel", LongType()), StructField("tf", StringType()), *[own[c] for c in carried]])
    if sequences is None:
        kept = kept.add("seq", StringType())
    out = StructType([*kept.fields, StructField("came", BooleanType())])

    def stateful(stream: DataFrame) -> DataFrame:
        rows = stream.where("region is not null").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept], F.pmod(F.hash("region"), F.lit(buckets)).alias("bucket"))
        return rows.groupBy("bucket").transformWithStateInPandas(RegionMotifs(kept), out, "Append", "None")

    def score(df: DataFrame) -> DataFrame:
        if sequences is None or not hasattr(predictor, "score_pairs"):
            df = written(df)  # read more than once, and the state moves on once
        texts = df.groupBy("region").agg(F.max("seq").alias("seq")) if sequences is None else sequences
        return pair_ablation(df.drop("seq"), texts, predictor, tracks, max_distance, carried, came="came")

    with _rocks(spark):
        return _run(spark, source, schema, target, files_per_trigger, stateful, score)
