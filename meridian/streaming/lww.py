"""Last-writer-wins state kept up to date over a log directory by Structured Streaming.

The state is a built-in aggregate on (stamp, arrival), so there is no Python in it and no ties. It grows with the
distinct ids and never expires: dropping a tombstone's stamp would let an older write bring the id back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from meridian.operators import lww
from meridian.sources import files

STATE = "id long, seq long, hlc long, tombstone boolean"
#: Batches after which a stream's changes are merged.
MERGE_BATCHES = 32


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(stream: DataFrame) -> DataFrame:
    """The winner of each id of a stream (seq, id, hlc, tombstone)."""
    best = F.max_by(F.struct("seq", "hlc", "tombstone"), F.struct(F.col("hlc"), -F.col("seq")))
    return stream.groupBy("id").agg(best.alias("w")).select("id", "w.seq", "w.hlc", "w.tombstone")


def materialise(stream: DataFrame, out: str, checkpoint: str, merge_every: int = MERGE_BATCHES) -> StreamingQuery:
    """Writes what each batch changed as a folder out/delta=N, and every so often all of it as out/base=N, after which
    older folders go; read it by current(). A batch that runs again writes the same folders again."""

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/delta={n}")
        if (n + 1) % merge_every == 0:
            if not files.exists(spark, f"{out}/base={n}/_SUCCESS"):
                current(spark, out).write.mode("overwrite").parquet(f"{out}/base={n}")
            for name in files.names(spark, out):
                if int(name.split("=")[1]) < n or name == f"delta={n}":
                    files.delete(spark, f"{out}/{name}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The state (id, seq, hlc, tombstone): the last whole base and what changed since."""
    done = [x for x in files.names(spark, out) if files.exists(spark, f"{out}/{x}/_SUCCESS")]
    number = {x: int(x.split("=")[1]) for x in done}
    base = max((x for x in done if x.startswith("base=")), key=number.get, default=None)
    parts = [x for x in done if x.startswith("delta=") and (base is None or number[x] > number[base])] + ([base] if base else [])
    rows = spark.read.schema(STATE).parquet(*[f"{out}/{x}" for x in parts]) if parts else spark.createDataFrame([], STATE)
    return lww.winners(rows)


def outcomes(stream: DataFrame) -> DataFrame:
    """(seq, id, outcome) of each write of a stream (seq, id, hlc) as it arrives: Stale unless its stamp is above all
    earlier ones of its id. Batches arrive in order; inside a batch writes go by seq. The state is a stamp an id."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        writes = pd.concat(list(pdfs)).sort_values("seq")
        high = writes["hlc"].cummax()
        before = high.shift(fill_value=-1)
        if state.exists:
            before = before.clip(lower=state.get[0])
        stale = writes["hlc"] <= before
        state.update((max(int(high.iloc[-1]), state.get[0] if state.exists else -1),))
        yield pd.DataFrame({"seq": writes["seq"], "id": key[0], "outcome": stale.map({True: "Stale", False: "Applied"})})

    grouped = stream.select("seq", "id", "hlc").groupBy("id")
    return grouped.applyInPandasWithState(run, "seq long, id long, outcome string", "hlc long", "append", GroupStateTimeout.NoTimeout)


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes an append-only stream as Parquet, each row once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
