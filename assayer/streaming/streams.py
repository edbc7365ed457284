"""Incremental forms: bounded and resumable ingest, continuous sequences, newest rows, live progress.

Each sink is idempotent per micro-batch: a batch that is replayed after a failure writes the same folder again.
"""

import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assayer.operators import training as T
from assayer.operators.audit import latest_per_key
from assayer.operators.store import read_if_there
from assayer.sources import blobs as B


def table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table of that name in a folder as a stream, be it one file or a folder of part files.

    The last letter is written as a pattern: a path without one has to be a folder.
    """
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{folder.rstrip('/')}/{name[:-1]}[{name[-1]}]")


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take everything that has arrived since the last run, then stop; the checkpoint remembers what was read."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def bounded_ingest(stream: DataFrame, path: str, checkpoint: str, rows: int, poll_seconds: float = 0.2) -> int:
    """Stop once about `rows` rows were read: whole batches only, so it may overshoot by a batch or two.

    Ends by itself when all that has arrived is read, also when that is nothing.  Set maxFilesPerTrigger on the stream,
    or all is one batch.  Progress is kept by batch, as the query itself remembers only the latest hundred.
    """
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    by_batch: dict[int, int] = {}
    while True:
        active = q.isActive
        by_batch |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
        if not active or sum(by_batch.values()) >= rows:
            break
        time.sleep(poll_seconds)
    q.stop()
    q.awaitTermination()
    return sum(by_batch.values())


def stream_rows(stream: DataFrame, transform, path: str, checkpoint: str) -> None:
    """A stateless transform, such as a join with the static question table, from source to table."""
    ingest(transform(stream), path, checkpoint)


def each_batch(stream: DataFrame, write, checkpoint: str) -> list[dict]:
    """Hand every micro-batch that has arrived to write(batch, batch_id); returns the progress of each."""
    q = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [dict(p) for p in q.recentProgress]


# --- sequences ---------------------------------------------------------------------------------------------------------

def stream_sequences(payloads: DataFrame, articles_of, sets: DataFrame, factory, path: str, checkpoint: str, **windows) -> None:
    """Training sequences from archived records as they arrive.

    payloads(payload, ...) are raw JSON texts; articles_of(parsed) gives the columns that encode_windows asks for; sets is
    the static question table.  A batch's windows and refusals go to path/windows, texts that don't parse to
    path/dead_letters, each in a folder of the batch that a replay writes again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = B.parse(batch).persist()  # read twice; a lost part is parsed again
        broken = F.col(B.CORRUPT).isNotNull() | F.col("payload").isNull()
        parsed.filter(broken).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/dead_letters/batch_id={batch_id}")
        rows = T.encode_windows(articles_of(parsed.filter(~broken).drop(B.CORRUPT)), sets, factory, **windows)
        rows.write.mode("overwrite").parquet(f"{path}/windows/batch_id={batch_id}")
        parsed.unpersist()

    each_batch(payloads, write, checkpoint)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows and refusals of a stream; T.sequences and T.quarantined tell them apart."""
    return spark.read.parquet(f"{path}/windows").drop("batch_id")


# --- tables that are folded together now and then ------------------------------------------------------------------------

#: Batches after which their rows are merged into one table.
MERGE_EVERY = 16


class Folded:
    """Rows of each batch in a folder of its own, and every few batches one merged table of all so far.

    path/folds has one row for each merged table, written after it; a reader takes the newest merged table named there and
    the batches behind it, so it needs no listing of folders, and the number of batches between merges may change from run
    to run.  A batch that runs again overwrites the same folders from the same input.  Batches and merged tables before the
    newest one are no longer read and may be removed by their owner.
    """

    def __init__(self, spark: SparkSession, path: str, schema, merge):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def last_fold(self, before: int | None = None) -> int | None:
        folds = read_if_there(self.spark, f"{self.path}/folds", "batch_id long")
        return (folds if before is None else folds.filter(F.col("batch_id") < before)).agg(F.max("batch_id")).first()[0]

    def read(self, before: int | None = None) -> DataFrame:
        fold = self.last_fold(before)
        rows = read_if_there(self.spark, f"{self.path}/batches", self._with_batch())
        rows = (rows if fold is None else rows.filter(F.col("batch_id") > fold)).drop("batch_id")
        return self.merge(rows if fold is None else rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/merged/{fold}")))

    def _with_batch(self) -> StructType:
        return StructType([*self.schema.fields, StructField("batch_id", LongType())])

    def add(self, rows: DataFrame, batch_id: int, merge_every: int) -> None:
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/batches/batch_id={batch_id}")
        if batch_id - (-1 if (fold := self.last_fold(batch_id)) is None else fold) >= merge_every:
            self.read(batch_id).write.mode("overwrite").parquet(f"{self.path}/merged/{batch_id}")
            self.spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("append").parquet(f"{self.path}/folds")


def stream_latest(stream: DataFrame, path: str, checkpoint: str, merge_every: int = MERGE_EVERY) -> None:
    """Newest row per key as rows arrive; a key is rewritten once in merge_every batches."""
    each_batch(stream, lambda batch, batch_id: Folded(batch.sparkSession, path, stream.schema, latest_per_key).add(batch, batch_id, merge_every), checkpoint)


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """Newest row per key over all batches."""
    return Folded(spark, path, schema, latest_per_key).read()


# --- progress ------------------------------------------------------------------------------------------------------------

PROGRESS = StructType([StructField("run_id", StringType()), StructField("config_id", StringType()), *[StructField(c, LongType()) for c in ("processed", "failed", "skipped")]])


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id", "config_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("processed", "failed", "skipped")])


def stream_progress(records: DataFrame, path: str, checkpoint: str, key: list[str], event_time: str, late_after: str, merge_every: int = MERGE_EVERY) -> None:
    """Live counters per run and configuration; the stream itself remembers only records of the last while.

    A record (key) that comes again within `late_after` of event time counts once: its key is state until the watermark has
    passed it, so the state of a run that is over goes away.  Counters are not state: each batch adds its own counts, which
    are folded together every merge_every batches.  A record older than the watermark is not counted; how many there were,
    and how large the state is, stands in path/batch_log (batch_id, rows, late, state_rows).
    """
    seen_once = records.withWatermark(event_time, late_after).dropDuplicatesWithinWatermark(key)
    s = F.col("status")

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("run_id", "config_id").agg(
            F.count_if(s == "ok").alias("processed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"))
        Folded(batch.sparkSession, path, PROGRESS, _sums).add(counts, batch_id, merge_every)

    done = each_batch(seen_once, write, checkpoint)
    log = [(p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in done]
    if log:
        records.sparkSession.createDataFrame(log, BATCH_LOG).coalesce(1).write.mode("append").parquet(f"{path}/batch_log")


BATCH_LOG = "batch_id long, rows long, late long, state_rows long"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Counters of each run and configuration over all batches."""
    return Folded(spark, path, PROGRESS, _sums).read()


def read_batch_log(spark: SparkSession, path: str) -> DataFrame:
    return read_if_there(spark, f"{path}/batch_log", BATCH_LOG)
