"""Accumulate new ledger files into archives as they arrive.

Each micro-batch of a file stream becomes one archive, named after its batch id.  A batch
that is retried overwrites its own archive, so the result is the same as if it ran once.
Overlaps between deliveries are resolved when archives are combined, or, with ``once``, before they are stored: a keyed
state holds every transaction seen so far and an archive gets only those that its delivery brings for the first time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.classify import classify
from ledgerloom.operators.dedup import IDENTITY
from ledgerloom.sources import archive

DELIVERY_SCHEMA = ("account string, txn_ts timestamp_ntz, description string, "
                   "amount decimal(28,4), source_file string, row_id bigint")


def first_sightings(ledger: DataFrame) -> DataFrame:
    """Transactions of a ledger stream that no earlier micro-batch has brought, each once, by its first file and row.

    Days, not times, tell transactions apart, as in archives.  To be used in update mode.  The state is a streaming aggregate, so
    copies are combined inside their tasks before the shuffle, whatever share of a delivery they are.  It keeps, per
    transaction, the times of the first and the last batch with it; a batch's time is fixed in the checkpoint, and both are
    equal in the batch that brings a transaction first, also when that batch is run again.  The state grows with the number
    of different transactions (some 100 bytes each); a session with the RocksDB state store keeps it on the executors' disks.
    """
    keys = ["account", *IDENTITY]
    timed = ledger.withColumns({
        "txn_ts": F.date_trunc("day", "txn_ts").cast("timestamp_ntz"), "_now": F.current_timestamp()})
    sightings = timed.groupBy(*keys).agg(
        F.min(F.struct("source_file", "row_id")).alias("_copy"), F.min("_now").alias("_first"), F.max("_now").alias("_last"))
    return sightings.where("_first = _last").select(
        *keys, F.col("_copy.source_file").alias("source_file"), F.col("_copy.row_id").alias("row_id"))


def accumulate(spark: SparkSession, landing: str, root: str, checkpoint: str, *,
               label: str = "Delivery", files_per_batch: int | None = None, once: bool = False) -> StreamingQuery:
    """Start a stream over Parquet ledgers in ``landing`` that stops once it has caught up.

    With ``once`` every transaction is stored by the first delivery only, see :func:`first_sightings`; a checkpoint holds for
    one way or the other.
    """
    reader = spark.readStream.schema(DELIVERY_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, batch_id: int) -> None:
        archive.save(classify(batch), root, f"{label} {batch_id}",
                     created_at=dt.datetime.now(), archive=f"{label}_{batch_id:09d}")

    deliveries = reader.parquet(landing)
    return (
        (first_sightings(deliveries) if once else deliveries).writeStream.foreachBatch(store)
        .outputMode("update" if once else "append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
