"""Continuous loading of line files, and a bounded queue for the access log."""

from __future__ import annotations

import threading
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators.store import ACCESS, Audit, Store


def stream_load(spark: SparkSession, store: Store, path: str, checkpoint: str, once: bool = True, audit: Audit = Audit()) -> StreamingQuery:
    """Every new file's documents are loaded as one batch each trigger; documents that don't fit are left out.

    The snapshot that a batch publishes has its number, under the name of ``checkpoint``, so that a
    batch which is tried again after its commit changes nothing.
    """

    def batch(df: DataFrame, n: int) -> None:
        if df.limit(1).count():
            store.load(df, audit, mark=(checkpoint, n))

    lines = spark.readStream.text(path).where(F.trim("value") != "").select(F.col("value").alias("body"))
    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


class AccessLog:
    """Access records, gathered and appended in batches: sync writes each, async up to ``batch`` or after ``wait`` seconds, off none.

    A full queue refuses records, and a write that fails loses its batch; both are counted.
    """

    NAMES = [f.strip().split(" ")[0] for f in ACCESS.split(",")][1:]
    SCHEMA = ACCESS.split(",", 1)[1]

    def __init__(self, store: Store, mode: str = "async", most: int = 10_000, batch: int = 256, wait: float = 0.25):
        if mode not in ("sync", "async", "off"):
            raise ValueError("mode is sync, async or off")
        self.store, self.mode, self.most, self.batch, self.wait = store, mode, most, batch, wait
        self.refused = self.lost = 0
        self._rows: list[tuple] = []
        self._lock, self._writing, self._timer = threading.Lock(), threading.Lock(), None

    def record(self, **fields: object) -> bool:
        """False if the record was refused."""
        if self.mode == "off":
            return True
        row = tuple(fields.get(n, datetime.now(UTC).replace(tzinfo=None) if n == "ts" else None) for n in self.NAMES)
        with self._lock:
            if len(self._rows) >= self.most:
                self.refused += 1
                return False
            self._rows.append(row)
            full = self.mode == "sync" or len(self._rows) >= self.batch
            if not full and self._timer is None:
                self._timer = threading.Timer(self.wait, self.flush)
                self._timer.daemon = True
                self._timer.start()
        if full:
            self.flush()
        return True

    def flush(self) -> None:
        with self._writing:
            with self._lock:
                rows, self._rows, self._timer = self._rows, [], None
            if not rows:
                return
            try:
                self.store.log_access(self.store.spark.createDataFrame(rows, self.SCHEMA))
            except Exception:
                self.lost += len(rows)
                if self.mode == "sync":
                    raise

    def close(self) -> None:
        if self._timer is not None:
            self._timer.cancel()
        self.flush()
