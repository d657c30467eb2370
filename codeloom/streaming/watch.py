"""Live changes: debounced file events merged into a stored graph, windowed counts, and streaming orphan state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from codeloom.operators.orphans import OrphanState
from codeloom.sources.files import graph_of, parsed
from codeloom.sources.store import GraphStore
from codeloom.util import scope, shared_dir, written


def debounced(changes: DataFrame) -> DataFrame:
    """The latest change of each path in a batch (columns ``path, kind, seq``); a deletion outweighs all else."""
    per = changes.groupBy("path").agg(F.max_by("kind", "seq").alias("last"), F.max((F.col("kind") == "DELETE").cast("int")).alias("gone"), F.max("seq").alias("seq"))
    return per.select("path", F.when(F.col("gone") == 1, "DELETE").otherwise(F.col("last")).alias("kind"), "seq")


class Watcher:
    """Merges micro-batches of file changes (``path, kind, content, seq``) into a store.

    A changed file's subtree is replaced, so that what vanished from it goes as well.  A batch is one change of the
    store.  One that fails is tried ``tries`` times, then file by file, so that a file that fails holds no other
    up: it is counted, named in ``failures`` and left out.  Counters are kept in ``stats``.
    """

    def __init__(self, store: GraphStore, project_id: str, refresh: Callable[[GraphStore], None] | None = None, tries: int = 2) -> None:
        self.store, self.project_id, self.refresh, self.tries = store, project_id, refresh, tries
        self.stats = {"batches": 0, "changed": 0, "deleted": 0, "failed": 0}
        self.failures: dict[str, str] = {}

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        spark = batch.sparkSession
        with scope(spark):
            batch, _ = written(batch, "changes")
            latest, _ = written(debounced(batch), "latest")
            newest, _ = written(batch.join(latest.where("kind <> 'DELETE'").select("path", "seq"), ["path", "seq"], "left_semi").select("path", "content"), "newest")
            try:
                for left in range(self.tries - 1, -1, -1):
                    try:
                        self._replace(latest, newest)
                        break
                    except Exception:
                        if not left:
                            raise
                n = {r["gone"]: r["n"] for r in latest.groupBy((F.col("kind") == "DELETE").alias("gone")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
                self.stats["deleted"] += n.get(True, 0)
                self.stats["changed"] += n.get(False, 0)
            except Exception:
                self._one_by_one(latest, newest)
            finally:
                self.stats["batches"] += 1
        if self.refresh:
            self.refresh(self.store)

    def _replace(self, latest: DataFrame, newest: DataFrame) -> None:
        graph = [written(x, "graph")[0] for x in graph_of(parsed(newest), self.project_id)]  # what can't be parsed fails before anything is removed
        self.store.remove_files(self.project_id, latest)
        self.store.merge(*graph)

    def _one_by_one(self, latest: DataFrame, newest: DataFrame) -> None:
        for row in latest.select("path", "kind").toLocalIterator():  # the paths of one micro-batch
            own = F.col("path") == row["path"]
            try:
                self._replace(latest.where(own), newest.where(own))
                self.stats["deleted" if row["kind"] == "DELETE" else "changed"] += 1
            except Exception as e:
                self.stats["failed"] += 1
                self.failures[row["path"]] = str(e).split("\n")[0]

    def start(self, changes: DataFrame, checkpoint: str, millis: int = 250) -> StreamingQuery:
        """Run on a stream; the trigger's interval is the debounce."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{millis} milliseconds").start()


class Monitors:
    """Watchers of several trees, one stream each; one that is running is not started again."""

    def __init__(self) -> None:
        self.queries: dict[str, StreamingQuery] = {}

    def start(self, name: str, watcher: Watcher, changes: DataFrame, checkpoint: str, millis: int = 250) -> bool:
        if name in self.queries and self.queries[name].isActive:
            return False
        self.queries[name] = watcher.start(changes, checkpoint, millis)
        return True

    def running(self) -> list[str]:
        return sorted(n for n, q in self.queries.items() if q.isActive)

    def stop(self, name: str) -> None:
        q = self.queries.pop(name, None)
        if q is not None:
            q.stop()


class ProgressEvents(StreamingQueryListener):
    """Hands on what streams do as events: ``started``, ``progress`` (with the rows read) and ``ended``."""

    def __init__(self, push: Callable[[dict], None]) -> None:
        self.push = push

    def onQueryStarted(self, event) -> None:
        self.push({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self.push({"event": "progress", "id": str(event.progress.id), "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.push({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.push({"event": "ended", "id": str(event.id), "error": event.exception})


def catch_up(changes: DataFrame, watcher: Watcher, checkpoint: str) -> None:
    """Apply all changes that wait (a re-scan since the last one), then stop."""
    changes.writeStream.foreachBatch(watcher.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; works on streams (with a watermark) and tables."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e = e.withWatermark("ts", late) if e.isStreaming else e
    counts = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def orphan_stream(events: DataFrame, state: OrphanState, checkpoint: str, **trigger) -> StreamingQuery:
    """Bring a stream of events (``field, key, at, kind, row_no``) into a stored orphan state, a batch at a time.

    A batch that is run again after a failure is known by its number and left out.
    """
    each = lambda batch, number: state.apply(batch, number=number)
    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that waits into a table in memory (for tests and bounded inputs)."""
    spark: SparkSession = stream.sparkSession
    where = f"{shared_dir(spark)}/codeloom/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
