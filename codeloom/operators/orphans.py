"""References to records that do not exist, by a keyed state that is kept and updated batch by batch.

Method: the state is a set of stored tables.  The parent index holds for each key when its record appeared and
disappeared; the pending table holds the references that found no record; the tally holds how many references a
key has.  A batch of events changes them: arrivals and deletions go into the index, new references probe it, those
without a record are put down as pending.  An arrival resolves all references that wait for its key, a deletion
reopens those it has; these numbers, and what is pending at the end of each month, are kept as counts.  A batch
costs in proportion to itself and to the state: references of the past are not read again.

A reference that comes in late is judged at its own time, as the index keeps the times of all changes; a change
that comes in late counts for pending references, but not in the counts of months gone by.  Keys that hold a
thousandth of a batch's references or more meet the index by a broadcast of their few rows.

Defined cases: a null key or time is no reference; of equal events of a batch one counts (repeated rows); events
at the same moment are taken as deletion, arrival, reference, so that a record that is in the next delivery as
well does not disappear; a deletion of what never appeared is none; keys must be equal as written; empty tables
give an empty result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.util import drop_written, get_text, put_text, shared_dir, skewed_lookup, small_side, written

DELETED, ARRIVED, REFERRED = 0, 1, 2
#: Before all times: when library records arrived.
ALWAYS = "0001-01-01 00:00:00"
_KEY = ["field", "key"]
_TABLES = {
    "index": "field string, key string, changes array<struct<at:timestamp,alive:boolean>>",
    "pending": "field string, key string, row_no bigint, at timestamp",
    "tally": "field string, key string, refs bigint",
    "counts": "field string, period string, orphaned bigint, resolved bigint, reopened bigint",
}


def _named(name: str) -> Column:
    """Key of a fully qualified name within its project."""
    return F.concat("project_id", F.lit("\n"), F.col(name))


def _event(field: str, key: Column, at: Column, kind: int) -> Column:
    return F.struct(F.lit(field).alias("field"), key.alias("key"), at.cast("timestamp").alias("at"), F.lit(kind).alias("kind"))


def _events(df: DataFrame, *events: Column, row_no: str | None = None) -> DataFrame:
    """One scan of a table for all events of its rows."""
    number = F.lit(None).cast("bigint") if row_no is None else F.col(row_no).cast("bigint")
    out = df.select(number.alias("row_no"), F.inline(F.array(*events)))
    return out.select("field", "key", "at", "kind", "row_no").where(F.col("key").isNotNull() & F.col("at").isNotNull())


def reference_events(edge_keys: DataFrame, findings: DataFrame) -> DataFrame:
    """The references of the code graph: ``field, key, at, kind, row_no``."""
    a = _events(edge_keys, _event("to_id", F.col("to_id"), F.col("ingested_at"), REFERRED), row_no="event_no")
    found = F.col("found_at")
    return a.unionByName(_events(findings, _event("subject", _named("subject"), found, REFERRED), _event("file_id", F.col("file_id"), found, REFERRED), row_no="finding_id"))


def parent_events(nodes: DataFrame, library: DataFrame, files: DataFrame) -> DataFrame:
    """Arrivals and deletions of records: a delivery deletes what its project's preceding one had and it has not."""
    w = Window.partitionBy("project_id").orderBy("begins")
    days = nodes.where(F.col("snapshot_no").isNotNull()).groupBy("project_id", "snapshot_no").agg(F.min("snapshot_at").alias("begins"))
    days = small_side(days.withColumn("ends", F.lead("begins").over(w)), "calendar")
    there = nodes.select("project_id", "snapshot_no", "id", "fq_name").join(days, ["project_id", "snapshot_no"])
    ids, names, always = F.col("id"), _named("fq_name"), F.lit(ALWAYS)
    a = _events(there, *(_event(f, k, F.col(t), kind) for f, k in (("to_id", ids), ("subject", names)) for t, kind in (("begins", ARRIVED), ("ends", DELETED))))
    b = _events(library, _event("to_id", ids, always, ARRIVED), _event("subject", names, always, ARRIVED))
    c = _events(files, _event("file_id", F.col("file_id"), F.col("first_seen_at"), ARRIVED), _event("file_id", F.col("file_id"), F.col("removed_at"), DELETED))
    return a.unionByName(b).unionByName(c)


def graph_events(edge_keys: DataFrame, findings: DataFrame, nodes: DataFrame, library: DataFrame, files: DataFrame) -> DataFrame:
    """The event stream of the code graph: ``field, key, at, kind, row_no``."""
    return reference_events(edge_keys, findings).unionByName(parent_events(nodes, library, files))


def changes(events: Column) -> Column:
    """Of arrivals and deletions (``at, alive``) those that change something, in order: arrival, deletion, arrival, ..."""

    def step(done: Column, e: Column) -> Column:
        last = F.element_at(done, -1)
        more = F.concat(done, F.array(e))
        back = F.slice(done, F.lit(1), F.size(done) - 1)  # gone and there again at one moment
        arrived = F.when(F.size(done) == 0, more).when(last["alive"], done).when(last["at"] == e["at"], back).otherwise(more)
        deleted = F.when(F.size(done) == 0, done).when(last["alive"], more).otherwise(done)
        return F.when(e["alive"], arrived).otherwise(deleted)

    return F.aggregate(F.array_sort(events), F.array().cast("array<struct<at:timestamp,alive:boolean>>"), step)


def _passed() -> Column:
    """How many changes of its key a reference comes after: odd while the record is there, 0 before it ever was."""
    return F.coalesce(F.size(F.filter("changes", lambda c: c["at"] <= F.col("at"))), F.lit(0))


class OrphanState:
    """The stored state; :meth:`apply` brings a batch in, the other methods read it.

    ``folder``: where a state lies that is to be carried on; without it a new one in the shared folder.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/codeloom/orphans-{uuid.uuid4().hex}"
        said = get_text(spark, f"{self.folder}/CURRENT")
        self.now = json.loads(said) if said else {t: [] for t in _TABLES} | {"until": None, "batch": -1}

    def read(self, table: str, now: dict | None = None) -> DataFrame:
        at = (now or self.now)[table]
        return self.spark.read.schema(_TABLES[table]).parquet(*at) if at else self.spark.createDataFrame([], _TABLES[table])

    def _write(self, table: str, df: DataFrame) -> str:
        path = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def apply(self, batch: DataFrame, counts: bool = True, number: int | None = None) -> None:
        """Bring in a batch of events (``field, key, at, kind, row_no``); ``counts`` keeps the numbers of each month as well.

        The state changes as a whole once all of the next one is written: a batch that fails changes nothing, and
        one whose ``number`` was brought in before is left out.
        """
        if number is not None and number <= self.now["batch"]:
            return
        is_ref = F.col("kind") == REFERRED
        refs = batch.where(is_ref).select("field", "key", "row_no", "at")
        parents = batch.where(~is_ref).select("field", "key", "at", (F.col("kind") == ARRIVED).alias("alive"))
        said = batch.agg(F.count_if(is_ref).alias("refs"), F.max("at").cast("string").alias("until")).first()  # two values
        if said["until"] is None:
            return
        new = {k: list(v) if isinstance(v, list) else v for k, v in self.now.items()} | {"until": max(said["until"], self.now["until"] or ""), "batch": self.now["batch"] if number is None else number}
        known = self.read("index").select("field", "key", F.inline("changes"))
        index = known.unionByName(parents).groupBy(*_KEY).agg(changes(F.collect_set(F.struct("at", "alive"))).alias("changes"))
        new["index"] = [self._write("index", index.where(F.size("changes") > 0))]
        if counts:  # else repeated rows do no harm until they are pending
            refs, refs_at = written(refs.dropDuplicates(), "references")
        probed = skewed_lookup(refs, self.read("index", new), _KEY, max(1, said["refs"]), how="left").select("field", "key", "row_no", "at", _passed().alias("passed"))
        if counts:
            probed, probed_at = written(probed, "probed")
        lost = probed.where(F.col("passed") % 2 == 0).select("field", "key", "row_no", "at").dropDuplicates()
        new["pending"].append(self._write("pending", lost))
        if counts:
            self._count(probed, new)
            for path in (refs_at, probed_at):
                drop_written(self.spark, path)
        put_text(self.spark, f"{self.folder}/CURRENT", json.dumps(new))
        old, self.now = self.now, new
        for table in ("index", "tally"):
            for path in set(old[table]) - set(new[table]):
                drop_written(self.spark, path)

    def _count(self, probed: DataFrame, new: dict) -> None:
        """The references of each key by the changes they come after, and what the batch's changes did to those before them."""
        fresh = probed.groupBy(*_KEY, "passed").agg(F.count(F.lit(1)).alias("n"))
        parts = self.read("tally").select("field", "key", F.lit(-1).alias("passed"), F.col("refs").alias("n")).unionByName(fresh)
        parts, parts_at = written(parts.groupBy(*_KEY).agg(F.collect_list(F.struct("passed", "n")).alias("parts")), "parts")  # one entry a change
        total = lambda kept: F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
        new["tally"] = [self._write("tally", parts.select("field", "key", total(F.col("parts")).alias("refs")))]
        happened = self.read("index", new).join(parts, _KEY).select("field", "parts", F.posexplode("changes").alias("i", "c"))
        if self.now["until"]:
            happened = happened.where(F.col("c.at") > F.lit(self.now["until"]).cast("timestamp"))
        n = total(F.filter("parts", lambda x: x["passed"] <= F.col("i")))
        moved = happened.select("field", F.date_format("c.at", "yyyy-MM").alias("period"), F.lit(0).cast("bigint").alias("orphaned"), F.when(F.col("c.alive"), n).otherwise(0).alias("resolved"), F.when(~F.col("c.alive"), n).otherwise(0).alias("reopened"))
        lost = self.spark.read.schema(_TABLES["pending"]).parquet(new["pending"][-1])
        zero = F.lit(0).cast("bigint")
        orphaned = lost.select("field", F.date_format("at", "yyyy-MM").alias("period"), F.lit(1).cast("bigint").alias("orphaned"), zero.alias("resolved"), zero.alias("reopened"))
        sums = moved.unionByName(orphaned).groupBy("field", "period").agg(*[F.sum(c).alias(c) for c in ("orphaned", "resolved", "reopened")])
        new["counts"].append(self._write("counts", sums))
        drop_written(self.spark, parts_at)

    def orphans(self) -> DataFrame:
        """References whose record was not there at their time: ``table_name, field, row_no, state, period``."""
        lost = self.read("pending").dropDuplicates()
        judged = skewed_lookup(lost, self.read("index"), _KEY, max(1, lost.count()), how="left").withColumn("passed", _passed()).where(F.col("passed") % 2 == 0)
        state = F.when(F.col("changes").isNull(), "missing").when(F.col("passed") > 0, "deleted").otherwise("late")
        return _tagged(judged.select("field", "row_no", state.alias("state"), F.date_format("at", "yyyy-MM").alias("period"))).select("table_name", "field", "row_no", "state", "period")

    def counts(self) -> DataFrame:
        """The state at each month's end: ``table_name, field, period, orphaned, resolved, reopened, pending``."""
        per = _tagged(self.read("counts")).groupBy("table_name", "field", "period").agg(*[F.sum(c).alias(c) for c in ("orphaned", "resolved", "reopened")])
        per = per.where("orphaned + resolved + reopened > 0")
        upto = Window.partitionBy("table_name", "field").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a month
        return per.withColumn("pending", F.sum(F.col("orphaned") - F.col("resolved") + F.col("reopened")).over(upto))


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("table_name", F.when(F.col("field") == "to_id", "edge_keys").otherwise("findings"))


def replayed(references: DataFrame, parents: DataFrame, counts: bool = True) -> OrphanState:
    """The state after all events, brought in month by month (of the references) in the order of their times."""
    spark, state, period = references.sparkSession, OrphanState(references.sparkSession), F.date_format("at", "yyyy-MM")
    months = sorted(r["m"] for r in references.select(period.alias("m")).distinct().collect())  # one row a month
    if months:
        number = F.least(F.size(F.filter(F.array(*map(F.lit, months)), lambda m: m < period)), F.lit(len(months) - 1))
        events, at = written(references.unionByName(parents).withColumn("batch", number), "events", "batch")
        for n in range(len(months)):
            state.apply(events.where(F.col("batch") == n).drop("batch"), counts, n)
        drop_written(spark, at)
    return state
