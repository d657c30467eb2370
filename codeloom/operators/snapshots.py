"""What changed between consecutive full deliveries of a table.

Method: the records of a delivery are sorted by key (by the hash of the key, which is as good an order as any) and
cut into content-defined chunks: a chunk begins at every key whose hash has its low bits clear, so that an inserted
or removed record only disturbs its own chunk.  Chunks whose digest equals that of the same chunk in the project's
preceding delivery are discarded whole; only the rows of unmatched chunks are joined and classified.

A task holds a key range of a project, the same in all its deliveries: projects are cut into as many ranges as
their rows need (``RANGE_ROWS``), so that a chunk is far smaller than a range, and a hot project is many ranges.
One shuffle by (project, range) serves deduplication, sorting, chunking, the digests and the join of what is left:
rows move once, and digests and rows of discarded chunks not at all after that.

Defined cases: of several rows of a record in one delivery the newest ``delivered_at`` counts (a null one
is oldest; of equal ones the greatest values win); null is a value, but a row with a null in its record
key, project or snapshot number names no record and is left out; a project's first delivery yields nothing; an
empty table yields nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.util import lookup, written

#: Mean rows of a chunk (a power of two), and rows of all deliveries that a key range should hold.
CHUNK_ROWS, RANGE_ROWS = 4, 20_000


def deliveries(df: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``project_id, snapshot_no, prev_no, next_no, ranges`` of each project's deliveries (if it has two or more)."""
    w = Window.partitionBy("project_id").orderBy("snapshot_no")
    seen = df.where(F.col("snapshot_no").isNotNull() & F.col("project_id").isNotNull()).groupBy("project_id", "snapshot_no").agg(F.count(F.lit(1)).alias("rows"))
    ranges = F.ceil(F.sum("rows").over(Window.partitionBy("project_id")) / F.lit(range_rows)).cast("int")
    out = seen.select("project_id", "snapshot_no", F.lag("snapshot_no").over(w).alias("prev_no"), F.lead("snapshot_no").over(w).alias("next_no"), ranges.alias("ranges"))
    return out.where("prev_no is not null or next_no is not null")


def _digest(*cols: Column) -> list[Column]:
    """Two independent 64-bit digests of a set of distinct rows (order does not matter)."""
    flat = [x for c in cols for x in (c.isNull(), c)]
    return [F.bit_xor(F.xxhash64(*flat)).alias("d1"), F.bit_xor(F.xxhash64(F.lit("b"), *flat)).alias("d2"), F.count(F.lit(1)).alias("n")]


def chunked(df: DataFrame, key: Column, values: list[str], chunk_rows: int = CHUNK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each chunk of each delivery: its place, its rows, and whether the deliveries before and after have the same."""
    if chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    calendar, _ = written(deliveries(df, range_rows), "deliveries")
    rows = df.select("project_id", "snapshot_no", "delivered_at", key.alias("record_key"), F.struct(*[F.col(v) for v in values]).alias("v")).where(F.col("record_key").isNotNull())
    rows = lookup(rows, calendar.select("project_id", "snapshot_no", "ranges"), ["project_id", "snapshot_no"], "sizes")
    h = F.xxhash64("record_key")
    # the hash's high bits name the range, so that ranges are pieces of the sorted keys; its low bits cut chunks
    place = F.shiftright(F.shiftrightunsigned(h, 33) * F.col("ranges"), 31).cast("int")
    rows = rows.select("project_id", place.alias("range"), "snapshot_no", "record_key", "delivered_at", "v").repartition("project_id", "range").withColumn("h", h)

    # newest row of each record; the same sort also serves the chunking below
    newest = Window.partitionBy("project_id", "range", "snapshot_no", "h", "record_key").orderBy(F.col("delivered_at").desc_nulls_last(), F.col("v").desc())
    rows = rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn", "delivered_at")
    in_order = Window.partitionBy("project_id", "range", "snapshot_no").orderBy("h", "record_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boundary = F.when(F.col("h").bitwiseAND(chunk_rows - 1) == 0, F.col("h"))
    rows = rows.withColumn("chunk", F.last(boundary, ignorenulls=True).over(in_order))

    chunks = rows.groupBy("project_id", "range", "chunk", "snapshot_no").agg(F.collect_list(F.struct("record_key", "v")).alias("rows"), *_digest(F.col("record_key"), *[F.col("v")[v] for v in values]))
    # broadcast only while it is measured small: then the chunks keep their clustering
    chunks = lookup(chunks, calendar.drop("ranges"), ["project_id", "snapshot_no"], "deliveries")
    same = Window.partitionBy("project_id", "range", "chunk").orderBy("snapshot_no")
    mark = F.struct("snapshot_no", "n", "d1", "d2")
    chunks = chunks.withColumn("before", F.lag(mark).over(same)).withColumn("after", F.lead(mark).over(same))

    def matched(other: str, number: str) -> Column:
        o = F.col(other)
        return F.coalesce((o["snapshot_no"] == F.col(number)) & (o["n"] == F.col("n")) & (o["d1"] == F.col("d1")) & (o["d2"] == F.col("d2")), F.lit(False))

    return chunks.select("project_id", "range", "chunk", "snapshot_no", "prev_no", "next_no", "n", "rows", matched("before", "prev_no").alias("as_before"), matched("after", "next_no").alias("as_after"))


def snapshot_changes(df: DataFrame, table_name: str, key: Column, values: list[str], chunk_rows: int = CHUNK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``table_name, snapshot_no, project_id, record_key, change`` between a project's consecutive deliveries.

    ``key`` names the record within its project, ``values`` are compared.
    """
    sides = F.filter(
        F.array(
            F.when(F.col("prev_no").isNotNull() & ~F.col("as_before"), F.struct(F.lit(True).alias("new"), F.col("snapshot_no").alias("at"))),
            F.when(F.col("next_no").isNotNull() & ~F.col("as_after"), F.struct(F.lit(False).alias("new"), F.col("next_no").alias("at"))),
        ),
        lambda s: s.isNotNull(),
    )
    left = chunked(df, key, values, chunk_rows, range_rows).select("project_id", "range", "rows", sides.alias("sides")).where(F.size("sides") > 0)
    left = left.select("project_id", "range", F.explode("sides").alias("s"), "rows").select("project_id", "range", "s.*", F.explode("rows").alias("r"))
    left = left.select("project_id", "range", F.col("at").alias("snapshot_no"), "r.record_key", F.when(F.col("new"), F.col("r.v")).alias("nv"), F.when(~F.col("new"), F.col("r.v")).alias("ov"))

    # both sides of a record meet in one group (a full outer join on clustered rows); each side has one row
    both = left.groupBy("project_id", "range", "snapshot_no", "record_key").agg(F.max("nv").alias("nv"), F.max("ov").alias("ov"))
    change = F.when(F.col("ov").isNull(), "added").when(F.col("nv").isNull(), "removed").when(~F.col("nv").eqNullSafe(F.col("ov")), "changed")
    out = both.select(F.lit(table_name).alias("table_name"), "snapshot_no", "project_id", "record_key", change.alias("change"))
    return out.where(F.col("change").isNotNull())


def chunk_report(df: DataFrame, table_name: str, key: Column, values: list[str], chunk_rows: int = CHUNK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``table_name, snapshot_no, n_chunks, n_matched, n_rows, n_discarded``: what equal digests spare, by delivery."""
    later = chunked(df, key, values, chunk_rows, range_rows).where("prev_no is not null").groupBy("snapshot_no")
    own = F.when(F.col("as_before"), F.col("n")).otherwise(0)
    out = later.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("as_before").alias("n_matched"), F.sum("n").alias("n_rows"), F.sum(own).alias("n_discarded"))
    return out.select(F.lit(table_name).alias("table_name"), "*")


def node_key() -> Column:
    return F.concat("label", F.lit(":"), "fq_name")


def edge_key() -> Column:
    return F.concat("source", F.lit(">"), "target")


def graph_changes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Changes of both delivered tables of the code graph."""
    return _both(snapshot_changes, nodes, edges)


def graph_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _both(chunk_report, nodes, edges)


def _both(operator, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = operator(nodes, "slice_nodes", node_key(), ["callee_count", "file_id", "start_line", "end_line"])
    return a.unionByName(operator(edges, "slice_edges", edge_key(), ["type"]))
