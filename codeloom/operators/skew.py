"""Per-key figures when a few keys hold most rows.

Method: every input split dictionary-encodes its keys, runs a numpy ``bincount`` over the codes and
hands on one dense array block per key range (hash block); the blocks are then sorted by key within their range
and summed by a distributed reduction that holds one key at a time.  A key reaches the reduction at most once per split and measure, however many rows it has,
so no task ever sees the rows of a hot key together.  Rows are never shuffled by the skewed key.

Defined cases: a null key belongs to no group; a null weight counts as 0 in sums; an empty table gives
an empty result; repeated rows count as they stand; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.util import parallelism

#: Keys a split may hold in its dictionary before it hands its blocks on and starts anew (memory bound).
DICTIONARY_KEYS = 1_000_000


class _Dense:
    """A growing dictionary of keys and one dense accumulator array per measure."""

    def __init__(self, measures: int) -> None:
        self.codes: dict[str, int] = {}
        self.sums = [np.zeros(1024, np.int64) for _ in range(measures)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Global codes of a chunk's distinct keys, and each row's index into them."""
        enc = column.dictionary_encode()
        codes = self.codes
        mapped = np.fromiter((codes.setdefault(k, len(codes)) for k in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
        for i, a in enumerate(self.sums):
            if len(a) < len(codes):
                self.sums[i] = np.concatenate([a, np.zeros(max(len(codes) - len(a), len(a)), np.int64)])
        return mapped, enc.indices

    def add(self, column: pa.Array, weights: list[np.ndarray | None]) -> None:
        keep = column.is_valid()
        if column.null_count:
            mask = keep.to_numpy(zero_copy_only=False)
            column = column.drop_null()
            weights = [None if w is None else w[mask] for w in weights]
        if not len(column):
            return
        mapped, indices = self.encode(column)
        indices = indices.to_numpy(zero_copy_only=False)
        for a, w in zip(self.sums, weights):
            if w is None:
                part = np.bincount(indices, minlength=len(mapped))
            else:
                # exact in integers: float weights of bincount would lose digits above 2**53
                part = np.zeros(len(mapped), np.int64)
                np.add.at(part, indices, w)
            a[mapped] += part

    def take(self) -> tuple[list[str], list[np.ndarray]]:
        keys, n = list(self.codes), len(self.codes)
        sums = [a[:n].copy() for a in self.sums]
        self.__init__(len(self.sums))
        return keys, sums


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.cast(pa.string()) if not pa.types.is_string(c.type) else c


def _split_blocks(keys: list[str], measures: dict[str, str | None]):
    """mapInArrow body: array blocks of one input split, per key column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {k: _Dense(len(measures)) for k in keys}

        def blocks(field: str) -> pa.RecordBatch:
            ks, sums = dense[field].take()
            return pa.RecordBatch.from_pydict({"key_field": pa.array([field] * len(ks), pa.string()), "node_id": pa.array(ks, pa.string())} | {m: pa.array(s) for m, s in zip(measures, sums)})

        for b in batches:
            weights = [None if w is None else _whole(b, w) for w in measures.values()]
            for k in keys:
                dense[k].add(_column(b, k), weights)
                if len(dense[k].codes) > DICTIONARY_KEYS:
                    yield blocks(k)
        for k in keys:
            if dense[k].codes:
                yield blocks(k)

    return run


def _whole(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _sum_blocks(measures: list[str]):
    """mapInArrow body: the sorted blocks of a key range, summed key by key as they pass; one key is held at a time."""

    def block(fields: list[str], ids: list[str], sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key_field": pa.array(fields, pa.string()), "node_id": pa.array(ids, pa.string())} | {m: pa.array(x) for m, x in zip(measures, sums)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, str] | None = None
        sums = [0] * len(measures)
        for b in batches:
            if not b.num_rows:
                continue
            fields, ids = b.column(0), b.column(1)
            new = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                differs = pa.compute.or_(pa.compute.not_equal(fields[1:], fields[:-1]), pa.compute.not_equal(ids[1:], ids[:-1]))
                new[1:] = differs.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            fields, ids = fields.take(pa.array(starts)).to_pylist(), ids.take(pa.array(starts)).to_pylist()
            parts = [np.add.reduceat(_whole(b, m), starts) for m in measures]
            if held == (fields[0], ids[0]):
                for x, s in zip(parts, sums):
                    x[0] += s
            elif held:
                yield block([held[0]], [held[1]], [np.array([s], np.int64) for s in sums])
            if len(ids) > 1:
                yield block(fields[:-1], ids[:-1], [x[:-1] for x in parts])
            held, sums = (fields[-1], ids[-1]), [int(x[-1]) for x in parts]
        if held:
            yield block([held[0]], [held[1]], [np.array([s], np.int64) for s in sums])

    return run


def dense_key_sums(df: DataFrame, keys: list[str], measures: dict[str, str | None]) -> DataFrame:
    """Sums per value of each key column: ``key_field, node_id, <measure>...`` (bigint).

    ``measures`` maps an output name to the integer column to sum, or to None to count rows.
    """
    weights = [w for w in measures.values() if w is not None]
    schema = "key_field string, node_id string, " + ", ".join(f"`{m}` bigint" for m in measures)
    cols = list(dict.fromkeys([*keys, *weights]))
    partial = df.select(*cols).mapInArrow(_split_blocks(keys, measures), schema)
    # the reduction's width follows the session's; each partition owns a hash range of the key dictionary
    ranged = partial.repartition(parallelism(df.sparkSession), "key_field", "node_id").sortWithinPartitions("key_field", "node_id")
    return ranged.mapInArrow(_sum_blocks(list(measures)), schema)


def heavy_keys(edges: DataFrame, keys: list[str], one_in: int = 100) -> DataFrame:
    """Values that hold at least one in ``one_in`` of all rows of ``edges`` in a key column."""
    total = edges.count()  # one number, from the parquet footers
    sums = dense_key_sums(edges, keys, {"edges": None})
    return sums.where(F.col("edges") * one_in >= F.lit(total)).select("key_field", "node_id", "edges")


def key_figures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, distinct partners and callees for every key: ``key_field, node_id, edges, partners, callees``.

    Pairs are folded first, by the hash of the whole pair (even, whatever the skew); what is left per pair
    is one row with its count, so that bincount gives distinct partners and edges in one pass.  An edge
    with a null partner counts as an edge but not as a partner.  callees: sum of callee_count over the rows
    of the node as they stand, null where no row states one.  A node that states callees but has no edge has
    a row as source, with no edges and partners.
    """
    pairs = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).withColumn("met", F.when(F.col("source").isNotNull() & F.col("target").isNotNull(), 1).otherwise(0))
    per_key = dense_key_sums(pairs, ["source", "target"], {"edges": "n", "partners": "met"})
    stated = nodes.where(F.col("callee_count").isNotNull()).select("id", "callee_count")
    callees = dense_key_sums(stated, ["id"], {"callees": "callee_count"}).select("node_id", "callees")
    none = F.lit(0).cast("bigint")
    return per_key.join(callees, "node_id", "full").select(F.coalesce("key_field", F.lit("source")).alias("key_field"), "node_id", F.coalesce("edges", none).alias("edges"), F.coalesce("partners", none).alias("partners"), "callees")


def heaviest_callers(nodes: DataFrame, one_in: int = 1000) -> DataFrame:
    """Nodes whose rows hold at least one in ``one_in`` of all callees: ``node_id, callees, deliveries``."""
    stated = nodes.where(F.col("callee_count").isNotNull()).select("id", "callee_count")
    total = stated.agg(F.coalesce(F.sum("callee_count"), F.lit(0))).first()[0]  # one number
    sums = dense_key_sums(stated, ["id"], {"callees": "callee_count", "deliveries": None})
    return sums.where(F.col("callees") * one_in >= F.lit(total)).select("node_id", "callees", "deliveries")
