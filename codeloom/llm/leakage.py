"""Passages of held-out test items inside a corpus.

Method: greedy string tiling.  Documents are rendered and cut into words.  Seeds are word n-grams shared with
an item, found by a running Karp-Rabin hash over word numbers.  Seeds that follow each other on one diagonal
(the same distance between the place in the document and that in the item) are one maximal match, so that a
match costs its length once; of the matches the longest that overlaps no earlier one becomes a tile, and so on
until none of the least length is left.

A document leaks an item by a passage (one tile of ``PASSAGE_WORDS`` words) or, where passages were cut up or put
in another order, by coverage: its tiles of ``TILE_WORDS`` words or more hold ``COVERAGE`` of the item's words.

The items are the stated query set: they are read in blocks of bounded size (``BLOCK_CHARS``), each block's
hash table goes to the executors, and every document is matched against it in place: nothing is shuffled,
whatever passage is popular.  If there are several blocks, the documents are rendered once, into a written table.

Defined cases: null or empty texts and items match nothing; an item shorter than a tile has no case; repeated
documents count each; items may share passages, each is reported; a tile lies within one item.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.wikitext import page_words
from codeloom.util import written

#: Words of a passage that counts by itself, and of the least tile.
PASSAGE_WORDS, TILE_WORDS = 13, 5
#: Share of an item's words that tiles must hold to count without such a passage.
COVERAGE = 0.6
#: Characters of test items that one pass holds in memory.
BLOCK_CHARS = 20_000_000
#: Pairs of seeds that are held at once.
_PAIRS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all windows of ``n`` word numbers, each from the sums before and behind it."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.full(len(ids), _BASE, np.uint64)
        up[0] = 1
        down = np.full(m, _BACK, np.uint64)
        down[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * np.cumprod(up), dtype=np.uint64)])
        return (sums[n:] - sums[:m]) * np.cumprod(down)


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ids.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


class Items:
    """Test items as word numbers in one row, and where each seed stands in it."""

    def __init__(self, items: list[tuple[int, str]], least: int = TILE_WORDS) -> None:
        self.least, self.number = least, {}
        self.item_ids, self.starts, parts = [], [], []
        at = 0
        for item_id, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in page_words(text or "")]
            self.item_ids.append(item_id)
            self.starts.append(at)
            parts.append(np.array([*own, 0], np.int64))  # 0 ends an item
            at += len(own) + 1
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts.append(at)
        self.words = {i: e - s - 1 for i, s, e in zip(self.item_ids, self.starts, self.starts[1:])}
        self.bounds = np.array(self.starts, np.int64)
        at = self._whole(self.flat)
        h = rolling(self.flat, least)[at]
        order = np.argsort(h, kind="stable")
        self.where = at[order]
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.behind = np.append(self.first[1:], len(h))

    def _whole(self, ids: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold no 0."""
        known = np.cumsum(np.concatenate([[0], ids > 0]))
        return np.flatnonzero(known[self.least :] - known[: -self.least] == self.least) if len(ids) >= self.least else np.zeros(0, np.int64)

    def tiles(self, doc: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """Per item the tiles (length, document position, item position) of a document's words."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in doc), np.int64, len(doc))
        starts = self._whole(ids)
        if not len(starts) or not len(self.hashes):
            return {}
        h = rolling(ids, self.least)[starts]
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, p, q in self._matches(ids, starts[hit], at[hit]):
            item = int(np.searchsorted(self.bounds, q, "right")) - 1
            matches[item].append((n, p, q - self.starts[item]))
        return {self.item_ids[i]: _greedy(m, self.least) for i, m in sorted(matches.items())}

    def _matches(self, ids: np.ndarray, pos: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """All maximal matches: runs of seeds on one diagonal, compared word by word."""
        counts = self.behind[at] - self.first[at]
        runs = []
        ends = np.cumsum(counts)
        i = 0
        while i < len(pos):  # as many seeds as fit in memory
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS, "right")))
            c = counts[i:j]
            p = np.repeat(pos[i:j], c)
            q = self.where[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.first[at[i:j]], c)]
            runs.append(_joined(q - p, p, np.ones(len(p), np.int64)))
            i = j
        if not runs:
            return
        diagonal, p, n = _joined(*(np.concatenate(x) for x in zip(*runs))) if len(runs) > 1 else runs[0]
        for d, p0, k in zip(diagonal.tolist(), p.tolist(), n.tolist()):
            k += self.least - 1
            same = ids[p0 : p0 + k] == self.flat[p0 + d : p0 + d + k]
            if same.all():
                yield k, p0, p0 + d
            else:  # equal hashes of different words
                for s, e in zip(*_runs(same)):
                    if e - s >= self.least:
                        yield int(e - s), p0 + int(s), p0 + int(s) + d


def _joined(diagonal: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (diagonal, start, seeds) with those put together that follow each other."""
    order = np.lexsort((p, diagonal))
    diagonal, p, n = diagonal[order], p[order], n[order]
    new = np.ones(len(p), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return diagonal[first], p[first], np.add.reduceat(n, first)


def _greedy(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Longest first, then the first in the document and in the item; what a tile covers is cut off the others."""
    if len(matches) == 1:
        return matches
    p_end, q_end = max(p + n for n, p, _ in matches), max(q + n for n, _, q in matches)
    in_doc, in_item = np.zeros(p_end, bool), np.zeros(q_end, bool)
    heap = [(-n, p, q) for n, p, q in matches]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = in_doc[p : p + n] | in_item[q : q + n]
        if not taken.any():
            tiles.append((n, p, q))
            in_doc[p : p + n] = in_item[q : q + n] = True
        else:
            for s, e in zip(*_runs(~taken)):
                if e - s >= least:
                    heapq.heappush(heap, (int(s - e), p + int(s), q + int(s)))
    return tiles


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items, in as many blocks as their characters need, and whether a block is the only one."""
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + chars // BLOCK_CHARS
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()], n == 1


def leaked(docs: DataFrame, items: DataFrame, passage: int = PASSAGE_WORDS, tile: int = TILE_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, longest, covered, item_words, leak`` of the documents that give an item away.

    ``longest``: words of the longest tile, ``covered``: of all tiles, ``item_words``: of the item.  ``leak`` is
    'passage' if the longest tile has ``passage`` words, else 'coverage'.
    """
    texts = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, longest int, covered int, item_words int"
    spark, out, rendered = docs.sparkSession, None, False
    blocks = _blocks(items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text"))
    for block, only in blocks:
        if not only and not rendered:
            texts, _ = written(texts.mapInArrow(_as_words, "doc_id bigint, text string"), "words")
            rendered = True
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def match(batches: Iterator[pa.RecordBatch], shared=shared, name=name, rendered=rendered) -> Iterator[pa.RecordBatch]:
            known = _prepared(shared, name, min(tile, passage))
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item_id, tiles in known.tiles(text.split(" ") if rendered else page_words(text)).items():
                        longest, covered, n = max(t[0] for t in tiles), sum(t[0] for t in tiles), known.words[item_id]
                        if longest >= passage or covered >= coverage * n:
                            rows.append((doc_id, item_id, longest, covered, n))
                if rows:
                    a = np.array(rows, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), *(pa.array(a[:, i].astype(np.int32)) for i in (2, 3, 4))], ["doc_id", "item_id", "longest", "covered", "item_words"])

        part = texts.mapInArrow(match, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("leak", F.when(F.col("longest") >= passage, "passage").otherwise("coverage"))


def _as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(page_words(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])


_CACHE: dict[str, Items] = {}


def _prepared(shared, name: str, least: int) -> Items:
    """A worker builds the tables of a block once, not once a task."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = Items(shared.value, least)
    return _CACHE[name]
