"""One consistent form for texts that look the same.

Method: script-aware repair.  A text is first brought to one form of widths, spaces, invisible characters and
combining accents.  In words of mixed scripts the dominant script is that of the letters that look like no other
script's; their look-alikes are replaced by letters of that script, all or none, if the word so written stands in
the corpus vocabulary: the corpus's words of one script.  Where it does not, but the mixed word itself is spelled
in several ways, the most frequent of these is taken for all, so that nothing is written that nobody writes.

A word of look-alikes only shows no script, be it mixed or not.  So that texts that look the same agree, it takes
the spelling (one script first) that is most frequent in texts of the same dominant script; in Latin texts the
Latin one, if it exists.  Words of one script with a letter that tells it are never changed.

Letter case, accents, raised digits, fractions, kinds of dash and line breaks stay as they are.

Defined cases: null stays null and empty stays empty, neither pairs with anything; equal texts are no pair
with each other, but each of them pairs with every look-alike of other characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.chars import MIXED, clean, replace_words, skeleton, suspects
from codeloom.util import lookup, small_side, written

#: Documents of one look-alike group that a task joins at once.
GROUP_ROWS = 1000


_WORD = "word string, look string, settled boolean, rank int, own boolean"
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("look", pa.string()), ("settled", pa.bool_()), ("rank", pa.int32()), ("own", pa.bool_())]))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("word", "look", "settled", "rank", "own")
    for b in batches:
        texts = [None if t is None else clean(t) for t in b.column(1).to_pylist()]
        found = [suspects(t or "") for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), pa.array([c for c, _ in found], pa.int32()), pa.array([[dict(zip(names, w)) for w in ws] for _, ws in found], _WORDS)], ["doc_id", "form", "raw", "script", "words"])


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [replace_words(t, {x["word"]: x["best"] for x in fixed}) if fixed else t for t, fixed in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], ["doc_id", "form", "raw"])


def repairs(base: DataFrame) -> DataFrame:
    """``word, script, best``: what replaces a word in texts of a dominant script (-1: in all, as the word shows its own)."""
    asked = base.where(F.size("words") > 0).select(F.inline("words")).groupBy("word").agg(*[F.first(c).alias(c) for c in ("look", "settled", "rank")])
    said = base.select("script", F.explode(F.split("form", r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''").groupBy("word", "script").agg(F.count(F.lit(1)).alias("n"))
    where = F.when(F.col("settled"), -1).otherwise(F.col("script"))
    found = lookup(said, asked, ["word"], "asked").groupBy("look", where.alias("script"), "word", "rank").agg(F.sum("n").alias("n"))
    found, _ = written(found, "spellings")
    rank = F.when(F.col("script") == 0, F.col("rank")).otherwise(F.when(F.col("rank") == MIXED, MIXED).otherwise(0))
    best = found.groupBy("look", "script").agg(F.min_by("word", F.struct(rank, -F.col("n"), F.col("word"))).alias("best"), F.count(F.lit(1)).alias("ways")).where("ways > 1")
    return found.join(best, ["look", "script"]).where("word <> best").select("word", "script", "best")


def consistent_form(docs: DataFrame) -> DataFrame:
    """``doc_id, form, raw``: the consistent form of every text, and a digest of the text as it stands."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.sha2("text", 256).alias("raw"))
    base, _ = written(base.mapInArrow(_cleaned, f"doc_id bigint, form string, raw string, script int, words array<struct<{_WORD.replace(' ', ':').replace(',:', ',')}>>"), "clean")
    # ids and words only: the texts stay where they are
    own = base.where(F.size("words") > 0).select("doc_id", F.col("script").alias("doc_script"), F.inline("words")).where("own")
    own = own.select("doc_id", "word", F.when(F.col("settled"), -1).otherwise(F.col("doc_script")).alias("script"))
    fixes = lookup(own, repairs(base), ["word", "script"], "repairs").groupBy("doc_id").agg(F.collect_set(F.struct("word", "best")).alias("fixes"))
    rest = base.select("doc_id", "form", "raw")
    return lookup(rest, fixes, ["doc_id"], "fixes", "left").select("doc_id", "form", "raw", "fixes").mapInArrow(_replaced, "doc_id bigint, form string, raw string")


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` of documents that look the same and are not the same characters."""
    forms = consistent_form(docs.where(F.length("text") > 0)).select("doc_id", F.sha2("form", 256).alias("look"), "raw")
    # groups with two texts or more; equal copies are folded before anything is shuffled by group
    groups = forms.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n")).groupBy("look").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).where("texts > 1").select("look", "n")
    members, _ = written(forms.join(small_side(groups, "groups"), "look"), "alike")
    parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    a = members.select("look", F.col("doc_id").alias("doc_id_a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("salt"))
    b = members.select("look", F.col("doc_id").alias("doc_id_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    return a.join(b, ["look", "salt"]).where("raw_a <> raw_b AND doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else skeleton(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "look"])


def forms_and_looks(docs: DataFrame) -> DataFrame:
    """``doc_id, form, look``: digests of each text's consistent form and of its look (all look-alikes replaced, whatever the words)."""
    looks = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_looks, "doc_id bigint, look string")
    forms = consistent_form(docs).select("doc_id", F.sha2("form", 256).alias("form"))
    return forms.join(looks.select("doc_id", F.sha2("look", 256).alias("look")), "doc_id")
