"""Source files that do not parse.

Method: bundled grammars are turned into parse tables; every file's whole token stream is run through the
tables of its language, and the first token that no continuation fits is reported.  The language is that of
the path's extension; see :mod:`codeloom.llm.syntax`.

Defined cases: null and empty contents are no cases (a JSON text of blanks is one: it has no value); files of
other extensions are not judged; repeated rows give one result; nesting of any depth is parsed, as the parser
keeps its own stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.syntax.parse import EXTENSIONS, first_error
from codeloom.util import spread

_SCHEMA = "file_id string, project_id string, scan_id bigint, language string, broken boolean, line int, column int, token string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        broken, line, column, token = [], [], [], []
        for language, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            bad = first_error(language, text) if text else None
            broken.append(bad is not None)
            before = text[: bad[0]] if bad else ""
            line.append(before.count("\n") + 1 if bad else None)
            column.append(len(before) - before.rfind("\n") if bad else None)
            token.append(bad[1] if bad else None)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(broken), pa.array(line, pa.int32()), pa.array(column, pa.int32()), pa.array(token, pa.string())], ["file_id", "project_id", "scan_id", "language", "broken", "line", "column", "token"])


def judged(files: DataFrame) -> DataFrame:
    """Every file of a known language once: whether it is broken, and where its first error stands."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[ending]
    rows = files.where(F.col("file_id").isNotNull()).select("file_id", "project_id", F.col("scan_id").cast("bigint").alias("scan_id"), language.alias("language"), "content").where("language is not null")
    return spread(rows).mapInArrow(_parsed, _SCHEMA).dropDuplicates(["file_id"])


def broken_files(files: DataFrame) -> DataFrame:
    return judged(files).where("broken").select("file_id", "project_id", "language", "line", "column", "token")


def broken_rates(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Per repository and language: files, broken files, their rate, and the skipped files its scans state."""
    stated = scans.dropDuplicates(["scan_id"]).groupBy("project_id").agg(F.sum("files_skipped").alias("files_skipped"))
    rates = judged(files).groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("broken").cast("bigint")).alias("n_broken"))
    return rates.withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6)).join(stated, "project_id", "left")
