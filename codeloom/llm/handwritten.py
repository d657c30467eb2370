"""Files that nobody wrote by hand here: generated, minified, vendored, or data put into code.

Method: attribute files.  Those of the repositories are parsed, their globs resolved by directory and line, and
their marks applied.  Repositories that declare nothing get equivalent lines, mined from the corpus: every
directory (wherever it lies, and by its path), and every file ending, is a candidate pattern; it becomes a line
if nearly all files that it matches, in all repositories, show by their content that they were not written by
hand.  What no such line matches gets a line of its own path if its content shows it.  Lines that public
repositories commonly declare stand before all of these.  Content is only the evidence that lines are mined
from: a marker in a file's header, lines of one shape in long runs, code squeezed into long lines, literals that
make up most of it, a notice of somebody else's library, or the same code as files known to be vendored.

Precedence, as within an attribute file: common lines, directory names, endings, directory paths from the root
down, single files; the last that matches names the kind.  A repository's own lines come last, nearest directory
and then later line first: what they take back (``-generated``, ``=false``) is taken back from all others.

Defined cases: null content counts as no evidence, a pattern may still match; empty files likewise; null paths
match no pattern; a null project declares nothing; repeated rows give one; empty tables give none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import attributes
from codeloom.util import lookup, spread, written

#: A mined pattern needs so large a share of its files with evidence; a copied text, of the files that hold it.
MINED_SHARE, COPIED_SHARE = 0.95, 0.5

_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma)\b)|/\*|\*|--|;|<!--|\"\"\"|'''|%|REM\b)", re.I)
_PASS_LINE = re.compile(r"\s*(?:$|['\"]use strict['\"];?$|<\?php|@echo off)")
_GENERATED = re.compile(
    r"""@generated\b | \bauto-?generated\b | <auto-generated | \bauto-?gen\b
    | \b(?:is|was|been|code|file|source|automatically)?\s*generated\s*(?:by|from|with|using|via|automatically|on|at|code|file|source)\b
    | \bautomatically\s+(?:generated|created|produced|written|built)\b
    | \bmachine[- ](?:written|generated|made|produced)\b
    | \b(?:produced|emitted|created|built|written|compiled|derived)\s+(?:automatically\s+)?by\b.*(?:hands\s+off|do\s+not|don't|compiler|generator|tool|script|\d+\.\d+)
    | \bdo\s+not\s+(?:edit|modify|change|touch|alter)\b(?=\s*$|\s*[.!;,:*)-]|\s+(?:this|it|manually|by\s+hand|directly|or\b|any|the\s+(?:file|code|output|contents?|generated)\b))
    | \b(?:manual\s+)?(?:changes|edits|modifications)\b.*\b(?:lost|overwritten|vanish|discarded|undone)\b
    | \bre-?run\b.*\binstead\b | \bhands\s+off\b
    | \berzeugt\s+(?:von|mit|durch)\b | \bautomatisch\s+(?:erzeugt|erstellt|generiert)\b | \bnicht\s+(?:von\s+hand\s+|manuell\s+)?(?:bearbeiten|ändern|editieren)\b
    | \bgénérée?\s+(?:par|automatiquement|à\s+partir)\b | \bne\s+pas\s+(?:modifier|éditer)\b
    | \b(?:generado|gerado|generato)\s+(?:por|da|dal|automatic\w+|automátic\w+)\b | \bno\s+(?:editar|modificar)\b | \bnão\s+(?:edite|editar|modificar)\b | \bnon\s+modificare\b
    | \bсгенерирован | \bсоздан[оа]?\s+автоматически | \bне\s+редактировать | 自動生成 | 自动生成 | 請勿編輯 | 请勿编辑 | 編集しないで""",
    re.I | re.X,
)
_VENDORED = re.compile(
    r"""\bupstream\s+(?:release|version|source|commit)\b | \boriginal\s+(?:archive|distribution|source|package)\b | \(c\)\s+the\s+\S+\s+contributors\b
    | \bdistributed\s+under\b | \bsee\s+its\s+own\b | \b(?:vendored|copied|imported|taken|adapted)\s+from\b | @preserve\b | @license\b
    | ^\W*[a-z][\w.-]*\s+v?\d+\.\d+\.\d+\W*$""",
    re.I | re.X | re.M,
)
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfFdD]?(?![\w.])")
_PACKED = re.compile(r"[A-Za-z0-9+/=_-]{44,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_JSON_PART = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]', re.S)
_LOCK_KEY = re.compile(r"\w*lock\w*version\w*", re.I)
_BLANKS = re.compile(r"\s+")
_MAP = re.compile(r"^//[#@]\s*sourceMappingURL=", re.M)


def header(text: str) -> str:
    """The comments before the first code of a file."""
    out, inside = [], ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.strip()
        if inside:
            out.append(s)
            if inside in s:
                inside = ""
        elif _COMMENT_LINE.match(s):
            out.append(s)
            for start, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")):
                if s.startswith(start) and end not in s[len(start) :]:
                    inside = end
        elif not _PASS_LINE.match(s):
            break
    return "\n".join(out)


def is_lock(text: str) -> bool:
    """Whether a JSON object has a key of its own (not of a part) that states a lock file's version."""
    depth = 0
    for m in _JSON_PART.finditer(text):
        c = m[0][0]
        if c == '"':
            if depth == 1 and m[2] and _LOCK_KEY.fullmatch(m[1]):
                return True
        else:
            depth += 1 if c in "{[" else -1
    return False


def uniform_share(lines: list[str]) -> float:
    """Share of the lines in the longest run whose shapes (names and numbers aside) repeat with a period up to 8."""
    shapes = [_NUMBER.sub("0", _WORD.sub("a", _STRING.sub("s", x))) for x in lines]
    best = 0
    for period in range(1, 9):
        run = 0
        for i in range(period, len(shapes)):
            run = run + 1 if shapes[i] == shapes[i - period] else 0
            if run >= max(8, 4 * period) and run + period > best:
                best = run + period
    return best / len(lines) if lines else 0.0


def evidence(extension: str, text: str | None) -> str | None:
    """What a file's content shows: 'generated', 'minified', 'vendored', 'data' or nothing."""
    if not text or not text.strip():
        return None
    top = header(text)
    if top and _GENERATED.search(top):
        return "generated"
    if top and _VENDORED.search(top):
        return "vendored"
    if extension == "json":
        return "generated" if is_lock(text) else None
    solid = len(text) - sum(len(m) for m in _BLANKS.findall(text))
    packed = sum(len(m) for m in _PACKED.findall(text))
    if packed > 0.5 * solid:
        return "data"
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    long = sum(len(x) for x in lines if len(x) > 160)
    if long > 0.6 * len(text) and len(text) - solid < 0.15 * len(text):
        return "minified"
    if _MAP.search(text) and len(text) > 60 * len(lines):
        return "minified"
    if len(lines) >= 6 and sum(len(m) for m in _NUMBER.findall(text)) > 0.5 * solid:
        return "data"
    if len(lines) >= 10 and uniform_share(lines) > 0.5:
        return "data" if extension == "sql" else "generated"
    return None


def body_digest(text: str | None) -> str | None:
    """Digest of the code: lines without comments, blanks and line ends; null without code."""
    if not text:
        return None
    body = "\n".join(s for x in text.splitlines() if (s := x.strip()) and not _COMMENT_LINE.match(s))
    return hashlib.sha256(body.encode()).hexdigest()[:32] if body else None


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = [None if p is None else p.replace("\\", "/") for p in b.column(2).to_pylist()]
        texts = b.column(4).to_pylist()
        declared = ["generated" if (x or "").lower().endswith(("-generated", "_generated", "(generated)")) else None for x in b.column(3).to_pylist()]
        shown = [d or evidence((p or "").rsplit(".", 1)[-1].lower(), t) for p, d, t in zip(paths, declared, texts)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths, pa.string()), pa.array(shown, pa.string()), pa.array([attributes.common_kind(p or "") for p in paths], pa.string()), pa.array(map(body_digest, texts), pa.string())], ["file_id", "project_id", "path", "shown", "common", "body"])


def with_copies(seen: DataFrame) -> DataFrame:
    """``seen`` with evidence for files whose code is that of vendored ones, where these are a fair share of those that hold it."""
    own = F.col("shown").eqNullSafe("vendored") | F.col("common").eqNullSafe("vendored")
    holds = seen.where("body is not null").groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("k"), F.count_if(F.col("shown").isNull() & ~own).alias("open"))
    library = holds.where((F.col("open") > 0) & (F.col("k") > 0) & (F.col("k") >= COPIED_SHARE * F.col("n"))).select("body")
    blank = seen.where("shown is null and body is not null").select("file_id", "body")
    copied = lookup(blank, library, ["body"], "library").select("file_id", F.lit("vendored").alias("copied"))
    return seen.join(copied, "file_id", "left").withColumn("shown", F.coalesce("shown", "copied")).drop("copied", "body")


def candidates(seen: DataFrame) -> DataFrame:
    """``file_id, shown, rank, pattern``: every pattern of an attribute file that would match a file's path."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    line = lambda rank, pattern: F.struct(F.lit(rank).cast("int").alias("rank") if isinstance(rank, int) else rank.cast("int").alias("rank"), pattern.alias("pattern"))
    names = F.transform(F.array_distinct(dirs), lambda d: line(1, F.concat(F.lit("**/"), d, F.lit("/**"))))
    paths = F.transform(dirs, lambda d, i: line(i + 3, F.concat(F.lit("/"), F.array_join(F.slice(dirs, F.lit(1), i + 1), "/"), F.lit("/**"))))
    ending = F.regexp_extract(F.lower(F.element_at(parts, -1)), r"([._-][a-z0-9]+\.[a-z0-9]+)$", 1)
    tail = F.filter(F.array(line(2, F.concat(F.lit("*"), ending))), lambda x: x["pattern"] != "*")
    return seen.where("path is not null").select("file_id", "shown", F.inline(F.concat(names, tail, paths)))


def mined_lines(seen: DataFrame) -> DataFrame:
    """``pattern, rank, kind``: the lines that the corpus bears out, for two files or more."""
    per = candidates(seen).groupBy("pattern", "rank").agg(F.count(F.lit(1)).alias("n"), F.count("shown").alias("k"), F.mode("shown", True).alias("kind"))
    return per.where((F.col("n") > 1) & (F.col("k") >= MINED_SHARE * F.col("n"))).select("pattern", "rank", "kind")


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for project, path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            directory = path.replace("\\", "/").rpartition("/")[0]
            rows += [{"project_id": project, "directory": directory, "rule": {"line": n, "regex": r, "kind": k, "mark": m}} for n, r, k, m in attributes.rules(text or "", directory)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("project_id", pa.string()), ("directory", pa.string()), ("rule", _RULE)]))


_RULE = pa.struct([("line", pa.int32()), ("regex", pa.string()), ("kind", pa.string()), ("mark", pa.bool_())])
_COMPILED: dict[str, re.Pattern[str]] = {}


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file, kind and attribute file the last rule that matches."""
    for b in batches:
        rows = []
        for file_id, path, depth, rules in zip(*(b.column(i).to_pylist() for i in range(4))):
            last = {}
            for r in rules:
                pattern = _COMPILED.get(r["regex"]) or _COMPILED.setdefault(r["regex"], re.compile(r["regex"]))
                if pattern.match(path):
                    last[r["kind"]] = r["mark"]
            rows += [{"file_id": file_id, "depth": depth, "kind": k, "mark": m} for k, m in last.items()]
        if len(_COMPILED) > 100_000:
            _COMPILED.clear()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file_id", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("mark", pa.bool_())]))


def declared_marks(files: DataFrame, seen: DataFrame) -> DataFrame | None:
    """``file_id, declared`` from the attribute files among the rows; None if there is none.

    A file meets the attribute files of its own directory and those above it, not all of its repository.
    """
    own = files.where(F.col("path").rlike(r"(^|[/\\])\.gitattributes$") & F.col("content").isNotNull()).select("project_id", "path", "content")
    if own.isEmpty():
        return None
    rules = own.mapInArrow(_rules, "project_id string, directory string, rule struct<line:int,regex:string,kind:string,mark:boolean>")
    rules = rules.groupBy("project_id", "directory").agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # the lines of one attribute file
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory")))
    asked = seen.where("path is not null").select("file_id", "project_id", "path", F.inline(above))
    met = lookup(asked, rules, ["project_id", "directory"], "rules").select("file_id", "path", "depth", "rules")
    hits = met.mapInArrow(_hits, "file_id string, depth int, kind string, mark boolean")
    last = hits.groupBy("file_id", "kind").agg(F.max_by("mark", "depth").alias("mark"))  # the nearest directory decides
    return last.where("mark is not null").groupBy("file_id").agg(F.max("mark").alias("declared"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """``file_id, project_id, reason, source, pattern`` of the files nobody wrote by hand here.

    ``reason`` is the kind, ``source`` says whose line decided: 'declared', 'file', 'directory', 'ending' or 'common'.
    """
    kept = files.where(F.col("file_id").isNotNull()).select("file_id", "project_id", "path", "language", "content")
    seen = spread(kept).mapInArrow(_shown, "file_id string, project_id string, path string, shown string, common string, body string")
    seen, _ = written(seen.dropDuplicates(["file_id"]), "shown")
    seen, _ = written(with_copies(seen), "evidence")
    matched = lookup(candidates(seen).select("file_id", "pattern", "rank"), mined_lines(seen), ["pattern", "rank"], "lines")
    lines = matched.groupBy("file_id").agg(F.max_by(F.struct("kind", "pattern", "rank"), F.struct("rank", "pattern")).alias("line"))
    out = seen.join(lines, "file_id", "left")
    line = F.col("line")
    nothing = F.lit(None).cast("string")
    found = (
        F.when(line.isNotNull(), F.struct(line["kind"].alias("reason"), F.when(line["rank"] == 2, "ending").otherwise("directory").alias("source"), line["pattern"].alias("pattern")))
        .when(F.col("shown").isNotNull(), F.struct(F.col("shown").alias("reason"), F.lit("file").alias("source"), F.coalesce(F.concat(F.lit("/"), F.col("path")), F.lit("")).alias("pattern")))
        .when(F.col("common").isNotNull(), F.struct(F.col("common").alias("reason"), F.lit("common").alias("source"), nothing.alias("pattern")))
    )
    declared = declared_marks(files, seen)
    if declared is not None:
        out = out.join(declared, "file_id", "left")
        own = F.struct(F.lit("declared").alias("reason"), F.lit("declared").alias("source"), nothing.alias("pattern"))
        found = F.when(F.col("declared"), own).when(F.col("declared").isNull(), found)
    return out.select("file_id", "project_id", found.alias("found")).where("found is not null").select("file_id", "project_id", "found.*")
