"""Which parser reads which file; one contract for all: path and text in, events out."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from codeloom.sources.parsers import code, data
from codeloom.sources.parsers.base import Sink

#: (language, extensions, parser); names without an extension are matched whole, in lower case.
REGISTRY: list[tuple[str, tuple[str, ...], Callable[[Sink], None]]] = [
    ("java", ("java",), partial(code.braces, language="java")), ("python", ("py", "pyi"), code.python), ("typescript", ("ts", "tsx"), partial(code.braces, language="typescript")), ("javascript", ("js", "jsx", "mjs", "cjs"), partial(code.braces, language="javascript")),
    ("vue", ("vue",), data.vue), ("go", ("go",), partial(code.braces, language="go")), ("rust", ("rs",), partial(code.braces, language="rust")), ("c", ("c", "h"), partial(code.braces, language="c")), ("cpp", ("cpp", "cc", "cxx", "hpp", "hh"), partial(code.braces, language="cpp")),
    ("csharp", ("cs",), partial(code.braces, language="csharp")), ("kotlin", ("kt", "kts"), partial(code.braces, language="kotlin")), ("php", ("php",), partial(code.braces, language="php")), ("solidity", ("sol",), partial(code.braces, language="solidity")),
    ("sql", ("sql", "ddl"), data.sql), ("plsql", ("pls", "plsql", "pks", "pkb"), partial(data.sql, columns=False, routines=True)), ("tsql", ("tsql",), partial(data.sql, columns=False, routines=True)), ("hive", ("hql", "hive"), data.nothing),
    ("yaml", ("yml", "yaml"), data.yaml_), ("json", ("json",), data.json_), ("env", ("env", "properties", "ini"), data.env), ("maven", ("pom.xml",), data.pom), ("style", ("css", "scss", "sass", "less", "styl"), data.style), ("docker", ("dockerfile",), data.dockerfile),
    ("terraform", ("tf",), data.terraform), ("bicep", ("bicep",), data.bicep), ("graphql", ("graphql", "gql", "graphqls"), data.graphql), ("protobuf", ("proto",), data.protobuf), ("sparql", ("rq", "sparql"), data.sparql), ("cypher", ("cypher", "cql"), data.cypher),
]
_BY_ENDING = {e: (language, run) for language, endings, run in REGISTRY for e in endings}
EXTRA: list[Callable[[str, str], list[dict]]] = []


def parsers_of(path: str) -> tuple[str, Callable[[Sink], None]] | None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name.startswith("dockerfile."):
        name = "dockerfile"
    return _BY_ENDING.get(name) or _BY_ENDING.get(name.rsplit(".", 1)[-1])


def parse_file(path: str, text: str) -> list[dict]:
    """The events of a file, numbered in order; none for a file nobody reads."""
    found = parsers_of(path)
    if not found:
        return []
    language, run = found
    sink = Sink(path.replace("\\", "/"), language, text)
    run(sink)
    for extra in EXTRA:
        sink.events += extra(path, text)
    return sink.events
