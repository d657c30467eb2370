"""Schemas, configuration, builds, styles and infrastructure."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import yaml

from codeloom.sources.parsers.base import Key, Sink, arguments, block_end, masked


# ---------------------------------------------------------------- SQL dialects
def _clean(name: str) -> str:
    return re.sub(r"[\"`\[\]]", "", name).lower()


_NAME = r"[\w\"`\[\].$]+"


def table_uses(sink: Sink, text: str) -> None:
    """Which tables a statement reads and writes; the first keyword decides."""
    m = re.match(r"\s*(\w+)", text)
    write = bool(m) and m[1].lower() in ("insert", "update", "delete", "replace", "truncate", "merge")
    for i, m in enumerate(re.finditer(rf"\b(from|into|update|join)\s+({_NAME})", text, re.I)):
        if m[2].lower() not in ("select", "set", "lateral", "unnest"):
            name = _clean(m[2])
            sink.edge(sink.file, "WRITES_TABLE" if write and i == 0 else "READS_TABLE", sink.node(("Table", name), name=name))


def sql(sink: Sink, columns: bool = True, routines: bool = False) -> None:
    text = masked(sink.text, "dash")
    for m in re.finditer(rf"\bcreate\s+(?:temporary\s+|temp\s+|external\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*(\()?", text, re.I):
        name = _clean(m[1])
        key = sink.child(sink.file, "Table", name, m.start(), name=name)
        for part in arguments(text, m.start(2))[0] if m[2] and columns else []:
            c = re.match(rf"({_NAME})\s+(\w+)", part)
            if c and c[1].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key", "index", "like"):
                sink.child(key, "Column", f"{name}.{_clean(c[1])}", name=_clean(c[1]), type=c[2].lower(), table_ref=name)
    for statement in text.split(";"):
        if not re.match(r"\s*create\s+table", statement, re.I):
            table_uses(sink, statement)
    if routines:
        for m in re.finditer(rf"\bcreate\s+(?:or\s+replace\s+|or\s+alter\s+)?(procedure|proc|function)\s+({_NAME})", text, re.I):
            sink.child(sink.file, "Method", _clean(m[2]), m.start(), name=_clean(m[2]), kind=m[1].lower())


# ---------------------------------------------------------------- configuration
def _flat(sink: Sink, value, prefix: str) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flat(sink, v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _flat(sink, v, f"{prefix}[{i}]")
    elif prefix:
        sink.child(sink.file, "ConfigKey", prefix, name=prefix, value=value)


def yaml_(sink: Sink) -> None:
    try:
        for doc in yaml.safe_load_all(sink.text):
            _flat(sink, doc, "")
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        sink.child(sink.file, "ParseError", f"{sink.path}::error", name="error", value=str(e)[:200])


def json_(sink: Sink) -> None:
    if sink.path.rsplit("/", 1)[-1] in ("package-lock.json", "npm-shrinkwrap.json", "composer.lock", "tsconfig.tsbuildinfo"):
        return
    try:
        _flat(sink, json.loads(sink.text), "")
    except (ValueError, RecursionError):
        sink.child(sink.file, "ParseError", f"{sink.path}::error", name="error")


def env(sink: Sink) -> None:
    properties = sink.path.endswith((".properties", ".ini"))
    for m in re.finditer(r"(?m)^[ \t]*(?:export\s+)?([A-Za-z_][\w.-]*)\s*[=:]\s*(.*?)[ \t]*$", sink.text):
        sink.child(sink.file, "ConfigKey" if properties else "EnvVar", m[1], m.start(), name=m[1], value=m[2].strip("\"'"))


def pom(sink: Sink) -> None:
    try:
        root = ET.fromstring(re.sub(r"\sxmlns=\"[^\"]+\"", "", sink.text, count=1))
    except ET.ParseError:
        return
    text = lambda e, tag: (e.findtext(tag) or "").strip()
    known = {f"project.{t}": text(root, t) for t in ("version", "groupId", "artifactId")} | {p.tag: (p.text or "").strip() for p in root.findall("properties/*")}

    def filled(value: str) -> str:
        for _ in range(5):
            new = re.sub(r"\$\{([^}]+)\}", lambda m: known.get(m[1], m[0]), value)
            if new == value:
                break
            value = new
        return value

    managed = {(text(d, "groupId"), text(d, "artifactId")): filled(text(d, "version")) for d in root.findall("dependencyManagement/dependencies/dependency")}
    for d in root.findall("dependencies/dependency"):
        group, artifact, version = filled(text(d, "groupId")), filled(text(d, "artifactId")), filled(text(d, "version"))
        source = None if version else "managed"
        version = version or managed.get((group, artifact), "")
        key = sink.node(("MavenDependency", f"{group}:{artifact}"), name=artifact, group_id=group, artifact_id=artifact, version=version, scope=text(d, "scope") or "compile", version_source=source)
        sink.edge(("Project", "*"), "DEPENDS_ON", key)
        sink.edge(sink.file, "DECLARES", key)


# ---------------------------------------------------------------- styles
def style(sink: Sink) -> None:
    text = masked(sink.text, "css" if sink.path.endswith(".css") else "scss", strings=False)
    for name in dict.fromkeys(re.findall(r"\.(-?[_a-zA-Z][\w-]*)(?=[^{};]*\{)", text)):
        sink.child(sink.file, "CssClass", name, name=name, css_module=".module." in sink.path)
    for m in re.finditer(r"(?m)(?:^|[{;])\s*((?:--|\$|@)[\w-]+)\s*:\s*([^;{}]+)", text):
        if m[1].lstrip("@") not in ("media", "import", "include", "mixin", "extend", "use"):
            sink.child(sink.file, "DesignToken", m[1], name=m[1], value=m[2].strip())
    for m in re.finditer(r"@mixin\s+([\w-]+)", text):
        sink.child(sink.file, "CssMixin", m[1], m.start(), name=m[1])
    for m in re.finditer(r"@include\s+([\w-]+)", text):
        sink.edge(sink.file, "CALLS", ("CssMixin", m[1]))
    for m in re.finditer(r"@extend\s+\.([\w-]+)", text):
        sink.edge(sink.file, "EXTENDS", ("CssClass", m[1]))
    for m in re.finditer(r"var\(\s*(--[\w-]+)", text):
        sink.edge(sink.file, "READS_CONFIG", ("DesignToken", m[1]))
    for m in re.finditer(r"@(?:import|use|forward)\s+(?:url\()?['\"]([^'\"]+)", text):
        sink.edge(sink.file, "IMPORTS", sink.node(("Module", m[1]), name=m[1]))


def vue(sink: Sink) -> None:
    from codeloom.sources.parsers.code import braces

    whole = sink.text
    blank = lambda a, b: re.sub(r"[^\n]", " ", whole[:a]) + whole[a:b]
    for m in re.finditer(r"<script[^>]*>(.*?)</script>", whole, re.S):
        sink.text = blank(*m.span(1))
        braces(sink, "typescript" if 'lang="ts"' in m.group()[:80] else "javascript")
    for m in re.finditer(r"<style[^>]*>(.*?)</style>", whole, re.S):
        sink.text = blank(*m.span(1))
        style(sink)
    sink.text = whole
    m = re.search(r"<template[^>]*>(.*)</template>", whole, re.S)
    for name in dict.fromkeys(re.findall(r"<([A-Z]\w+)", masked(m[1], "xml", strings=False)) if m else []):
        sink.edge(sink.file, "REFERENCES_COMPONENT", sink.node(("VueComponent", name), name=name))


# ---------------------------------------------------------------- containers and infrastructure
def dockerfile(sink: Sink) -> None:
    text = re.sub(r"\\\s*\n", " ", re.sub(r"(?m)^\s*#.*$", "", sink.text))
    owner: Key = sink.file
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z]+)\s+(.*)", line)
        if not m:
            continue
        word, rest = m[1].upper(), m[2].strip()
        if word == "FROM":
            f = re.match(r"(?:--platform=\S+\s+)?(\S+)(?:\s+as\s+(\S+))?", rest, re.I)
            ref, _, digest = f[1].partition("@")
            repository, tag = ref.rsplit(":", 1) if ":" in ref.rsplit("/", 1)[-1] else (ref, None)
            owner = sink.child(sink.file, "ContainerStage", f"{sink.path}::{f[2] or ref}", name=f[2] or ref, base_image=f[1])
            sink.edge(owner, "DEPENDS_ON", sink.node(("ContainerImage", f[1]), name=repository, repository=repository, tag=tag or (None if digest else "latest"), digest=digest or None, is_base=True))
        elif word == "EXPOSE":
            for p in rest.split():
                port, _, protocol = p.partition("/")
                sink.edge(owner, "EXPOSES", sink.node(("ContainerPort", p), name=port, port=port, protocol=protocol or "tcp"))
        elif word == "ENV":
            pairs = re.findall(r"(\w+)=(\"[^\"]*\"|\S+)", rest) or [tuple((rest + " ").split(" ", 1))]
            for k, v in pairs:
                sink.child(owner, "EnvVar", k, name=k, value=v.strip().strip('"'))
        elif word == "ARG":
            k, _, v = rest.partition("=")
            sink.edge(owner, "DECLARES", sink.node(("ContainerBuildArg", k), name=k, default_value=v or None))
        elif word in ("CMD", "ENTRYPOINT", "RUN"):
            sink.child(owner, "ContainerCommand", f"{sink.path}::{word} {rest[:80]}", name=word, command=rest)


_TF = re.compile(r"(?m)^\s*(resource|data|module|variable|output|provider)\s+\"([^\"]+)\"(?:\s+\"([^\"]+)\")?\s*\{")
_TF_LABEL = {"resource": "Resource", "data": "DataSource", "module": "TerraformModule", "variable": "TerraformVariable", "output": "TerraformOutput", "provider": "TerraformProvider"}


def terraform(sink: Sink) -> None:
    text = masked(sink.text, "tf", strings=False)
    names: dict[str, Key] = {}
    bodies = []
    for m in _TF.finditer(text):
        kind, a, b = m[1], m[2], m[3]
        ref = {"resource": f"{a}.{b}", "data": f"data.{a}.{b}", "module": f"module.{a}", "variable": f"var.{a}"}.get(kind, f"{kind}.{a}")
        names[ref] = sink.child(sink.file, _TF_LABEL[kind], ref, m.start(), name=b or a, resource_type=a if b else None, provider=a.split("_")[0] if b else None)
        bodies.append((names[ref], text[m.end() : block_end(text, m.end() - 1)]))
    for key, body in bodies:
        for ref in dict.fromkeys(re.findall(r"(?:data\.[a-z]\w*\.\w+|module\.\w+|var\.\w+|\b[a-z]\w*_\w+\.\w+)", body)):
            target = next((names[r] for r in (ref, ".".join(ref.split(".")[:2])) if r in names), None)
            if target and target != key:
                sink.edge(key, "USES", target)


def bicep(sink: Sink) -> None:
    text = masked(sink.text, "c", strings=False)
    for m in re.finditer(r"(?m)^\s*(resource|module|param|output)\s+(\w+)\s+('[^']+'|\w+)?", text):
        label = {"resource": "Resource", "module": "BicepModule", "param": "TerraformVariable", "output": "TerraformOutput"}[m[1]]
        sink.child(sink.file, label, f"{sink.path}::{m[2]}", m.start(), name=m[2], resource_type=(m[3] or "").strip("'") or None)


# ---------------------------------------------------------------- interface languages
def graphql(sink: Sink) -> None:
    text = masked(sink.text, "hash")
    labels = {"type": "GraphqlType", "interface": "GraphqlInterface", "enum": "GraphqlEnum", "union": "GraphqlUnion", "scalar": "GraphqlScalar", "input": "GraphqlInput"}
    for m in re.finditer(r"\b(type|interface|enum|union|scalar|input)\s+(\w+)[^{\n=]*(\{)?", text):
        key = sink.child(sink.file, labels[m[1]], m[2], m.start(), name=m[2])
        if m[3] and m[1] != "enum":
            for f in re.finditer(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*([\w\[\]!]+)", text[m.end() : block_end(text, m.end() - 1)]):
                sink.child(key, "GraphqlField", f"{m[2]}.{f[1]}", name=f[1], type=f[2])


def protobuf(sink: Sink) -> None:
    text = masked(sink.text, "c")
    for m in re.finditer(r"\bimport\s+(?:public\s+)?\"", text):
        name = re.match(r"[^\"]*\"([^\"]+)\"", sink.text[m.start() :])[1]
        sink.edge(sink.file, "IMPORTS", sink.node(("Module", name), name=name))
    for m in re.finditer(r"\b(message|enum|service)\s+(\w+)\s*\{", text):
        key = sink.child(sink.file, {"message": "ProtobufMessage", "enum": "ProtobufEnum", "service": "ProtobufService"}[m[1]], m[2], m.start(), name=m[2])
        if m[1] == "service":
            for r in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", text[m.end() : block_end(text, m.end() - 1)]):
                rpc = sink.child(key, "ProtobufRpc", f"{m[2]}.{r[1]}", name=r[1])
                for t in (r[2], r[3]):
                    sink.edge(rpc, "REFERENCES", ("ProtobufMessage", t))


def sparql(sink: Sink) -> None:
    m = re.search(r"\b(select|construct|ask|describe|insert|delete)\b", masked(sink.text, "hash"), re.I)
    if m:
        sink.child(sink.file, "SparqlQuery", f"{sink.path}::query", m.start(), name=m[1].upper())


def cypher(sink: Sink) -> None:
    text = masked(sink.text, "c")
    for name in dict.fromkeys(re.findall(r"\(\s*\w*\s*:\s*(\w+)", text)):
        sink.edge(sink.file, "REFERENCES", sink.node(("CypherLabel", name), name=name))
    for name in dict.fromkeys(re.findall(r"\[\s*\w*\s*:\s*(\w+)", text)):
        sink.edge(sink.file, "REFERENCES", sink.node(("CypherRelType", name), name=name))


def nothing(sink: Sink) -> None:
    """Only the file itself."""
