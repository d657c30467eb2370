import re

import pytest

from codeloom.llm import attributes as A
from codeloom.llm import handwritten as H

FILES = "file_id string, project_id string, path string, language string, content string, reason string"
HAND = "import os\n\n\ndef load(path):\n    # generated totals go here\n    total = 0\n    for line in open(path):\n        if line.strip():\n            total += len(line)\n        else:\n            total -= 1\n    return total\n\n\nclass Store:\n    def __init__(self, root):\n        self.root = root or os.getcwd()\n\n    def path(self, name):\n        return os.path.join(self.root, name)\n"


@pytest.mark.parametrize(
    "pattern, directory, yes, no",
    [
        ("*.min.js", "", ["a.min.js", "x/y/b.min.js"], ["a.js"]),
        ("/gen/*.py", "", ["gen/a.py"], ["x/gen/a.py", "gen/b/a.py"]),
        ("gen/**", "sub", ["sub/gen/a/b.py"], ["gen/a.py", "sub/x/gen/a"]),
        ("**/lib/**", "", ["lib/a", "x/lib/y/z"], ["xlib/a"]),
        ("a?c.[ch]", "", ["abc.c", "d/axc.h"], ["a/c.c", "abc.x"]),
        ("docs/**/x.md", "", ["docs/x.md", "docs/a/b/x.md"], ["x.md"]),
    ],
)
def test_globs(pattern, directory, yes, no):
    r = re.compile(A.glob_regex(pattern, directory))
    assert all(r.match(p) for p in yes) and not any(r.match(p) for p in no)


def test_rules_of_an_attribute_file():
    got = A.rules('# c\n*.go linguist-generated=true text\n"a b/*" -linguist-vendored\nx linguist-generated=false\ny !linguist-generated\n', "")
    assert [(n, k, m) for n, _, k, m in got] == [(2, "generated", True), (3, "vendored", False), (4, "generated", False), (5, "generated", None)]


@pytest.mark.parametrize(
    "extension, text, kind",
    [
        ("py", "# Code generated by tool 1.2 from x.avd. DO NOT EDIT.\n" + HAND, "generated"),
        ("js", "/*\n * Copyright the own authors.\n */\n// Erzeugt von X-Generator 2.0 - nicht von Hand bearbeiten!\nvar a = 1;", "generated"),
        ("ts", "// parcelkit 2.11.5\n// (c) the parcelkit contributors, X licence\nexport const a = 1;", "vendored"),
        ("py", HAND, None),
        ("py", '"""Writes headers."""\nHEADER = "// Code generated from %s. DO NOT EDIT."\n' + HAND, None),
        ("py", "# do not edit the ledger by hand\n" + HAND, None),
        ("js", "// Copyright the own authors.\nfunction a(b) {\n  return b;\n}\n", None),
        ("js", "var a=function(b){return b&&b.c?b.d(24):void 0};" * 30, "minified"),
        ("js", "const WORDS = ['" + "', 'some words to be read aloud ".join(["x"] * 20) + "'];\n" + "\n".join(f"function f{i}(a) {{\n  const b{' = a' * i};\n{'  a();' * i}\n  return a + {i};\n}}\n" for i in range(1, 9)), None),
        ("go", "package a\n\nvar raw = `\n" + "\n".join("eRK+dCqqkIR4hV806rtgg0uaGOtW4IWwF5XUzd7F3XntuMIV9nMgk6JEjXE9SxrSLUvV3yWLEx/h" for _ in range(20)) + "\n`\n", "data"),
        ("py", "P = [\n" + "\n".join(f"    [{i}.25, -{i}.5, {i * 7}.125]," for i in range(40)) + "\n]\n", "data"),
        ("java", "class A {\n" + "\n".join(f"    private int f{i}_;\n    public int getF{i}() {{ return f{i}_; }}\n    public A setF{i}(int v) {{ f{i}_ = v; return this; }}" for i in range(12)) + "\n}\n", "generated"),
        ("sql", "\n".join(f"INSERT INTO seed (id, code) VALUES ({i}, 'C{i}');" for i in range(40)), "data"),
        ("json", '{\n  "lockVersion": 3,\n  "packages": {}\n}', "generated"),
        ("json", '{\n  "a": [1, 2, 3, 4],\n  "b": 1\n}', None),
        ("json", '{\n  "name": "' + "x" * 5000 + '",\n  "tree": {"a": [1]},\n  "lockfileVersion": 3\n}', "generated"),
        ("json", '{"a": {"lockVersion": 3}, "text": "lockVersion"}', None),
        ("py", None, None), ("py", "", None),
    ],
)
def test_evidence(extension, text, kind):
    assert H.evidence(extension, text) == kind
    if text and extension != "json":
        assert H.evidence(extension, text.replace("\n", "\r\n")) == kind


def test_files(spark, rows):
    gen = "// @generated by x\n"
    data = [
        ("1", "p", "src/a.py", "python", HAND, ""), ("1", "p", "src/a.py", "python", HAND, ""), ("2", "p", "node_modules/x/y.js", "javascript", None, ""), ("3", "p", "src\\b.ts", "typescript-generated", "let a = 1;", ""),
        ("4", "p", "out/a.js", None, gen, ""), ("5", "p", "out/b.js", None, gen, ""), ("6", "q", "out/c.js", None, gen, ""), ("7", "q", "out/d.js", None, "let", ""),
        ("8", "q", ".gitattributes", None, "out/** -linguist-generated\n*.go linguist-generated\n", ""), ("9", "q", "hand/.gitattributes", None, "*.go -linguist-generated\n", ""), ("10", "q", "hand/a.go", "go", gen, ""), ("11", "q", "b.go", "go", "package b\n", ""),
        ("12", "p", "vendor/lib/z.py", "python", "# c\n" + HAND, ""), ("13", "p", "src/vendor/own.py", "python", HAND.replace("total", "sum_"), ""), ("14", "p", None, None, None, ""),
    ]
    got = {r["file_id"]: r["reason"] for r in H.not_handwritten(spark.createDataFrame(data, FILES)).collect()}
    # 6 and 10 are taken back by the repository, 7 shows nothing and its directory is not marked by enough files
    assert got == {"1": "vendored", "2": "vendored", "3": "generated", "4": "generated", "5": "generated", "11": "declared", "12": "vendored"}
    more = spark.createDataFrame([(f"m{i}", "r", f"emit/x{i}.js", None, gen if i else "let", "") for i in range(30)], FILES)
    assert {r["file_id"] for r in H.not_handwritten(more).collect()} == {f"m{i}" for i in range(30)}
    assert rows(H.not_handwritten(spark.createDataFrame([], FILES))) == []


def test_mined_lines_mark_files_without_evidence_and_name_their_source(spark):
    gen = "// @generated by x\n"
    data = [(f"d{i}", "pq"[i % 2], f"a/emit/x{i}.js", None, gen if i else None, "") for i in range(40)]
    data += [(f"e{i}", "r", f"own/n{i}_pb9.py", None, "# @generated by x\n" if i else HAND, "") for i in range(40)] + [(f"h{i}", "r", f"own/h{i}.py", None, HAND + f"\nx{i} = 1\n", "") for i in range(9)]
    data += [("s", "r", "own/single.py", None, "# @generated by x\n", ""), ("v", "r", "node_modules/a.js", None, "", ""), ("n", None, None, None, "// @generated by x\n", "")]
    got = {r["file_id"]: (r["reason"], r["source"], r["pattern"]) for r in H.not_handwritten(spark.createDataFrame(data, FILES)).collect()}
    assert got == {f"d{i}": ("generated", "directory", "/a/emit/**") for i in range(40)} | {f"e{i}": ("generated", "ending", "*_pb9.py") for i in range(40)} | {
        "s": ("generated", "file", "/own/single.py"), "v": ("vendored", "common", None), "n": ("generated", "file", ""),
    }


def test_nearest_attribute_file_and_later_line_decide(spark):
    rules = "*.js generated\n*.js -generated\nkeep/*.js vendored\n"
    data = [("0", "p", ".gitattributes", None, rules, ""), ("1", "p", "a.js", None, "// @generated by x\n", ""), ("2", "p", "keep/b.js", None, "", ""), ("3", "p", "keep/sub/.gitattributes", None, "*.js generated\nz.js !generated\n", ""), ("4", "p", "keep/sub/c.js", None, "", ""), ("5", "p", "keep/sub/z.js", None, "", ""), ("6", "q", "a.js", None, "", "")]
    got = {r["file_id"]: r["source"] for r in H.not_handwritten(spark.createDataFrame(data, FILES)).collect()}
    assert got == {"2": "declared", "4": "declared"}


def test_short_code_is_compared_as_well_and_blank_bodies_meet_nowhere(spark):
    data = [("1", "p", "third_party/a.py", None, "x = 1\n", ""), ("2", "p", "src/b.py", None, "# mine\nx = 1\n", ""), ("3", "p", "src/c.py", None, "# only\n", ""), ("4", "p", "third_party/d.py", None, "# only\n", "")]
    got = {r["file_id"]: r["reason"] for r in H.not_handwritten(spark.createDataFrame(data, FILES)).collect()}
    assert got == {"1": "vendored", "2": "vendored", "4": "vendored"}
