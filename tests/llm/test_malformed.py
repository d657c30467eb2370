import ast
import json

import pytest

from codeloom.llm.malformed import broken_files, broken_rates
from codeloom.llm.syntax.lr import Tables
from codeloom.llm.syntax.parse import first_error

GOOD = {
    "python": ["x = [i async for i in y if i]\n", "def f(a, /, b: int = 1, *c, d=2, **e) -> None:\n\tif a: return\n\telse:\n\t\tpass\n", "match x:\n  case {'a': [1, *_]} if y: pass\n  case _: pass\n", "match = 1; print(match)\n", "with (open(a) as b, c): pass\nx = f'{a!r:>{w}}' 'b'\n", "async def f():\n    await x\n    return (yield)\n", "lambda *a, b=1: a @ b\n", "x: int\ny[1:2, ::3] = *a, b\nprint(*a, **b, c=1)\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nfinally:\n  del a, b[0]\n", "class A[T: int](B, metaclass=C):\n  '''doc'''\n  @d.e(f)\n  def g(self): ...\n", "# only a comment", "if x:\n\n    # c\n  \n    y = 1\\\n  + 2\n", "type X = int\n", "not_in = a not in b is not c\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"]}', " [] ", '"x"'],
    "javascript": ["const {a, b: [c] = [], ...d} = e ?? {}, f = async (x) => ({...x})\nlet g = a?.b?.[c]?.(d)\n`x${`y${1}`}z`", "for (const x of y) if (x) continue; else break\ndo x++; while (x < 3) y()", "class A extends B { #p = 1; static { } get x() { return this.#p } async *g() { yield* z } 'q'() {} }", "label: for (;;) { break label }\nvar r = /[/]\\/(?<n>x)/gi.test(s), q = a / b / c", "import d, * as n from 'x'\nexport default function () {}\nexport const y = 1", "a = b\n++c\nreturn_ = 1", "if (a) { } else if (b) throw new Error(`x`)\nswitch (x) { case 1: default: y() }", "x = function* () {}, y = () => {}, z = new (a.b)(), w = new A", "let async = 1, of = 2, get = 3; async = get", "#!/usr/bin/env node\n'use strict'"],
    "typescript": ["export interface A<T extends object = {}> extends B<T> { readonly a?: T[]; [k: string]: any; (x: number): string; m<U>(u: U): void }", "type F = { [K in keyof T]?: T[K] extends (infer U)[] ? U : never } & Partial<X> | `a${string}`", "abstract class C<T> implements I, J { constructor(private readonly x: number, y?: string) { super() } protected abstract f(): void; static g = <T,>(a: T) => a as unknown as T }", "enum E { A = 1, 'b' }\ndeclare module 'm' { export function f(x: number): asserts x is 1; }\nnamespace N.M { const a = 1 }", "const x = <const>['a'], y = z!.w satisfies Q, f = (a: number, ...b: string[]): a is 3 => true, m = new Map<string, Array<number>>()", "import type { A } from './a'\nexport type { A }\nlet v: typeof import('x').y, t: [a: string, b?: number], u: (new () => X)[]", "@Dec({a: 1}) class D { @Input() name!: string; get v(): number { return 1 } }", "function f(this: Window, a?: number): void\nfunction f(a: any) { return a < b && c > d }"],
    "java": ["package a.b; import static c.D.*; @A(x = {1, 2}) public final class E<T extends F & G> extends H<T[]> implements I { static { } private int[] a = {1, 2}, b[]; E() { this(1); } <U> U f(final List<? super U> x, int... y) throws Z { return (U) (x) -> { }; } }", "record P(int x, String y) { P { if (x < 0) throw new X(); } }\nsealed interface S permits P, Q {}\nenum N { A(1) { void f() {} }, B; int g; }", "class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) ; for (var x : y) { } try (var r = a(); s) { } catch (X | Y e) { } finally { } int r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; String t = \"\"\"\n  x \"q\"\n  \"\"\"; a.<B>c()::d; } }".replace("a.<B>c()::d;", "F g = a.<B>c()::d;"), "class A { int x = a >> 2 >>> 1; boolean b = o instanceof String s && s.length() > 1; Map<String, List<int[]>> m = new HashMap<>(); Object o = new int[3][]; Runnable r = A::new; }", "@interface X { int v() default 1; } class record { int record; }"],
    "go": ["package p\nimport (\n\tx \"y\"\n)\ntype T struct { A, B int `json:\"a\"`; *C }\nfunc (t *T) F(a int, b ...string) (c map[string][]int, err error) {\n\tif x := f(); x != nil { return nil, x }\n\tfor i, v := range []T{{A: 1}, {}} { go func() { ch <- v }() }\n\tswitch y := z.(type) { case int, *T: fallthrough; default: }\n\tselect { case <-done: }\n\treturn\n}\n", "package p\nfunc M[K comparable, V int | ~string](m map[K]V) []V { var r []V; for _, v := range m { r = append(r, v) }; return r[1:len(r)-1] }\nconst ( A = iota; B )\nvar _ interface { F(); ~int | string } = nil\n"],
    "c": ["#include <a.h>\n#if X\nint a;\n#else\nint b;\n#endif\n#define M(x) \\\n  (x)\ntypedef struct s { unsigned b : 3; union { int c; } d[2]; } t, *u;\nstatic inline const char *f(t *x, int (*g)(int, ...), ...) { for (int i = 0; i < 3; ++i) { if (x->d[i].c) goto end; } end: return (char *)x + sizeof(t) * 2, \"a\" \"b\"; }\nenum { A = 1, B, };\nint arr[] = { [0] = 1, [2] = {3} };\nstruct p q = { .x = 1, .y = { 2 } };\n", "int main(void) { do { switch (x) { case 1: case 'a': break; default: ; } } while (0); a ? b : c; return -1L; }\n"],
    "sql": ["-- c\nCREATE TABLE IF NOT EXISTS a.b (id BIGINT NOT NULL PRIMARY KEY, n VARCHAR(64) DEFAULT 'x''y', d DECIMAL(12, 2), CONSTRAINT c FOREIGN KEY (n) REFERENCES z (id) ON DELETE CASCADE);\nINSERT INTO a (x, y) VALUES (1, CURRENT_TIMESTAMP), (2, NULL);", "WITH t AS (SELECT DISTINCT a, count(*) AS n FROM b LEFT JOIN c ON b.i = c.i GROUP BY a HAVING count(*) > 1) SELECT t.*, CASE WHEN n > 1 THEN 'x' ELSE 'y' END k, row_number() OVER (PARTITION BY a ORDER BY n DESC) FROM t WHERE a IN (SELECT max(q) FROM z) AND n NOT BETWEEN 1 AND 2 OR x IS NOT NULL ORDER BY 1 LIMIT 5;", "UPDATE a SET b = b + 1 WHERE c LIKE '%x'; DELETE FROM a; ALTER TABLE a ADD COLUMN b INT; DROP TABLE IF EXISTS a; CREATE UNIQUE INDEX i ON a (b, c DESC)"],
}
BAD = {
    "python": ["print 'x'\n", "def f(:\n  pass\n", "if x:\n    y\n  z\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n=======\n", "'abc\n", "a = 01\n", "class A\n  pass\n", "if x:\n\ty\n        z\n", "1 = x\n", "else:\n  pass\n", "try:\n  x\n", "x = 5 y\n", "for x in y\n  z\n", "f(a b)\n"],
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1 2]", '{"a": 01}', '{"a"}', "nul", '["\\x"]', '{"a": 1} x', "// c\n1"],
    "javascript": ["let x = ;", "function f( { }", "if (x { }", "const a = `x${", "'abc\n'", "}\n", "class A { x y }", "a b", "for (;;", "<<<<<<< HEAD\n", "var x = {a: 1", "import from 'x'", "x = /[/\n/"],
    "typescript": ["interface A { x: }", "let x: = 1", "type A = | ;", "function f(a: number { }", "enum { A }", "package main\n", "class A { f(): { }"],
    "java": ["class A { int f() { return 1 } }", "class A { void f() { ", "public class { }", "class A { int x = 'ab'; }", "int x = 1;x", "class A { void f() { if x { } } }", "class A { } }", "class A { <<<<<<< HEAD }", '{"a": 1}'],
    "go": ["package p\nfunc f() {\n", "func f() {}\n", "package p\nfunc f() { x := }\n", "package p\nvar x = 'ab'\n", "package p\nfunc f()\n{\n}\nfoo\n", "package p\ntype T struct { A int B int }\n"],
    "c": ["int f( { }", "int x\nint y;", "int f() { return 1 }", "#if X\nint a;\n", "struct s { int a }\n;", "int a[] = { 1, 2 ;", "char *s = \"abc\n;", "#endif\n"],
    "sql": ["SELECT FROM WHERE", "CREATE TABLE a (x INT", "INSERT INTO a VALUES 1", "SELEC 1", "SELECT 'abc", "CREATE TABLE a (x INT y INT z);", "<<<<<<< HEAD\nSELECT 1;"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_well_formed_texts_pass(language):
    for text in GOOD[language]:
        assert first_error(language, text) is None, (text, first_error(language, text))
        assert first_error(language, text.replace("\n", "\r\n")) is None or "\\" in text, text


@pytest.mark.parametrize("language", sorted(BAD))
def test_broken_texts_fail(language):
    for text in BAD[language]:
        assert first_error(language, text) is not None, text


def test_python_and_json_agree_with_their_own_parsers():
    source = open(ast.__file__, encoding="utf-8").read()
    cuts = [source] + [source[: len(source) * k // 41] for k in range(1, 41)]
    for text in cuts:
        try:
            compile(text, "x", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)
            good = True
        except SyntaxError:
            good = False
        assert (first_error("python", text) is None) == good, text[-80:]
    data = json.dumps({"a": [{"b": [1.5, None, "x\\y\n"]}] * 4}, indent=1)
    assert first_error("json", data) is None and all(first_error("json", data[:k]) for k in range(len(data)))


def test_deep_nesting():
    n = 50_000
    assert first_error("json", "[" * n + "]" * n) is None and first_error("json", "[" * n + "]" * (n - 1)) == (2 * n - 1, "end of file")


def test_many_readings_take_no_long_time():
    n = 60
    for language, text in (("go", "package p\nvar x = " + "[]T{{" * n + "}}" * n), ("java", "class A { boolean x = " + " < ".join(f"a{i}" for i in range(n)) + "; Object y = " + "(a) " * n + "b; }"), ("typescript", "x = " + "(a, " * n + "b" + ")" * n), ("c", "int f(void) { x = " + "(a) " * n + "b; " + "a * b; " * n + "}")):
        assert first_error(language, text) is None and first_error(language, text[:-1]) is not None


def test_a_small_ambiguous_grammar():
    t = Tables("e: e '+' e | 'x' | '(' e ')'")
    assert t.first_error(list("x+x+(x+x)+x")) == -1 and t.first_error(list("x+")) == 2 and t.first_error(list("x)")) == 1


FILES = "file_id string, project_id string, scan_id long, path string, language string, content string, broken string"


def test_files_and_rates(spark, rows):
    data = [
        ("1", "p", 1, "a/b.PY", None, "x = (\n", ""), ("1", "p", 1, "a/b.PY", None, "x = (\n", ""), ("2", "p", 1, "a\\c.py", "py", "x = 1\n", ""), ("3", "p", None, "d.json", "json", "", ""), ("4", "q", 2, "d.json", "json", None, ""),
        ("5", "q", 2, "noext", "java", "(", ""), ("6", "q", 2, None, "java", "(", ""), ("7", "q", 2, "x.json", None, " ", ""), (None, "q", 2, "x.json", None, "{", ""),
    ]
    files = spark.createDataFrame(data, FILES)
    assert rows(broken_files(files)) == [("1", "p", "python", 2, 1, "NEWLINE"), ("7", "q", "json", 1, 2, "end of file")]
    scans = spark.createDataFrame([(1, "p", 3), (1, "p", 3), (2, "p", None), (3, "p", 4)], "scan_id long, project_id string, files_skipped long")
    assert rows(broken_rates(files, scans)) == [("p", "json", 1, 0, 0.0, 7), ("p", "python", 2, 1, 0.5, 7), ("q", "json", 2, 1, 0.5, None)]
    assert rows(broken_files(files.where("false"))) == []


@pytest.mark.parametrize(
    "good, text",
    [
        (False, "int f(void) {\n#ifdef A\n  return 1;\n#else\n  return 1 +;\n#endif\n}\n"),
        (False, "int f(void) {\n#if A\n  return 1;\n#elif B\n  return 2 2;\n#else\n  return 3;\n#endif\n}\n"),
        (True, "int f(void) {\n#ifdef A\n  if (x) {\n#else\n  if (y) {\n#endif\n  }\n  return 1;\n}\n"),
        (True, "#if 0\nthis is no code \"at all\n#bogus\n#else\nint x;\n#endif\n"), (True, "#if (0)\n}{\n#endif\nint x;\n"),
        (True, "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n"),
        (False, "#ifdef A\nint x;\n"), (False, "#ifdef A\n#else\n#else\n#endif\n"), (False, "#else\n"), (False, "#bogus\n"), (False, "#include <std"), (True, "#include <a.h>\n#include \"b.h\"\n#include HEADER\n"),
        (False, "<<<<<<< a\nint x;\n"), (False, "#ifdef A\n<<<<<<< a\n#endif\nint x;\n"), (False, "#ifdef A\nint y;\n#else\n<<<<<<< a\n#endif\nint x;\n"),
        (False, "crate {\n  int size;\n};\n"), (False, "t crate {\n  int size;\n};\n"), (True, "f(a) int a; { return a; }\nint (*g(void))(int) { return 0; }\n"),
    ],
)
def test_every_branch_of_c_is_parsed(good, text):
    assert (first_error("c", text) is None) == good


MARKUP = [
    (True, "const a = <div/>;\nconst b = <A.B c='d' e={f} {...g} data-h>text {i} {/* none */} <b>{j.map(k => <li key={k}>{k}</li>)}</b></A.B>;\n"),
    (True, "function F() {\n  return (\n    <>\n      {x ? <p>it's</p> : null}\n      <input value={`a${<i/>}`} />\n    </>\n  );\n}\n"),
    (True, "const less = a < b && c > d;\nconst t = x => <b>{x}</b>;\n"),
    (False, "const a = <div>;\n"), (False, "const a = <div></p>;\n"), (False, "const a = <div b=c/>;\n"), (False, "const a = <div>{x +}</div>;\n"), (False, "const a = <div>}</div>;\n"), (False, "const a = <b><i></b></i>;\n"),
]


@pytest.mark.parametrize("good, text", MARKUP)
def test_markup_in_scripts(good, text):
    assert (first_error("jsx", text) is None) == good and (first_error("tsx", text) is None) == good


def test_generics_are_no_markup():
    assert first_error("tsx", "const f = <T extends object>(x: T): T => x;\nconst g = <T,>(x: T) => <b>{x}</b>;\n") is None
    assert first_error("javascript", "const a = <div/>;\n") is not None


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_a_return_needs_a_function(language):
    for text in ("return 1;\n", "{\n  let x = 1;\n  return x;\n}\n", "if (a) {\n  for (const v of w) {\n    return v;\n  }\n}\n"):
        assert first_error(language, text) is not None
    for text in ("function f() {\n  if (a) { return 1; }\n  { return 2; }\n}\n", "const f = () => { return 1; };\n", "const o = { return: 1, m() { return 2; } };\no.return;\n", "class A { get x() { try { return 1; } finally { } } }\n"):
        assert first_error(language, text) is None


def test_remembered_stacks_change_nothing(monkeypatch):
    from codeloom.llm.syntax import lr

    texts = ["x = [1, 2]\nif x:\n    y(a, b=2)\n", "x = [1, 2\n", "def f(:\n    pass\n"]
    want = [first_error("python", t) for t in texts]
    assert [first_error("python", t) for t in texts] == want
    monkeypatch.setattr(lr, "REMEMBERED", 0)
    assert [first_error("python", t) for t in texts] == want
