"""A read-only subset of Cypher, compiled to DataFrame joins.

Text is tokenised, parsed to patterns and expressions, and lowered clause by clause; the optimizer sees one
ordinary plan (searches of variable length run level by level first).  A bound variable is a set of columns
``var__property``; only properties that the text uses are carried.  Property names may be written in either
case (``fqName`` or ``fq_name``); ``label`` and ``labels(n)[0]`` are the label, ``type(r)`` an edge's type.
Clauses that write are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import traverse

_TOKEN = re.compile(r"\s+|//[^\n]*|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+|\d+)|(?P<param>\$\w+)|(?P<id>[A-Za-z_]\w*|`[^`]+`)|(?P<op><>|<=|>=|=~|\.\.|->|<-|[-+*/%=<>()\[\]{},.:|])")
_WRITES = {"CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "DROP", "COPY", "ALTER", "LOAD", "BEGIN", "COMMIT", "ROLLBACK"}
_AGGREGATES = {"count", "collect", "min", "max", "sum", "avg"}
#: Where the text gives no bound, a search goes on until it finds nothing new.
UNBOUNDED = None


class CypherError(ValueError):
    """The text is not in the subset."""


@dataclass
class Node:
    var: str
    label: str | None
    props: dict[str, Any]


@dataclass
class Rel:
    var: str
    types: list[str]
    direction: str  # out, in, both
    low: int = 1
    high: int | None = 1
    many: bool = False


@dataclass
class Pattern:
    parts: list
    name: str | None = None
    shortest: bool = False


@dataclass
class Clause:
    kind: str
    patterns: list[Pattern] = field(default_factory=list)
    where: Any = None
    items: list[tuple[Any, str]] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: Any = None
    limit: Any = None


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


class Parser:
    """Recursive descent; expressions are tuples ``(kind, ...)``."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if m is None:
                raise CypherError(f"unexpected {text[pos]!r} at {pos}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            pos = m.end()
        self.i = self.fresh = 0

    # -------------------------------------------------- tokens
    def peek(self, *words: str) -> bool:
        for k, w in enumerate(words):
            if self.i + k >= len(self.tokens):
                return False
            kind, t = self.tokens[self.i + k]
            if kind == "str" or (t.upper() if kind == "id" else t) != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word} at {self.tokens[self.i][1] if self.i < len(self.tokens) else 'the end'}")

    def name(self) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] != "id":
            raise CypherError("expected a name")
        self.i += 1
        return self.tokens[self.i - 1][1].strip("`")

    def anonymous(self) -> str:
        self.fresh += 1
        return f"_a{self.fresh}"

    # -------------------------------------------------- clauses
    def query(self) -> list[list[Clause]]:
        for kind, t in self.tokens:
            if kind == "id" and t.upper() in _WRITES:
                raise CypherError(f"only reading is allowed: {t}")
        parts = [self.single()]
        self.union_all = False
        while self.take("UNION"):
            self.union_all = self.take("ALL")
            parts.append(self.single())
        if self.i < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.i][1]}")
        return parts

    def single(self) -> list[Clause]:
        out = []
        while self.i < len(self.tokens) and not self.peek("UNION"):
            if self.take("OPTIONAL", "MATCH"):
                out.append(self.match("optional"))
            elif self.take("MATCH"):
                out.append(self.match("match"))
            elif self.take("UNWIND"):
                e = self.expr()
                self.need("AS")
                out.append(Clause("unwind", items=[(e, self.name())]))
            elif self.take("WITH"):
                out.append(self.project("with"))
            elif self.take("RETURN"):
                out.append(self.project("return"))
            else:
                raise CypherError(f"unexpected {self.tokens[self.i][1]}")
        if not out or out[-1].kind != "return":
            raise CypherError("RETURN is missing")
        return out

    def match(self, kind: str) -> Clause:
        c = Clause(kind, [self.pattern()])
        while self.take(","):
            c.patterns.append(self.pattern())
        if self.take("WHERE"):
            c.where = self.expr()
        return c

    def project(self, kind: str) -> Clause:
        c = Clause(kind, distinct=self.take("DISTINCT"))
        while True:
            start = self.i
            e = self.expr()
            text = "".join(t for _, t in self.tokens[start : self.i])
            c.items.append((e, self.name() if self.take("AS") else text.split(".")[-1] if e[0] == "prop" else text))
            if not self.take(","):
                break
        if self.take("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.take("DESC") or self.take("DESCENDING")
                c.order.append((e, bool(down)))
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                if not self.take(","):
                    break
        if self.take("SKIP"):
            c.skip = self.expr()
        if self.take("LIMIT"):
            c.limit = self.expr()
        if self.take("WHERE"):
            c.where = self.expr()
        return c

    # -------------------------------------------------- patterns
    def pattern(self) -> Pattern:
        name = None
        if self.i + 1 < len(self.tokens) and self.tokens[self.i][0] == "id" and self.tokens[self.i + 1][1] == "=":
            name = self.name()
            self.need("=")
        if self.take("SHORTESTPATH", "("):
            p = Pattern(self.chain(), name, True)
            self.need(")")
            return p
        return Pattern(self.chain(), name)

    def chain(self) -> list:
        parts: list = [self.node()]
        while self.peek("-") or self.peek("<-"):
            parts += [self.rel(), self.node()]
        return parts

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.tokens[self.i][0] == "id" else self.anonymous()
        label = self.name() if self.take(":") else None
        props: dict[str, Any] = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                props[snake(key)] = self.expr()
                self.take(",")
        self.need(")")
        return Node(var, label, props)

    def rel(self) -> Rel:
        back = self.take("<-")
        if not back:
            self.need("-")
        r = Rel(self.anonymous(), [], "in" if back else "both")
        if self.take("["):
            if self.tokens[self.i][0] == "id":
                r.var = self.name()
            if self.take(":"):
                r.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    r.types.append(self.name())
            if self.take("*"):
                r.many, r.low, r.high = True, 1, UNBOUNDED
                if self.tokens[self.i][0] == "num":
                    r.low = r.high = int(self.number())
                if self.take(".."):
                    r.high = int(self.number()) if self.tokens[self.i][0] == "num" else UNBOUNDED
            self.need("]")
        if back:
            self.need("-")
        elif self.take("->"):
            r.direction = "out"
        else:
            self.need("-")
        return r

    def number(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    # -------------------------------------------------- expressions
    def expr(self) -> tuple:
        e = self.conjunction()
        while self.take("OR"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.negation()
        while self.take("AND"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        e = self.sum()
        while True:
            for op in ("=", "<>", "<=", ">=", "<", ">", "=~"):
                if self.take(op):
                    e = ("cmp", op, e, self.sum())
                    break
            else:
                if self.take("IN"):
                    e = ("in", e, self.sum())
                elif self.take("STARTS", "WITH"):
                    e = ("call", "starts_with", [e, self.sum()], False)
                elif self.take("ENDS", "WITH"):
                    e = ("call", "ends_with", [e, self.sum()], False)
                elif self.take("CONTAINS"):
                    e = ("call", "contains", [e, self.sum()], False)
                elif self.take("IS", "NOT", "NULL"):
                    e = ("not", ("null", e))
                elif self.take("IS", "NULL"):
                    e = ("null", e)
                else:
                    return e

    def sum(self) -> tuple:
        e = self.product()
        while self.peek("+") or self.peek("-"):
            self.i += 1
            e = ("math", self.tokens[self.i - 1][1], e, self.product())
        return e

    def product(self) -> tuple:
        e = self.postfix()
        while self.peek("*") or self.peek("/") or self.peek("%"):
            self.i += 1
            e = ("math", self.tokens[self.i - 1][1], e, self.postfix())
        return e

    def postfix(self) -> tuple:
        e = self.atom()
        while self.take("["):
            low = None if self.peek("..") else self.expr()
            if self.take(".."):
                e = ("slice", e, low, None if self.peek("]") else self.expr())
            else:
                e = ("index", e, low)
            self.need("]")
        return e

    def atom(self) -> tuple:
        if self.i >= len(self.tokens):
            raise CypherError("unexpected end")
        kind, t = self.tokens[self.i]
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("-"):
            return ("math", "-", ("lit", 0), self.postfix())
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if self.take("EXISTS", "{"):
            self.take("MATCH")
            c = self.match("match")
            self.need("}")
            return ("exists", c)
        if self.take("CASE"):
            cases, other = [], None
            while self.take("WHEN"):
                test = self.expr()
                self.need("THEN")
                cases.append((test, self.expr()))
            if self.take("ELSE"):
                other = self.expr()
            self.need("END")
            return ("case", cases, other)
        self.i += 1
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", t[1:-1]))
        if kind == "num":
            return ("lit", float(t) if "." in t else int(t))
        if kind == "param":
            return ("param", t[1:])
        if kind != "id":
            raise CypherError(f"unexpected {t}")
        if t.lower() in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[t.lower()])
        if self.take("("):
            distinct, args = self.take("DISTINCT"), []
            while not self.take(")"):
                args.append(("star",) if self.take("*") else self.expr())
                self.take(",")
            return ("call", t.lower(), args, distinct)
        if self.take("."):
            return ("prop", t, snake(self.name()))
        return ("var", t.strip("`"))


def _walk(e: Any):
    """All tuples inside an expression, clauses or patterns."""
    if isinstance(e, tuple):
        yield e
        for x in e:
            yield from _walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from _walk(x)
    elif isinstance(e, dict):
        yield from _walk(list(e.values()))
    elif isinstance(e, (Clause, Pattern, Node, Rel)):
        yield from _walk(list(vars(e).values()))


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict[str, Any]) -> None:
        self.nodes, self.edges, self.params = nodes, edges, params
        self.columns = set(nodes.columns)

    def run(self, clauses: list[Clause]) -> DataFrame:
        self.used: dict[str, set[str]] = {}
        for e in _walk(clauses):
            if e and e[0] == "prop":
                self.used.setdefault(e[1], set()).add(e[2])
            elif len(e) == 2 and e[0] == "var":
                self.used.setdefault(e[1], set()).update({"label", "fq_name", "name"})
        self.vars: dict[str, str] = {}  # variable -> node, edge, path or value
        frame: DataFrame | None = None
        for c in clauses:
            if c.kind == "match":
                frame = self.where(self.bind(c.patterns, frame, c.where), c.where)
            elif c.kind == "optional":
                frame = self.optional(c, frame)
            elif c.kind == "unwind":
                base = self.nodes.sparkSession.range(1).drop("id") if frame is None else frame
                frame = base.withColumn(c.items[0][1], F.explode(self.value(c.items[0][0])))
                self.vars[c.items[0][1]] = "value"
            else:
                frame = self.projected(c, frame)
        return frame

    # -------------------------------------------------- patterns
    def node_frame(self, n: Node) -> DataFrame:
        keep = {"id", "label"} | self.used.get(n.var, set()) | set(n.props)
        unknown = keep - self.columns
        df = self.nodes.select(*[(F.lit(None).cast("string") if p in unknown else F.col(p)).alias(f"{n.var}__{p}") for p in sorted(keep)])
        if n.label:
            df = df.where(F.col(f"{n.var}__label") == n.label)
        for p, e in n.props.items():
            df = df.where(F.col(f"{n.var}__{p}") == self.value(e))
        return df

    def bind(self, patterns: list[Pattern], frame: DataFrame | None, where: Any = None) -> DataFrame:
        for p in patterns:
            nodes, rels = p.parts[::2], p.parts[1::2]
            if frame is not None and not {n.var for n in nodes} & set(self.vars) and not self.joined_by({x.var for x in p.parts}, where):
                raise CypherError(f"({nodes[0].var}) shares no variable with what comes before, and WHERE sets nothing of it equal to that: all pairs are not given")
            frame = self.add_node(nodes[0], frame)
            for a, r, b in zip(nodes, rels, nodes[1:]):
                frame = self.add_step(a, r, b, frame, p)
            if p.name:
                self.vars[p.name] = "path"
                if not any(r.many for r in rels):
                    frame = frame.withColumn(f"{p.name}__length", F.lit(len(rels)))
        return frame

    def joined_by(self, own: set[str], where: Any) -> bool:
        """Whether WHERE sets something of the variables ``own`` equal to something of those bound before."""

        def uses(e: Any) -> set[str]:
            return {x[1] for x in _walk(e) if len(x) > 1 and x[0] in ("var", "prop")}

        for e in self.conjuncts(where):
            if e[0] == "cmp" and e[1] == "=":
                a, b = uses(e[2]), uses(e[3])
                if a and b and any(x <= own and y <= set(self.vars) for x, y in ((a, b), (b, a))):
                    return True
        return False

    def add_node(self, n: Node, frame: DataFrame | None) -> DataFrame:
        if n.var in self.vars:
            for p, e in ([("label", ("lit", n.label))] if n.label else []) + list(n.props.items()):
                frame = frame.where(F.col(f"{n.var}__{p}") == self.value(e))
            return frame
        self.vars[n.var] = "node"
        df = self.node_frame(n)
        if frame is None:
            return df
        return frame.join(df)  # WHERE has an equality, which the optimizer makes the join's key

    def add_step(self, a: Node, r: Rel, b: Node, frame: DataFrame, p: Pattern) -> DataFrame:
        here, there = f"{a.var}__id", f"{b.var}__id"
        e = self.edges.where(F.col("edge_type").isin(r.types)) if r.types else self.edges
        if r.many or p.shortest:
            step = self.search(e, r, frame.select(F.col(here).alias("source")).distinct(), p)
        else:
            keep = sorted(({"edge_type"} | self.used.get(r.var, set())) & set(self.edges.columns) - {"src", "dst"})
            cols = [F.col(c).alias(f"{r.var}__{c}") for c in keep]
            out = e.select(F.col("src").alias(here), F.col("dst").alias("_there"), *cols)
            back = e.select(F.col("dst").alias(here), F.col("src").alias("_there"), *cols)
            step = out if r.direction == "out" else back if r.direction == "in" else out.unionAll(back)
            self.vars[r.var] = "edge"
        frame = frame.join(step.withColumnRenamed("source", here) if "source" in step.columns else step, here)
        if b.var in self.vars:
            return self.add_node(b, frame.where(F.col("_there") == F.col(there)).drop("_there"))
        self.vars[b.var] = "node"
        return frame.withColumnRenamed("_there", there).join(self.node_frame(b), there)

    def search(self, e: DataFrame, r: Rel, seeds: DataFrame, p: Pattern) -> DataFrame:
        """``source, _there`` and the length, for steps of variable length."""
        pairs = e.select("src", "dst").distinct()
        flip = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = pairs if r.direction == "out" else flip if r.direction == "in" else pairs.unionByName(flip).distinct()
        hit = traverse.reached(pairs, seeds, r.high).select("source", F.col("node").alias("_there"), F.col("depth").alias("_d"))
        if r.low == 0:
            hit = hit.unionByName(seeds.select("source", F.col("source").alias("_there"), F.lit(0).alias("_d")))
        elif r.low > 1:
            hit = hit.where(F.col("_d") >= r.low)
        return hit.withColumnRenamed("_d", f"{p.name}__length") if p.name else hit.drop("_d")

    def optional(self, c: Clause, frame: DataFrame) -> DataFrame:
        before = dict(self.vars)
        shared = sorted({n.var for p in c.patterns for n in p.parts[::2]} & set(before))
        if not shared:
            raise CypherError("OPTIONAL MATCH needs a bound variable")
        keys = [f"{v}__id" for v in shared]
        own = [x for x in frame.columns if x.split("__")[0] in shared]
        found = self.where(self.bind(c.patterns, frame.select(*own).distinct(), c.where), c.where)
        return frame.join(found.select(*keys, *[x for x in found.columns if x not in frame.columns]), keys, "left")

    # -------------------------------------------------- filters
    def where(self, frame: DataFrame, e: Any) -> DataFrame:
        for part in self.conjuncts(e):
            negated = part[0] == "not" and part[1][0] == "exists"
            if negated or part[0] == "exists":
                frame = self.exists(frame, (part[1] if negated else part)[1], negated)
            else:
                frame = frame.where(self.value(part))
        return frame

    def conjuncts(self, e: Any) -> list:
        return [] if e is None else self.conjuncts(e[1]) + self.conjuncts(e[2]) if e[0] == "and" else [e]

    def exists(self, frame: DataFrame, c: Clause, negated: bool) -> DataFrame:
        shared = sorted({n.var for p in c.patterns for n in p.parts[::2]} & set(self.vars))
        kept, keys = dict(self.vars), [f"{v}__id" for v in shared]
        own = [x for x in frame.columns if x.split("__")[0] in shared]
        found = self.where(self.bind(c.patterns, frame.select(*own).distinct(), c.where), c.where).select(*keys).distinct()
        self.vars = kept
        return frame.join(found, keys, "left_anti" if negated else "left_semi")

    # -------------------------------------------------- projection
    def aggregated(self, e: Any) -> bool:
        return any(x[0] == "call" and x[1] in _AGGREGATES for x in _walk(e) if len(x) > 1)

    def projected(self, c: Clause, frame: DataFrame) -> DataFrame:
        kinds, groups, sums = {}, [], []
        for e, alias in c.items:
            if e[0] == "var" and self.vars.get(e[1]) in ("node", "edge") and c.kind == "with":
                cols = [F.col(x).alias(alias + x[len(e[1]) :]) for x in frame.columns if x.split("__")[0] == e[1]]
                kinds[alias] = self.vars[e[1]]
                groups += cols
            else:
                kinds[alias] = "value"
                (sums if self.aggregated(e) else groups).append(self.value(e).alias(alias))
        if sums:
            out = frame.groupBy(*groups).agg(*sums)
        else:
            hidden = [self.value(e).alias(f"_o{i}") for i, (e, _) in enumerate(c.order) if not self.is_alias(e, c)] if not c.distinct else []
            out = frame.select(*groups, *hidden)
        order = c.order
        aliases = [a for _, a in c.items]
        if c.distinct:
            out = out.distinct()
        visible = [x for x in out.columns if not re.fullmatch(r"_o\d+", x)]
        if order:
            keys = []
            for i, (e, down) in enumerate(order):
                key = F.col(f"`{self.is_alias(e, c)}`") if self.is_alias(e, c) else F.col(f"_o{i}") if f"_o{i}" in out.columns else self.value(e)
                keys.append(key.desc_nulls_first() if down else key.asc_nulls_last())
            out = out.orderBy(*keys, *[F.col(f"`{x}`") for x in visible if x in aliases])
        if c.skip is not None:
            out = out.offset(int(self.constant(c.skip)))
        if c.limit is not None:
            out = out.limit(int(self.constant(c.limit)))
        out = out.select(*[F.col(f"`{x}`") for x in visible])
        self.vars = kinds
        return self.where(out, c.where)

    def is_alias(self, e: Any, c: Clause) -> str | None:
        for own, alias in c.items:
            if own == e or e == ("var", alias):
                return alias
        return None

    def constant(self, e: Any) -> Any:
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.parameter(e[1])
        raise CypherError("expected a number or a parameter")

    def parameter(self, name: str) -> Any:
        if name not in self.params:
            raise CypherError(f"no value for ${name}")
        return self.params[name]

    def value(self, e: Any) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            v = self.parameter(e[1])
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if kind == "list":
            return F.array(*map(self.value, e[1]))
        if kind == "prop":
            if self.vars.get(e[1]) == "edge" and e[2] not in self.edges.columns:
                return F.lit(None)
            return F.col(f"{e[1]}__{e[2]}")
        if kind == "var":
            if self.vars.get(e[1]) == "node":
                return F.struct(*[F.col(f"{e[1]}__{p}").alias(p) for p in ("id", "label", "fq_name", "name")])
            if self.vars.get(e[1]) == "edge":
                return F.col(f"{e[1]}__edge_type")
            return F.col(f"`{e[1]}`")
        if kind == "and":
            return self.value(e[1]) & self.value(e[2])
        if kind == "or":
            return self.value(e[1]) | self.value(e[2])
        if kind == "not":
            return ~self.value(e[1])
        if kind == "null":
            return self.identity(e[1]).isNull()
        if kind == "in":
            return F.array_contains(self.value(e[2]), self.value(e[1]))
        if kind == "cmp":
            return self.compared(e[1], e[2], e[3])
        if kind == "math":
            a, b = self.value(e[2]), self.value(e[3])
            if e[1] == "+":
                return F.concat(a.cast("string"), b.cast("string")) if any(x[0] == "lit" and isinstance(x[1], str) for x in (e[2], e[3])) else a + b
            if e[1] == "/":  # whole numbers divide whole
                return F.try_divide(a - a % b, b).cast("bigint")
            return a - b if e[1] == "-" else a * b if e[1] == "*" else a % b
        if kind == "index":
            if e[1][:2] == ("call", "labels"):
                return F.col(f"{e[1][2][0][1]}__label")
            i = self.constant(e[2]) if e[2][0] in ("lit", "param") else -self.constant(e[2][3])
            return F.try_element_at(self.value(e[1]), F.lit(i + 1 if i >= 0 else i))
        if kind == "slice":
            low = self.constant(e[2]) if e[2] else 0
            high = self.constant(e[3]) if e[3] else 1 << 30
            return F.slice(self.value(e[1]), low + 1, high - low)
        if kind == "case":
            out = None
            for test, then in e[1]:
                out = F.when(self.value(test), self.value(then)) if out is None else out.when(self.value(test), self.value(then))
            return out if e[2] is None else out.otherwise(self.value(e[2]))
        if kind == "call":
            return self.called(e[1], e[2], e[3])
        raise CypherError(f"not supported here: {kind}")

    def identity(self, e: Any) -> Column:
        return F.col(f"{e[1]}__id") if e[0] == "var" and self.vars.get(e[1]) == "node" else self.value(e)

    def compared(self, op: str, a: Any, b: Any) -> Column:
        x, y = self.identity(a), self.identity(b)
        if op == "=~":
            return x.rlike(f"^(?:{self.constant(b)})$")
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def called(self, name: str, args: list, distinct: bool) -> Column:
        if name == "count":
            if args == [("star",)]:
                return F.count(F.lit(1))
            return F.countDistinct(self.identity(args[0])) if distinct else F.count(self.identity(args[0]))
        if name in ("length", "size") and args[0][0] == "var" and self.vars.get(args[0][1]) == "path":
            return F.col(f"{args[0][1]}__length")
        if name == "type":
            return F.col(f"{args[0][1]}__edge_type")
        if name == "label" and args[0][0] == "var":
            return F.col(f"{args[0][1]}__label")
        if name == "labels":
            return F.array(F.col(f"{args[0][1]}__label"))
        if name == "id":
            return F.col(f"{args[0][1]}__id")
        v = [self.value(a) for a in args]
        simple = {
            "collect": lambda: F.array_sort(F.collect_set(v[0]) if distinct else F.collect_list(v[0])), "min": lambda: F.min(v[0]), "max": lambda: F.max(v[0]), "sum": lambda: F.sum(v[0]), "avg": lambda: F.avg(v[0]),
            "coalesce": lambda: F.coalesce(*v), "lower": lambda: F.lower(v[0]), "tolower": lambda: F.lower(v[0]), "upper": lambda: F.upper(v[0]), "toupper": lambda: F.upper(v[0]), "trim": lambda: F.trim(v[0]),
            "tostring": lambda: v[0].cast("string"), "tointeger": lambda: v[0].try_cast("bigint"), "timestamp": lambda: F.to_timestamp(v[0]), "datetime": lambda: F.to_timestamp(v[0]), "size": lambda: F.size(v[0]),
            "split": lambda: F.split(v[0], re.escape(self.constant(args[1]))), "starts_with": lambda: F.startswith(v[0], v[1]), "ends_with": lambda: F.endswith(v[0], v[1]), "contains": lambda: F.contains(v[0], v[1]),
            "regexp_matches": lambda: v[0].rlike(self.constant(args[1])), "list_slice": lambda: F.slice(v[0], v[1], v[2] - v[1] + 1), "substring": lambda: F.substring(v[0], self.constant(args[1]) + 1, self.constant(args[2]) if len(args) > 2 else 1 << 30), "abs": lambda: F.abs(v[0]),
        }
        if name not in simple:
            raise CypherError(f"unknown function {name}")
        return simple[name]()


def run(text: str, nodes: DataFrame, edges: DataFrame, params: dict[str, Any] | None = None) -> DataFrame:
    """The result of a query over a graph; parameters that the text does not use are ignored."""
    parser = Parser(text)
    parts = parser.query()
    results = [Compiler(nodes, edges, params or {}).run(p) for p in parts]
    if len(results) == 1:
        return results[0]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    return out if parser.union_all else out.distinct()
