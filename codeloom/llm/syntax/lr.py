"""SLR(1) tables from a grammar's text, and a generalised LR recogniser that runs on them.

Grammar text: one rule a line, ``name: symbols | symbols``; quoted symbols and names without a rule are
terminals; ``x?``, ``x*``, ``x+`` and ``( a | b )`` have their usual meaning; ``%empty`` is the empty string.
Where the tables leave a choice, all ways are followed at once in one graph of stacks, so that a grammar may be
ambiguous: only whether a text belongs to the language is asked.

A stack holds nothing but states, so that the same stacks come back all the time, in one text and from text to
text.  Equal graphs of stacks are therefore kept as one, with the step that each token led to: most tokens cost
one lookup, as in a finite automaton that is built while it runs.
"""

from __future__ import annotations

import re
from collections import defaultdict

END = "$end"
#: Graphs of stacks that are remembered before all are forgotten (memory bound).
REMEMBERED = 300_000
_PART = re.compile(r"'[^']+'|%empty|[A-Za-z_]\w*|[()|?*+]")


class Grammar:
    """Rules of a grammar text, with the extended notation written out."""

    def __init__(self, text: str) -> None:
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.start = ""
        joined = re.sub(r"\n[ \t]+", " ", re.sub(r"(?m)^\s*;;.*$", "", text.strip()))
        for line in filter(str.strip, joined.split("\n")):
            name, body = line.split(":", 1)
            name = f"<{name.strip()}>"  # kept apart from a terminal of the same spelling
            self.start = self.start or name
            parts = _PART.findall(body)
            self.rules.setdefault(name, []).extend(self._choice(parts, 0)[0])
        unruled = {s for all_ in self.rules.values() for rhs in all_ for s in rhs if s[0] == "<" and s[-1] == ">" and len(s) > 2 and s not in self.rules}
        for name, all_ in self.rules.items():
            self.rules[name] = [tuple(s[1:-1] if s in unruled else s for s in rhs) for rhs in all_]

    def _choice(self, parts: list[str], i: int) -> tuple[list[tuple[str, ...]], int]:
        out, seq = [], []
        while i < len(parts) and parts[i] != ")":
            p = parts[i]
            if p == "|":
                out.append(tuple(seq))
                seq = []
                i += 1
                continue
            if p == "(":
                inner, i = self._choice(parts, i + 1)
                # the closing parenthesis is at i
                symbol = self._named("|".join(" ".join(x) for x in inner), inner)
            else:
                symbol = "" if p == "%empty" else p.strip("'") if p[0] == "'" else f"<{p}>"
            i += 1
            while i < len(parts) and parts[i] in "?*+":
                symbol = self._repeated(symbol, parts[i])
                i += 1
            if symbol:
                seq.append(symbol)
        out.append(tuple(seq))
        return out, i

    def _named(self, name: str, choices: list[tuple[str, ...]]) -> str:
        if len(choices) == 1 and len(choices[0]) == 1:
            return choices[0][0]
        self.rules.setdefault(f"({name})", choices)
        return f"({name})"

    def _repeated(self, symbol: str, how: str) -> str:
        if how == "?":
            return self._named(f"{symbol} ?", [(symbol,), ()])
        many = f"{symbol} +"
        self.rules.setdefault(many, [(many, symbol), (symbol,)])
        return many if how == "+" else self._named(f"{symbol} *", [(many,), ()])


def _below(nodes: list[list]) -> list[list]:
    """All nodes one link down, each once."""
    seen = {id(x): x for node in nodes for x in (node[1], *(node[2] or ())) if x is not None}
    return list(seen.values())


def _ends(nodes: list[list], n: int) -> list[list]:
    """The nodes ``n`` links down."""
    for _ in range(n):
        nodes = _below(nodes)
    return nodes


def _ends_over(node: list, n: int, top: list, below: list) -> list[list]:
    """The nodes ``n`` links down from ``node`` on ways over the link from ``top`` to ``below``."""
    out: dict[int, list] = {}
    nodes = [node]
    for left in range(n - 1, -1, -1):
        if any(x is top for x in nodes):
            out |= {id(x): x for x in _ends([below], left)}
        nodes = _below(nodes)
    return list(out.values())


class Tables:
    """Parse tables: ``actions[state][terminal]`` is (state to shift to or -1, reductions)."""

    def __init__(self, grammar: str) -> None:
        g = Grammar(grammar)
        rules = [("$start", (g.start,))] + [(lhs, rhs) for lhs, all_ in g.rules.items() for rhs in dict.fromkeys(all_)]
        names = {"$start", *g.rules}
        of = defaultdict(list)
        for i, (lhs, _) in enumerate(rules):
            of[lhs].append(i)
        follow = self._follow(rules, names)
        self._build(rules, names, of, follow)
        self._forget()

    @staticmethod
    def _follow(rules, names) -> dict[str, set[str]]:
        empty: set[str] = set()
        first = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for lhs, rhs in rules:
                before = len(first[lhs]), len(empty)
                for s in rhs:
                    first[lhs] |= first[s] if s in names else {s}
                    if s not in empty:
                        break
                else:
                    empty.add(lhs)
                changed |= before != (len(first[lhs]), len(empty))
        follow = defaultdict(set)
        follow["$start"].add(END)
        changed = True
        while changed:
            changed = False
            for lhs, rhs in rules:
                after = set(follow[lhs])
                for s in reversed(rhs):
                    if s in names:
                        if not after <= follow[s]:
                            follow[s] |= after
                            changed = True
                        after = first[s] | (after if s in empty else set())
                    else:
                        after = {s}
        return follow

    def _build(self, rules, names, of, follow) -> None:
        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            out, seen = list(kernel), set(kernel)
            for rule, dot in out:
                rhs = rules[rule][1]
                if dot < len(rhs) and rhs[dot] in names:
                    for r in of[rhs[dot]]:
                        if (r, 0) not in seen:
                            seen.add((r, 0))
                            out.append((r, 0))
            return out

        start = frozenset([(0, 0)])
        states, order = {start: 0}, [start]
        self.shifts: list[dict[str, int]] = []
        self.gotos: list[dict[str, int]] = []
        reductions: list[dict[str, list[tuple[str, int]]]] = []
        for kernel in order:
            moves, reduce = defaultdict(set), defaultdict(list)
            for rule, dot in closure(kernel):
                lhs, rhs = rules[rule]
                if dot < len(rhs):
                    moves[rhs[dot]].add((rule, dot + 1))
                else:
                    for t in follow[lhs]:
                        reduce[t].append((lhs, len(rhs)))
            shift, goto = {}, {}
            for symbol, items in moves.items():
                items = frozenset(items)
                if items not in states:
                    states[items] = len(order)
                    order.append(items)
                (goto if symbol in names else shift)[symbol] = states[items]
            self.shifts.append(shift)
            self.gotos.append(goto)
            reductions.append(reduce)
        self.actions: list[dict[str, tuple[int, tuple[tuple[str, int], ...]]]] = []
        for shift, reduce in zip(self.shifts, reductions):
            self.actions.append({t: (shift.get(t, -1), tuple(reduce.get(t, ()))) for t in {*shift, *reduce}})
        self.shifts = []

    def _feed(self, level: list[list], token: str) -> list[list]:
        """Tops after one more token; none if it does not fit.

        The stacks are a graph: a node is [state, node below, further nodes below or None, number or None]; tops of
        one state are one node, so that the work stays polynomial however many readings a text has.
        """
        actions, gotos = self.actions, self.gotos
        if len(level) == 1:  # the usual case: one stack, one thing to do
            node = level[0]
            while True:
                act = actions[node[0]].get(token)
                if act is None:
                    return []
                to, reduce = act
                if not reduce:
                    return [[to, node, None, None]]
                if to >= 0 or len(reduce) > 1:
                    break
                lhs, n = reduce[0]
                if lhs == "$start":
                    return [node]
                below = node
                while n and below[2] is None:
                    below = below[1]
                    n -= 1
                if n:
                    break
                node = [gotos[below[0]][lhs], below, None, None]
            level = [node]
        level = [[*node[:3], None] for node in level]  # nodes that are remembered are never changed
        active = {node[0]: node for node in level}
        work, done, accepted = list(level), [], []
        todo: list[tuple[list, str]] = []
        while work or todo:
            if todo:
                below, lhs = todo.pop()
                state = gotos[below[0]][lhs]
                top = active.get(state)
                if top is None:
                    active[state] = top = [state, below, None, None]
                    work.append(top)
                elif below is not top[1] and not (top[2] and any(x is below for x in top[2])):
                    top[2] = [*(top[2] or ()), below]
                    for node in done:  # reductions that run over the new link
                        for more, n in actions[node[0]].get(token, (-1, ()))[1]:
                            todo += [(x, more) for x in _ends_over(node, n, top, below)]
                continue
            node = work.pop()
            done.append(node)
            for lhs, n in actions[node[0]].get(token, (-1, ()))[1]:
                if lhs == "$start":
                    accepted.append(node)
                else:
                    todo += [(x, lhs) for x in _ends([node], n)]
        if accepted:
            return accepted[:1]
        out: dict[int, list] = {}
        for node in active.values():
            to = actions[node[0]].get(token, (-1, ()))[0]
            if to >= 0:
                if to in out:
                    out[to][2] = [*(out[to][2] or ()), node]
                else:
                    out[to] = [to, node, None, None]
        return list(out.values())

    def _forget(self) -> None:
        self._nodes: dict[tuple, list] = {}
        self._graphs: dict[tuple[int, ...], Graph] = {}
        self._start = self._graph([[0, None, None, None]])

    def _kept(self, node: list, above: tuple[int, ...] = ()) -> list | None:
        """The remembered node equal to this one; None if its graph runs in a circle."""
        if node[3] is not None:
            return node
        if id(node) in above:
            return None
        belows = []
        for x in (node[1], *(node[2] or ())):
            if x is not None:
                x = self._kept(x, (*above, id(node)))
                if x is None:
                    return None
                belows.append(x)
        belows = sorted({x[3]: x for x in belows}.values(), key=lambda x: x[3])
        key = (node[0], *[x[3] for x in belows])
        old = self._nodes.get(key)
        if old is None:
            old = self._nodes[key] = [node[0], belows[0] if belows else None, belows[1:] or None, len(self._nodes)]
        return old

    def _graph(self, tops: list[list]) -> Graph:
        kept = [self._kept(x) for x in tops]
        if any(x is None for x in kept):
            return Graph(tops)
        key = tuple(sorted(x[3] for x in kept))
        return self._graphs.setdefault(key, Graph(kept))

    def _step(self, graph: Graph, token: str) -> Graph:
        """The graph after a token; one without tops if the token does not fit."""
        tops = self._feed(graph.tops, token)
        graph.after[token] = new = self._graph(tops) if tops else NOTHING
        return new

    def first_error(self, tokens, inserted: str | None = None, may_insert=None) -> int:
        """Index of the first token that cannot be fitted in, -1 if the tokens are a sentence.

        ``inserted`` is a token that may be put before token i where ``may_insert(i)`` (automatic semicolons).
        """
        if len(self._nodes) > REMEMBERED:
            self._forget()
        graph, step = self._start, self._step
        for i, t in enumerate(tokens):
            new = graph.after.get(t) or step(graph, t)
            if new is NOTHING:
                if inserted is None or not may_insert(i):
                    return i
                new = graph.after.get(inserted) or step(graph, inserted)
                if new is NOTHING:
                    return i
                new = new.after.get(t) or step(new, t)
                if new is NOTHING:
                    return i
            graph = new
        if (graph.after.get(END) or step(graph, END)) is not NOTHING:
            return -1
        if inserted is not None:
            new = graph.after.get(inserted) or step(graph, inserted)
            if new is not NOTHING and (new.after.get(END) or step(new, END)) is not NOTHING:
                return -1
        return len(tokens)


class Graph:
    """The tops of a graph of stacks, and the graphs that tokens led to from here."""

    __slots__ = ("after", "tops")

    def __init__(self, tops: list[list]) -> None:
        self.tops, self.after = tops, {}


NOTHING = Graph([])
