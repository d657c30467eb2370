"""One entry to the graph's analyses, bound to a graph and (unless it is '*') to one project."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import analytics, communities, ingest, match, rules, traverse
from codeloom.plans import cypher


class GraphEngine:
    """Analyses over ``nodes`` and ``edges``; every method gives a DataFrame (or a dict of them)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, project_id: str = "*") -> None:
        every = project_id == "*"
        self.nodes = nodes if every else nodes.where(F.col("project_id") == project_id)
        self.edges = edges if every else edges.where(F.col("project_id") == project_id)

    def __getattr__(self, name: str):
        """Operators by name: those of one argument take the nodes, the others nodes and edges first."""
        for module in (match, analytics, traverse):
            f = getattr(module, name, None)
            if callable(f) and not name.startswith("_"):
                given = f.__code__.co_varnames[: f.__code__.co_argcount]
                first = [getattr(self, a) for a in given[:2] if a in ("nodes", "edges")]
                return lambda *args, **kw: f(*first, *args, **kw)
        raise AttributeError(name)

    def _id(self, symbol: str) -> str | None:
        row = match.find_symbol(self.nodes, symbol).first()
        return row["id"] if row else None

    def explain(self, symbol: str) -> dict[str, DataFrame]:
        """A symbol with its callers, callees, contents and references."""
        i = self._id(symbol)
        if i is None:
            return {"matches": match.find_symbol(self.nodes, symbol)}
        n, e = self.nodes, self.edges
        return {"matches": match.find_symbol(n, symbol), "callers": match.callers(n, e, i), "callees": match.callees(n, e, i), "contains": match.neighbours(n, e, i, "CONTAINS"), "references": match.neighbours(n, e, i, "REFERENCES", False)}

    def impact(self, symbol: str, depth: int = 3) -> DataFrame | None:
        i = self._id(symbol)
        return None if i is None else traverse.impact_downstream(self.nodes, self.edges, i, min(depth, 10))

    def test_impact(self, symbol: str, depth: int = 3) -> DataFrame | None:
        i = self._id(symbol)
        return None if i is None else traverse.test_reach(self.nodes, self.edges, i, min(depth, 10))

    def trace(self, source: str, target: str, depth: int = 6) -> dict[str, Any]:
        """A shortest call path between two symbols, or why there is none."""
        a, b = self._id(source), self._id(target)
        if a is None or b is None:
            return {"found": False, "depth": -1, "reason": "source-not-found" if a is None else "target-not-found"}
        path = traverse.shortest_path(self.nodes, self.edges, a, b, depth)
        if path is None:
            return {"found": False, "depth": -1, "reason": "no-path"}
        return {"found": True, "depth": max(0, len(path) - 1), "nodes": traverse.path_table(self.nodes, path)}

    def health(self) -> dict[str, DataFrame]:
        n, e, top = self.nodes, self.edges, analytics.top
        return {"god_files": top(analytics.god_files(n, e), "methods", "path"), "god_classes": top(analytics.god_classes(n, e), "methods", "fq_name"), "long_methods": top(analytics.long_methods(n), "lines", "fq_name"), "dead_code": top(analytics.dead_code(n, e), None, "fq_name")}

    def violations(self, *layers: rules.Config) -> DataFrame:
        return rules.violations(self.nodes, self.edges, rules.resolved(*layers))

    def communities(self, refined: bool = False, least: int = 2) -> DataFrame:
        calls = self.edges.where("edge_type = 'CALLS'")
        member = communities.leiden(calls) if refined else communities.louvain(calls)
        return communities.described(calls, member, least)

    def diff(self, other: GraphEngine, labels: tuple[str, ...] = ("File", "Class", "Method", "ApiEndpoint", "Table")) -> dict[str, DataFrame]:
        """What was added and removed from this graph to another, by label; changed dependency versions; calls."""
        out = {label: ingest.diff_rows(self.nodes.where(F.col("label") == label), other.nodes.where(F.col("label") == label), ["fq_name"]) for label in labels}
        deps = lambda g: g.nodes.where("label = 'MavenDependency'")
        out["dependencies"] = ingest.diff_rows(deps(self), deps(other), ["group_id", "artifact_id"], ["version"])
        calls = lambda g: traverse.links(g.edges, "CALLS")
        return out | {"calls": ingest.diff_rows(calls(self), calls(other), ["src", "dst"])}

    def schema(self) -> dict[str, DataFrame]:
        return {"labels": match.node_counts(self.nodes), "types": match.edge_counts(self.nodes, self.edges), "connectivity": match.schema_connectivity(self.nodes, self.edges)}

    def query(self, text: str, **params: Any) -> DataFrame:
        """A query text; see :mod:`codeloom.plans.cypher`."""
        return cypher.run(text, self.nodes, self.edges, params)

    def tagged(self, analysis: str, *args: Any, **kw: Any) -> DataFrame:
        """The rows of an analysis for every project, each with its ``project_id``: an analysis that looks at one project only is run for each."""
        out = None
        for r in sorted(x[0] for x in self.nodes.select("project_id").where("project_id is not null").distinct().collect()):  # projects
            rows = getattr(GraphEngine(self.nodes, self.edges, r), analysis)(*args, **kw).withColumn("project_id", F.lit(r))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("the graph has no project")
        return out

    def rename(self, symbol: str) -> DataFrame | None:
        """What a rename of a symbol has to change."""
        i = self._id(symbol)
        return None if i is None else match.rename_sites(self.nodes, self.edges, i)

    def context(self, symbol: str, depth: int = 1) -> tuple[DataFrame, DataFrame] | None:
        """A symbol's neighbourhood: nodes and the edges among them."""
        i = self._id(symbol)
        return None if i is None else traverse.ego_slice(self.nodes, self.edges, i, depth)

    def wiki(self) -> str:
        """A page about the graph, from its bounded summaries."""
        parts = analytics.onboard(self.nodes, self.edges)
        lines = ["# Overview", ""]
        for title, df in parts.items():
            rows = df.limit(50).collect()  # a page shows the first of each part
            lines += [f"## {title.replace('_', ' ').capitalize()}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(str(x) for x in r) + " |" for r in rows], ""]
        return "\n".join(lines)
