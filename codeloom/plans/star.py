"""The property graph derived from the star-schema tables: DataFrames, and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.util import table

_COLUMNS = {
    "id": "string", "project_id": "string", "label": "string", "fq_name": "string", "name": "string", "kind": "string", "path": "string", "language": "string", "file_id": "string", "class_id": "string", "table_id": "string",
    "start_line": "bigint", "end_line": "bigint", "line_count": "bigint", "param_count": "bigint", "return_type": "string", "visibility": "string", "is_test": "boolean", "is_static": "boolean", "is_constructor": "boolean",
    "is_queue_listener": "boolean", "is_scheduled": "boolean", "http_method": "string", "http_path": "string", "framework": "string", "view_ref": "string", "group_id": "string", "artifact_id": "string", "version": "string",
    "scope": "string", "value": "string", "last_ingested_at": "timestamp",
}


def _shape(df: DataFrame, label: str, **cols: Column | str) -> DataFrame:
    given = {k: (F.lit(v) if isinstance(v, str) else v) for k, v in cols.items()} | {"label": F.lit(label)}
    given.setdefault("project_id", F.lit("star"))
    return df.select(*[(given.get(c, F.lit(None))).cast(t).alias(c) for c, t in _COLUMNS.items()])


def _key(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), *[x for i, c in enumerate(cols) for x in ([F.lit("_")] if i else []) + [F.col(c).cast("string")]])


class Star:
    """Nodes and edges over the tables of one directory; everything lazy, unneeded parts are pruned by the optimizer."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._t = lambda name: table(spark, sf_dir, name)

    def files(self) -> DataFrame:
        d = self._t("nation").join(self._t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        path = F.concat(F.lit("src/"), "r_name", F.lit("/"), "n_name")
        return _shape(d, "File", id=_key("f", "n_nationkey"), fq_name=path, name=F.col("n_name"), path=path, language=F.col("r_name"), line_count=F.col("n_nationkey") * 10 + 5)

    def _class_names(self) -> DataFrame:
        d = self._t("customer").join(F.broadcast(self._t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        return d.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment", F.concat("n_name", F.lit("."), "c_name").alias("class_fq"))

    def classes(self) -> DataFrame:
        return _shape(self._class_names(), "Class", id=_key("c", "c_custkey"), fq_name=F.col("class_fq"), name=F.col("c_name"), kind=F.lower("c_mktsegment"), file_id=_key("f", "c_nationkey"), start_line=F.lit(1))

    def methods(self) -> DataFrame:
        lines = self._t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
        d = self._t("orders").join(self._class_names(), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        k = F.col("o_orderkey")
        name = F.when(k % 250 == 0, "main").otherwise(F.concat(F.lit("op"), (k % 500).cast("string")))
        digit, start = F.substring("o_orderpriority", 1, 1), k % 1000 + 1
        return _shape(
            d, "Method", id=_key("m", "o_orderkey"), name=name, fq_name=F.concat("class_fq", F.lit("."), name, F.lit("("), k.cast("string"), F.lit(")")), file_id=_key("f", "c_nationkey"), class_id=_key("c", "c_custkey"),
            param_count=F.coalesce("n_lines", F.lit(0)), return_type=F.col("o_orderstatus"), start_line=start, end_line=start + F.floor(F.col("o_totalprice") / 5000),
            visibility=F.when(digit == "1", "public").when(digit == "2", "protected").when(digit == "3", "package").otherwise("private"), is_test=k % 10 == 3, is_static=k % 2 == 0, is_constructor=k % 20 == 7,
            is_queue_listener=k % 100 == 1, is_scheduled=k % 100 == 2, last_ingested_at=F.col("o_orderdate"),
        )

    def tables(self) -> DataFrame:
        return _shape(self._t("supplier"), "Table", id=_key("t", "s_suppkey"), fq_name=F.col("s_name"), name=F.col("s_name"))

    def columns(self) -> DataFrame:
        d = self._t("lineitem").select("l_suppkey", "l_partkey").distinct().join(self._t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return _shape(d, "Column", id=_key("k", "l_suppkey", "l_partkey"), fq_name=F.concat("s_name", F.lit("."), F.col("l_partkey").cast("string")), name=F.col("l_partkey"), table_id=_key("t", "l_suppkey"))

    def endpoints(self) -> DataFrame:
        k = F.col("p_partkey")
        verb = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (k % 4 + 1).cast("int"))
        path = F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/"), k.cast("string"))
        view = F.when(k % 2 == 1, F.concat(F.lit("views.op"), (k % 500).cast("string")))
        return _shape(self._t("part").where("p_size <= 5"), "ApiEndpoint", id=_key("e", "p_partkey"), fq_name=F.concat(verb, F.lit(" "), path), name=path, http_method=verb, http_path=path, framework=F.col("p_brand"), view_ref=view, file_id=F.concat(F.lit("f"), (k % 25).cast("string")))

    def dependencies(self) -> DataFrame:
        d = self._t("part").groupBy("p_brand", "p_name").agg(F.max("p_size").alias("size"), F.min("p_type").alias("type"))
        return _shape(d, "MavenDependency", id=_key("d", "p_brand", "p_name"), fq_name=F.concat("p_brand", F.lit(":"), "p_name"), name=F.col("p_name"), group_id=F.col("p_brand"), artifact_id=F.col("p_name"), version=F.col("size"), scope=F.col("type"))

    def modules(self) -> DataFrame:
        return _shape(self._t("part").select("p_brand").distinct(), "Module", id=_key("b", "p_brand"), fq_name=F.col("p_brand"), name=F.col("p_brand"))

    def config_keys(self) -> DataFrame:
        d = self._t("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return _shape(d, "ConfigKey", project_id="ev", id=_key("g", "k"), fq_name=F.concat(F.lit("k."), "k"), name=F.col("k"), value=F.col("n"))

    def projects(self) -> DataFrame:
        d = self._t("region").where("r_regionkey = 0").select(F.explode(F.array(F.lit("star"), F.lit("ev"))).alias("p"))
        return _shape(d, "Project", project_id=F.col("p"), id=_key("p", "p"), fq_name=F.col("p"), name=F.col("p"))

    @property
    def nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.projects(), self.files(), self.classes(), self.methods(), self.tables(), self.columns(), self.endpoints(), self.dependencies(), self.modules(), self.config_keys()])

    # ------------------------------------------------------------ edges
    @staticmethod
    def _edge(df: DataFrame, kind: str, src: Column, dst: Column, line: Column | None = None, confidence: float | None = None, project: str = "star") -> DataFrame:
        return df.select(F.lit(project).alias("project_id"), F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"), (F.lit(None) if line is None else line).cast("bigint").alias("call_site_line"), F.lit(confidence).cast("double").alias("confidence"))

    def calls(self) -> DataFrame:
        """Orders that share a part call each other in turn; a returned part turns the call round."""
        lines = self._t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("back")).repartition("l_partkey")  # the only exchange up to the calls
        per = lines.groupBy("l_partkey", "l_orderkey").agg(F.min("l_linenumber").alias("line"), F.max("back").alias("back"))
        w = Window.partitionBy("l_partkey").orderBy("l_orderkey")
        per = per.withColumn("next", F.lead("l_orderkey").over(w)).where("next is not null")
        a, b = F.when(F.col("back") == 1, F.col("next")).otherwise(F.col("l_orderkey")), F.when(F.col("back") == 1, F.col("l_orderkey")).otherwise(F.col("next"))
        d = per.select(a.alias("a"), b.alias("b"), "line").groupBy("a", "b").agg(F.min("line").alias("line"))
        return self._edge(d, "CALLS", _key("m", "a"), _key("m", "b"), F.col("line"), 0.8)

    def references(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        d = self._t("orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("next")).where("next is not null")
        return self._edge(d, "REFERENCES", _key("m", "o_orderkey"), _key("m", "next"))

    def contains(self) -> DataFrame:
        parts = [
            self._edge(self._t("customer"), "CONTAINS", _key("f", "c_nationkey"), _key("c", "c_custkey")),
            self._edge(self._t("orders"), "CONTAINS", _key("c", "o_custkey"), _key("m", "o_orderkey")),
            self._edge(self._t("lineitem").select("l_suppkey", "l_partkey").distinct(), "CONTAINS", _key("t", "l_suppkey"), _key("k", "l_suppkey", "l_partkey")),
        ]
        return reduce(DataFrame.unionByName, parts)

    def table_uses(self, kind: str, status: str) -> DataFrame:
        return self._edge(self._t("lineitem").where(F.col("l_linestatus") == status).select("l_orderkey", "l_suppkey").distinct(), kind, _key("m", "l_orderkey"), _key("t", "l_suppkey"))

    def column_reads(self) -> DataFrame:
        return self._edge(self._t("lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_suppkey", "l_partkey").distinct(), "READS_COLUMN", _key("m", "l_orderkey"), _key("k", "l_suppkey", "l_partkey"))

    def extends(self) -> DataFrame:
        d = self._t("customer").where("c_custkey > 0").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("up"))
        return self._edge(d, "EXTENDS", _key("c", "c_custkey"), _key("c", "up"))

    def exposes(self) -> DataFrame:
        d = self._t("part").where("p_size <= 5").select("p_partkey", (F.col("p_partkey") % 25).alias("f"))
        return self._edge(d, "EXPOSES", _key("f", "f"), _key("e", "p_partkey"))

    def handles(self) -> DataFrame:
        d = self._t("part").where("p_size <= 5 and p_partkey % 2 = 0").join(self._t("lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey").agg(F.min("l_orderkey").alias("o"))
        return self._edge(d, "HANDLES", _key("e", "p_partkey"), _key("m", "o"))

    def imports(self) -> DataFrame:
        d = self._t("lineitem").select("l_suppkey", "l_partkey").distinct().join(self._t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(self._t("part"), F.col("l_partkey") == F.col("p_partkey"))
        return self._edge(d.select("s_nationkey", "p_brand").distinct(), "IMPORTS", _key("f", "s_nationkey"), _key("b", "p_brand"))

    def depends_on(self) -> DataFrame:
        return self._edge(self._t("part").select("p_brand", "p_name").distinct(), "DEPENDS_ON", F.lit("pstar"), _key("d", "p_brand", "p_name"))

    @property
    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.calls(), self.references(), self.contains(), self.table_uses("READS_TABLE", "O"), self.table_uses("WRITES_TABLE", "F"), self.column_reads(), self.extends(), self.exposes(), self.handles(), self.imports(), self.depends_on()])

    # ------------------------------------------------------------ unresolved calls
    def placeholders(self) -> DataFrame:
        """Calls whose target was not known at the site: their names and their edges."""
        k = F.col("o_orderkey")
        d = self._t("orders").where(k % 40 == 5).select(k, F.concat(F.lit("op"), (k * 7 % 500).cast("string")).alias("name"), (k % 7).alias("arity"))
        return d.select("o_orderkey", "name", F.concat(F.lit("unresolved."), "name", F.lit(":"), F.col("arity").cast("string")).alias("fq_name"))

    def with_placeholders(self) -> tuple[DataFrame, DataFrame]:
        """Methods and calls with the unresolved ones among them."""
        p = self.placeholders()
        nodes = _shape(p.select("name", "fq_name").distinct(), "Method", id=F.concat(F.lit("u"), "fq_name"), name=F.col("name"), fq_name=F.col("fq_name"))
        edges = self._edge(p, "CALLS", _key("m", "o_orderkey"), F.concat(F.lit("u"), "fq_name"), None, 0.5)
        return self.methods().unionByName(nodes), self.calls().unionByName(edges)


#: The same graph for the SQL side.  Read by `WITH RECURSIVE` + SQL + the query.
SQL = """
files_ AS (SELECT 'f' || n_nationkey AS id, 'star' AS project_id, 'File' AS label, 'src/' || r_name || '/' || n_name AS fq_name, n_name AS name, 'src/' || r_name || '/' || n_name AS path, r_name AS language, CAST(n_nationkey * 10 + 5 AS BIGINT) AS line_count FROM nation JOIN region ON n_regionkey = r_regionkey),
class_names AS (SELECT c_custkey, c_nationkey, c_name, c_mktsegment, n_name || '.' || c_name AS class_fq FROM customer JOIN nation ON c_nationkey = n_nationkey),
classes AS (SELECT 'c' || c_custkey AS id, 'star' AS project_id, 'Class' AS label, class_fq AS fq_name, c_name AS name, lower(c_mktsegment) AS kind, 'f' || c_nationkey AS file_id, 1::BIGINT AS start_line FROM class_names),
line_counts AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1),
methods0 AS (SELECT *, CASE WHEN o_orderkey % 250 = 0 THEN 'main' ELSE 'op' || (o_orderkey % 500) END AS nm FROM orders JOIN class_names ON o_custkey = c_custkey LEFT JOIN line_counts ON o_orderkey = l_orderkey),
methods AS (SELECT 'm' || o_orderkey AS id, 'star' AS project_id, 'Method' AS label, class_fq || '.' || nm || '(' || o_orderkey || ')' AS fq_name, nm AS name, 'f' || c_nationkey AS file_id, 'c' || c_custkey AS class_id, coalesce(n_lines, 0) AS param_count, o_orderstatus AS return_type,
  o_orderkey % 1000 + 1 AS start_line, o_orderkey % 1000 + 1 + CAST(floor(o_totalprice / 5000) AS BIGINT) AS end_line, CASE left(o_orderpriority, 1) WHEN '1' THEN 'public' WHEN '2' THEN 'protected' WHEN '3' THEN 'package' ELSE 'private' END AS visibility,
  o_orderkey % 10 = 3 AS is_test, o_orderkey % 2 = 0 AS is_static, o_orderkey % 20 = 7 AS is_constructor, o_orderkey % 100 = 1 AS is_queue_listener, o_orderkey % 100 = 2 AS is_scheduled, o_orderdate AS last_ingested_at FROM methods0),
tables_ AS (SELECT 't' || s_suppkey AS id, 'star' AS project_id, 'Table' AS label, s_name AS fq_name, s_name AS name FROM supplier),
sup_parts AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
columns_ AS (SELECT 'k' || l_suppkey || '_' || l_partkey AS id, 'star' AS project_id, 'Column' AS label, s_name || '.' || l_partkey AS fq_name, CAST(l_partkey AS VARCHAR) AS name, 't' || l_suppkey AS table_id FROM sup_parts JOIN supplier ON l_suppkey = s_suppkey),
endpoints0 AS (SELECT *, ['GET', 'POST', 'PUT', 'DELETE'][p_partkey % 4 + 1] AS verb, '/' || replace(p_name, ' ', '/') || '/' || p_partkey AS pth FROM part WHERE p_size <= 5),
endpoints AS (SELECT 'e' || p_partkey AS id, 'star' AS project_id, 'ApiEndpoint' AS label, verb || ' ' || pth AS fq_name, pth AS name, verb AS http_method, pth AS http_path, p_brand AS framework, CASE WHEN p_partkey % 2 = 1 THEN 'views.op' || (p_partkey % 500) END AS view_ref, 'f' || (p_partkey % 25) AS file_id FROM endpoints0),
dependencies AS (SELECT 'd' || p_brand || '_' || p_name AS id, 'star' AS project_id, 'MavenDependency' AS label, p_brand || ':' || p_name AS fq_name, p_name AS name, p_brand AS group_id, p_name AS artifact_id, CAST(max(p_size) AS VARCHAR) AS version, min(p_type) AS scope FROM part GROUP BY p_brand, p_name),
modules AS (SELECT DISTINCT 'b' || p_brand AS id, 'star' AS project_id, 'Module' AS label, p_brand AS fq_name, p_brand AS name FROM part),
config_keys AS (SELECT 'g' || k AS id, 'ev' AS project_id, 'ConfigKey' AS label, 'k.' || k AS fq_name, k AS name, CAST(count(*) AS VARCHAR) AS value FROM (SELECT props ->> '$.k' AS k FROM events) GROUP BY k),
projects_ AS (SELECT 'p' || p AS id, p AS project_id, 'Project' AS label, p AS fq_name, p AS name FROM (SELECT unnest(['star', 'ev']) AS p)),
nodes AS (SELECT * FROM projects_ UNION ALL BY NAME SELECT * FROM files_ UNION ALL BY NAME SELECT * FROM classes UNION ALL BY NAME SELECT * FROM methods UNION ALL BY NAME SELECT * FROM tables_ UNION ALL BY NAME SELECT * FROM columns_ UNION ALL BY NAME SELECT * FROM endpoints
  UNION ALL BY NAME SELECT * FROM dependencies UNION ALL BY NAME SELECT * FROM modules UNION ALL BY NAME SELECT * FROM config_keys),
shared AS (SELECT l_partkey, l_orderkey, min(l_linenumber) AS line, bool_or(l_returnflag = 'R') AS back FROM lineitem GROUP BY 1, 2),
turns AS (SELECT *, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS nxt FROM shared),
calls AS (SELECT 'CALLS' AS edge_type, 'm' || CASE WHEN back THEN nxt ELSE l_orderkey END AS src, 'm' || CASE WHEN back THEN l_orderkey ELSE nxt END AS dst, CAST(min(line) AS BIGINT) AS call_site_line FROM turns WHERE nxt IS NOT NULL GROUP BY 2, 3),
refs AS (SELECT 'REFERENCES' AS edge_type, 'm' || o_orderkey AS src, 'm' || nxt AS dst, NULL::BIGINT AS call_site_line FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL),
contains_ AS (SELECT 'CONTAINS' AS edge_type, 'f' || c_nationkey AS src, 'c' || c_custkey AS dst, NULL::BIGINT AS call_site_line FROM customer UNION ALL SELECT 'CONTAINS', 'c' || o_custkey, 'm' || o_orderkey, NULL FROM orders UNION ALL SELECT 'CONTAINS', 't' || l_suppkey, 'k' || l_suppkey || '_' || l_partkey, NULL FROM sup_parts),
extends_ AS (SELECT 'EXTENDS' AS edge_type, 'c' || c_custkey AS src, 'c' || (c_custkey // 2) AS dst, NULL::BIGINT AS call_site_line FROM customer WHERE c_custkey > 0),
uses AS (SELECT DISTINCT CASE l_linestatus WHEN 'O' THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END AS edge_type, 'm' || l_orderkey AS src, 't' || l_suppkey AS dst, NULL::BIGINT AS call_site_line FROM lineitem WHERE l_linestatus IN ('O', 'F')),
column_reads AS (SELECT DISTINCT 'READS_COLUMN' AS edge_type, 'm' || l_orderkey AS src, 'k' || l_suppkey || '_' || l_partkey AS dst, NULL::BIGINT AS call_site_line FROM lineitem WHERE l_linestatus = 'O'),
exposes AS (SELECT 'EXPOSES' AS edge_type, 'f' || (p_partkey % 25) AS src, 'e' || p_partkey AS dst, NULL::BIGINT AS call_site_line FROM part WHERE p_size <= 5),
handles AS (SELECT 'HANDLES' AS edge_type, 'e' || p_partkey AS src, 'm' || min(l_orderkey) AS dst, NULL::BIGINT AS call_site_line FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size <= 5 AND p_partkey % 2 = 0 GROUP BY p_partkey),
imports AS (SELECT DISTINCT 'IMPORTS' AS edge_type, 'f' || s_nationkey AS src, 'b' || p_brand AS dst, NULL::BIGINT AS call_site_line FROM sup_parts JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
depends AS (SELECT DISTINCT 'DEPENDS_ON' AS edge_type, 'pstar' AS src, 'd' || p_brand || '_' || p_name AS dst, NULL::BIGINT AS call_site_line FROM part),
edges AS (SELECT 'star' AS project_id, * FROM (SELECT * FROM calls UNION ALL SELECT * FROM refs UNION ALL SELECT * FROM contains_ UNION ALL SELECT * FROM extends_ UNION ALL SELECT * FROM uses UNION ALL SELECT * FROM column_reads UNION ALL SELECT * FROM exposes UNION ALL SELECT * FROM handles UNION ALL SELECT * FROM imports UNION ALL SELECT * FROM depends)),
holders AS (SELECT o_orderkey, 'op' || (o_orderkey * 7 % 500) AS name, o_orderkey % 7 AS arity FROM orders WHERE o_orderkey % 40 = 5),
mixed_methods AS (SELECT id, fq_name, name, param_count FROM methods UNION ALL SELECT DISTINCT 'uunresolved.' || name || ':' || arity, 'unresolved.' || name || ':' || arity, name, NULL FROM holders),
mixed_calls AS (SELECT src, dst, 0.8 AS confidence FROM calls UNION ALL SELECT 'm' || o_orderkey, 'uunresolved.' || name || ':' || arity, 0.5 FROM holders)
"""
