"""The named analyses of the graph; each is one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import module_prefix, severity_score
from codeloom.util import first_of_each

GOD_FILE, GOD_CLASS, LONG_METHOD, DEEP = 30, 20, 80, 5


def _contained(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.where("edge_type = 'CONTAINS'").select(F.col("src").alias(src), F.col("dst").alias(dst))


def _label(nodes: DataFrame, label: str, **cols: str) -> DataFrame:
    return nodes.where(F.col("label") == label).select(*[F.col(c).alias(a) for a, c in cols.items()])


def god_files(nodes: DataFrame, edges: DataFrame, least: int = GOD_FILE) -> DataFrame:
    """Files whose classes hold ``least`` methods or more: ``path, methods, file_id``."""
    chain = _label(nodes, "File", f="id", path="path").join(_contained(edges, "f", "c"), "f").join(_label(nodes, "Class", c="id"), "c").join(_contained(edges, "c", "m"), "c").join(_label(nodes, "Method", m="id"), "m")
    return chain.groupBy("path", F.col("f").alias("file_id")).agg(F.count(F.lit(1)).alias("methods")).where(F.col("methods") >= least)


def god_classes(nodes: DataFrame, edges: DataFrame, least: int = GOD_CLASS) -> DataFrame:
    chain = _label(nodes, "Class", c="id", fq_name="fq_name", file_id="file_id").join(_contained(edges, "c", "m"), "c").join(_label(nodes, "Method", m="id"), "m")
    return chain.groupBy("fq_name", "file_id").agg(F.count(F.lit(1)).alias("methods")).where(F.col("methods") >= least)


def long_methods(nodes: DataFrame, least: int = LONG_METHOD) -> DataFrame:
    lines = (F.col("end_line") - F.col("start_line")).alias("lines")
    return nodes.where("label = 'Method'").select("fq_name", lines, "file_id", "start_line").where(F.col("lines") >= least)


def dead_code(nodes: DataFrame, edges: DataFrame, spare_handlers: bool = False) -> DataFrame:
    """Private or package methods nobody calls, but for tests, mains and constructors (and handlers, for the rule)."""
    quiet = nodes.where("label = 'Method' AND visibility IN ('private', 'package') AND NOT coalesce(is_test, false) AND NOT coalesce(is_constructor, false) AND name <> 'main'")
    types = ["CALLS", "HANDLES"] if spare_handlers else ["CALLS"]
    used = edges.where(F.col("edge_type").isin(types)).select(F.col("dst").alias("id"))
    return quiet.join(used, "id", "left_anti").select("fq_name", "file_id", "start_line")


def top(df: DataFrame, value: str | None, key: str, limit: int = 20) -> DataFrame:
    return df.orderBy(*([F.col(value).desc()] if value else []), key).limit(limit)


def guard_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``passed, errors, warnings, god_files, god_classes, long_methods``; passed without god files and classes."""
    parts = [(god_files(nodes, edges), "god_files"), (god_classes(nodes, edges), "god_classes"), (long_methods(nodes), "long_methods")]
    rows = None
    for df, what in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.agg(*[F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w) for _, w in parts])
    errors = F.col("god_files") + F.col("god_classes")
    return wide.select((errors == 0).alias("passed"), errors.alias("errors"), F.col("long_methods").alias("warnings"), "god_files", "god_classes", "long_methods")


def file_inventory(nodes: DataFrame) -> DataFrame:
    counts = nodes.where("label = 'Method'").groupBy("file_id").agg(F.count(F.lit(1)).alias("method_count"))
    files = nodes.where("label = 'File'").select(F.col("id").alias("file_id"), "path", "language", "line_count")
    return files.join(counts, "file_id", "left").select("path", "language", "line_count", F.coalesce("method_count", F.lit(0)).alias("method_count"))


def recently_changed(nodes: DataFrame, since, limit: int = 50) -> DataFrame:
    hits = nodes.where(F.col("last_ingested_at") > since).select("label", "fq_name", "last_ingested_at")
    return hits.orderBy(F.col("last_ingested_at").desc(), "fq_name").limit(limit)


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'File'").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def table_columns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    cols = _contained(edges, "t", "k").join(_label(nodes, "Column", k="id"), "k").groupBy("t").agg(F.count(F.lit(1)).alias("columns"))
    return _label(nodes, "Table", t="id", table="fq_name").join(cols, "t", "left").select("table", F.coalesce("columns", F.lit(0)).alias("columns"))


def duplicates(nodes: DataFrame, least: int = 2, limit: int = 100) -> DataFrame:
    """Methods alike in name, parameters, return type and length (in steps of five lines)."""
    length = F.col("end_line") - F.col("start_line")
    body = nodes.where("label = 'Method' AND name <> '<init>'").where(length >= 5).withColumn("line_bucket", F.floor(length / 5) * 5)
    groups = body.groupBy("name", "param_count", "return_type", "line_bucket").agg(F.count(F.lit(1)).alias("occurrences"), F.min("fq_name").alias("first_member"))
    return groups.where(F.col("occurrences") >= max(2, least)).orderBy(F.col("occurrences").desc(), "name", "param_count", "return_type", "line_bucket").limit(limit)


def duplicate_members(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each member of the groups of :func:`duplicates`."""
    length = F.col("end_line") - F.col("start_line")
    body = nodes.where("label = 'Method'").withColumn("line_bucket", F.floor(length / 5) * 5)
    return body.join(groups, ["name", "param_count", "return_type", "line_bucket"]).select("name", "param_count", "return_type", "line_bucket", "fq_name")


def rest_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``method, path, framework, file, handler``: the least handler counts if there are several."""
    handler = edges.where("edge_type = 'HANDLES'").select(F.col("src").alias("e"), F.col("dst").alias("m")).join(_label(nodes, "Method", m="id", fq="fq_name"), "m").groupBy("e").agg(F.min("fq").alias("handler"))
    ends = nodes.where("label = 'ApiEndpoint'").select(F.col("id").alias("e"), "http_method", "http_path", "framework", F.col("file_id").alias("f"))
    return ends.join(handler, "e", "left").join(_label(nodes, "File", f="id", file="path"), "f", "left").select(F.col("http_method").alias("method"), F.col("http_path").alias("path"), "framework", "file", "handler")


def outgoing(nodes: DataFrame, edges: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Calls of methods to targets whose name fits a pattern: ``caller, target, calls``."""
    m = nodes.where("label = 'Method'")
    targets = m.where(F.col("fq_name").rlike(pattern)).select(F.col("id").alias("dst"), F.col("fq_name").alias("target"))
    hits = edges.where("edge_type = 'CALLS'").select("src", "dst").join(targets, "dst").join(m.select(F.col("id").alias("src"), F.col("fq_name").alias("caller")), "src")
    return hits.groupBy("caller", "target").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.col("calls").desc(), "caller", "target").limit(limit)


def tables_touched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``table, access, sources``: distinct readers and writers of each table."""
    e = edges.where("edge_type IN ('READS_TABLE', 'WRITES_TABLE')").select("src", F.col("dst").alias("t"), F.when(F.col("edge_type") == "READS_TABLE", "read").otherwise("write").alias("access"))
    return e.join(_label(nodes, "Table", t="id", table="fq_name"), "t").groupBy("table", "access").agg(F.countDistinct("src").alias("sources"))


def db_impact(nodes: DataFrame, edges: DataFrame, table_name: str, column: str | None = None) -> DataFrame:
    """Methods that read or write a table (or of these, those that read the column): ``access, fq_name, file_id, line``."""
    t = _label(nodes, "Table", dst="id", fq="fq_name").where(F.col("fq") == table_name).select("dst")
    use = edges.where("edge_type IN ('READS_TABLE', 'WRITES_TABLE')").join(t, "dst", "left_semi").select(F.when(F.col("edge_type") == "READS_TABLE", "read").otherwise("write").alias("access"), "src")
    if column is not None:
        k = _label(nodes, "Column", dst="id", fq="fq_name").where(F.col("fq") == f"{table_name}.{column}").select("dst")
        use = use.join(edges.where("edge_type IN ('READS_COLUMN', 'WRITES_COLUMN')").join(k, "dst", "left_semi").select("src"), "src", "left_semi")
    m = _label(nodes, "Method", src="id", fq_name="fq_name", file_id="file_id", line="start_line")
    return use.join(m, "src").select("access", "fq_name", "file_id", "line").distinct()


def infrastructure(nodes: DataFrame) -> dict[str, DataFrame]:
    """The sections of an infrastructure summary; columns that a graph has not are null."""

    def of(label: str, *columns: str) -> DataFrame:
        return nodes.where(F.col("label") == label).select(*[F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in columns])

    m = nodes.where("label = 'Method'")
    return {
        "api_endpoints": of("ApiEndpoint", "http_method", "http_path", "framework"),
        "queue_listeners": m.where("coalesce(is_queue_listener, false)").select("fq_name"),
        "scheduled_jobs": m.where("coalesce(is_scheduled, false)").select("fq_name"),
        "config_keys": of("ConfigKey", "fq_name", "value"),
        "env_vars": of("EnvVar", "fq_name", "value"),
        "container_images": of("ContainerImage", "fq_name", "repository", "tag"),
        "container_ports": of("ContainerPort", "port", "protocol"),
        "terraform_resources": of("Resource", "fq_name", "resource_type", "provider"),
    }


def module_counts(nodes: DataFrame, segments: int = 1) -> DataFrame:
    return nodes.where("label = 'Method'").groupBy(module_prefix(F.col("fq_name"), segments).alias("module")).agg(F.count(F.lit(1)).alias("members"))


def changelog(nodes: DataFrame, since, most: int = 50) -> DataFrame:
    """The newest nodes of each label, and how many there are: ``label, fq_name, last_ingested_at, total``."""
    hits = nodes.where(F.col("last_ingested_at") > since).select("label", "fq_name", "last_ingested_at")
    totals = hits.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    newest = first_of_each(hits, ["label"], [F.col("last_ingested_at").desc(), F.col("fq_name")], most)
    return newest.join(totals, "label").select("label", "fq_name", "last_ingested_at", "total")


def migrate_risk(callers, references, tests):
    """0..100: callers up to 60, references up to 20, 20 more without a test."""
    risk = F.least(F.lit(60), callers * 6) + F.least(F.lit(20), F.floor(references * 2 / 5)) + F.when(tests > 0, 0).otherwise(20)
    return F.least(F.lit(100), risk).cast("bigint")


def risk_label(risk):
    return F.when(risk >= 75, "HIGH").when(risk >= 40, "MEDIUM").otherwise("LOW")


def migrate_plan(nodes: DataFrame, edges: DataFrame, depth: int = 5, brief: bool = False) -> DataFrame:
    """Risk of moving each class: callers, references, importing files and tests from outside it.

    A test counts if calls or references lead from it to a method of the class within ``depth`` (1..12) edges;
    ``by_module`` has the callers of each module (``modules`` of them).  A ``brief`` plan leaves importers and modules out.
    """
    from codeloom.operators.coverage import counted
    from codeloom.operators.traverse import clamp

    m = nodes.where("label = 'Method'").select("id", "class_id", "is_test", "fq_name", module_prefix(F.col("fq_name")).alias("module"))
    links = edges.where("edge_type IN ('CALLS', 'REFERENCES')").select("src", "dst", "edge_type")
    counts = counted(m, links, clamp(depth, 12), not brief)
    c = nodes.where("label = 'Class'").select("id", "fq_name")
    if not brief:
        files = _label(nodes, "File", src="id")
        importers = edges.where("edge_type = 'IMPORTS'").join(files, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("importers"))
        c = c.join(importers, "id", "left")
    out = (_counts_by_joins(c, m, links, edges, depth) if counts is None else counts.of(c)).fillna(0, ["callers", "references", "tests", *([] if brief else ["importers", "modules"])])
    risk = migrate_risk(F.col("callers"), F.col("references"), F.col("tests"))
    more = [] if brief else ["importers", "modules", F.map_from_entries(F.array_sort(F.coalesce("by_module", F.array().cast("array<struct<module:string,n:bigint>>")))).alias("by_module")]
    order = ["fq_name", "callers", "references", *more[:1], "tests", *more[1:]]
    return out.select(*order, risk.alias("risk"), risk_label(risk).alias("risk_label"))


def _counts_by_joins(classes: DataFrame, m: DataFrame, links: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """:mod:`coverage`'s counts by joins of DataFrames, whatever the number of nodes; columns that are not asked for are pruned."""
    to, of = m.select(F.col("id").alias("dst"), F.col("class_id").alias("id")), m.select(F.col("id").alias("src"), F.col("class_id").alias("origin"), "module")
    e = links.join(to, "dst").join(of, "src").where("id <> origin")
    per = e.groupBy("id").agg(
        F.countDistinct(F.when(F.col("edge_type") == "CALLS", F.col("src"))).alias("callers"),
        F.countDistinct(F.when(F.col("edge_type") == "REFERENCES", F.col("src"))).alias("references"),
    )
    by = e.where("edge_type = 'CALLS'").groupBy("id", "module").agg(F.countDistinct("src").alias("n"))
    by = by.groupBy("id").agg(F.count(F.lit(1)).alias("modules"), F.collect_list(F.struct("module", "n")).alias("by_module"))
    tests = _tests_of_classes(m, edges, depth).withColumnRenamed("target", "id")
    return classes.join(per, "id", "left").join(tests, "id", "left").join(by, "id", "left")


def _tests_of_classes(methods: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``target, tests``: tests of other classes from which 1..``depth`` edges lead to a method of the class."""
    from codeloom.operators.traverse import clamp, links, reached

    pairs, depth = links(edges, "CALLS", "REFERENCES"), clamp(depth, 12)
    tests = methods.where("is_test").select(F.col("id").alias("source"), F.col("class_id").alias("origin"))
    near = tests.select("source", F.col("source").alias("node"))
    if depth > 1:
        near = near.unionByName(reached(pairs, tests.select("source"), depth - 1).select("source", "node"))
    # the last edge leads to classes, not to methods, of which there are more
    onto = pairs.join(methods.select(F.col("id").alias("dst"), F.col("class_id").alias("target")), "dst").select(F.col("src").alias("node"), "target").distinct()
    hit = near.join(onto, "node").select("source", "target").distinct().join(tests, "source").where("target <> origin")
    return hit.groupBy("target").agg(F.count(F.lit(1)).alias("tests"))


def audit(nodes: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with an advisory (``group_id, artifact_id, version, advisory, severity``), worst first."""
    deps = nodes.where("label = 'MavenDependency'").select("group_id", "artifact_id", "version").where("trim(version) <> '' AND NOT contains(version, '${')")
    return deps.join(advisories, ["group_id", "artifact_id", "version"]).select("group_id", "artifact_id", "version", "advisory", "severity", severity_score(F.col("severity")).alias("score"))


def pr_impact(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """Per changed file (``file_id``): symbols touched, their callers, and distinct nodes within ``depth`` (1..8) edges downstream."""
    from codeloom.operators.traverse import clamp, links, reached

    symbols = nodes.where("label = 'Method'").join(files.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.col("id").alias("source"))
    touched = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols_touched"))
    calls = edges.where("edge_type = 'CALLS'").select("src", F.col("dst").alias("source")).join(symbols, "source").groupBy("file_id").agg(F.count(F.lit(1)).alias("incoming_callers"))
    # one search a file, from all its symbols: a node is found once a file, not once a symbol
    starts = symbols.select(F.col("file_id").alias("source"), F.col("source").alias("node"))
    reach = reached(links(edges, "CALLS", "REFERENCES"), starts, clamp(depth, 8)).groupBy(F.col("source").alias("file_id")).agg(F.count(F.lit(1)).alias("downstream_reach"))
    paths = nodes.where("label = 'File'").select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    out = paths.join(touched, "file_id").join(calls, "file_id", "left").join(reach, "file_id", "left")
    return out.select("file", "symbols_touched", F.coalesce("incoming_callers", F.lit(0)).alias("incoming_callers"), F.coalesce("downstream_reach", F.lit(0)).alias("downstream_reach"))


# Names in a target that tell a call to another service.
HTTP_CLIENTS = "RestTemplate WebClient HttpClient FeignClient OkHttpClient".split()
MESSAGE_CLIENTS = "KafkaTemplate RabbitTemplate JmsTemplate StreamBridge SqsTemplate SnsTemplate".split()


def service_links(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> dict[str, DataFrame]:
    """What a project calls, consumes, offers and stores; ``outgoing_requests`` are those of scripts."""
    h = nodes.where("label = 'HttpCall'").select(F.col("id").alias("dst"), F.col("http_method").alias("method"), F.col("http_path").alias("target"), F.col("framework").alias("client"))
    requests = edges.where("edge_type = 'CALLS_HTTP'").join(_label(nodes, "File", src="id", caller="path"), "src").join(h, "dst").select("caller", "method", "target", "client")
    return {
        "outgoing_http": outgoing(nodes, edges, f"(?i)({'|'.join(HTTP_CLIENTS)})", limit),
        "outgoing_requests": requests,
        "outgoing_messaging": outgoing(nodes, edges, f"(?i)({'|'.join(MESSAGE_CLIENTS)})", limit),
        "incoming_consumers": infrastructure(nodes)["queue_listeners"].withColumnRenamed("fq_name", "handler"),
        "rest_endpoints": rest_endpoints(nodes, edges),
        "tables_touched": tables_touched(nodes, edges),
    }


def onboard(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    from codeloom.operators.match import call_graph_hubs

    infra = infrastructure(nodes)
    return {
        "languages": languages(nodes), "top_classes": top(god_classes(nodes, edges, 1).select("fq_name", "methods"), "methods", "fq_name", 10), "rest_endpoints": rest_endpoints(nodes, edges).select("method", "path", "framework"),
        "tables": table_columns(nodes, edges), "config_keys": infra["config_keys"].orderBy("fq_name").limit(50), "env_vars": infra["env_vars"], "call_graph_hubs": call_graph_hubs(nodes, edges),
    }

