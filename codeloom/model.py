"""The property graph of software: node and edge columns, identities, coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a node, by type, as the graph's users name them (in snake case).
TEXT = """id project_id label fq_name name kind path language file_id class_id table_id contract_id signature return_type receiver type visibility decorators package namespace value default_value value_type
http_method http_path framework view_ref scope source resource_type provider group_id artifact_id version version_source repository tag digest base_image protocol command root_path last_scan_commit content_hash file_content_hash""".split()
WHOLE = "start_line end_line line_count param_count port".split()
FLAGS = """is_static is_abstract is_test is_async is_constructor is_entry is_queue_listener is_scheduled is_external is_base is_anonymous_handler is_classmethod is_dataclass is_final is_fixture is_property css_module module_export""".split()
TIMES = ["last_ingested_at"]

NODE = T.StructType([T.StructField(c, t) for cols, t in ((TEXT, T.StringType()), (WHOLE, T.LongType()), (FLAGS, T.BooleanType()), (TIMES, T.TimestampType())) for c in cols] + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
EDGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("project_id", "edge_type", "src", "dst")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("call_site_line", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("via", T.StringType()), T.StructField("via_method_reference", T.BooleanType()), T.StructField("ambiguous", T.BooleanType())]
)
EDGE_TYPES = "CONTAINS CALLS EXTENDS IMPLEMENTS IMPORTS EXPOSES HANDLES DEPENDS_ON DECLARES READS_TABLE WRITES_TABLE READS_CONFIG USES REFERENCES REFERENCES_COMPONENT CALLS_HTTP READS_COLUMN WRITES_COLUMN".split()
#: Labels a re-scan may remove when a file no longer yields them.
SCANNED_LABELS = "Class Method Field Module Interface Table Column ApiEndpoint EnvVar ConfigKey CssClass DesignToken CssMixin".split()


def node_id(project_id: Column, label: Column, fq_name: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``project:label:fq_name``; null if a part is null."""
    return F.substring(F.sha2(F.concat(project_id, F.lit(":"), label, F.lit(":"), fq_name), 256), 1, 16)


def content_hash(label: Column, fq_name: Column, props: Column) -> Column:
    """First 16 hex digits over label, fq_name and the sorted non-null properties (bookkeeping ones left out)."""
    kept = F.map_filter(props, lambda k, v: v.isNotNull() & ~k.isin("last_ingested_at", "content_hash"))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\0")))
    return F.substring(F.sha2(F.concat(label, F.lit("\0"), fq_name, F.lit("\0"), F.array_join(pairs, "")), 256), 1, 16)


def coerced(value: Column, dtype: T.DataType) -> Column:
    """A parser's text as a typed value: flags by 'true', numbers or null, never an error."""
    if isinstance(dtype, T.BooleanType):
        return F.lower(value) == "true"
    if isinstance(dtype, T.StringType):
        return value
    return value.try_cast(dtype)


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns: missing ones null, unknown ones left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
