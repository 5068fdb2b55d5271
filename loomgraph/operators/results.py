"""Results as they are handed on: fields cleared, chunk metadata, statements as text, and the context in several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"chunks": ("chunk_id",), "topic_ids": ("topic_id",), "scores": ("score", "result_score")}


def cleared(rows: DataFrame, *what: str, to: object = None) -> DataFrame:
    """Rows without their chunks, topic ids or scores, which become null, or scores a number."""
    names = [c for w in what for c in FIELDS[w] if c in rows.columns]
    return rows.withColumns({c: F.lit(to).cast(rows.schema[c].dataType) for c in names})


def chunk_value(metadata: Column, key: str, default: Column | None = None) -> Column:
    """The value of a chunk's metadata that stands for it, or what is given instead."""
    return F.coalesce(metadata[key], default if default is not None else F.lit(None).cast("string"))


def enriched(rows: DataFrame, sources: DataFrame, formatted: Column) -> DataFrame:
    """Rows with the source they come from as text; sources: source_id and what formatted reads."""
    return rows.join(sources.select("source_id", formatted.alias("source")), "source_id", "left")


def nested(rows: DataFrame, source: str, topic: str, statement: str, order: str) -> DataFrame:
    """source, topics (array of topic, statements): statements by descending order, topics by their best one."""
    t = rows.groupBy(source, topic).agg(F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("o"), F.col(statement).alias("s")))).alias("s"))
    t = t.select(F.col(source).alias("source"), F.struct(F.col("s")[0]["o"].alias("o"), F.col(topic).alias("topic"), F.transform("s", lambda x: x["s"]).alias("statements")).alias("t"))
    return t.groupBy("source").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["topic"].alias("topic"), x["statements"].alias("statements"))).alias("topics"))


def as_text(topics: Column, source: Column) -> Column:
    """For each topic a heading, its statements as one line and its source."""
    block = lambda t: F.concat(F.lit("## "), t["topic"], F.lit("\n"), F.array_join(t["statements"], " "), F.lit("\n[Source: "), source, F.lit("]\n\n"))
    return F.array_join(F.transform(topics, block), "\n")


def as_json(topics: Column, source: Column) -> Column:
    return F.to_json(F.struct(source.alias("source"), topics.alias("topics")))


def yaml_string(x: Column) -> Column:
    """A string in double quotes, as JSON and YAML both have it."""
    made = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(made, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def as_yaml(topics: Column, source: Column) -> Column:
    one = lambda t: F.concat(F.lit("  - topic: "), yaml_string(t["topic"]), F.lit("\n    statements:"), F.array_join(F.transform(t["statements"], lambda s: F.concat(F.lit("\n    - "), yaml_string(s))), ""))
    return F.concat(F.lit("- source: "), yaml_string(source), F.lit("\n  topics:\n"), F.array_join(F.transform(topics, one), "\n"))


def xml_string(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def as_xml(topics: Column, source: Column, tag: str = "item") -> Column:
    one = lambda t: F.concat(F.lit("<topic><name>"), xml_string(t["topic"]), F.lit("</name>"), F.array_join(F.transform(t["statements"], lambda s: F.concat(F.lit("<statement>"), xml_string(s), F.lit("</statement>"))), ""), F.lit("</topic>"))
    return F.concat(F.lit(f"<{tag}><source>"), xml_string(source), F.lit("</source>"), F.array_join(F.transform(topics, one), ""), F.lit(f"</{tag}>"))


FORMATS = {"text": as_text, "json": as_json, "yaml": as_yaml, "xml": as_xml}


def formatted(rows: DataFrame, form: str = "json") -> DataFrame:
    """source, context: each nested result in a format."""
    return rows.select("source", FORMATS[form](F.col("topics"), F.col("source")).alias("context"))
