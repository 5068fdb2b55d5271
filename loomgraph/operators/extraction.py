"""Parsing of extraction responses: lines of topics, entities, propositions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import clean


def parse(responses: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, topic, proposition, kind, subject, predicate, object of the lines of each response.

    Running last values over a response's line numbers carry the current topic, section and proposition. A line a | b
    in the entities section is an entity with its class; a | p | c below a proposition a relation, whose kind is SPO when
    both ends are entities of the topic, SPC when the subject is, and LOCAL when neither is, whose line is a detail too;
    other lines there are details, lines before any section garbage.
    """
    lines = responses.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    low = F.lower("line")
    after = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    w = Window.partitionBy("id").orderBy("n")
    head = F.when(low.startswith("topic:"), "topic").when(low.rlike(r"^entit[^:]*:"), "entities").when(low.startswith("proposition:"), "proposition")
    rows = lines.withColumn("head", head).withColumn("section", F.last("head", True).over(w))
    rows = rows.withColumn("topic", F.last(F.when(F.col("head") == "topic", clean(after)), True).over(w))
    rows = rows.withColumn("proposition", F.last(F.when(F.col("head") == "proposition", after).when(F.col("head").isNotNull(), F.lit("")), True).over(w))
    body = rows.where("head is null").withColumn("part", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)))
    entity = body.where("section = 'entities' and size(part) = 2").select("id", "topic", F.lit("").alias("proposition"), F.lit("ENTITY").alias("kind"), clean(F.col("part")[0]).alias("subject"), F.lit("").alias("predicate"), F.initcap(clean(F.col("part")[1])).alias("object"))
    said = body.where("section = 'proposition'")
    known = entity.select("id", "topic", F.lower("subject").alias("e")).distinct()
    rel = said.where("size(part) = 3").select("id", "topic", "proposition", clean(F.col("part")[0]).alias("subject"), F.upper(clean(F.col("part")[1])).alias("predicate"), clean(F.col("part")[2]).alias("object"))
    s, o = known.withColumnRenamed("e", "se").withColumn("has_s", F.lit(True)), known.withColumnRenamed("e", "oe").withColumn("has_o", F.lit(True))
    rel = rel.withColumn("se", F.lower("subject")).withColumn("oe", F.lower("object")).join(s, ["id", "topic", "se"], "left").join(o, ["id", "topic", "oe"], "left")
    rel = rel.withColumn("kind", F.when(F.col("has_s") & F.col("has_o"), "SPO").when(F.col("has_s"), "SPC").otherwise("LOCAL"))
    rel = rel.select("id", "topic", "proposition", "kind", "subject", "predicate", "object")
    other = said.where("size(part) <> 3").select("id", "topic", "proposition", F.lit("DETAIL").alias("kind"), F.col("line").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("object"))
    junk = body.where("section is null or section = 'topic' or (section = 'entities' and size(part) <> 2)").select("id", F.coalesce("topic", F.lit("")).alias("topic"), F.lit("").alias("proposition"), F.lit("GARBAGE").alias("kind"), F.col("line").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("object"))
    return entity.unionByName(rel).unionByName(other).unionByName(junk)
