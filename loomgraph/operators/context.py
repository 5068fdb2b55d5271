"""Query context: from a question to keywords, entities and entity contexts.

Questions and keywords are a stated few, so tables of them are small; the graph's tables aren't collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import rerank
from loomgraph.operators.graph import Graph
from loomgraph.operators.ordered import without_prefixes
from loomgraph.operators.retrieval import context_tree
from loomgraph.sources.shared import few, written


def split_keywords(response: Column, most: int = 10, delimiter: str = "^") -> Column:
    """Keywords of a model's answer: trimmed, without empty and repeated ones, the first most."""
    parts = F.filter(F.transform(F.split(response, "\\" + delimiter), text.trim), lambda x: x != "")
    return F.slice(F.array_distinct(parts), 1, most)


def long_words(question: Column, most: int = 10, letters: int = 5) -> Column:
    """The rule that stands for named entities where no model is given: distinct words of so many letters, longest first, then as said."""
    words = F.array_distinct(F.regexp_extract_all(question, F.lit(rf"(\p{{L}}{{{letters},}})"), F.lit(1)))
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(placed), lambda x: x["w"]), 1, most)


def keyword_parts(keywords: DataFrame) -> DataFrame:
    """keyword, search_str and class of keywords; one may restrict its class, as value|class."""
    parts = F.split("keyword", r"\|")
    return keywords.select("keyword").distinct().select("keyword", text.search_str(parts[0]).alias("key"), F.when(F.size(parts) > 1, F.trim(parts[1])).alias("kind"))


def entity_lookup(g: Graph, keywords: DataFrame) -> DataFrame:
    """keyword, entity_id, value, class, score of the entities that keywords name exactly, or, where none does, begin; score is the degree.

    Beginnings are joined as equal prefixes of the keywords' lengths, so no keyword is held against every entity. Local
    entities don't count.
    """
    words = keyword_parts(keywords)
    e = g.entity.where("not is_local").select("entity_id", "value", "search_str", "class")
    fits = F.col("kind").isNull() | (F.col("class") == F.col("kind"))
    exact = e.join(F.broadcast(words), (F.col("search_str") == F.col("key")) & fits)
    rest = words.join(exact.select("keyword").distinct(), "keyword", "left_anti")
    sizes = rest.agg(F.collect_set(F.length("key")).alias("sizes"))  # one row, of lengths
    starts = e.join(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).where(F.length("search_str") >= F.col("size")).withColumn("start", F.substring("search_str", F.lit(1), F.col("size")))
    begins = starts.join(F.broadcast(rest), (F.col("start") == F.col("key")) & (F.col("kind").isNull() | F.col("class").startswith(F.col("kind"))))
    cols = ("keyword", "entity_id", "value", "class")
    return exact.select(*cols).unionByName(begins.select(*cols)).join(g.degree, "entity_id").select(*cols, F.col("degree").alias("score"))


def summed(found: DataFrame, limit: int | None = None) -> DataFrame:
    """entity_id, value, class and the sum of its scores over keywords; the limit greatest."""
    rows = found.groupBy("entity_id").agg(F.min("value").alias("value"), F.min("class").alias("class"), F.sum("score").alias("score"))
    return rows if limit is None else rows.orderBy(F.desc("score"), "entity_id").limit(limit)


def statement_entities(g: Graph) -> DataFrame:
    """statement_id with the entities of its facts, without local ones."""
    real = g.entity.where("not is_local").select("entity_id")
    return g.supports.join(g.entity_fact.select("entity_id", "fact_id").distinct(), "fact_id").join(real, "entity_id", "left_semi").select("statement_id", "entity_id").distinct()


def entities_of(g: Graph, nodes: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """entity_id, value, class, score (degree) of the entities of topics (key topic_id) or chunks (chunk_id), the limit of highest degree."""
    s = g.statement.join(nodes.select(key).distinct(), key, "left_semi").select("statement_id")
    e = statement_entities(g).join(s, "statement_id", "left_semi").select("entity_id").distinct()
    rows = e.join(g.degree, "entity_id").join(g.entity, "entity_id")
    return rows.select("entity_id", "value", "class", F.col("degree").alias("score")).orderBy(F.desc("score"), "entity_id").limit(limit)


def entities_of_statements(g: Graph, statements: DataFrame) -> DataFrame:
    """statement_id with entity_id and score of its entities; a statement without any has a row of its own."""
    named = statement_entities(g).join(g.degree, "entity_id").select("statement_id", "entity_id", F.col("degree").alias("score"))
    return statements.select("statement_id").distinct().join(named, "statement_id", "left")


def reranked(entities: DataFrame, phrases: DataFrame) -> DataFrame:
    """entities with rerank: the TF-IDF score of 'value (class)' against phrases (m, text), to four places, 0 without a gram in common."""
    told = entities.select("entity_id", F.lower(F.format_string("%s (%s)", "value", "class")).alias("text")).distinct()
    score = rerank.score(told, phrases, "entity_id", "text").select("entity_id", F.round("score", 4).alias("rerank"))
    return entities.join(score, "entity_id", "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


def entity_contexts(g: Graph, entities: DataFrame, phrases: DataFrame, low: float = 0.1, high: float = 10.0, depth: int = 3, width: int = 2, most: int = 3) -> DataFrame:
    """root_id, path, values, score: the most contexts of entities (entity_id, value, class, score).

    From each entity a tree of neighbours grows; they and the entities stay if their degree lies between low and high times
    the score of the first entity. Contexts are the longest paths within what stays, less those whose values begin another;
    roots come by their score, and a root's contexts by the mean rerank of their entities.
    """
    entities = written(entities, "entities")
    tree = written(context_tree(g, entities, depth, width), "tree")
    nodes = few(tree.select(F.explode("path").alias("entity_id")).distinct().join(entities.select("entity_id"), "entity_id", "left_anti"))
    near = g.degree.join(nodes, "entity_id").join(g.entity.select("entity_id", "value", "class").join(nodes, "entity_id"), "entity_id").select("entity_id", "value", "class", F.col("degree").cast("double").alias("score"))
    every = reranked(entities.select("entity_id", "value", "class", F.col("score").cast("double").alias("score")).unionByName(written(near, "near")), phrases)
    first = entities.agg(F.max_by(F.col("score").cast("double"), F.struct(F.col("score"), F.col("entity_id"))).alias("base"))  # one row
    kept = every.join(F.broadcast(first), F.col("score").between(F.lit(low) * F.col("base"), F.lit(high) * F.col("base"))).select("entity_id", "value", "score", "rerank")
    paths = tree.select("root_id", "path").unionByName(entities.select(F.col("entity_id").alias("root_id"), F.array("entity_id").alias("path"))).distinct()
    placed = paths.select("root_id", "path", F.posexplode("path").alias("pos", "entity_id")).join(kept, "entity_id", "left")
    # a path ends before its first entity that doesn't stay; without its root it isn't one
    cut = placed.groupBy("root_id", "path").agg(F.min(F.when(F.col("value").isNull(), F.col("pos"))).alias("cut"), F.array_sort(F.collect_list(F.struct("pos", "value", "rerank", "score"))).alias("e"))
    cut = cut.withColumn("e", F.when(F.col("cut").isNull(), F.col("e")).otherwise(F.slice("e", F.lit(1), F.col("cut")))).where(F.size("e") > 0)
    made = cut.select("root_id", F.transform("e", lambda x: x["value"]).alias("values"), F.col("e")[0]["score"].alias("root_score"), (F.aggregate("e", F.lit(0.0), lambda s, x: s + x["rerank"]) / F.size("e")).alias("score"))
    made = made.withColumn("key", F.lower(F.array_join("values", ",")))
    best = without_prefixes(made.groupBy("key").agg(F.max_by(F.struct("root_id", "values", "root_score", "score"), F.struct("root_score", "root_id")).alias("r")).select("key", "r.*"), "key")
    return best.orderBy(F.desc("root_score"), "root_id", F.desc(F.round("score", 6)), "key").limit(most).select("root_id", F.array_join("values", ", ").alias("context"), F.round("score", 4).alias("score"))


def parts_of(query: Column, most_words: int = 25) -> Column:
    """A question as its sentences if it has over most_words words, else as one."""
    parts = F.filter(F.transform(F.split(query, r"(?<=[?.!])\s+"), text.trim), lambda x: x != "")
    return F.when(F.size(F.split(F.trim(query), r"\s+")) > most_words, parts).otherwise(F.array(F.trim(query)))


def per_keyword(limit: int, keywords: int) -> int:
    """Results that each of a multipart query's searches may give."""
    return limit // max(1, keywords) + 1


def in_requested_order(rows: DataFrame, wanted: DataFrame, key: str, place: str = "place") -> DataFrame:
    """Rows with the places of the ids that were asked for; ids without a row are left out."""
    return wanted.select(key, place).join(rows, key)


def entity_paths(g: Graph, start: DataFrame, depth: int = 3, limit: int = 1000) -> DataFrame:
    """path (entity ids): walks of 1 to depth relations from entities whose name begins with a prefix (column prefix, a few), without
    repeats; the first limit by length and path."""
    e = g.relation.select(F.col("src").alias("at"), F.col("dst").alias("to")).where("at <> to").distinct()
    sizes = start.agg(F.collect_set(F.length("prefix")).alias("sizes"))
    seed = g.entity.where("not is_local").join(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).withColumn("prefix", F.substring("search_str", F.lit(1), F.col("size")))
    level = seed.join(F.broadcast(start.select("prefix").distinct()), "prefix", "left_semi").select(F.array("entity_id").alias("path"), F.col("entity_id").alias("at")).distinct()
    out = None
    for _ in range(depth):
        level = level.join(e, "at").where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
        level = level.orderBy("path").limit(limit)  # longer paths go on only from the first limit of a length, which suffice
        out = level if out is None else out.unionByName(level)
    return out.select("path").orderBy(F.size("path"), "path").limit(limit)
