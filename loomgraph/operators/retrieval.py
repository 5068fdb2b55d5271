"""Graph patterns, from seeds to statements, and the grouping that ends every search.

Seeds are k rows of a top-k, so they're broadcast. What a search goes on from is counted, and broadcast where it's few
ids: the graph's tables are then only scanned, and what is shuffled are the rows that the search meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.sources.shared import few


def seeds(df: DataFrame, column: str) -> DataFrame:
    """A few ids, bounded by the k of the search that found them."""
    return F.broadcast(df.select(column).distinct())


def capped(df: DataFrame, by: str, k: int, *order: str | Column) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def chunk_statements(g: Graph, chunks: DataFrame, limit: int = 50) -> DataFrame:
    """Statements of the topics that chunks mention, limit a chunk: chunk_id, statement_id."""
    t = g.topic_chunk.join(seeds(chunks, "chunk_id"), "chunk_id")
    found = t.join(g.statement.select("topic_id", "statement_id"), "topic_id").select("chunk_id", "statement_id").distinct()
    return capped(found, "chunk_id", limit, "statement_id")


def topic_statements(g: Graph, topics: DataFrame, limit: int = 25) -> DataFrame:
    found = g.statement.join(seeds(topics, "topic_id"), "topic_id").select("topic_id", "statement_id")
    return capped(found, "topic_id", limit, "statement_id")


def topic_fact_statements(g: Graph, topics: DataFrame, limit: int = 50) -> DataFrame:
    """Statements, of any source, that the facts of a topic support; limit facts a topic."""
    facts = g.statement_fact.join(seeds(topics, "topic_id"), "topic_id").select("topic_id", "fact_id").distinct()
    facts = few(capped(facts, "topic_id", limit, "fact_id"))
    return g.supports.join(facts, "fact_id").select("topic_id", "statement_id").distinct()


def with_neighbours(g: Graph, statements: DataFrame) -> DataFrame:
    """Statements and those next to them in their topic."""
    ids = few(statements.select("statement_id"))
    before = g.previous.join(ids, "statement_id").select(F.col("previous_id").alias("statement_id"))
    after = g.previous.join(ids.withColumnRenamed("statement_id", "previous_id"), "previous_id").select("statement_id")
    return ids.unionByName(before).unionByName(after).distinct()


def entity_statements(g: Graph, entities: DataFrame, limit: int = 50) -> DataFrame:
    """Statements of facts with one of these subjects, and their neighbours."""
    f = few(g.entity_fact.where("role = 'SUBJECT'").join(seeds(entities, "entity_id"), "entity_id").select("entity_id", "fact_id"))
    found = capped(g.supports.join(f, "fact_id").select("entity_id", "statement_id").distinct(), "entity_id", limit, "statement_id")
    return with_neighbours(g, found)


def undirected(relation: DataFrame, at: DataFrame) -> DataFrame:
    """a, b: both directions of the relations of a few entities (column a), not to themselves."""
    a = relation.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return a.join(at, "a").unionByName(a.select(F.col("b").alias("a"), F.col("a").alias("b")).join(at, "a")).select("a", "b").distinct()


def pair_statements(g: Graph, one: DataFrame, others: DataFrame) -> DataFrame:
    """Statements of facts between entities on paths of one or two relations from one set of entities to another."""
    start, goal = few(one.select(F.col("entity_id").alias("a"))), few(others.select(F.col("entity_id").alias("goal")))
    first, last = undirected(g.relation, start), undirected(g.relation, goal.withColumnRenamed("goal", "a"))
    direct = first.join(goal, F.col("b") == F.col("goal"), "left_semi").select(F.array("a", "b").alias("path"))
    second = first.select("a", F.col("b").alias("m")).join(last.select(F.col("b").alias("m"), F.col("a").alias("c")), "m").where("c <> a")
    two = second.select(F.array("a", "m", "c").alias("path"))
    nodes = few(direct.unionByName(two).select(F.explode("path").alias("entity_id")))
    on = g.entity_fact.join(nodes, "entity_id").groupBy("fact_id").agg(F.count_distinct("role").alias("roles")).where("roles = 2").select("fact_id")
    return with_neighbours(g, g.supports.join(few(on), "fact_id").select("statement_id").distinct())


def entities_of(g: Graph, nodes: DataFrame, key: str) -> DataFrame:
    """key, entity_id: the entities of the facts of a few statements, chunks or topics (column key)."""
    facts = few(g.statement_fact.select(key, "fact_id").join(seeds(nodes, key), key).select(key, "fact_id"))
    return g.entity_fact.select("entity_id", "fact_id").join(facts, "fact_id").select(key, "entity_id").distinct()


def with_entities(g: Graph, entities: DataFrame, key: str) -> DataFrame:
    """other_id, entity_id: the chunks or topics (key) that mention these entities, once each, all rows of one in one partition."""
    facts = few(g.entity_fact.select("entity_id", "fact_id").join(entities, "entity_id").select("entity_id", "fact_id"), repeats=True)
    return g.statement_fact.select(F.col(key).alias("other_id"), "fact_id").join(facts, "fact_id").select("other_id", "entity_id").repartition("other_id").distinct()


def statement_neighbours(g: Graph, statements: DataFrame) -> DataFrame:
    """statement_id and others that share an entity with it."""
    mine = few(entities_of(g, statements, "statement_id"))
    shared = few(g.entity_fact.select("entity_id", "fact_id").join(mine, "entity_id").select("statement_id", "fact_id"))
    shared = g.supports.withColumnRenamed("statement_id", "other_id").join(shared, "fact_id")
    return shared.where("statement_id <> other_id").select("statement_id", "other_id").distinct()


def chunk_neighbours(g: Graph, chunks: DataFrame, entities: int = 5, limit: int = 20) -> DataFrame:
    """chunk_id and the chunks that share most of its entities of highest degree."""
    mine = few(entities_of(g, chunks, "chunk_id"))
    top = few(capped(g.degree.join(mine, "entity_id"), "chunk_id", entities, F.desc("degree"), "entity_id").select("chunk_id", "entity_id"))
    other = with_entities(g, F.broadcast(top.select("entity_id").distinct()), "chunk_id").join(top, "entity_id").where("chunk_id <> other_id")
    return capped(other.groupBy("chunk_id", "other_id").agg(F.count(F.lit(1)).alias("shared")), "chunk_id", limit, F.desc("shared"), "other_id")


def topic_neighbours(g: Graph, topics: DataFrame, limit: int = 5) -> DataFrame:
    """topic_id and topics with the most facts' entities in common, of the same chunk, and of the next one; each kind limited."""
    s = seeds(topics, "topic_id")
    mine = few(entities_of(g, topics, "topic_id"))
    # rows of another topic stay together, so that its pairs with these are counted and cut where they are made
    strong = with_entities(g, few(mine.select("entity_id")), "topic_id").join(mine, "entity_id").where("topic_id <> other_id").groupBy("topic_id", "other_id").agg(F.count(F.lit(1)).alias("n"))
    strong = capped(strong, "topic_id", limit, F.desc("n"), "other_id").select("topic_id", "other_id", F.lit("entity").alias("kind"))
    mine = g.topic_chunk.join(s, "topic_id")
    there = g.topic_chunk.withColumnRenamed("topic_id", "other_id")
    same = capped(mine.join(there, "chunk_id").where("topic_id <> other_id").select("topic_id", "other_id").distinct(), "topic_id", limit, "other_id").select("topic_id", "other_id", F.lit("chunk").alias("kind"))
    after = mine.join(g.chunk_links.select("chunk_id", "next_id"), "chunk_id").select("topic_id", F.col("next_id").alias("chunk_id")).join(there, "chunk_id").where("topic_id <> other_id").select("topic_id", "other_id").distinct()
    after = capped(after, "topic_id", limit, "other_id").select("topic_id", "other_id", F.lit("next").alias("kind"))
    return strong.unionByName(same).unionByName(after).groupBy("topic_id", "other_id").agg(F.min("kind").alias("kind"))


def keyword_statements(g: Graph, keywords: DataFrame) -> DataFrame:
    """statement_id, m: how many of the keywords (a few, broadcast) name an entity of its facts."""
    e = g.entity.join(F.broadcast(keywords.select("search_str").distinct()), "search_str").select("entity_id", "search_str")
    hit = e.join(g.entity_fact.select("entity_id", "fact_id"), "entity_id").join(g.supports, "fact_id")
    return hit.groupBy("statement_id").agg(F.count_distinct("search_str").alias("m"))


def entity_lookup(g: Graph, keywords: DataFrame) -> DataFrame:
    """search_str and entities named exactly so, or that begin with it where there is none; score is the degree."""
    words = F.broadcast(keywords.select(F.col("search_str").alias("keyword")).distinct())
    e = g.entity.where("not is_local").select("entity_id", "value", "search_str")
    exact = e.join(words, F.col("search_str") == F.col("keyword")).select("keyword", "entity_id", "value")
    rest = F.broadcast(words.join(exact.select("keyword").distinct(), "keyword", "left_anti"))
    begins = e.join(rest, F.col("search_str").startswith(F.col("keyword"))).select("keyword", "entity_id", "value")
    return exact.unionByName(begins).join(g.degree, "entity_id").select("keyword", "entity_id", "value", F.col("degree").alias("score"))


def entity_scores(found: DataFrame, limit: int) -> DataFrame:
    """Sums of an entity's scores over keywords, the greatest first."""
    return found.groupBy("entity_id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "entity_id").limit(limit)


def entity_filter(df: DataFrame, low: float = 0.1, high: float = 10.0, first: Column | None = None) -> DataFrame:
    """Entities whose score lies between low and high times that of the first one (the greatest unless told)."""
    top = df.agg((F.max("score") if first is None else first).alias("s")).first()["s"]
    return df.where(F.lit(False)) if top is None else df.where(F.col("score").between(low * top, high * top))


def context_tree(g: Graph, roots: DataFrame, depth: int = 3, width: int = 2) -> DataFrame:
    """root_id, path: entities reached by outgoing relations, each time the depth + 2 of highest degree, none twice on a path."""
    e = g.relation.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    real = g.entity.where("not is_local").select(F.col("entity_id").alias("to")).join(g.degree.select(F.col("entity_id").alias("to"), "degree"), "to")
    level = roots.select(F.col("entity_id").alias("root_id"), F.array("entity_id").alias("path"), F.col("entity_id").alias("at"))
    out = None
    for k in range(1, depth):
        step = few(F.broadcast(level).join(e, "at").where(~F.array_contains("path", F.col("to"))))
        named = few(step.select("to"))
        step = step.join(few(real.join(named, "to")), "to")
        best = Window.partitionBy("path").orderBy(F.desc("degree"), "to")
        step = step.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + width)
        level = step.select("root_id", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
        out = level if out is None else out.unionByName(level)
    return out.select("root_id", "path")


def grouped(g: Graph, statements: DataFrame, query_limit: int = 10) -> DataFrame:
    """Statements by topic and source: the query_limit best sources by their topics' statements per chunk, a row a statement.

    A source's result_score is the sum over its topics of whole statements per distinct chunk; a statement's
    score is its number of facts.
    """
    ids = few(statements.select("statement_id"))
    s = g.statement.join(ids, "statement_id")
    per = s.groupBy("source_id", "topic_id").agg(F.floor(F.count(F.lit(1)) / F.count_distinct("chunk_id")).alias("k"))
    best = per.groupBy("source_id").agg(F.sum("k").alias("result_score")).orderBy(F.desc("result_score"), "source_id").limit(query_limit)
    facts = g.supports.join(ids, "statement_id", "left_semi").groupBy("statement_id").agg(F.count(F.lit(1)).alias("facts"))
    rows = s.join(F.broadcast(best), "source_id").join(facts, "statement_id", "left")  # query_limit rows
    return rows.select("source_id", "result_score", "topic_id", "chunk_id", "statement_id", F.coalesce("facts", F.lit(0)).cast("double").alias("score"))
