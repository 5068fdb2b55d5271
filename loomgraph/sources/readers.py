"""Readers of documents: id, text and metadata from files; writers of staged chunks.

All are plans over Spark's own sources; only formats that need a parser of their own run Python, on batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, text_field: str | None = None, strict: bool = False) -> DataFrame:
    """file_path, text, document (JSON) of each line that isn't blank; lines that don't parse are skipped, or fail if strict."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value").where(F.trim("value") != "")
    parsed = F.try_parse_json(F.col("value"))
    lines = lines.withColumn("ok", parsed.isNotNull())
    if strict:
        lines = lines.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.col("value"))).cast("boolean")))
    text = F.col("value") if text_field is None else F.get_json_object("value", f"$.{text_field}")
    return lines.where("ok").select("file_path", text.alias("text"), F.col("value").alias("document"))


def json_array(spark: SparkSession, path: str, text: Callable[[Column], Column] | str = "text") -> DataFrame:
    """One row for each element of each file's array, or for its object."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.trim("value").alias("value"))
    many = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = rows.select("filename", F.explode(many).alias("document"))
    return rows.select("filename", (text(F.col("document")) if callable(text) else F.get_json_object("document", f"$.{text}")).alias("text"), "document")


def structured(spark: SparkSession, path: str, columns: list[str | int], joiner: str = " ", header: bool = True) -> DataFrame:
    """A document a row of CSV files, of columns by name or place."""
    df = spark.read.option("header", header).csv(path)
    picked = [F.col(f"`{df.columns[c] if isinstance(c, int) else c}`") for c in columns]
    return df.select(F.concat_ws(joiner, *picked).alias("text"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("document"))


def csv(spark: SparkSession, path: str, concat_rows: bool = True, joiner: str = ", ") -> DataFrame:
    """The values of a row joined as text; with concat_rows one document a file, its rows in order, one a line.

    Quoted values may hold commas and doubled quotes; a value that spans lines isn't told apart from two rows.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where("line <> ''")
    value = F.regexp_extract_all("line", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = F.transform(value, lambda v: F.when(v.startswith('"'), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))
    rows = lines.select("file_path", "row", F.array_join(bare, joiner).alias("text"))
    if not concat_rows:
        return rows.select("file_path", "text")
    return rows.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda r: r["text"]), "\n").alias("text"))

def json_tree(spark: SparkSession, path: str, levels_back: int = 0) -> DataFrame:
    """Leaves of JSON files as lines of the last levels_back keys (all if 0) and the value."""
    import pandas as pd

    def walk(x, keys):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, [*keys, str(k)])
        elif isinstance(x, list):
            for v in x:
                yield from walk(v, keys)
        else:
            yield " ".join([*keys[-levels_back:], str(x)] if levels_back else [*keys, str(x)])

    def flatten(it):
        for df in it:
            yield pd.DataFrame({"file_path": df.file_path, "text": ["\n".join(walk(json.loads(v), [])) for v in df.value]})

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value").mapInPandas(flatten, "file_path string, text string")


def records(df: DataFrame, content: list[str], metadata: list[str] = ()) -> DataFrame:
    """Documents of records: the first content field that isn't null, and a metadata map."""
    pairs = [x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]
    return df.select(F.coalesce(*(F.col(c).cast("string") for c in content)).alias("text"), F.create_map(*pairs).alias("metadata") if pairs else F.lit(None).cast("map<string,string>").alias("metadata"))


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole text files below a folder; local or any Hadoop file system."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """A document for each heading's section of Markdown files: file_path, seq, header, text."""
    files = directory(spark, path, "*.md")
    parts = files.select("file_path", F.posexplode(F.split("text", r"(?m)^(?=#{1,6} )")).alias("seq", "part")).where(F.trim("part") != "")
    return parts.select("file_path", "seq", F.trim(F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1)).alias("header"), F.trim("part").alias("text"))


def binary(spark: SparkSession, path: str, pattern: str, parse: Callable[[bytes], str]) -> DataFrame:
    """Files of other formats, by a parser of their bytes (PDF, DOCX, PPTX: give one that's installed)."""
    import pandas as pd

    def read(it):
        for df in it:
            yield pd.DataFrame({"file_path": df.path, "text": [parse(b) for b in df.content]})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", "content").mapInPandas(read, "file_path string, text string")


def database(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def html_text(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles and tags, the common entities decoded."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def web(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Documents of fetched pages: url, title, text."""
    return pages.select(F.col(url).alias("url"), html_text(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)).alias("title"), html_text(F.col(html)).alias("text"))


def chain(*producers: DataFrame) -> DataFrame:
    """Documents of several sources, one after the other."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stage(chunks: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write chunks (source_id, chunk_id, value, metadata) as JSON, a folder a source, with the allowed metadata keys."""
    rows = chunks
    if keys is not None and "metadata" in chunks.columns:
        rows = rows.withColumn("metadata", F.map_filter("metadata", lambda k, _: k.isin(*keys)))
    rows.write.mode("overwrite").partitionBy("source_id").json(path)


def staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def get_chunks(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks by id; missing ones are left out."""
    return store.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def tap(df: DataFrame, path: str) -> DataFrame:
    """Write df aside and go on with it."""
    df.write.mode("append").parquet(path)
    return df
