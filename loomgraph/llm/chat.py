"""Chat formatting with cumulative-snapshot collapse.

A logged conversation whose turns are the first turns of another one is a snapshot of it. Every turn is
hashed with its position, and rolling xors of those hashes identify each prefix of each conversation;
anti-joins against the proper prefixes of others leave the maximal conversations, the one of least id
where several are equal. Those are then rendered.

Turns are numbered in two steps, within stretches of ``STRIDE`` turn numbers and over the stretches of a
conversation, so a conversation that holds a third of all rows isn't sorted by one task, and long ones are
rendered in parts of ``PART`` turns, numbered from 0.

Turns come in the order of their number, null last, then role, then text. Repeated rows are one turn; a
null role or text counts as empty; rows without a conversation's id are left out. "<|im_" within a role or
a text is rendered as "<| im_", so that no text can end its own turn. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIDE = 256
PART = 64


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), n, role, text and the two halves of the hash of the turns up to here."""
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRIDE), F.lit(2**62)))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    within = Window.partitionBy("conv", "stretch").orderBy(*order)
    rows = rows.withColumn("at", F.row_number().over(within))
    before = Window.partitionBy("conv").orderBy("stretch")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "stretch").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.select("conv", "stretch", F.coalesce(F.sum("k").over(past), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy("conv")).alias("n"))
    rows = rows.join(sizes, ["conv", "stretch"]).withColumn("pos", F.col("base") + F.col("at"))
    one, other = F.xxhash64("pos", "role", "text"), F.xxhash64("text", "pos", "role", F.lit(7))
    rows = rows.withColumn("x", one).withColumn("y", other)
    sums = rows.groupBy("conv", "stretch").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = sums.select("conv", "stretch", F.coalesce(F.bit_xor("x").over(past), F.lit(0)).alias("px"), F.coalesce(F.bit_xor("y").over(past), F.lit(0)).alias("py"))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x", F.bit_xor("x").over(upto)).withColumn("y", F.bit_xor("y").over(upto)).join(sums, ["conv", "stretch"])
    return rows.select("conv", "pos", "n", "role", "text", F.col("x").bitwiseXOR(F.col("px")).alias("h1"), F.col("y").bitwiseXOR(F.col("py")).alias("h2"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv and copies: conversations that are no prefix of a longer one, the least of equal ones."""
    whole = rows.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    proper = rows.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv", "copies")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, part, n_turns (of the conversation), copies (logged with the same turns), text."""
    rows = numbered(turns, conv, turn, role, text)
    safe = lambda c: F.replace(F.col(c), F.lit("<|im_"), F.lit("<| im_"))
    piece = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    kept = rows.join(maximal(rows), "conv").select("conv", "n", "copies", "pos", F.floor((F.col("pos") - 1) / PART).cast("long").alias("part"), piece.alias("piece"))
    parts = kept.groupBy("conv", "part", "n", "copies").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return parts.select(F.col("conv").alias(conv), "part", F.col("n").alias("n_turns"), "copies", F.array_join(F.col("p.piece"), "").alias("text"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    struct_pack(r := role, t := text) AS said,
    '<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS piece FROM t),
a AS (SELECT *, list(said) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM p),
w AS (SELECT upto, min(conv_id) AS conv_id, count(*) AS copies FROM a WHERE pos = n GROUP BY upto),
k AS (SELECT conv_id, copies FROM w WHERE upto NOT IN (SELECT upto FROM a WHERE pos < n))
SELECT conv_id, (pos - 1) // {PART} AS part, n AS n_turns, copies, length(string_agg(piece, '' ORDER BY pos)) AS n_chars, sha256(string_agg(piece, '' ORDER BY pos)) AS text_sha256
FROM p JOIN k USING (conv_id) GROUP BY conv_id, (pos - 1) // {PART}, n, copies
"""
