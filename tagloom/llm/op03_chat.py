"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds one conversation many times, once after every exchange. Turns get rolling prefix hashes of 128
bits: turn k's is the exclusive-or of the hashes of (place, role, text) of turns 1 to k. A conversation whose last hash
is a proper prefix hash of another one is a snapshot of it; anti-joins drop those, and of conversations that are equal
the one with the least id stays. What is left is rendered.

No conversation is ever gathered in one task, since one id may hold much of the log: places and rolling hashes are
prefix sums over ranges of (conv_id, turn), whose totals are joined back, and a rendered conversation is cut into parts of
PART_TURNS turns. Texts are shuffled twice, the hashes of the search stand for them elsewhere.

Only DataFrame functions are used. Defined cases: a turn logged several times (equal conv_id, turn, role and text) counts
once; different turns with one number stand in the order of role and text (only such texts are sorted, and they are ranked
over ranges as well); null roles and texts are empty; null turns come first; rows with a null conv_id make up a conversation of their own, which is the least; an empty table gives no rows;
other columns are ignored. The marks of the format are made harmless where they occur in roles or texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

#: Turns in one part of a rendered conversation.
PART_TURNS = 256
#: The format: marks of public chat templates, and what stands for their first characters inside texts.
OPEN, CLOSE, MARK, HARMLESS = "<|im_start|>", "<|im_end|>", "<|", "< |"
_ID = ("conv_id", "turn", "role", "x", "y")
_NUMBER = ("conv_id", "turn", "role")


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _turns(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and two hashes x, y of the text."""
    rows = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _plain("role").alias("role"), _plain("text").alias("text"))
    return rows.withColumns({"x": F.xxhash64("text"), "y": F.xxhash64(F.lit(1), "text")})


def _before(local: DataFrame, value: Column, name: str) -> DataFrame:
    """Per (range, conversation): the total of value over the conversation's earlier ranges."""
    earlier = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = local.groupBy("range", "conv_id").agg(value.alias(name))
    return totals.select("range", "conv_id", F.coalesce((F.sum if name == "n" else F.bit_xor)(name).over(earlier), F.lit(0)).alias(f"before_{name}"))


def _joined(rows: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        other = other.select(F.col("range").alias("_r"), F.col("conv_id").alias("_c"), *[c for c in other.columns if c.startswith("before_")])
        rows = rows.join(other, (F.col("range") == F.col("_r")) & F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_r", "_c")
    return rows


def _same(left: str, right: str, columns: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _ranked(log: DataFrame) -> DataFrame:
    """Distinct turns with rank: 0, but for turns that share number and role, which are ranked by text."""
    turns = _turns(log)
    distinct = cut(turns.select(*_ID).distinct())
    shared = cut(distinct.groupBy(*_NUMBER).agg(F.count("*").alias("n")).where("n > 1").select(*_NUMBER))
    if shared.isEmpty():
        return distinct.withColumn("rank", F.lit(0).cast("long"))
    tied = turns.alias("t").join(shared.alias("s"), _same("t", "s", _NUMBER), "left_semi").distinct()
    ranks = tied.repartitionByRange(*_NUMBER, "text").sortWithinPartitions(*_NUMBER, "text").select(*_ID, (F.monotonically_increasing_id() + 1).alias("_rank"))
    found = distinct.alias("d").join(cut(ranks).alias("r"), _same("d", "r", _ID), "left")
    return found.select("d.*", F.coalesce("r._rank", F.lit(0).cast("long")).alias("rank"))


def prefix_hashes(log: DataFrame) -> DataFrame:
    """Distinct turns (conv_id, turn, role, x, y) with place (from 1), n_turns, and the rolling hash (a, b)."""
    turns = _ranked(log)
    dealt = cut(turns.repartitionByRange(*_NUMBER, "rank", "x", "y").withColumn("range", F.spark_partition_id()))
    inside = W.partitionBy("range", "conv_id").orderBy("turn", "role", "rank")
    placed = dealt.withColumn("place", F.row_number().over(inside).cast("long"))
    placed = _joined(placed, _before(dealt, F.count("*"), "n")).withColumn("place", F.col("place") + F.col("before_n")).drop("before_n")
    hashed = cut(placed.withColumns({"ha": F.xxhash64(F.lit(2), "place", "role", "x", "y"), "hb": F.xxhash64(F.lit(3), "place", "role", "x", "y")}))
    rolling = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = hashed.withColumns({"a": F.bit_xor("ha").over(rolling), "b": F.bit_xor("hb").over(rolling)})
    rolled = _joined(rolled, _before(hashed, F.bit_xor("ha"), "ha"), _before(hashed, F.bit_xor("hb"), "hb"))
    sizes = hashed.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    sizes = _joined(hashed.select("range", "conv_id").distinct().withColumnRenamed("conv_id", "c").join(sizes, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c").withColumnRenamed("n_turns", "before_size"))
    rolled = _joined(rolled, sizes)
    return rolled.select(*_ID, "place", F.col("before_size").alias("n_turns"), F.col("a").bitwiseXOR(F.col("before_ha")).alias("a"), F.col("b").bitwiseXOR(F.col("before_hb")).alias("b"))


def maximal(hashes: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns) of the conversations that stay."""
    whole = hashes.where(F.col("place") == F.col("n_turns")).groupBy("place", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("least"))
    prefixes = hashes.where(F.col("place") < F.col("n_turns")).select("place", "a", "b").distinct()
    kept = whole.join(prefixes, ["place", "a", "b"], "left_anti")
    return kept.select(F.col("least.conv_id").alias("conv_id"), F.col("place").alias("n_turns"))


def _harmless(column: str) -> Column:
    return F.replace(F.col(column), F.lit(MARK), F.lit(HARMLESS))


def render(log: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, part, text): the maximal conversations in chat format, in parts of PART_TURNS turns."""
    hashes = cut(prefix_hashes(log))
    kept = maximal(hashes)
    part = F.floor((F.col("place") - 1) / PART_TURNS).cast("int")
    parts = kept.select("conv_id", "n_turns", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_turns") - 1) / PART_TURNS).cast("int"))).alias("part"))
    wanted = hashes.select(*_ID, "place", part.alias("_part"), F.col("conv_id").alias("_c"))
    wanted = wanted.join(parts.withColumnRenamed("conv_id", "_k"), F.col("_c").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("part"))).drop("_c", "_k", "_part")
    texts = _turns(log).groupBy(*_ID).agg(F.first("text").alias("text"))
    both = texts.alias("t").join(wanted.alias("w"), _same("t", "w", _ID)).select("w.conv_id", "n_turns", "part", "place", "w.role", "text")
    piece = F.concat(F.lit(OPEN), _harmless("role"), F.lit("\n"), _harmless("text"), F.lit(CLOSE + "\n"))
    pieces = both.groupBy("conv_id", "n_turns", "part").agg(F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    return pieces.select("conv_id", "n_turns", "part", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """All conversations."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
h AS (SELECT *, md5(string_agg(md5(role || chr(10) || text), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS h FROM p),
kept AS (SELECT CASE WHEN count(*) = count(conv_id) THEN min(conv_id) END AS conv_id FROM h WHERE place = n_turns AND NOT EXISTS (SELECT 1 FROM h AS o WHERE o.place < o.n_turns AND o.h = h.h) GROUP BY h)
SELECT conv_id, n_turns, CAST((place - 1) // {PART_TURNS} AS INT) AS part,
       string_agg('{OPEN}' || replace(role, '{MARK}', '{HARMLESS}') || chr(10) || replace(text, '{MARK}', '{HARMLESS}') || '{CLOSE}' || chr(10), '' ORDER BY place) AS text
FROM h WHERE EXISTS (SELECT 1 FROM kept WHERE kept.conv_id IS NOT DISTINCT FROM h.conv_id) GROUP BY conv_id, n_turns, part
"""
