"""Sorts, top-k, dedup and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import leaderboard as LB
from barlab.operators import search as SE
from barlab.operators import specs as SP
from barlab.plans import boards as BD
from barlab.registry import oracle, query

B3 = "i:row_id i:candidate_id s:method f:score"
BC = ["row_id", "candidate_id", "method", "score"]


@query("leaderboard_sort", oracle(B3 + " i:rank", BD.BOARD, "SELECT row_id, candidate_id, method, score, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM board"))
def leaderboard_sort(spark, d):
    """Total order with its global rank; the rank needs no single-task window."""
    n = SP.numbered(BD.board(spark, d).select(BC), [F.col("score").desc_nulls_last(), F.col("row_id")], "rank")
    return n.select(*BC, (F.col("rank") + 1).alias("rank"))


@query("leaderboard_merge", oracle(B3 + " f:extra", BD.BOARD,
    "u AS (SELECT row_id, candidate_id, method, score, CAST(NULL AS DOUBLE) AS extra FROM board WHERE stage < 8 UNION ALL SELECT row_id, candidate_id, method, score, train_calmar FROM board WHERE stage >= 8)",
    "SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, row_id) = 1"))
def leaderboard_merge(spark, d):
    b = BD.board(spark, d)
    a = b.where("stage < 8").select(BC)
    z = b.where("stage >= 8").select(*BC, F.col("train_calmar").alias("extra"))
    return LB.merge([a, z], ties=("row_id",))


@query("topk_plus_verified", oracle(B3, BD.BOARD, "SELECT row_id, candidate_id, method, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rn FROM board) WHERE rn <= 100 OR (accepted AND NOT locked_opened)"))
def topk_plus_verified(spark, d):
    b = BD.board(spark, d)
    return LB.topk_plus(b, 100, F.col("accepted") & ~F.col("locked_opened"), [F.col("score").desc(), F.col("row_id")]).select(BC)


SIGN = "'f' || candidate_id % 50 || ';g' || row_id % 7"


@query("beam_select", oracle("i:candidate_id i:row_id f:score s:kind", BD.BOARD,
    "a AS (SELECT * FROM board QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, row_id DESC) = 1)",
    f"b AS (SELECT * FROM board QUALIFY row_number() OVER (PARTITION BY {SIGN} ORDER BY score DESC, row_id DESC) = 1)",
    "(SELECT candidate_id, row_id, score, 'id' AS kind FROM a ORDER BY score DESC, row_id LIMIT 32) UNION ALL (SELECT candidate_id, row_id, score, 'signature' FROM b ORDER BY score DESC, row_id LIMIT 32)"))
def beam_select(spark, d):
    b = BD.board(spark, d).select("row_id", "candidate_id", "score")
    one = LB.best_per(b, ["candidate_id"], [F.col("score"), F.col("row_id")])
    top = LB.sort_rows(one, "score", "row_id").limit(32).withColumn("kind", F.lit("id"))
    specs = F.array(F.concat(F.lit("f"), (F.col("candidate_id") % 50).cast("string"), F.lit("|threshold|1|1")), F.concat(F.lit("g"), (F.col("row_id") % 7).cast("string"), F.lit("|threshold|1|1")))
    sig = LB.best_per(b.withColumn("sig", SP.signature(specs)), ["sig"], [F.col("score"), F.col("row_id")]).drop("sig")
    return top.unionByName(LB.sort_rows(sig, "score", "row_id").limit(32).withColumn("kind", F.lit("signature")))


@query("unseen_candidates", oracle("s:key i:copies", BD.BOARD,
    "c AS (SELECT method || '/' || printf('%.4f', round(train_calmar, 4)) || '/' || printf('%.4f', round(validation_calmar, 4)) AS key, stage FROM board)",
    "SELECT key, COUNT(*) AS copies FROM c WHERE stage >= 8 AND key NOT IN (SELECT key FROM c WHERE stage < 8) GROUP BY 1"))
def unseen_candidates(spark, d):
    """Candidates of later stages whose rounded key no earlier stage evaluated, with their copy count."""
    b = BD.board(spark, d).select(F.array("method").alias("specs"), F.array(F.lit("SPY")).alias("assets"), F.lit("mom").alias("selector"),
        F.col("train_calmar").alias("intercept"), F.col("validation_calmar").alias("scale"), F.lit(0.0).alias("smoothing"), "stage", "method")
    fresh = SE.unseen(b.where("stage >= 8"), b.where("stage < 8"))
    copies = b.where("stage >= 8").groupBy("method", F.round("intercept", 4).alias("i"), F.round("scale", 4).alias("c")).agg(F.count(F.lit(1)).alias("copies"))
    j = fresh.select("method", F.round("intercept", 4).alias("i"), F.round("scale", 4).alias("c")).join(copies, ["method", "i", "c"])
    return j.select(F.concat_ws("/", "method", F.format_string("%.4f", "i"), F.format_string("%.4f", "c")).alias("key"), "copies")


@query("state_merge", oracle("s:method i:candidate_id f:train_sharpe i:row_id", BD.BOARD,
    "o AS (SELECT * FROM board QUALIFY row_number() OVER (PARTITION BY method, candidate_id ORDER BY train_sharpe DESC, row_id) = 1)",
    "SELECT method, candidate_id, train_sharpe, row_id FROM o QUALIFY row_number() OVER (PARTITION BY method ORDER BY train_sharpe DESC, candidate_id) <= 200"))
def state_merge(spark, d):
    b = BD.board(spark, d).select("method", "candidate_id", "train_sharpe", "row_id")
    return LB.state_merge(b, "train_sharpe", 200, ("row_id",))


@query("file_accounting", oracle("s:method i:expected i:found b:incomplete", BD.BOARD,
    "e AS (SELECT DISTINCT method, 16 AS expected FROM board UNION ALL SELECT 'bohb', 4)", "f AS (SELECT method, COUNT(DISTINCT stage) AS found FROM board WHERE method <> '5-LOW' OR stage < 9 GROUP BY 1)",
    "SELECT e.method, expected, coalesce(found, 0) AS found, coalesce(found, 0) < expected AS incomplete FROM e LEFT JOIN f ON e.method = f.method"))
def file_accounting(spark, d):
    b = BD.board(spark, d).withColumn("source_file", F.concat(F.lit("stage_"), F.col("stage").cast("string")))
    exp = b.select("method").distinct().withColumn("expected", F.lit(16)).unionByName(spark.sql("SELECT 'bohb' AS method, 4 AS expected"))
    return LB.file_accounting(b.where("method <> '5-LOW' OR stage < 9"), exp)


@query("chunk_split", oracle("i:row_id i:chunk", BD.BOARD, "n AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) - 1 AS i, COUNT(*) OVER () AS n FROM board)", "SELECT row_id, i // CAST(ceil(n / 7e0) AS BIGINT) AS chunk FROM n"))
def chunk_split(spark, d):
    return LB.chunks(BD.board(spark, d).select("row_id", "score"), [F.col("score").desc(), F.col("row_id")], 7).select("row_id", "chunk")


@query("set_operations", oracle("i:candidate_id i:shared i:only_left i:joint f:jaccard", BD.BOARD, """
g AS (SELECT candidate_id, list(DISTINCT method) FILTER (stage < 8) AS a, list(DISTINCT method) FILTER (stage >= 8) AS b FROM board GROUP BY 1)""",
    "h AS (SELECT candidate_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM g)",
    "SELECT candidate_id, len(list_intersect(a, b)) AS shared, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_left, len(list_distinct(list_concat(a, b))) AS joint, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS jaccard FROM h"))
def set_operations(spark, d):
    b = BD.board(spark, d)
    left = F.when(F.col("stage") < 8, F.col("method"))
    right = F.when(F.col("stage") >= 8, F.col("method"))
    g = b.groupBy("candidate_id").agg(F.collect_set(left).alias("a"), F.collect_set(right).alias("b"))
    shared, joint = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return g.select("candidate_id", shared.alias("shared"), F.size(F.array_except("a", "b")).alias("only_left"), joint.alias("joint"), (shared / joint).alias("jaccard"))


