"""Candidate generation and search rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.gates_q import WS
from barlab.functions import text as TX
from barlab.operators import gates as GT
from barlab.operators import leaderboard as LB
from barlab.operators import quality as Q
from barlab.operators import search as SE
from barlab.operators import specs as SP
from barlab.plans import boards as BD
from barlab.plans import daily as DL
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import rounds as RD
from barlab.plans import sweeps as SW
from barlab.registry import oracle
from barlab.registry import sharing_query as query



def symbols():
    return F.array(F.lit("A"), F.lit("N"), F.lit("R"))


def catalog(spark, d):
    long = SW.period_long(D.weekly(spark, d)).where("period = 'train'")
    return SP.numbered(SP.weekly_catalog(long).select("spec"), [F.col("spec")])


def study(spark, d):
    return RD.Study(D.weekly(spark, d), D.weekly_assets(spark, d))


def spec_board(spark, d):
    """Evaluated rows over orders with three specs each; one row per candidate. Only what the searches read goes
    through the choice of the best row, and a row's specs are made after it, since its id decides them."""

    def build():
        b = BD.board(spark, d).select("candidate_id", "row_id", "method", "stage", F.round(F.col("train_calmar") * 1000, 6).alias("points"))
        return LB.best_per(b, ["candidate_id"], [F.col("points"), F.col("row_id")])

    k = F.col("row_id")
    f = F.array(*[F.lit(x) for x in D.SPEC_FEATURES])
    spec = lambda i: F.concat(F.get(f, ((k * i) % 8).cast("int")), F.lit("|threshold|"), (k * i % 5).cast("string"), F.lit("|1|1"))
    return I.shared(f"spec_board:{d}", build).withColumn("specs", F.array(spec(1), spec(3), spec(5)))


FL = "[" + ", ".join(f"'{x}'" for x in D.SPEC_FEATURES) + "]"
SB = ["sb0 AS (SELECT *, round(train_calmar * 1000, 6) AS points FROM board)",
    "sb1 AS (SELECT * FROM sb0 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY points DESC, row_id DESC) = 1)",
    f"sb AS (SELECT candidate_id, points, row_id, method, list_transform([1, 3, 5], lambda i: {FL}[row_id * i % 8 + 1] || '|threshold|' || row_id * i % 5 || '|1|1') AS specs FROM sb1)",
    "scat AS (SELECT DISTINCT unnest(specs) AS spec FROM sb)"]


def spec_catalog(b):
    return b.select(F.explode("specs").alias("spec")).distinct()


@query("seed_candidates")
def seed_candidates(spark, d):
    return SE.with_id(SE.seed_candidates(catalog(spark, d), symbols(), 200, 7)).select("candidate_id", F.array_join("specs", ";").alias("specs"), "selector", "intercept", "scale", "smoothing")


def beam(spark, d):
    return SE.with_id(SE.random_candidates(catalog(spark, d), symbols(), 32, 11))


@query("mutate")
def mutate(spark, d):
    return SE.with_id(SE.mutate(beam(spark, d), catalog(spark, d), 6, 13, universes=[["A", "N", "R"], ["A", "N"], ["A", "R"], ["N", "R"], ["A"], ["N"], ["R"]])).select("candidate_id", F.array_join("specs", ";").alias("specs"), "selector", "intercept", "scale", "smoothing")


@query("crossover")
def crossover(spark, d):
    parents = SP.numbered(beam(spark, d), [F.col("candidate_id")])
    kids = SE.crossover(SE.cycled(parents, 128), parents, 17)
    return SE.with_id(kids).select("candidate_id", F.array_join("specs", ";").alias("specs"), "selector", "intercept", "scale", "smoothing")


@query("spec_reward_weights", oracle("s:spec f:weight", BD.BOARD, SB,
    "top AS (SELECT * FROM sb ORDER BY points DESC, candidate_id LIMIT 200)", "g AS (SELECT spec, SUM(1 + greatest(points, 0) / 1000) AS g FROM (SELECT unnest(specs) AS spec, points FROM top) GROUP BY 1)",
    "w AS (SELECT c.spec, 1 + coalesce(g, 0) AS w FROM scat AS c LEFT JOIN g ON g.spec = c.spec)", "SELECT spec, w / (SELECT SUM(w) FROM w) AS weight FROM w"))
def spec_reward_weights(spark, d):
    b = spec_board(spark, d)
    return SE.spec_rewards(b, spec_catalog(b), "points")


@query("group_rewards", oracle("s:group_name f:reward i:pulls f:ucb", BD.BOARD, SB,
    "top AS (SELECT * FROM sb ORDER BY points DESC, candidate_id LIMIT 300)", "x AS (SELECT unnest(specs) AS spec, points FROM top)",
    "g AS (SELECT split_part(spec, '_', 1) AS grp, SUM(1 + greatest(points, 0) / 1500) AS g, COUNT(*) AS pulls FROM x WHERE spec IN (SELECT spec FROM scat) GROUP BY 1)",
    "h AS (SELECT k.grp, 1 + coalesce(g, 0) AS reward, coalesce(pulls, 0) AS pulls FROM (SELECT DISTINCT split_part(spec, '_', 1) AS grp FROM scat) AS k LEFT JOIN g ON g.grp = k.grp)",
    "SELECT grp AS group_name, reward, pulls, CASE WHEN pulls = 0 THEN 1e6 ELSE reward / greatest(pulls, 1) + sqrt(2 * ln((SELECT SUM(pulls) FROM h) + 1e0) / greatest(pulls, 1)) END AS ucb FROM h"))
def group_rewards(spark, d):
    b = spec_board(spark, d)
    return SE.group_rewards(b, spec_catalog(b), "points").withColumnRenamed("group", "group_name")


@query("weighted_sampling")
def weighted_sampling(spark, d):
    """Five specs per stage drawn without replacement, weights from training scores."""
    b = spec_board(spark, d).select("stage", F.explode("specs").alias("spec"), "points")
    items = b.groupBy("stage", "spec").agg(F.max("points").alias("p"))
    return SE.weighted_sample(items, 1.0 + F.greatest("p", F.lit(0.0)) / 1000.0, 5, 23, "stage").select("stage", "spec")




@query("adaptive_family_weights", oracle("s:family i:attempts f:reward f:weight", BD.BOARD, WS,
    "r AS (SELECT method AS family, CASE WHEN row_id % 2 = 0 THEN CASE WHEN reason_calmar = '' THEN 20 ELSE 4 END WHEN reason_calmar = '' THEN 0 WHEN train_calmar > 0 THEN least(0.9, train_calmar) ELSE 0 END AS w FROM wk)",
    "g AS (SELECT family, COUNT(*) AS attempts, SUM(w) AS reward FROM r GROUP BY 1)",
    "SELECT family, attempts, reward, (0.1 + greatest(0, reward / attempts)) * CASE WHEN family = '5-LOW' THEN 0.5 ELSE 1 END AS weight FROM g"))
def adaptive_family_weights(spark, d):
    w = GT.weekly_scores(BD.board(spark, d))
    reason = F.when(F.col("reason_calmar") == "", "").otherwise("train_calmar")
    r = w.select(F.col("method").alias("family"), SE.family_reward(reason, F.col("row_id") % 2 == 0, F.col("train_calmar")).alias("w"))
    g = r.groupBy("family").agg(F.count(F.lit(1)).alias("attempts"), F.sum("w").alias("reward"))
    return SE.adaptive_family_weights(g.withColumn("penalty", F.when(F.col("family") == "5-LOW", 0.5).otherwise(1.0)))


@query("anti_overfit_penalty", oracle("i:candidate_id f:penalty", BD.BOARD, SB,
    "c AS (SELECT candidate_id, method AS model, 'fam' || row_id % 4 AS family, list_distinct(list_transform(specs, lambda s: split_part(s, '|', 1))) AS fs FROM sb)",
    "p AS (SELECT DISTINCT method AS model, 'fam' || row_id % 3 AS family, row_id % 5 = 0 AS fl, list_sort(list_distinct(list_transform(specs, lambda s: split_part(s, '|', 1)))) AS ps FROM sb)",
    "m AS (SELECT c.candidate_id, len(list_intersect(fs, ps)) / CAST(len(list_distinct(list_concat(fs, ps))) AS DOUBLE) AS j, c.model = p.model AS sm, c.family = p.family AS sf, fl FROM c, p)",
    "w AS (SELECT candidate_id, MAX(j + CASE WHEN sm THEN 0.25 ELSE 0 END + CASE WHEN sf THEN 0.25 ELSE 0 END + CASE WHEN fl THEN 0.5 ELSE 0 END) AS penalty FROM m WHERE j >= 0.5 GROUP BY 1)",
    "SELECT c.candidate_id, coalesce(penalty, 0) AS penalty FROM c LEFT JOIN w ON w.candidate_id = c.candidate_id"))
def anti_overfit_penalty(spark, d):
    b = spec_board(spark, d)
    feats = F.transform("specs", lambda s: F.substring_index(s, "|", 1))
    fam = lambda m: F.concat(F.lit("fam"), (F.col("row_id") % m).cast("string"))
    c = b.select("candidate_id", F.col("method").alias("model"), fam(4).alias("family"), feats.alias("features"))
    # the ledger has every pattern once, however many rows share it
    led = b.select(F.col("method").alias("model"), fam(3).alias("family"), (F.col("row_id") % 5 == 0).alias("failed_locked"), F.array_sort(F.array_distinct(feats)).alias("features"), "row_id")
    led = led.groupBy("model", "family", "failed_locked", "features").agg(F.min("row_id").alias("pattern_id"))
    return SE.overfit_penalty(c, led)


@query("expected_improvement", oracle("i:candidate_id f:expected_improvement", BD.BOARD, SB,
    "w AS (SELECT spec, 1 + length(spec) / 100e0 AS weight FROM scat)", "x AS (SELECT candidate_id, unnest(specs) AS spec FROM sb)",
    "tried AS (SELECT DISTINCT unnest(specs) AS spec FROM sb WHERE points > 0)",
    "a AS (SELECT x.candidate_id, AVG(coalesce(w.weight, 1)) AS u, AVG(CASE WHEN t.spec IS NULL THEN 1e0 ELSE 0e0 END) AS n FROM x LEFT JOIN w ON w.spec = x.spec LEFT JOIN tried AS t ON t.spec = x.spec GROUP BY 1)",
    f"fm AS (SELECT DISTINCT candidate_id, {TX.classify_sql(TX.DAILY_FAMILIES, 'f', chr(39) + 'other' + chr(39))} AS fam FROM (SELECT DISTINCT candidate_id, split_part(spec, '|', 1) AS f FROM x))",
    "b AS (SELECT candidate_id, AVG(CASE WHEN fam = 'rolling' THEN 1.4e0 WHEN fam = 'volatility' THEN 0.8e0 ELSE 1 + length(fam) / 100e0 END) AS f FROM fm GROUP BY 1)",
    "SELECT candidate_id, u + 0.6 * f + 0.4 * n AS expected_improvement FROM a JOIN b USING (candidate_id)"))
def expected_improvement(spark, d):
    b = spec_board(spark, d)
    w = spec_catalog(b).select("spec", (1.0 + F.length("spec") / 100.0).alias("weight"))
    fams = spec_catalog(b).select(TX.daily_family(F.substring_index("spec", "|", 1)).alias("family")).distinct()
    fams = fams.select("family", F.when(F.col("family") == "rolling", 1.4).when(F.col("family") == "volatility", 0.8).otherwise(1.0 + F.length("family") / 100.0).alias("reward"))
    tried = b.where("points > 0").select(F.explode("specs").alias("spec"))
    return SE.expected_improvement(b, w, fams, tried)


def board_rows(board):
    """Every evaluated row."""
    return board.select("candidate_id", "method", "wave", F.array_join("specs", ";").alias("specs"), "selector", "score", "train_sharpe", "validation_sharpe")


@query("beam_round")
def beam_round(spark, d):
    """Random start, then beam mutations of the best, each round one job."""
    return board_rows(RD.search(study(spark, d), "beam", 2, 48, 101))


@query("search_rounds")
def search_rounds(spark, d):
    """A random start, then learned-weight, bandit and expected-improvement proposals evaluated in one job."""
    s = study(spark, d)
    start = RD.search(s, "random_broad", 1, 32, 31)
    fresh = None
    for i, m in enumerate(("weights", "ucb", "expected_improvement")):
        p = RD.propose(s, start, m, 24, 131 + i)
        fresh = p if fresh is None else fresh.unionByName(p)
    nxt = s.evaluate(SE.with_id(SE.unseen(fresh, start)).dropDuplicates(["candidate_id"]), "learned", 2)
    return board_rows(start.unionByName(nxt))


@query("lite_proposals")
def lite_proposals(spark, d):
    """Proposals of each method from the same leaderboard."""
    s = study(spark, d)
    b = RD.search(s, "random_broad", 1, 40, 5)
    out = None
    for i, m in enumerate(("random_broad", "beam", "genetic", "midpoint", "weights", "half_weights", "bandit", "ucb")):
        p = SE.with_id(RD.propose(s, b, m, 24, 900 + i)).select(F.lit(m).alias("method"), "candidate_id", F.size("specs").alias("n_specs"), "selector", "intercept", "scale", "smoothing")
        out = p if out is None else out.unionByName(p)
    return out


@query("wave_resume")
def wave_resume(spark, d):
    """Second wave: the state's best candidates are evaluated again first, then new ones."""
    s = study(spark, d)
    first = RD.search(s, "random_broad", 1, 40, 5)
    state = LB.state_merge(first.withColumn("seq", F.lit(1)), "train_sharpe", 10)
    return board_rows(RD.search(s, "beam", 1, 24, 77, prior=state, wave=2))


@query("candidate_stream")
def candidate_stream(spark, d):
    long = Q.melt(D.featured(spark, d).where("ts <= DATE'1998-12-31'"), ["ts"], D.FEATURES)
    cat = SP.daily_catalog(long).select("spec", TX.daily_family(F.col("feature")).alias("family"))
    return SE.daily_candidates(cat, 300, 41)


def daily_study(spark, d):
    return DL.Study(D.featured(spark, d), D.FEATURES)


@query("two_wave_adaptive")
def two_wave_adaptive(spark, d):
    """Walk-forward backtests of a first wave, then of a second with spec weights learned from its scores."""
    return DL.adaptive(daily_study(spark, d), 120, 43).select(*DL.BOARD)


@query("daily_bayesian")
def daily_bayesian(spark, d):
    """Expected improvement over pools of daily candidates, in rounds of backtests."""
    return DL.bayesian(daily_study(spark, d), 100, 120_000).select(*DL.BOARD)


@query("daily_bandit")
def daily_bandit(spark, d):
    """Batches of single-family candidates, allocated by upper confidence bounds."""
    return DL.bandit(daily_study(spark, d), 120, 130_000).select(*DL.BOARD, "allocated_family")


@query("daily_genetic")
def daily_genetic(spark, d):
    """Generations of daily candidates bred from the best backtests."""
    return DL.genetic(daily_study(spark, d), 96, 140_000).select(*DL.BOARD)


@query("ml_candidate_grid")
def ml_candidate_grid(spark, d):
    """One candidate per customer key, over the features usable in training."""
    long = SW.period_long(D.weekly(spark, d)).where("period = 'train'")
    names = sorted(r["feature"] for r in Q.usable_features(long, 52, 2, 0.20).where("usable").select("feature").collect())
    ids = I.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return SE.ml_candidates(names, ids, 53).withColumn("features", F.array_join("features", ","))


