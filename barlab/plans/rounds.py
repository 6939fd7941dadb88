"""Search rounds: propose, evaluate all proposals in one job, keep the best, repeat.

A round is one Spark job over every new candidate; the loop on the driver only counts rounds. Each
round's leaderboard is checkpointed, so lineage stays flat and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions import text as TX
from barlab.operators import gates as GT
from barlab.operators import search as SE
from barlab.operators import specs as SP
from barlab.plans import inputs as I
from barlab.plans import sweeps as SW
from barlab.session import checkpoint

SELECTOR_COLUMNS = {"momentum_4w": "mom_4", "momentum_13w": "mom_13", "momentum_26w": "mom_26", "momentum_52w": "mom_52", "low_vol_13w": "vol"}
CANDIDATE = ("candidate_id", "specs", "assets", "selector", "intercept", "scale", "smoothing")


class Study:
    """Inputs shared by all rounds: unlocked weekly examples, asset table and spec catalog."""

    def __init__(self, examples: DataFrame, assets: DataFrame):
        self.examples = checkpoint(examples.where("period <> 'locked'"))
        self.assets = checkpoint(assets)
        self.long = SW.period_long(self.examples)
        train = self.long.where("period = 'train'")
        self.catalog = checkpoint(SP.numbered(SP.weekly_catalog(train).select("spec"), [F.col("spec")]))
        symbols = sorted(r["symbol"] for r in self.assets.select("symbol").distinct().collect())  # bounded by the tradable assets
        self.universes = [u for u in (symbols, *([a, b] for i, a in enumerate(symbols) for b in symbols[i + 1 :]), *([a] for a in symbols)) if u]
        self.universe = F.array(*[F.lit(s) for s in symbols])

    def picks(self, cands: DataFrame) -> DataFrame:
        """Best asset per selector, universe and period, computed once per distinct pair."""
        kinds = cands.select("selector", F.array_sort("assets").alias("u")).distinct()
        sides = kinds.select("selector", F.array_join("u", ",").alias("universe"), F.explode("u").alias("symbol"))
        score = None
        for name, col in SELECTOR_COLUMNS.items():
            v = -F.col(col) if col == "vol" else F.col(col)
            score = F.when(F.col("selector") == name, v) if score is None else score.when(F.col("selector") == name, v)
        x = sides.join(self.assets, "symbol").withColumn("score", score)
        best = F.min_by(F.struct("symbol", "next_return"), F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "symbol")))
        g = x.groupBy("selector", "universe", F.col("period_end").alias("decision_date")).agg(best.alias("b"))
        base = self.assets.where(F.col("symbol") == I.BENCHMARK).select(F.col("period_end").alias("decision_date"), F.col("next_return").alias("base_next"))
        return g.join(base, "decision_date", "left").select(
            "selector", "universe", "decision_date", F.coalesce("b.symbol", F.lit(I.BENCHMARK)).alias("traded_asset"),
            F.coalesce(F.when(F.col("b").isNotNull(), F.col("b.next_return")).otherwise(F.col("base_next")), F.lit(0.0)).alias("asset_return"),
        )

    def positions(self, cands: DataFrame) -> DataFrame:
        e = SW.exposure_rows(self.long, cands.select("candidate_id", "specs", "selector", "intercept", "scale", "smoothing"))
        uni = cands.select("candidate_id", F.array_join(F.array_sort("assets"), ",").alias("universe"))
        base = self.examples.select("decision_date", F.col("target_end").alias("ts"), "target_year", "period", "sp500_down_year", F.coalesce("next_return", F.lit(0.0)).alias("spy_return"))
        p = e.join(uni, "candidate_id").join(self.picks(cands), ["selector", "universe", "decision_date"]).join(F.broadcast(base), "decision_date")
        return p.withColumn("strategy_return", F.col("exposure") * F.col("asset_return"))

    def evaluate(self, cands: DataFrame, method: str, wave: int = 1) -> DataFrame:
        """Scored leaderboard rows with the candidate's own fields."""
        # several branches read the proposals; write the (compact) candidate table once
        cands = checkpoint(cands)
        rows = SW.evaluate_positions(self.positions(cands), 52.0)
        scored = GT.weekly_scores(rows.join(cands.withColumn("feature_count", F.size("specs")), "candidate_id").withColumn("locked_opened", F.lit(False)))
        keep = ["train_sharpe", "validation_sharpe", "train_cagr", "train_mdd", "train_min_year_return", "reason_sharpe", "verified_sharpe_robust"]
        return scored.select(*CANDIDATE, F.col("score_sharpe").alias("score"), *keep, F.lit(method).alias("method"), F.lit(wave).alias("wave"))


def propose(study: Study, board: DataFrame | None, method: str, n: int, seed: int, beam: int = 8) -> DataFrame:
    """Next candidates of a method: random, beam, genetic, midpoint, learned weights or group bandit."""
    cat, uni = study.catalog, study.universe
    if method == "sobol":
        # low-discrepancy variant: the stream depends on stage and index only, not on the run's seed
        return SE.random_candidates(cat, uni, n, 10_000_019 + (seed // 1000) * 9_176)
    if board is None or method == "random_broad":
        return SE.random_candidates(cat, uni, n, seed)
    top = board.orderBy(F.col("score").desc(), "candidate_id").limit(beam).select(*CANDIDATE)
    parents = SP.numbered(top, [F.col("candidate_id")])
    if method == "beam":
        return SE.mutate(SE.cycled(parents, n), cat, 1, seed, universes=study.universes)
    if method == "genetic":
        return SE.mutate(SE.with_id(SE.crossover(SE.cycled(parents, n), parents, seed)), cat, 1, seed + 1, universes=study.universes)
    if method == "midpoint":
        return SE.mutate(SE.with_id(SE.midpoint(SE.cycled(parents, n), parents, seed)), cat, 1, seed + 1, universes=study.universes)
    if method in ("weights", "half_weights"):
        w = cat.join(SE.spec_rewards(board, cat), "spec")
        if method == "weights":
            return SE.random_candidates(w, uni, n, seed, weight="weight")
        return SE.random_candidates(w, uni, n // 2, seed, weight="weight").unionByName(SE.random_candidates(cat, uni, n - n // 2, seed + 7))
    if method in ("bandit", "expected_improvement", "ucb"):
        g = SE.group_rewards(board, cat)
        col = "ucb" if method == "ucb" else "reward"
        group = F.substring_index(F.substring_index("spec", "|", 1), "_", 1)
        w = cat.join(g.select(F.col("group").alias("_g"), F.greatest(F.col(col), F.lit(0.01)).alias("weight")), group == F.col("_g")).drop("_g")
        pool = SE.random_candidates(w, uni, n if method != "expected_improvement" else 3 * n, seed, weight="weight")
        if method != "expected_improvement":
            return pool
        ident = SE.with_id(pool)
        fams = SE.group_rewards(board, cat, group=TX.daily_family(F.substring_index("spec", "|", 1))).select(F.col("group").alias("family"), "reward")
        tried = board.select(F.explode("specs").alias("spec")).distinct()
        ei = SE.expected_improvement(ident, SE.spec_rewards(board, cat), fams, tried)
        return ident.join(ei, "candidate_id").orderBy(F.col("expected_improvement").desc(), "candidate_id").limit(n).drop("candidate_id", "expected_improvement")
    raise ValueError(f"unknown search method: {method}")


def search(study: Study, method: str, rounds: int, n: int, seed: int, prior: DataFrame | None = None, wave: int = 1) -> DataFrame:
    """Run the rounds of one method; earlier candidates are re-evaluated first and never repeated."""
    board = None
    if prior is not None:
        board = checkpoint(study.evaluate(prior.select(*CANDIDATE), method, wave))
    for i in range(rounds):
        fresh = propose(study, board, method, n, seed + 1000 * i)
        if board is not None:
            fresh = SE.unseen(fresh, board)
        rows = study.evaluate(SE.with_id(fresh).dropDuplicates(["candidate_id"]), method, wave)
        board = checkpoint(rows if board is None else board.unionByName(rows))
    return board
