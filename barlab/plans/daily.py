"""Daily long/short search: walk-forward backtests of vote and score candidates, and rounds that learn from their scores.

A round is a few Spark jobs over all of its candidates; the loop on the driver counts rounds and, for the bandit, keeps one
number of pulls and rewards for each of the at most ten families. Every board is checkpointed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.functions import text as TX
from barlab.operators import backtest as B
from barlab.operators import examples as E
from barlab.operators import gates as GT
from barlab.operators import quality as Q
from barlab.operators import recursive as RC
from barlab.operators import search as SE
from barlab.operators import specs as SP
from barlab.plans import inputs as I
from barlab.plans import rulebook as RB
from barlab.plans import strategies as S
from barlab.session import checkpoint

#: Blocks of a period, specs of a candidate, window of a score's spec without one.
BLOCKS, MOST_SPECS, SCORE_WINDOW = 6, 5, 120
#: Limits of the rescue gate (fixed values).
SOFT = {"train_calmar": (0.8, 8.0), "validation_calmar": 0.8, "ratio": 3.5, "cagr": 0.04, "mdd": 0.35, "trades": (6.0, 120.0), "long": (0.30, 0.85), "negative_years": 0, "features": 5}
#: What a block reads when a candidate is rejected before its blocks are run (fixed value).
NOT_RUN = -999.0
PARAMETERS = ("rule", "combo_size", "confirm_days", "min_hold_days", "feature_specs", "score_threshold", "long_specs", "short_specs", "long_min_votes", "short_min_votes")
_SLOTS = tuple(f"k{i}" for i in range(1, MOST_SPECS + 1))
_BY = ("candidate_id", "period")


def spec_list(*names: str) -> Column:
    """Specs of the text columns, in order."""
    return F.filter(F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), ";") for c in names])), lambda s: s != "")


class Study:
    """Train and validation rows of one symbol, their blocks, and the spec catalog from its training rows."""

    def __init__(self, featured: DataFrame, features, symbol: str = I.BENCHMARK, cost: float = 0.0002):
        own = S.split_periods(featured.where(F.col("symbol") == symbol))
        self.rows = checkpoint(own.select("symbol", "period", "ts", "close", *features))
        cut = E.blocks(self.rows, BLOCKS, ("symbol", "period"))
        self.blocks = checkpoint(cut.withColumn("period", F.concat("period", F.lit("/"), F.col("block").cast("string"))).drop("block"))
        long = Q.melt(self.rows.where("period = 'train'"), ["ts"], features)
        self.catalog = checkpoint(SP.daily_catalog(long).select("spec", TX.daily_family(F.col("feature")).alias("family")))
        self.symbol, self.cost = symbol, cost

    def slots(self, cands: DataFrame) -> DataFrame:
        """Candidates with one indicator key, level, direction and side for each of their specs."""
        tagged = lambda c, side: F.transform(spec_list(c), lambda s: F.struct(s.alias("spec"), F.lit(side).alias("side")))
        sides = F.concat(tagged("long_specs", "L"), tagged("short_specs", "S"), tagged("feature_specs", "F"))
        x = cands.withColumn("_specs", sides).withColumn("symbol", F.lit(self.symbol)).withColumn("feature_count", F.size("_specs"))
        out = {}
        for i in range(MOST_SPECS):
            item = F.get("_specs", F.lit(i))
            part = F.split(item["spec"], r"\|")
            window = F.get(part, F.lit(3)).try_cast("double").cast("int")
            z = F.concat_ws(":", F.lit("featz"), part[0], F.when(window > 0, window).otherwise(SCORE_WINDOW).cast("string"))
            out |= {f"k{i + 1}": F.when(item.isNotNull(), F.when((part[1] == "zscore") | (item["side"] == "F"), z).otherwise(F.concat_ws(":", F.lit("feat"), part[0]))),
                    f"v{i + 1}": F.get(part, F.lit(2)).try_cast("double"), f"d{i + 1}": F.get(part, F.lit(4)).try_cast("double"), f"s{i + 1}": item["side"]}
        return x.withColumns(out).drop("_specs")

    def positions(self, rows: DataFrame, cands: DataFrame) -> DataFrame:
        """(candidate_id, period, ts, close, position): the remembered side of every candidate on every row."""
        fields = ["rule", "confirm_days", "min_hold_days", "score_threshold", "long_min_votes", "short_min_votes", "feature_count"]
        spread = [f"{n}{i + 1}" for n in "vds" for i in range(MOST_SPECS)]
        x = RB.series_rows(rows, self.slots(cands).select("candidate_id", "symbol", *fields, *_SLOTS, *spread), _SLOTS)
        each = [(F.col(f"k{i}"), F.col(f"v{i}"), F.col(f"d{i}"), F.col(f"s{i}")) for i in range(1, MOST_SPECS + 1)]
        hit = lambda side: reduce(lambda a, b: a + b, [F.when((s == side) & F.when(d >= 0, k > v).otherwise(k < v), 1).otherwise(0) for k, v, d, s in each])
        total = reduce(lambda a, b: a + b, [F.when(s == "F", d * k).otherwise(F.when(s.isNull() | (s != "F"), 0.0)) for k, _, d, s in each])
        score = total / F.sqrt(F.col("feature_count").cast("double"))
        low = (hit("S") >= F.col("short_min_votes")) & ~(hit("L") >= F.col("long_min_votes"))
        down = F.when(F.col("rule") == "spy_long_short_score", score < -F.abs("score_threshold")).otherwise(low)
        x = x.select("candidate_id", "period", "ts", "close", "confirm_days", "min_hold_days", F.when(down, -1).otherwise(1).alias("want"))
        return RC.position_memory(x, "want", _BY, "confirm_days", "min_hold_days")

    def metrics(self, rows: DataFrame, cands: DataFrame) -> DataFrame:
        """Metrics of every (candidate_id, period) of ``rows``."""
        run = B.returns_backtest(self.positions(rows, cands).withColumnRenamed("position", "side"), "side", self.cost, 1, _BY)
        entry = (R.lag("position", 1, _BY).isNull() | (R.lag("position", 1, _BY) != F.col("position"))) & (F.col("position") != 0)
        x = run.withColumns({"_dd": R.drawdown("equity", by=_BY), "_in": entry.cast("int"), "_year": F.year("ts")})
        g = x.groupingSets([[*_BY, "_year"], [*_BY]], *_BY, "_year").agg(
            F.grouping_id().alias("gid"), F.count("*").alias("n"), F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"),
            F.min("_dd").alias("mdd"), F.sum("_in").alias("trades"), F.avg((F.col("position") > 0).cast("double")).alias("long_fraction"))
        whole, years = F.col("gid") == 1, F.greatest(F.col("n") / 252.0, F.lit(1 / 252.0))
        g = g.withColumn("cagr", F.when(F.col("last") > 0, F.pow(F.col("last") / B.CASH, 1.0 / years) - 1.0).otherwise(-1.0))
        g = g.withColumns({"calmar": B.calmar(F.col("cagr"), F.col("mdd"), 0.0), "trades_per_year": F.col("trades") / years})
        one = [F.max(F.when(whole, F.col(c))).alias(c) for c in ("calmar", "cagr", "mdd", "trades_per_year", "long_fraction")]
        return g.groupBy(*_BY).agg(*one, F.count_if(~whole & (F.col("last") < F.col("first"))).alias("negative_years"))

    def evaluate(self, cands: DataFrame) -> DataFrame:
        """Scored rows: gates over train and validation, then the blocks of those that no early limit rejects."""
        cands = checkpoint(cands.withColumn("candidate_id", F.sha1(F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PARAMETERS]))).dropDuplicates(["candidate_id"]))
        m = self.metrics(self.rows, cands)
        at = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
        wide = m.groupBy("candidate_id").agg(
            *[at(p, c).alias(f"{p}_{c}") for p in ("train", "validation") for c in ("calmar", "cagr", "mdd")],
            at("train", "trades_per_year").alias("trades_per_year"), at("train", "long_fraction").alias("long_fraction"), at("validation", "negative_years").alias("validation_negative_years"))
        wide = cands.join(wide, "candidate_id").withColumn("feature_count", F.size(spec_list("long_specs", "short_specs", "feature_specs")))
        tc, mdd, trades = F.col("train_calmar"), F.abs("train_mdd"), F.col("trades_per_year")
        early = GT.reason([("early_train_calmar", tc < 0.5), ("early_train_mdd", mdd > 0.45), ("early_too_few_trades", trades < 4.0), ("early_too_many_trades", trades > 150.0)])
        strict = checkpoint(GT.survival_gate(wide).withColumn("early", early))
        kept = strict.where("early = ''").select("candidate_id", *PARAMETERS)
        b = self.metrics(self.blocks, kept).withColumn("period", F.substring_index("period", "/", 1))
        x = strict.join(B.walkforward(b, ("candidate_id",)), "candidate_id", "left")
        run = F.col("early") == ""
        x = x.withColumns({f"{p}_block_min_calmar": F.when(run, F.col(f"{p}_block_min_calmar")).otherwise(NOT_RUN) for p in ("train", "validation")}
                          | {n: F.when(run, F.col(n)).otherwise(0) for n in ("train_blocks_positive", "validation_blocks_positive", "walkforward_passes")})
        x = x.withColumn("score", train_first_score())
        soft = GT.survival_gate(x.drop("robust_passes", "robust_total", "rejection_reason", "accepted", "survival_score"), SOFT).select("candidate_id", F.col("rejection_reason").alias("_soft"))
        few = lambda n, mark: GT.reason([(f"{mark}train_block_min_calmar", F.col("train_block_min_calmar") < n[0]), (f"{mark}validation_block_min_calmar", F.col("validation_block_min_calmar") < n[0]), (f"{mark}train_blocks_positive", F.col("train_blocks_positive") < n[1]), (f"{mark}validation_blocks_positive", F.col("validation_blocks_positive") < n[1])])
        x = x.join(soft, "candidate_id")
        x = x.withColumn("soft_rejection_reason", F.coalesce(F.nullif("early", F.lit("")), F.nullif("_soft", F.lit("")), few((0.0, 5), "soft_")))
        hard = few((0.5, BLOCKS), "")
        turned = run & F.col("accepted")
        x = x.withColumns({"soft_pass": F.col("soft_rejection_reason") == "", "rejection_reason": F.when(turned, hard).otherwise(F.col("rejection_reason")), "accepted": turned & (hard == ""),
                           "survival_score": F.col("survival_score") + F.col("score") + 4.0 * F.col("walkforward_passes")})
        return checkpoint(x.withColumn("specs", spec_list("long_specs", "short_specs", "feature_specs")).drop("early", "_soft"))


def train_first_score() -> Column:
    """Zero and missing block values count as -5."""
    block = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(-5.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return 3.0 * z("train_calmar") + z("validation_calmar") + 0.8 * block("train_block_min_calmar") + 0.4 * block("validation_block_min_calmar") + F.col("robust_passes")


def top(board: DataFrame, n: int, by: Column | None = None) -> DataFrame:
    return board.orderBy((F.col("score") if by is None else by).desc(), "candidate_id").limit(n)


def learned(board: DataFrame, n: int, reward: Column, best: bool) -> tuple[DataFrame, DataFrame]:
    """(spec, weight) and (family, reward) from the ``n`` best rows: the greatest reward of a spec, or its mean."""
    x = top(board, n).select(reward.alias("reward"), F.explode("specs").alias("spec")).withColumn("family", TX.daily_family(F.substring_index("spec", "|", 1)))
    if best:
        w = x.groupBy("spec").agg(F.greatest(F.lit(1.0), F.max("reward")).alias("weight"))
        return w, x.groupBy("family").agg(F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.max("reward"))).alias("reward"))
    w = x.groupBy("spec").agg((1.0 + F.avg("reward") / 8.0).alias("weight"))
    return w, x.groupBy("family").agg((1.0 + F.avg(F.col("reward") * 0.5) / 8.0).alias("reward"))


def adaptive(study: Study, n: int, seed: int) -> DataFrame:
    """A quarter of the budget (20 at least) unguided, the rest with spec weights from its best tenth."""
    first = min(n, max(20, n // 4))
    board = study.evaluate(SE.daily_candidates(study.catalog, first, seed)).withColumn("wave", F.lit(1))
    weights, _ = learned(board, max(10, first // 10), F.greatest(F.lit(0.25), 1.0 + F.col("score") / 25.0), True)
    second = study.evaluate(SE.daily_candidates(study.catalog, n - first, seed + 1, weights)).withColumn("wave", F.lit(2))
    return board.unionByName(second)


def bayesian(study: Study, n: int, seed: int, rounds: int = 2) -> DataFrame:
    """A fifth of the budget unguided; then pools four times as large, of which the greatest expected improvement is run."""
    warm = min(n, max(10, n // 5))
    board = study.evaluate(SE.daily_candidates(study.catalog, warm, seed)).withColumn("wave", F.lit(0))
    each = -(-(n - warm) // rounds)
    for r in range(1, rounds + 1):
        weights, families = learned(board, max(10, warm // 4), F.greatest(F.lit(0.0), F.col("score")), False)
        pool = SE.daily_candidates(study.catalog, 4 * each, seed + r, weights).withColumn("specs", spec_list("long_specs", "short_specs", "feature_specs"))
        pool = checkpoint(pool.withColumn("candidate_id", F.sha1(F.to_json(F.struct(*PARAMETERS)))))
        ei = SE.expected_improvement(pool, weights, families, board.select(F.explode("specs").alias("spec")).distinct())
        chosen = pool.join(ei, "candidate_id").orderBy(F.desc("expected_improvement"), "candidate_id").limit(each)
        board = board.unionByName(study.evaluate(chosen.select(*PARAMETERS)).withColumn("wave", F.lit(r)))
    return board


def ucb(families: list[str], pulls: dict[str, int], rewards: dict[str, float]) -> str:
    """The first family never pulled, or the one with the greatest mean reward plus exploration."""
    for f in families:
        if not pulls[f]:
            return f
    total = max(1, sum(pulls.values()))
    return max(families, key=lambda f: rewards[f] / pulls[f] + math.sqrt(2.0 * math.log(total + 1) / pulls[f]))


def bandit(study: Study, n: int, seed: int, batch: int = 30) -> DataFrame:
    """Batches of candidates from one family each, allocated by upper confidence bounds on their scores."""
    families = sorted(r[0] for r in study.catalog.select("family").distinct().collect())
    pulls, rewards = dict.fromkeys(families, 0), dict.fromkeys(families, 0.0)
    parts = []
    for r in range(-(-n // batch)):
        family = ucb(families, pulls, rewards)
        rows = study.evaluate(SE.daily_candidates(study.catalog.where(F.col("family") == family), min(batch, n - r * batch), seed + r))
        got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("score"))), F.lit(0.0)).alias("reward")).collect()[0]
        pulls[family] += max(1, got.n)
        rewards[family] += got.reward
        parts.append(rows.withColumns({"wave": F.lit(r), "allocated_family": F.lit(family)}))
    return reduce(DataFrame.unionByName, parts)


def genetic(study: Study, n: int, seed: int, rounds: int = 2, parents: int = 24) -> DataFrame:
    """Generations of children from the best rows: three specs of each parent, knobs of either, one spec replaced."""
    first = min(n, max(24, n // 5))
    board = study.evaluate(SE.daily_candidates(study.catalog, first, seed)).withColumn("wave", F.lit(0))
    catalog = checkpoint(SP.numbered(study.catalog.select("spec"), [F.col("spec")]))
    size = catalog.count()
    each = -(-(n - first) // rounds)
    for r in range(1, rounds + 1):
        variety = F.size(F.array_distinct(F.transform("specs", lambda s: F.substring_index(s, "|", 1)))) * 0.2
        pool = SP.numbered(top(board, parents, F.col("score") + variety + F.when(F.col("soft_pass"), 20.0).otherwise(0.0)).select("specs", "rule", "confirm_days", "min_hold_days", "candidate_id"), [F.col("candidate_id")])
        some = pool.count()
        u = lambda *k: SE.uniform(seed + r, F.col("id"), *k)  # noqa: B023, E731
        draws = study.catalog.sparkSession.range(2 * each).select("id", *[F.floor(u(k) * some).alias(f"i{k}") for k in (1, 2)], F.floor(u(3) * size).alias("index"))
        side = lambda k: pool.select(F.col("index").alias(f"i{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("specs", "rule", "confirm_days", "min_hold_days")])  # noqa: B023, E731
        x = draws.join(side(1), "i1").join(side(2), "i2").join(catalog.select("index", F.col("spec").alias("fresh")), "index")
        specs = F.slice(F.array_sort(F.array_union(F.slice("specs_1", 1, 3), F.slice("specs_2", 1, 3))), 1, MOST_SPECS)
        at = F.floor(u(4) * F.size("_s")).cast("int")
        x = x.withColumn("_s", specs).withColumn("_s", F.array_distinct(F.transform("_s", lambda s, i: F.when(i == at, F.col("fresh")).otherwise(s))))
        x = x.withColumn("_s", F.when(F.size("_s") < 2, F.array_union("_s", F.array("fresh"))).otherwise(F.col("_s"))).where(F.size("_s") >= 2)
        pick = lambda k, *c: SE.pick(u(k), F.array(*c))
        x = x.select("id", F.array_sort("_s").alias("_s"), pick(5, F.col("rule_1"), F.col("rule_2")).alias("rule"), pick(6, F.col("confirm_days_1"), F.col("confirm_days_2"), *map(F.lit, (2, 3, 5))).alias("confirm_days"),
                     pick(7, F.col("min_hold_days_1"), F.col("min_hold_days_2"), *map(F.lit, (5, 10, 15))).alias("min_hold_days"), SE.pick(u(8), SP.floats((0.0, 0.25, 0.5, 0.75, 1.0))).alias("t"))
        score, half = F.col("rule") == "spy_long_short_score", F.greatest(F.floor(F.size("_s") / 2), F.lit(1)).cast("int")
        mixed = F.transform(F.array_sort(F.transform("_s", lambda s: F.struct(u(9, s).alias("k"), s.alias("s")))), lambda p: p["s"])
        part = lambda a: F.when(~score, F.array_join(F.array_sort(a), ";"))  # noqa: B023, E731
        kids = x.select(
            "rule", F.size("_s").alias("combo_size"), "confirm_days", "min_hold_days", F.when(score, F.array_join("_s", ";")).alias("feature_specs"), F.when(score, F.col("t")).alias("score_threshold"),
            part(F.slice(mixed, F.lit(1), half)).alias("long_specs"), part(F.slice(mixed, half + 1, F.size("_s") - half)).alias("short_specs"),
            F.when(~score, 1).alias("long_min_votes"), F.when(~score, 1).alias("short_min_votes"))
        fresh = kids.dropDuplicates().join(board.select(*[F.col(c) for c in PARAMETERS]).distinct().withColumn("_old", F.lit(1)), [kids[c].eqNullSafe(board[c]) for c in PARAMETERS], "left_anti").limit(each)
        board = board.unionByName(study.evaluate(fresh).withColumn("wave", F.lit(r)))
    return board


BOARD = ("candidate_id", *PARAMETERS, "train_calmar", "validation_calmar", "train_cagr", "validation_cagr", "train_mdd", "validation_mdd", "trades_per_year", "long_fraction", "validation_negative_years",
         "train_block_min_calmar", "validation_block_min_calmar", "train_blocks_positive", "validation_blocks_positive", "walkforward_passes", "robust_passes", "score", "survival_score", "soft_pass", "accepted",
         "rejection_reason", "soft_rejection_reason", "wave")
