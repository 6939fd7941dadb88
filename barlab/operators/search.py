"""Candidate generation: seeds, mutation, crossover, rewards and beam rounds.

Random choices hash (seed, row, slot) to a uniform number, so a run is reproducible and independent of
partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators import specs as SP

SELECTORS = ("momentum_4w", "momentum_13w", "momentum_26w", "momentum_52w", "low_vol_13w")


def uniform(seed: int, *parts) -> Column:
    """Uniform number in (0, 1) from a hash of the seed and the parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def pick(u: Column, items: Column) -> Column:
    """Item of an array chosen by a uniform number."""
    return F.get(items, F.least(F.floor(u * F.size(items)), F.size(items) - 1).cast("int"))


def gauss(u1: Column, u2: Column, sd: float) -> Column:
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2) * sd


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def seed_combinations(seeds: DataFrame, sizes=(2, 3), modulus: int = 3, offset: int = 0) -> DataFrame:
    """Ordered combinations of a ranked seed list, thinned by the rank sum, times vote rules.

    ``seeds`` is the short ranked list a stage works from (spec, rank); combinations grow by a rank
    inequality, so no pair is emitted twice.
    """
    base = seeds.select(F.array("spec").alias("specs"), F.col("rank").alias("last"), F.col("rank").alias("total"))
    parts = []
    grown = base
    for k in range(2, max(sizes) + 1):
        nxt = seeds.select(F.col("spec").alias("s"), F.col("rank").alias("r"))
        grown = grown.join(nxt, F.col("r") > F.col("last")).select(
            F.array_append("specs", F.col("s")).alias("specs"), F.col("r").alias("last"), (F.col("total") + F.col("r")).alias("total")
        )
        if k in sizes:
            parts.append(grown.where(F.pmod("total", F.lit(modulus)) == offset).withColumn("size", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("min_votes", F.explode(F.sequence(F.lit(1), "size"))).drop("last", "total")


def decode(rows: DataFrame) -> DataFrame:
    """Leaderboard text fields back to typed candidates; empty and zero fields take the defaults."""
    keep = lambda x, sep: F.filter(F.split(F.coalesce(x, F.lit("")), sep), lambda s: s != "")
    out = {"specs": keep(F.col("specs"), ";")}
    if "assets" in rows.columns:
        a = keep(F.col("assets"), ",")
        out["assets"] = F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("SPY")))
    if "asset_selector" in rows.columns:
        out["selector"] = F.coalesce(F.nullif("asset_selector", F.lit("")), F.lit("momentum_26w"))
    for name, default in (("intercept", 0.0), ("scale", 1.0), ("smoothing", 0.0), ("min_votes", 1)):
        if name in rows.columns:
            out[name] = F.coalesce(F.nullif(F.col(name), F.lit(0).cast(rows.schema[name].dataType)), F.lit(default).cast(rows.schema[name].dataType))
    return rows.withColumns(out)


def candidate_key(*extra: str) -> Column:
    """Identity of a candidate: sorted specs and assets, knobs at four decimals."""
    knob = lambda n: F.round(F.col(n), 4)
    return F.struct(F.array_sort("specs").alias("s"), F.array_sort("assets").alias("a"), F.col("selector"), knob("intercept").alias("i"), knob("scale").alias("c"), knob("smoothing").alias("m"), *extra)


def with_id(cands: DataFrame, prefix: str = "weekly_multi_asset_") -> DataFrame:
    key = [F.array_sort("specs").alias("specs"), F.array_sort("assets").alias("assets"), F.col("selector")] + [F.round(n, 6).alias(n) for n in ("intercept", "scale", "smoothing")]
    return cands.withColumn("candidate_id", SP.digest_id(prefix, *key))


def unseen(cands: DataFrame, seen: DataFrame) -> DataFrame:
    """First copy of each new candidate whose rounded key was not evaluated before."""
    k = cands.withColumn("_k", F.sha2(F.to_json(candidate_key()), 256))
    fresh = k.join(seen.select(F.sha2(F.to_json(candidate_key()), 256).alias("_k")).distinct(), "_k", "left_anti")
    return fresh.dropDuplicates(["_k"]).drop("_k")


def seed_candidates(catalog: DataFrame, assets: Column, pool: int, seed: int, scales=(0.25, 0.5, 0.75, 1.0, 1.25), max_features: int = 5) -> DataFrame:
    """Every catalog spec at five scales, one more with a random intercept, then random combinations.

    ``catalog`` has (spec, index) with a dense index; random combinations draw indexes and join the
    catalog by equality.
    """
    i = F.col("index")
    one = catalog.select(
        F.array("spec").alias("specs"), assets.alias("assets"), F.get(F.array(*[F.lit(s) for s in SELECTORS]), F.pmod(i, F.lit(5)).cast("int")).alias("selector"), "index",
    )
    grid = one.withColumn("_k", F.explode(SP.floats((*scales, -1.0)))).select(
        "specs", "assets", "selector",
        F.when(F.col("_k") < 0, pick(uniform(seed, i, 1), SP.floats((-0.85, -0.6, -0.35, -0.1, 0.0, 0.1, 0.35, 0.6, 0.85)))).otherwise(0.0).alias("intercept"),
        F.when(F.col("_k") < 0, 0.35).otherwise(F.col("_k")).alias("scale"), F.lit(0.0).alias("smoothing"),
    )
    return grid.unionByName(random_candidates(catalog, assets, pool, seed, max_features))


def random_candidates(catalog: DataFrame, assets: Column, n: int, seed: int, max_features: int = 5, weight: str | None = None) -> DataFrame:
    """``n`` candidates of one to ``max_features`` specs with random knobs.

    Uniform draws pick catalog positions; with ``weight`` a draw falls into a position's share of the
    cumulative weight.
    """
    spark = catalog.sparkSession
    ids = spark.range(n).withColumn("k", F.floor(uniform(seed, F.col("id"), 0) * max_features) + 1)
    draws = ids.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).withColumn("u", uniform(seed, F.col("id"), 100, F.col("slot")))
    if weight is None:
        size = catalog.agg(F.count(F.lit(1)).alias("n"))
        total = int(size.head()["n"])
        hit = draws.withColumn("index", F.floor(F.col("u") * total)).join(catalog.select("index", "spec"), "index")
    else:
        cum = weighted_ranges(catalog, weight)
        cells = 256
        c = cum.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
        hit = draws.withColumn("_cell", F.floor(F.col("u") * cells)).join(c, "_cell").where("u >= lo AND u < hi")
    g = hit.groupBy("id").agg(F.array_sort(F.collect_set("spec")).alias("specs"))
    u = lambda s: uniform(seed, F.col("id"), s)
    return g.select(
        "specs", assets.alias("assets"), pick(u(201), F.array(*[F.lit(s) for s in SELECTORS])).alias("selector"),
        (u(202) * 1.10 - 0.55).alias("intercept"), (u(203) * 1.30 + 0.15).alias("scale"),
        pick(u(204), SP.floats((0.0, 0.10, 0.20, 0.35, 0.50))).alias("smoothing"),
    )


def weighted_ranges(catalog: DataFrame, weight: str) -> DataFrame:
    """(spec, lo, hi): each spec's slice of the unit interval. Two-level running sum over buckets of the
    dense index, so no single task sorts the catalog."""
    b = catalog.withColumn("_b", F.floor(F.col("index") / 4096))
    per = b.groupBy("_b").agg(F.sum(weight).alias("_w"))
    off = per.select("_b", F.coalesce(F.sum("_w").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_o"),
                     F.sum("_w").over(Window.partitionBy(F.lit(0))).alias("_t"))
    x = b.join(F.broadcast(off), "_b")
    run = F.col("_o") + F.sum(weight).over(Window.partitionBy("_b").orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("spec", ((run - F.col(weight)) / F.col("_t")).alias("lo"), (run / F.col("_t")).alias("hi"))


def cycled(parents: DataFrame, n: int) -> DataFrame:
    """``n`` rows that take the parents (dense ``index``) in turn, so that no proposal is lost to an uneven division."""
    spark = parents.sparkSession
    size = max(1, int(parents.agg(F.count(F.lit(1))).head()[0]))
    turns = spark.range(n).select(F.col("id").alias("turn"), (F.col("id") % size).alias("index"))
    return turns.join(parents, "index")


def mutate(beam: DataFrame, catalog: DataFrame, n: int, seed: int, max_features: int = 5, universes: list[list[str]] | None = None) -> DataFrame:
    """``n`` children per row: add, replace, drop or reweight a spec, another selector, or another asset universe.

    An "add" at the limit and a "drop" of the only spec reweight instead. A new selector or universe leaves the knobs as
    they are; the other actions jitter and clip them. ``turn`` tells rows of one parent apart.
    """
    size = int(catalog.agg(F.count(F.lit(1))).head()[0])
    kids = beam.withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(n))))
    turn = F.col("turn") if "turn" in beam.columns else F.lit(0)
    u = lambda s: uniform(seed, F.col("candidate_id"), turn, F.col("_m"), s)
    actions = ["add", "replace", "drop", "weight", "selector"] + (["assets"] if universes else [])
    kids = kids.withColumns({
        "_act": pick(u(1), F.array(*[F.lit(a) for a in actions])),
        "index": F.floor(u(2) * size), "_at": F.floor(u(3) * F.size("specs")).cast("int") + 1,
        "_u4": u(4), "_u5": u(5), "_i": gauss(u(6), u(7), 0.15), "_s": gauss(u(8), u(9), 0.20), "_h": gauss(u(10), u(11), 0.10), "_u12": u(12),
    })
    kids = kids.join(catalog.select("index", F.col("spec").alias("_new")), "index", "left")
    s = F.col("specs")
    without = F.filter(s, lambda x: x != F.element_at("specs", F.col("_at")))
    act = F.col("_act")
    changed = (
        F.when((act == "add") & (F.size(s) < max_features), F.array_append(s, F.col("_new")))
        .when(act == "replace", F.array_append(without, F.col("_new")))
        .when((act == "drop") & (F.size(s) > 1), without)
        .when(act.isin("add", "drop", "weight"), F.array_append(without, SP.with_weight(F.element_at("specs", F.col("_at")), pick(F.col("_u4"), SP.ints((1, 2, 3))))))
        .otherwise(s)
    )
    other = F.when(act == "assets", pick(F.col("_u12"), F.array(*[F.array(*[F.lit(x) for x in v]) for v in universes]))).otherwise(F.col("assets")) if universes else F.col("assets")
    still = act.isin("selector", "assets")
    knob = lambda name, step, low, high: F.when(still, F.col(name)).otherwise(clip(F.col(name) + F.col(step), low, high)).alias(name)
    return kids.select(
        F.array_sort(F.array_distinct(changed)).alias("specs"), other.alias("assets"),
        F.when(act == "selector", pick(F.col("_u5"), F.array(*[F.lit(x) for x in SELECTORS]))).otherwise(F.col("selector")).alias("selector"),
        knob("intercept", "_i", -0.95, 0.95), knob("scale", "_s", 0.05, 1.75), knob("smoothing", "_h", 0.0, 0.80),
    )


def mated(left: DataFrame, parents: DataFrame, seed: int) -> DataFrame:
    """Every row with a hash-chosen mate (``r_`` columns) among ``parents``, whose dense ``index`` makes it an equality join."""
    size = int(parents.agg(F.count(F.lit(1))).head()[0])
    turn = F.col("turn") if "turn" in left.columns else F.lit(0)
    right = parents.select(F.col("index").alias("_mate"), *[F.col(x).alias(f"r_{x}") for x in ("specs", "assets", "selector", "intercept", "scale", "smoothing")])
    rows = left.withColumns({f"_u{k}": uniform(seed, F.col("index"), turn, k) for k in (2, 3)}).withColumn("_mate", F.floor(uniform(seed, F.col("index"), turn, 1) * size))
    return rows.withColumn("turn", turn).join(right, "_mate")


def crossover(left: DataFrame, parents: DataFrame, seed: int) -> DataFrame:
    """One child per row of ``left``: half the specs of the row and of its mate, averaged knobs."""
    j = mated(left, parents, seed)
    half = lambda c: F.greatest(F.floor(F.size(c) / 2), F.lit(1)).cast("int")
    a = F.slice("specs", F.lit(1), half("specs"))
    start = F.floor(F.size("r_specs") / 2).cast("int")
    b = F.slice("r_specs", start + 1, F.size("r_specs") - start)
    mid = lambda x: ((F.col(x) + F.col(f"r_{x}")) / 2.0).alias(x)
    return j.select(
        "turn", F.array_sort(F.array_union(a, b)).alias("specs"), F.when(F.col("_u2") < 0.5, F.col("assets")).otherwise(F.col("r_assets")).alias("assets"),
        F.when(F.col("_u3") < 0.5, F.col("selector")).otherwise(F.col("r_selector")).alias("selector"), mid("intercept"), mid("scale"), mid("smoothing"),
    )


def midpoint(left: DataFrame, parents: DataFrame, seed: int, max_features: int = 5) -> DataFrame:
    """Differential step: all specs of base and donor up to the limit, universe and selector by turn, knobs half way."""
    j = mated(left, parents, seed)
    way = lambda x, low, high: clip(F.col(x) + 0.5 * (F.col(f"r_{x}") - F.col(x)), low, high).alias(x)
    return j.select(
        "turn", F.slice(F.array_sort(F.array_union("specs", "r_specs")), 1, max_features).alias("specs"),
        F.when(F.col("turn") % 2 != 0, F.col("assets")).otherwise(F.col("r_assets")).alias("assets"),
        F.when(F.col("turn") % 3 != 0, F.col("selector")).otherwise(F.col("r_selector")).alias("selector"),
        way("intercept", -0.95, 0.95), way("scale", 0.05, 1.75), way("smoothing", 0.0, 0.80),
    )


def spec_rewards(rows: DataFrame, catalog: DataFrame, score: str = "score", top: int = 200, unit: float = 1000.0) -> DataFrame:
    """Weight of every catalog spec: one plus rewards from the best rows, normalised."""
    best = rows.orderBy(F.col(score).desc(), "candidate_id").limit(top)
    r = best.select(F.explode("specs").alias("spec"), (1.0 + F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)) / unit).alias("g"))
    got = r.groupBy("spec").agg(F.sum("g").alias("g"))
    w = catalog.select("spec").distinct().join(got, "spec", "left").select("spec", (1.0 + F.coalesce("g", F.lit(0.0))).alias("w"))
    total = w.agg(F.sum("w").alias("t"), F.lit(1).alias("_k"))
    return w.join(F.broadcast(total), F.lit(1) == F.col("_k")).select("spec", (F.col("w") / F.col("t")).alias("weight"))


UNPULLED = 1e6


def group_rewards(rows: DataFrame, catalog: DataFrame, score: str = "score", top: int = 300, unit: float = 1500.0, group: Column | None = None) -> DataFrame:
    """Rewards per group of the catalog (feature prefixes by default), with an upper confidence score.

    Specs outside the catalog earn nothing. A group that was never pulled comes first: it gets the
    score UNPULLED.
    """
    known = catalog.select("spec").distinct()
    group = F.substring_index(F.substring_index("spec", "|", 1), "_", 1) if group is None else group
    best = rows.orderBy(F.col(score).desc(), "candidate_id").limit(top)
    r = best.select(F.explode("specs").alias("spec"), (1.0 + F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)) / unit).alias("g"))
    got = r.join(known, "spec", "left_semi").groupBy(group.alias("group")).agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("pulls"))
    all_groups = known.select(group.alias("group")).distinct()
    g = all_groups.join(got, "group", "left").select("group", (1.0 + F.coalesce("g", F.lit(0.0))).alias("reward"), F.coalesce("pulls", F.lit(0)).alias("pulls"))
    total = g.agg(F.sum("pulls").alias("n"), F.lit(1).alias("_k"))
    g = g.join(F.broadcast(total), F.lit(1) == F.col("_k"))
    bonus = F.sqrt(2.0 * F.ln(F.col("n") + 1.0) / F.greatest("pulls", F.lit(1)))
    score_of = F.when(F.col("pulls") == 0, F.lit(UNPULLED)).otherwise(F.col("reward") / F.greatest("pulls", F.lit(1)) + bonus)
    return g.select("group", "reward", "pulls", score_of.alias("ucb"))


def weighted_sample(items: DataFrame, weight: Column, k: int, seed: int, by: str, name: str = "spec") -> DataFrame:
    """Weighted draw of k items without replacement per group: the smallest -ln(u) / w win."""
    key = -F.ln(uniform(seed, F.col(by), F.col(name))) / weight
    w = Window.partitionBy(by).orderBy("_key", name)
    return items.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_key", "_rn")


def beam_select(rows: DataFrame, k: int, score: str = "score", signature: Column | None = None) -> DataFrame:
    """Best row per identity (or signature), then the top k."""
    key = F.col("candidate_id") if signature is None else signature
    rest = F.max_by(F.struct(*rows.columns), F.struct(F.col(score), F.col("candidate_id")))
    one = rows.groupBy(key.alias("_sig")).agg(rest.alias("_b")).select("_b.*")
    return one.orderBy(F.col(score).desc_nulls_last(), "candidate_id").limit(k)


def adaptive_family_weights(stats: DataFrame, min_weight: float = 0.10, scale: float = 1.0) -> DataFrame:
    """(min weight + mean reward x scale) x penalty per family; ``stats`` has family, attempts, reward, penalty."""
    mean = F.coalesce("reward", F.lit(0.0)) / F.greatest(F.coalesce("attempts", F.lit(0)), F.lit(1))
    w = (max(0.01, min_weight) + F.greatest(F.lit(0.0), mean) * max(0.01, scale)) * F.greatest(F.lit(0.01), F.coalesce("penalty", F.lit(1.0)))
    return stats.select("family", "attempts", "reward", w.alias("weight"))


def family_reward(reason: Column, has_validation: Column, train_calmar: Column, target: float = 1.0) -> Column:
    """Reward of one evaluated row from how far it got."""
    early = F.when(reason.isin("train_validation_calmar_ratio", "train_subperiod_calmar"), 2.0).when(
        reason.isin("train_total_metrics", "train_annual_return", "train_annual_calmar"), 1.0
    ).when((reason == "train_calmar") & (train_calmar > 0), F.least(F.lit(0.9), train_calmar / max(1e-9, target))).otherwise(0.0)
    late = F.when(reason == "", 20.0).when(reason.startswith("validation_"), 6.0).otherwise(4.0)
    return F.when(has_validation, late).otherwise(early)


def overfit_penalty(cands: DataFrame, ledger: DataFrame, floor: float = 0.50) -> DataFrame:
    """Worst similarity of each candidate with a failed pattern.

    Candidates with one model, family and feature set are of one kind and have one penalty, so only kinds meet the ledger.
    Kind and pattern must share at least one feature to overlap, so they meet by an equality join on features (and a count),
    not as a cross product. A candidate without an id has no penalty.
    """
    kind = ("model", "family", "fs")
    own = cands.select("candidate_id", "model", "family", F.array_sort(F.array_distinct("features")).alias("fs"))
    kinds = own.select(*kind).distinct().withColumn("nc", F.size("fs"))
    size_l = ledger.select("pattern_id", F.col("model").alias("pm"), F.col("family").alias("pf"), "failed_locked", F.array_distinct("features").alias("ps")).withColumn("np", F.size("ps"))
    hits = (
        kinds.select(*kind, "nc", F.explode("fs").alias("f"))
        .join(size_l.select("pattern_id", "pm", "pf", "failed_locked", "np", F.explode("ps").alias("f")), "f")
        .groupBy(*kind, "pattern_id", "nc", "pm", "pf", "failed_locked", "np").agg(F.count(F.lit(1)).alias("shared"))
    )
    j = F.col("shared") / (F.col("nc") + F.col("np") - F.col("shared"))
    one = lambda cond, v: F.when(cond, v).otherwise(0.0)
    local = j + one(F.col("pm") == F.col("model"), 0.25) + one(F.col("pf") == F.col("family"), 0.25) + one(F.col("failed_locked"), 0.5)
    worst = hits.where(j >= floor).groupBy(*[F.col(c).alias(f"_{c}") for c in kind]).agg(F.max(local).alias("penalty"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind]
    penalty = F.when(F.col("candidate_id").isNotNull(), F.col("penalty"))
    return own.join(worst, same, "left").select("candidate_id", F.coalesce(penalty, F.lit(0.0)).alias("penalty"))


def expected_improvement(cands: DataFrame, weights: DataFrame, families: DataFrame, tried: DataFrame) -> DataFrame:
    """Mean spec reward + 0.6 x mean family reward + 0.4 x share of untried specs."""
    x = cands.select("candidate_id", F.explode("specs").alias("spec"))
    x = x.join(weights, "spec", "left").join(tried.select("spec", F.lit(1).alias("_t")).distinct(), "spec", "left")
    a = x.groupBy("candidate_id").agg(F.avg(F.coalesce("weight", F.lit(1.0))).alias("use"), F.avg(F.when(F.col("_t").isNull(), 1.0).otherwise(0.0)).alias("novel"))
    fam = x.select("candidate_id", F.substring_index("spec", "|", 1).alias("feature")).distinct()
    from barlab.functions.text import daily_family

    fam = fam.select("candidate_id", daily_family(F.col("feature")).alias("family")).distinct().join(families, "family", "left")
    b = fam.groupBy("candidate_id").agg(F.avg(F.coalesce("reward", F.lit(1.0))).alias("fam"))
    return a.join(b, "candidate_id").select("candidate_id", (F.col("use") + 0.6 * F.col("fam") + 0.4 * F.col("novel")).alias("expected_improvement"))


# Prior weight of each daily feature family (fixed values).
FAMILY_PRIOR = {
    "spy_price": 1.15, "rolling": 1.10, "momentum": 1.10, "volatility": 1.05, "credit": 1.00, "rates": 0.95,
    "defensive_cyclical": 0.95, "cross_asset": 0.90, "macro": 0.85, "other": 0.70,
}


def choice(u: Column, values, weights) -> Column:
    """Value chosen by cumulative weights."""
    total, run = float(sum(weights)), 0.0
    out = None
    for v, w in zip(values[:-1], weights[:-1]):
        run += w / total
        out = F.when(u < run, F.lit(v)) if out is None else out.when(u < run, F.lit(v))
    return out.otherwise(F.lit(values[-1])) if out is not None else F.lit(values[-1])


def daily_candidates(catalog: DataFrame, n: int, seed: int, learned: DataFrame | None = None) -> DataFrame:
    """Family-weighted daily rule candidates: one or two families, two to five specs, confirm and hold choices.

    Every catalog row competes for a candidate with an exponential key scaled by its weight; the
    smallest keys win. Candidates see only catalog rows of their families (an equality join).
    """
    spark = catalog.sparkSession
    fams = catalog.select("family").distinct()
    prior = F.create_map(*[x for k, v in FAMILY_PRIOR.items() for x in (F.lit(k), F.lit(v))])
    ids = spark.range(n)
    u = lambda *s: uniform(seed, F.col("id"), *s)
    ids = ids.select(
        "id", choice(u(1), (1, 2), (0.55, 0.45)).alias("n_fam"), choice(u(2), (2, 3, 4, 5), (0.20, 0.30, 0.35, 0.15)).alias("combo_size"),
        choice(u(3), ("spy_long_short_always", "spy_long_short_score"), (0.72, 0.28)).alias("rule"),
        choice(u(4), (1, 2, 3, 5, 8), (0.15, 0.25, 0.25, 0.25, 0.10)).alias("confirm_days"),
        choice(u(5), (1, 3, 5, 10, 15, 20), (0.10, 0.20, 0.25, 0.25, 0.10, 0.10)).alias("min_hold_days"),
        choice(u(6), (0.0, 0.25, 0.5, 0.75, 1.0), (1, 1, 1, 1, 1)).alias("score_threshold"), choice(u(7), (1, 2), (1, 1)).alias("votes"),
    )
    # the family list is a taxonomy of at most ten names: carried as one array, not joined
    every = F.array(*[F.lit(k) for k in FAMILY_PRIOR])
    present = fams.agg(F.array_sort(F.collect_set("family")).alias("present"), F.lit(1).alias("_k"))
    x = ids.join(F.broadcast(present), F.lit(1) == F.col("_k")).drop("_k")
    ranked = F.array_sort(F.transform(F.filter(every, lambda f: F.array_contains("present", f)), lambda f: F.struct((-F.ln(uniform(seed, F.col("id"), f)) / prior[f]).alias("k"), f.alias("f"))))
    x = x.withColumn("family", F.explode(F.slice(F.transform(ranked, lambda s: s["f"]), F.lit(1), F.col("n_fam")))).drop("present")
    cat = catalog if learned is None else catalog.join(learned, "spec", "left")
    w = F.lit(1.0) if learned is None else F.coalesce(F.col("weight"), F.lit(1.0))
    j = x.join(cat.select("family", "spec", w.alias("_w")), "family").withColumn("_key", -F.ln(uniform(seed, F.col("id"), 9, F.col("spec"))) / F.col("_w"))
    g = j.groupBy("id", "rule", "combo_size", "confirm_days", "min_hold_days", "score_threshold", "votes").agg(F.array_sort(F.collect_list(F.struct("_key", "spec"))).alias("_s"))
    specs = F.slice(F.transform("_s", lambda s: s["spec"]), F.lit(1), F.col("combo_size"))
    g = g.withColumn("specs", specs).where(F.size("specs") >= 2)
    half = F.greatest(F.floor(F.size("specs") / 2), F.lit(1)).cast("int")
    score = F.col("rule") == "spy_long_short_score"
    longs, shorts = F.array_sort(F.slice("specs", F.lit(1), half)), F.array_sort(F.slice("specs", half + 1, F.size("specs") - half))
    out = g.select(
        "rule", "combo_size", "confirm_days", "min_hold_days", F.when(score, F.array_join(F.array_sort("specs"), ";")).alias("feature_specs"),
        F.when(score, F.col("score_threshold")).alias("score_threshold"), F.when(~score, F.array_join(longs, ";")).alias("long_specs"),
        F.when(~score, F.array_join(shorts, ";")).alias("short_specs"), F.when(~score, F.least("votes", F.size(longs))).alias("long_min_votes"),
        F.when(~score, F.least("votes", F.size(shorts))).alias("short_min_votes"),
    )
    return out.dropDuplicates()


def ml_candidates(features, ids: DataFrame, seed: int, max_features: int = 5) -> DataFrame:
    """Learning candidates, one per id: rotating model, hashed feature subset and hyper-parameters."""
    u = lambda s: uniform(seed, F.col("id"), s)
    names = F.array(*[F.lit(f) for f in features])
    k = F.floor(u(1) * min(max_features, len(features))).cast("int") + 1
    order = F.array_sort(F.transform(names, lambda f: F.struct(uniform(seed, F.col("id"), 2, f).alias("k"), f.alias("f"))))
    return ids.select(
        F.concat(F.lit("ml_"), F.col("id").cast("string")).alias("candidate_id"),
        F.array_sort(F.slice(F.transform(order, lambda s: s["f"]), F.lit(1), k)).alias("features"),
        F.get(F.array(F.lit("ridge"), F.lit("random_forest"), F.lit("hist_gradient_boosting")), F.pmod("id", F.lit(3)).cast("int")).alias("model"),
        pick(u(3), SP.floats((0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0))).alias("alpha"), pick(u(4), SP.ints((32, 48, 64, 96))).alias("n_estimators"),
        pick(u(5), SP.ints((2, 3, 4, 5))).alias("max_depth"), pick(u(6), SP.floats((0.03, 0.05, 0.08, 0.12))).alias("learning_rate"),
        (u(7) * 1.65 + 0.35).alias("scale"), (u(8) * 0.70 - 0.35).alias("intercept"), pick(u(9), F.array(*[F.lit(s) for s in SELECTORS])).alias("selector"),
    )
