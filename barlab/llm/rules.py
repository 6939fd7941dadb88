"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a column that says whether a document is rejected. A text is split into words and lines once, and the base columns
are there for every document. On a sample with these at hand each rule is run on its own: the share it rejects and the time
it takes beyond an empty rule, which is what it adds to the cascade, give its rejection per cost, and the rules are asked in falling
order of it. A document leaves the cascade at the first rule that rejects it, so later rules are not evaluated for it. The
order changes the work and which rule is named first, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import let
from barlab.session import checkpoint

#: Documents (about) in the sample that orders the rules.
SAMPLE = 2_000
#: Timed runs of a rule, and the least cost that the clock tells from none, in seconds.
RUNS, LEAST_COST = 3, 1e-3
WINDOW = 5
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. Texts whose windows all differ end there; otherwise the
    sorted hashes show which positions repeat, and one fold adds up the words that these windows cover.
    """

    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def positions(r: Column) -> Column:
            same = F.transform(r, lambda x, k: F.when((F.get(r, k - 1)["g"] == x["g"]) | (F.get(r, k + 1)["g"] == x["g"]), x["i"]))
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct((s["n"] + i + window - F.greatest(s["end"], i)).alias("n"), (i + window).alias("end"))
        return F.aggregate(let(ranked, positions), start, step, lambda s: s["n"])

    def of(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    return F.when(F.size(found) < window, F.lit(0)).otherwise(let(F.transform(found, lambda w: F.xxhash64(w)), of)).cast("long")


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the words and lines (``_words``, ``_lines``) of every text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("*", words(F.col("text")).alias("_words"), lines(F.col("text")).alias("_lines"))


def columns() -> dict[str, Column]:
    """What the rules read, by name, from the columns of ``split``."""
    text, found, parts = F.col("text"), F.col("_words"), F.col("_lines")
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(parts) - F.size(F.array_distinct(parts))).cast("long"),
        "n_repeat_words": repeated_words(found),
        "n_lines": F.size(parts).cast("long"),
        "n_exclaim": count_of(text, "!").cast("long"),
        "n_capitals": count_of(text, CAPITALS).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(found)).cast("long"),
    }


def with_base(docs: DataFrame) -> DataFrame:
    """``split`` with the base columns."""
    source = columns()
    return split(docs).select("*", *[source[k].alias(k) for k in BASE_COLUMNS])


Rule = Callable[[dict[str, Column]], Column]
#: The two rules of the base verdict.
BASE: dict[str, Rule] = {
    "few_words": lambda c: c["n_words"] < 10,
    "repeated_words": lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"],
}
#: Further rules; each is mild enough to leave ordinary prose alone.
RULES: dict[str, Rule] = BASE | {
    "symbols": lambda c: 10 * c["n_symbols"] > 3 * c["n_words"],
    "repeated_lines": lambda c: (c["n_dup_lines"] >= 3) & (100 * c["n_dup_lines"] > 30 * c["n_lines"]),
    "exclamations": lambda c: 10 * c["n_exclaim"] > 5 * c["n_words"],
    "capitals": lambda c: 2 * c["n_capitals"] > c["word_chars"],
    "word_length": lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]),
    "few_distinct_words": lambda c: (c["n_words"] >= 50) & (10 * c["n_distinct_words"] < c["n_words"]),
}


def order(docs: DataFrame, rules: dict[str, Rule], sample: int = SAMPLE, clock: Callable[[], float] = time.perf_counter) -> list[str]:
    """Rule names by rejection per cost on a sample of about ``sample`` documents; ties keep the given order.

    The cost is the least of RUNS runs by the clock, so the order, and with it ``rejected_by``, can change from run to run.
    """
    total = docs.count()
    if not total:
        return list(rules)
    few = checkpoint(with_base(docs.sample(min(1.0, sample / total), seed=7)))
    source = columns() | {k: F.col(k) for k in BASE_COLUMNS}

    def run(rejected: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(RUNS):
            began = clock()
            hits = few.agg(F.coalesce(F.sum(rejected.cast("int")), F.lit(0)).alias("n")).collect()[0]["n"]
            best = min(best, clock() - began)
        return best, hits

    idle, _ = run(F.col("n_words").isNull())
    gain = {}
    for name, rule in rules.items():
        seconds, hits = run(rule(source))
        gain[name] = hits / max(seconds - idle, LEAST_COST)
    return sorted(rules, key=lambda name: -gain[name])


def cascade(source: dict[str, Column], rules: dict[str, Rule], names: list[str]) -> Column:
    """Name of the first rule that rejects, null for a document that none rejects."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(rules[name](source), F.lit(name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``docs`` with the base columns, base_failed, rejected_by (first rule in cascade order) and kept.

    doc_id and the added columns are returned; only doc_id and text are read, so extra columns never clash. Null and empty
    texts have no words and fail. An empty table gives an empty table, repeated rows equal rows, and ties in the order of
    rules keep the order in which they are listed. Very long texts are handled whole, row by row, without a shuffle.
    """
    rules = rules or RULES
    names = order(docs, rules, sample)
    have = columns() | {k: F.col(k) for k in BASE_COLUMNS}
    failed = BASE["few_words"](have) | BASE["repeated_words"](have)
    judged = with_base(docs).select("doc_id", *BASE_COLUMNS, failed.alias("base_failed"), cascade(have, rules, names).alias("rejected_by"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
