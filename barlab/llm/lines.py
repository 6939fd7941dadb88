"""Line dedup by a log-template tree, in DataFrame functions only.

A line walks down a tree of fixed depth: its number of tokens, then its leading tokens. Tokens with a digit are variable
fields from the start and read ``<*>``. In a leaf, a token is constant at its position if two documents have it there or if more
than half of the leaf's different lines do, and a variable field elsewhere; a line's template are its constant tokens, if they
are enough of it. A template recurs when two documents or more have it, all of its constant tokens or all but one, and so does
a line that two documents have byte for byte, whatever its length: the document with the least doc_id keeps its lines, all
others lose theirs.

The texts are read once. Each line gets the hashes of its leaf and of its tokens, most lines without being split; the tokens
stay in a table beside them and are looked at only in leaves where something can be generalised. Equal lines count once there,
so a line that a third of the corpus shares costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import let, written

#: Leading tokens on the path to a leaf.
DEPTH = 3
#: Shorter lines have no template and recur byte for byte only.
LEAST_TOKENS = 3
#: Percent of the tokens without digits that a generalised template must keep.
LEAST_CONSTANT = 80
#: Open leaves, at 16 bytes each, up to which their list is broadcast; beyond it they are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000
FIELD = "<*>"
_VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*"
_BLANKS = "\t\v\f\r"
_NO_ID = (1 << 63) - 1


def template_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, words, n, n_fields, leaf, line, raw) of all lines; n is the number of tokens, words joins
    them, leaf and line are hashes of the tree path and of all tokens, and raw is that of the line as it is, where its tokens are too
    few or too variable for a template."""
    text, line = F.col("text").cast("string"), F.col("_line")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    plain = ~(line.rlike(r"[0-9\t\x0B\f\r]|  ") | line.startswith(" ") | line.endswith(" "))
    spaced = F.regexp_replace(F.regexp_replace(F.translate(line, _BLANKS, "    "), _VARIABLE, FIELD), " +", " ")
    rows = rows.withColumn("words", F.when(plain, line).otherwise(F.trim(spaced)))
    n = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    fields = F.when(F.contains("words", F.lit(FIELD)), F.size(F.filter(F.split("words", " "), lambda t: t == FIELD))).otherwise(0)
    rows = rows.withColumn("n", n).withColumn("n_fields", fields)
    raw = F.when((F.col("n") < LEAST_TOKENS) | (2 * (F.col("n") - F.col("n_fields")) < F.col("n")), F.xxhash64("_line"))
    leaf = F.xxhash64("n", F.substring_index("words", " ", DEPTH))
    return rows.withColumn("leaf", leaf).withColumn("line", F.xxhash64("words")).withColumn("raw", raw).drop("_line")


def enough(kept: Column) -> Column:
    """Whether a template with ``kept`` constant tokens says enough of a line."""
    return (100 * kept >= LEAST_CONSTANT * (F.col("n") - F.col("n_fields"))) & (2 * kept >= F.col("n"))


def several(known: DataFrame) -> DataFrame:
    """(leaf, line, first) of the lines whose supported tokens, all of them or all but one, two documents have."""
    size = F.size("held")
    fewer = F.when(enough(size - 1), F.transform("held", lambda c: c.bitwiseXOR(F.col("shape")))).otherwise(F.array().cast("array<bigint>"))
    keys = known.filter(enough(size)).select("leaf", "line", "low", "high", "first", F.explode(F.concat(F.array("shape"), fewer)).alias("key"))
    shared = keys.groupBy("leaf", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).filter("low <> high").select("leaf", "key", "first")
    return keys.select("leaf", "line", "key").join(shared, ["leaf", "key"]).groupBy("leaf", "line").agg(F.min("first").alias("first"))


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines): numbers of the lines that a document loses."""
    rows = written(template_lines(docs), "zstd").filter("n > 0")
    doc, last = F.xxhash64("doc_id", "text_hash"), F.lit(_NO_ID)
    spread = (F.min(doc).alias("low"), F.max(doc).alias("high"), F.min(F.coalesce("doc_id", last)).alias("first"))
    long = rows.filter(F.col("n") >= LEAST_TOKENS)
    distinct = written(long.groupBy("leaf", "line", "n", "n_fields").agg(*spread))
    exact = distinct.filter((F.col("low") != F.col("high")) & (2 * (F.col("n") - F.col("n_fields")) >= F.col("n"))).select("leaf", "line", "first")

    leaves = written(distinct.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("low").alias("_low"), F.max("high").alias("_high")).filter("lines > 1 and _low <> _high").select("leaf", "lines"))
    leaves = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    members = long.select("leaf", "line", "words", "n", "n_fields", "doc_id", "text_hash").join(leaves, "leaf")
    members = written(members.groupBy("leaf", "line", "words", "n", "n_fields", "lines").agg(*spread), "zstd")
    # A cell is a token at its position in its leaf.
    cells = members.select("leaf", "line", "lines", "low", "high", F.posexplode(F.split("words", " ")).alias("at", "token")).filter(F.col("token") != FIELD).withColumn("cell", F.xxhash64("leaf", "at", "token"))
    cell = cells.groupBy("cell").agg(F.count("*").alias("held"), F.max("lines").alias("lines"), F.min("low").alias("low"), F.max("high").alias("high"))
    cell = written(cell.select("cell", (2 * F.col("held") > F.col("lines")).alias("common"), (F.col("low") != F.col("high")).alias("supported")).filter("common or supported"))
    held = cells.select("leaf", "line", "cell").join(cell, "cell").groupBy("leaf", "line")
    own = F.collect_list(F.when(F.col("supported"), F.col("cell")))  # as many as the line has tokens at most
    held = written(held.agg(F.count_if("common").alias("kept"), own.alias("held"), F.bit_xor(F.when(F.col("supported"), F.col("cell"))).alias("shape")))
    known = members.drop("words").join(held, ["leaf", "line"])

    close = known.filter(enough(F.col("kept")))
    shared = close.groupBy("leaf").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).filter("low <> high").select("leaf", "first")
    general = close.select("leaf", "line").join(shared, "leaf").select("leaf", "line", "first")
    out = written(exact.unionByName(general).unionByName(several(known)).groupBy("leaf", "line").agg(F.min("first").alias("first")))

    lost = long.select("doc_id", "text_hash", "line_no", "leaf", "line").join(out, ["leaf", "line"]).select("doc_id", "text_hash", "line_no", "first")
    raw = rows.filter(F.col("raw").isNotNull())
    same = written(raw.groupBy("raw").agg(*spread).filter("low <> high").select("raw", "first"))
    lost = lost.unionByName(raw.select("doc_id", "text_hash", "line_no", "raw").join(same, "raw").select("doc_id", "text_hash", "line_no", "first"))
    lost = lost.filter(F.coalesce("doc_id", last) != F.col("first"))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("lines"))


def drop_templates(docs: DataFrame) -> DataFrame:
    """``docs`` with the recurring lines cut out of ``text``, and n_lines and n_dropped of every document.

    All columns of ``docs`` stay; its own n_lines and n_dropped, if any, are replaced. A null text stays null and has no
    lines; an empty text stays empty. Rows that repeat doc_id and text are one document and are answered alike; rows that
    share only the doc_id are two documents that are first together. A null doc_id comes last. Lines that repeat inside
    one document only do not recur. Blank lines stay. A document whose lines all go keeps its row with an empty text. An
    empty table gives an empty table. Very long texts have more lines, and nothing is cut.
    """
    lost = recurring(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lines").alias("_lines"))
    text = F.col("_row.text").cast("string")
    whole = docs.select(F.struct("*").alias("_row"))
    both = whole.join(lost, F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    count = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    kept = let(F.split(text, "\n"), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_lines"), lambda i: F.get(parts, i)), "\n"))
    new = F.when(F.col("_lines").isNull(), text).otherwise(kept)
    fields = [new.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*fields, count.cast("long").alias("n_lines"), F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_dropped"))
