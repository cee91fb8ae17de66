"""How document filters interact, by signed parity sums.

Five filters give each document a mask of five bits. For every set S of filters
a part and label add up +1 or -1 by the parity of the mask within S: 32 sums
that any task can add up alone (a Walsh-Hadamard transform of the counts of
masks). The transform is its own inverse but for the factor 32, so the counts
come back exactly, and every order of the filters is evaluated on 32 numbers:
no document is looked at again for any of the 120 orders. A filter removes a
document in an order if none of the others that it fails comes earlier, which
is so in 120 / (number of failures) of the orders.

Only the copies filter looks beyond its row: the smallest id of each text goes
back to the rows by the text's SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import SPACE, let, written

FILTERS = "ABCDE"
MIN_WORDS = 100
#: Least share of distinct words, most share of capitals (percent).
DISTINCT, CAPITALS = 80, 10
SYMBOLS = r"[#$%&*|]"
ORDERS = factorial(len(FILTERS))
_CELLS = 1 << len(FILTERS)
#: Labels whose documents are counted apart.
LABELS = ("all", "good", "toxic")


def _own_failures(text: Column) -> Column:
    """Bits of the four filters that a row decides alone."""

    def bits(w: Column) -> Column:
        fails = (
            F.size(w) < MIN_WORDS,
            100 * F.size(F.array_distinct(w)) < DISTINCT * F.size(w),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.length(text),
            text.rlike(SYMBOLS),
        )
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return let(F.array_remove(F.split(text, SPACE), ""), bits)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic of every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    facts = docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        _own_failures(text).alias("bits"),
        F.unhex(F.sha2(text, 256)).alias("copy"),
    )
    facts = written(facts, "facts")
    least = facts.groupBy("copy").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, True)).alias("good"), F.max(F.when(F.col("toxic") == 1, True)).alias("toxic")
    )
    # Written before the joins, so that the rows of a frequent text or id can be dealt to several tasks.
    firsts, marks = written(least.select("copy", "least"), "firsts"), written(marks, "marks")
    joined = facts.join(firsts, "copy", "left").join(marks, F.col("doc") == F.col("doc_id"), "left")
    copy = F.when(F.col("doc") > F.col("least"), 1 << 4).otherwise(0)
    none = F.lit(False)
    return joined.select("part", (F.col("bits") + copy).alias("mask"), F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def parity_sums(marked: DataFrame) -> DataFrame:
    """part, label, w0 .. w31: the signed parity sums."""
    of = F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    rows = marked.select("part", "mask", F.explode(F.array_compact(of)).alias("label"))
    signed = [F.sum((1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)).cast("long")).alias(f"w{s}") for s in range(_CELLS)]
    return rows.groupBy("part", "label").agg(*signed)


def _sum_where(values: Column, test) -> Column:
    return F.aggregate(F.filter(values, lambda v, i: test(i)), F.lit(0).cast("long"), lambda a, v: a + v)


def _each_cell(make) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), make)


def cells(sums: DataFrame) -> DataFrame:
    """part, label, cells: the number of documents of each mask, by the inverse transform."""
    w = F.array(*(F.col(f"w{s}") for s in range(_CELLS)))

    def cell(m: Column) -> Column:
        signed = F.transform(w, lambda v, s: v * (1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2)))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, v: a + v), len(FILTERS))

    return sums.select("part", "label", _each_cell(cell).alias("cells"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A null text is empty, a null part is the
    empty part; a row with a null id is never a copy, makes none and has no
    label; repeated rows each count, and rows with the same id and text aren't
    copies of each other. A document is good (toxic) if any row of ``labels``
    for its id says so. No documents give no rows. Other columns are not read.
    """
    counted = cells(parity_sums(masks(docs, labels, id_col, text_col, part_col)))
    zeros = F.array_repeat(F.lit(0).cast("long"), _CELLS)
    wide = counted.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("cells"))), zeros).alias(k) for k in LABELS))

    def passing(k: str) -> Column:
        """Of every set of filters, the documents that fail none of it."""
        return _each_cell(lambda t: _sum_where(F.col(k), lambda m: t.bitwiseAND(m) == 0))

    turns = F.array(*(F.lit(ORDERS // max(1, m.bit_count()) if m else 0).cast("long") for m in range(_CELLS)))
    wide = wide.withColumns({f"passing_{k}": passing(k) for k in LABELS}).withColumn("share", F.zip_with("all", turns, lambda n, k: n * k))
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    rows = wide.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.locate(f, F.col("filter_order")) for f in FILTERS]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    rows = rows.withColumns({"before": before, "own": own, "upto": before + own})

    def lost(k: str) -> Column:
        return F.get(f"passing_{k}", F.col("before")) - F.get(f"passing_{k}", F.col("upto"))

    fails = F.get("passing_all", F.lit(0)) - F.get("passing_all", F.col("own"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("passing_all", F.col("upto")).alias("kept"),
        lost("all").alias("removed"),
        (fails - lost("all")).alias("redundant"),
        F.get("all", F.col("own")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        _sum_where(F.col("share"), lambda m: F.col("own").bitwiseAND(m) != 0).alias("shapley"),
    )
