"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in Spark expression over the words and lines of the
whole text; no user function, join or shuffle is involved, so the scan is the
only cost and a hot source or a long text stays in its own task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import SPACE, let

# Frequent function words of the languages the rules know.
STOP_WORDS = (
    "the of and to in is that it for with as be on are by this "
    "de la que el en los las se un una y por con del "
    "le les et des une est dans pour du au "
    "der die und das den von zu mit ist ein eine nicht"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= measure <= high``."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The production table. Ratios are per word, but for the line ratios.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=1.5, high=20),
    Rule("symbol_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.002),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.5),
)

#: Measures that are sums over the text, before the ratios.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _adjacent_equal(items: Column, key) -> Column:
    """Of a sorted array, the items whose key equals a neighbour's."""
    return F.filter(
        items,
        lambda e, j: F.coalesce(key(F.get(items, j - 1)) == key(e), F.lit(False))
        | F.coalesce(key(F.get(items, j + 1)) == key(e), F.lit(False)),
    )


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(positions: Column) -> Column:
        steps = F.transform(
            positions, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(positions, j + 1) - p, F.lit(3)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(candidates: Column) -> Column:
        """Equal hashes are compared again by the words themselves."""
        windows = F.sort_array(
            F.transform(
                candidates,
                lambda e: F.struct(F.concat_ws(" ", w[e["i"]], w[e["i"] + 1], w[e["i"] + 2]).alias("g"), e["i"].alias("i")),
            )
        )
        return let(
            windows,
            lambda s: let(
                F.sort_array(F.transform(_adjacent_equal(s, lambda e: e["g"]), lambda e: e["i"])), covered
            ),
        )

    def with_hashes(h: Column) -> Column:
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(numbered, lambda s: let(_adjacent_equal(s, lambda e: e["h"]), exact))
        )

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes, with_hashes))


def measures(text: Column) -> Column:
    """One struct of the counts of ``COUNTS`` for a text; null has no words."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column, t: Column, lines: Column) -> Column:
        stop = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    def lines_of(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    return let(text, lambda t: let(_words(t), lambda w: let(lines_of(t), lambda ls: of(w, t, ls))))


def _ratios(m: Column) -> dict[str, Column]:
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    return {name: m[name] for name in COUNTS} | {
        "mean_word_chars": m["word_chars"] / words,
        "symbol_ratio": m["n_symbols"] / words,
        "stop_word_ratio": m["n_stop_words"] / words,
        "dup_line_ratio": m["n_dup_lines"] / lines,
        "repeat_word_ratio": m["n_repeat_words"] / words,
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(m: Column, rules=RULES) -> Column:
    """True where every row of the threshold table holds."""
    values, out = _ratios(m), F.lit(True)
    for rule in rules:
        if rule.low != float("-inf"):
            out = out & (values[rule.measure] >= rule.low)
        if rule.high != float("inf"):
            out = out & (values[rule.measure] <= rule.high)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, the counts, ``base_failed`` and ``kept``.

    Null texts and empty texts have no words and fail; repeated rows are scored
    each on its own; an empty table gives no rows; other columns of ``docs`` are
    not read, so their names cannot clash.
    """
    m = F.col("m")
    measured = docs.select(F.col(f"`{id_col}`").alias("doc_id"), measures(F.col(f"`{text_col}`")).alias("m"))
    return measured.select(
        "doc_id",
        *(m[c].alias(c) for c in COUNTS),
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & verdict(m, rules)).alias("kept"),
    )


def passing(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with all their own columns."""
    keep = let(measures(F.col(f"`{text_col}`")), lambda m: ~base_failed(m) & verdict(m, rules))
    return docs.filter(keep)
