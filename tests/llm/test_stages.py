"""One Python map a stage where texts are fetched by name."""

import pytest
from pyspark.sql import functions as F

from qualispark.llm import common, line_dedup, metric_join, near_documents


def maps_in_a_stage(df):
    """The most Python maps that a path of the plan passes without an exchange."""
    most, depth = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        while depth and depth[-1][0] >= at:
            depth.pop()
        n = depth[-1][1] if depth else 0
        n = 0 if "Exchange" in line[at:].split("(")[0] else n + ("MapInArrow" in line[at:].split("(")[0])
        depth.append((at, n))
        most = max(most, n)
    return most


@pytest.mark.parametrize("of", ["near_documents", "metric_join"])
def test_sets_of_few_texts_take_one_python_map_a_stage(spark, of):
    docs = spark.createDataFrame([(i, f"w{i % 7} a b c\nd e f g") for i in range(40)], "doc_id long, text string")
    own = docs.select("text")
    few = common.written(near_documents._classes(docs.filter(F.col("text").startswith("w3"))).select("cls"), "few")
    if of == "metric_join":
        found = metric_join._Join(docs, "text").sets(few)
    else:
        found = near_documents._tokens_of(own.select(F.translate("text", "\n", " ").alias("text")), few, line_dedup.rarity_sketch(own))
    assert maps_in_a_stage(found) == 1
    rows = found.collect()
    assert [r["cls"] for r in rows] == [few.first()["cls"]] and rows[0]["made"]
