"""What queries move or read again, by their plans and by counting."""

from textmill.plans.catalogue import QUERIES
from textmill.plans.registry import read_table
from textmill.plans.term_queries import length_stats

SF = "/root/testdata/sf0.001"


def test_lengths_are_taken_from_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    docs = read_table(spark, SF, "documents").select("lang", "text")
    n = docs.count()
    length_stats(lambda _: docs.mapInPandas(passed, docs.schema)).collect()
    assert seen.value == n


def test_grams_without_an_item_are_dropped_before_they_are_made_distinct(spark):
    plan = QUERIES["contamination_4gram"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_local_statistics_count_the_candidates_terms_only(spark):
    plan = QUERIES["two_stage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert any("LeftSemi" in line and "doc_id" in line for line in plan.splitlines())
