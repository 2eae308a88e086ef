"""Case milestones join tables that all grow with the cases."""

from pyspark.sql import functions as F

from lumbrera.operators import cases


def test_no_side_that_grows_is_broadcast(spark):
    """Texts are made in the plan, so that estimated sizes say little of them."""
    at = "timestamp '2024-05-10'"
    k = spark.range(3)
    file = f"named_struct('attachment', id, 'title', 'Final Report', 'url', 'https://a.org/x.pdf', 'content_type', cast(null AS string), 'at', {at})"
    rows = k.selectExpr("id AS case", "'A / B merger inquiry' AS title", "'mergers' AS case_type", "'cma_case' AS document_type", "'Body' AS body", f"{at} AS updated_at", f"array(named_struct('at', {at}, 'note', 'Final report published')) AS events", f"array({file}) AS attachments")
    texts = k.selectExpr("id AS attachment", "repeat('word ', 1000) AS text")
    out = cases.case_milestones(rows, texts, F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r["case"], r["level"], r["content"].count("word ") > 900) for r in out.collect()) == [(n, "EXACT", True) for n in range(3)]
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
