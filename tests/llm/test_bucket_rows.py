"""Classes are joined once, however many buckets they stand in."""

from rowlens.llm.minhash import _seen


def test_a_join_gives_a_row_a_class(spark):
    rest = spark.createDataFrame([(k, node, node % 2) for node in range(5) for k in range(190)], "key long, node long, component long")
    alive = spark.createDataFrame([(node, 7, node) for node in range(1, 5)], "node long, n long, c long")
    found = _seen(rest, alive)
    assert sorted(map(tuple, found.collect())) == [(k, node, node % 2, 7, node) for k in range(190) for node in range(1, 5)]
    # lists are opened behind the join, not before it
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")
