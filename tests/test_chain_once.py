"""A citation chain makes its edges once."""

from tessera.operators import graph


def test_a_chain_reads_edges_that_were_written_once(spark):
    e = spark.createDataFrame([("Case::a v. b", "Citation::x", "cites"), ("Citation::x", "Citation::y", "cites")], "src string, dst string, relation string").repartition(2)
    q = spark.createDataFrame([(1, "A v. B")], "q int, t string")
    found = graph.citation_chain(e, q, "q", "t", 2)
    # the plan that is left scans files: what made the edges is not in it, where it stood five times
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.node, r.hops) for r in found.collect()) == [("Case::a v. b", 0), ("Citation::x", 1), ("Citation::y", 2)]
