from kalends.operators.components import connected_components
from kalends.session import spread


def test_partitions_follow_the_rows_and_go_back(spark):
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    with spread(spark, 40_000_000):
        assert int(spark.conf.get(name)) == max(40, int(own))
    with spread(spark, 10):
        assert spark.conf.get(name) == own
    assert spark.conf.get(name) == own


def test_components_ask_for_partitions_by_their_edges(spark, monkeypatch):
    asked = []
    monkeypatch.setattr("kalends.operators.components.spread", lambda s, rows: asked.append(rows) or spread(s, rows))
    connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
    assert asked[:2] == [30, 60]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}
    stored = connected_components(spark.createDataFrame(edges, "a long, b long"), many=0)
    assert {r.node: r.component for r in stored.collect()} == got


def test_stars_and_no_edges(spark):
    edges = [(1, 0), (2, 0), (3, 0), (9, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
