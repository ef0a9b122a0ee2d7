"""Keys, links and hierarchies on small tables."""

from tidemill.operators import discovery, hierarchy


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ancestors(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 3), (5, 1), (6, None), (None, 1), (7, 7), (8, 9), (9, 10), (10, 8), (11, 8), (3, 2)], "id int, boss int")
    found = hierarchy.ancestors(links, "id", "boss")
    assert rows(found, "node", "ancestor", "depth") == sorted(
        [(2, 1, 1), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2), (4, 1, 3), (5, 3, 1), (5, 2, 2), (5, 1, 1), (7, 7, 1)]
        + [(a, b, (order.index(b) - order.index(a) - 1) % 3 + 1) for order in ([8, 9, 10],) for a in order for b in order]
        + [(11, 8, 1), (11, 9, 2), (11, 10, 3)]
    )
    assert rows(hierarchy.rings(found), "node", "ring") == [(7, 7), (8, 8), (9, 8), (10, 8)]
    assert hierarchy.ancestors(links.where("false"), "id", "boss").collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.range(1, 130).selectExpr("id", "id - 1 AS up")
    found = hierarchy.ancestors(chain, "id", "up")
    assert found.count() == 129 * 130 // 2 and found.agg({"depth": "max"}).first()[0] == 129


def test_keys(spark):
    df = spark.createDataFrame([(i // 3, i % 3, None if i == 5 else i, "x" * 100 + str(i), float(i), f"n{i}") for i in range(30)], "a int, b int, holes int, long string, f double, name string")
    assert discovery.keys_of(df) == [("name",), ("a", "b")]
    assert discovery.keys_of(df.union(df)) == [] and discovery.keys_of(df.where("false")) == []


def test_links(spark):
    parents = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "p_id long, p_name string")
    children = spark.createDataFrame([(i, i % 7 if i % 5 else None, i % 60, f"p{i % 9}") for i in range(200)], "c_key int, c_id int, c_other int, x_name string")
    found = discovery.links_of({"parents": parents, "children": children})
    want = [("children", "c_id", "parents", "p_id", 7), ("children", "x_name", "parents", "p_name", 9)]
    assert rows(found, "child", "column_name", "parent", "parent_column", "n_values") == want
    every = rows(discovery.links_of({"parents": parents, "children": children}, named=False), "child", "column_name", "parent", "parent_column")
    assert ("parents", "p_id", "children", "c_key") in every and not any(c == "c_other" and k == "p_id" for _, c, _, k in every)


def test_rings_without_all_ancestors(spark, monkeypatch):
    """A long tail into a ring of 13, a ring of one, rows that end nowhere; a round prolongs only the longest paths, in parts."""
    monkeypatch.setattr(hierarchy, "PART_ROWS", 40)
    links = [(100 + i, 101 + i) for i in range(70)] + [(170, 200), *((200 + i, 200 + (i + 1) % 13) for i in range(13))] + [(5, 5), (6, 5), (1, 2), (2, 3), (None, 4), (4, None)]
    df = spark.createDataFrame(links, "id long, boss long")
    want = [(5, 5), *((200 + i, 200) for i in range(13))]
    found = hierarchy.ancestors(df, "id", "boss")
    assert found.rdd.getNumPartitions() > 1
    assert {r["depth"] for r in found.where("node = 100 and ancestor = 205").collect()} == {76}
    for got in (hierarchy.rings_of(df, "id", "boss"), hierarchy.rings_of(df.union(spark.createDataFrame([(1, 3)], df.schema)), "id", "boss"), hierarchy.rings(found)):
        assert rows(got, "node", "ring") == want
    assert hierarchy.rings_of(df.where("id < 5"), "id", "boss").collect() == []
