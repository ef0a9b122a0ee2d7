"""Functions of the core on values that the driver's tables lack: nulls, empty tables, hostile texts, cycles, errors."""

import pytest
from pyspark.sql import functions as F

from tidemill import catalog
from tidemill.functions import converters, naming
from tidemill.operators import advice, checks, docstore, graph, masking, projection, splits, summaries, verify
from tidemill.sources import connections, sinks


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", fn("v").alias("out")).collect())]


def test_arrays(spark):
    texts = ["{}", "{a,b}", '{"a,b",NULL,c}', '{"NULL",null, x }', r'{"q\"x","b\\s"}', "{,a,}", "no array", None, "{a,{b}}", '{"open}']
    want = [[], ["a", "b"], ["a,b", None, "c"], ["NULL", None, "x"], ['q"x', "b\\s"], ["", "a", ""], None, None, None, None]
    assert column(spark, texts, converters.pg_array) == want


def test_converters(spark):
    assert column(spark, ["[1,5)", "(,7]", '["a","b")', "empty", None], converters.range_) == [("1", "5", "[)"), (None, "7", "(]"), ("a", "b", "[)"), None, None]
    assert column(spark, ["1e3", "NaN", "-Infinity", "x", None], converters.finite) == [1000.0, None, None, None, None]
    assert column(spark, ['"a"=>"1", "b"=>NULL', "", None], converters.hstore) == [{"a": "1", "b": None}, {}, None]
    assert column(spark, ['a=>1, "a"=>"2", "q\\"x"=>"b, \\\\c=>d"', 'k=>null,"n"=>"NULL"'], converters.hstore) == [{"a": "1", 'q"x': "b, \\c=>d"}, {"k": None, "n": "NULL"}]
    assert column(spark, ["(1.5,-2)", " ( 1e3 , .5 )", "garbage", None, "(1,)", "(1,2,3)"], converters.point) == [(1.5, -2.0), (1000.0, 0.5), None, None, None, None]
    assert column(spark, ["$1,234.50", "-$2", "x", ""], converters.money) == [1234.5, -2.0, None, None]
    with pytest.raises(ValueError):
        converters.unknown("v", "other")


def test_epoch_is_the_same_in_every_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.sql("SELECT timestamp_ntz'1970-01-02 00:00:00.5' AS a, date'1969-12-31' AS b, CAST(NULL AS timestamp_ntz) AS c")
            assert df.select(*(converters.epoch_ms(c) for c in "abc")).first()[:] == (86_400_500, -86_400_000, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_names():
    assert [naming.camel(x) for x in ("order_key", "__ORDER_key", "a", "")] == ["orderKey", "__orderKey", "a", ""]
    assert (naming.pascal("order_key"), naming.snake("orderKeyId"), naming.snake("OrderKey")) == ("OrderKey", "order_key_id", "order_key")
    assert (naming.field_name("class"), naming.field_name("_id"), naming.field_name("klass")) == ("class_", "_id_", "klass")
    assert naming.is_identifier("a_1") and not naming.is_identifier("1a") and not naming.is_identifier("for")
    assert (naming.identifier("1 a-b"), naming.identifier("")) == ("_1_a_b", "_")
    assert naming.literal("it's\n\\") == r"'it\'s\n\\'"
    assert (naming.quoted('a"b'), naming.quoted("a`b", "mysql"), naming.quoted("a]b", "mssql")) == ('"a""b"', "`a``b`", "[a]]b]")
    assert (naming.readable_bytes(1536), naming.readable_seconds(3725)) == ("1.5 KB", "1h 2m")


def test_connections():
    c = connections.parse_connection("postgres://u%40x:p%2Fw@db.neon.tech/shop?sslmode=require")
    assert (c.kind, c.host, c.port, c.user, c.password, c.database, c.options) == ("postgresql", "db.neon.tech", 5432, "u@x", "p/w", "shop", {"sslmode": "require"})
    assert connections.parse_connection(c.url) == c and "p/w" not in repr(c) and connections.provider(c.host) == "neon"
    assert c.jdbc()["url"] == "jdbc:postgresql://db.neon.tech:5432/shop"
    assert connections.parse_connection("sqlite:///a/b.db").database == "a/b.db" and connections.parse_connection("sqlite:").database == ":memory:"
    for bad in ("", "  ", "nothing", "oracle://h/d", "mysql:///d", "mysql://h", "mysql://h:99999/d", "mysql://h:x/d"):
        with pytest.raises(ValueError):
            connections.parse_connection(bad)


def test_sources(spark):
    found = connections.source("parquet", spark, "/root/testdata/sf0.001")
    assert found.read("region").count() == 5 and [c.name for c in found.described().tables["region"].columns] == ["r_regionkey", "r_name"]
    connections.register_source("own", lambda: found)
    assert connections.source("own") is found
    with pytest.raises(ValueError):
        connections.source("none")


def test_json_array(spark):
    assert sinks.json_array(spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1)) == '[{"a": 1}, {"a": 2, "b": "x"}]'
    with pytest.raises(ValueError):
        sinks.json_array(spark.range(11), most=10)


def test_upsert_and_update(spark):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, s string, v double")
    changes = spark.createDataFrame([(1, None), (2, "y"), (2, "x"), (3, "new"), (None, "lost")], "k int, s string")
    rows = lambda df: sorted(df.collect(), key=repr)
    assert rows(docstore.upsert(table, changes, "k")) == sorted([(1, "a", 1.0), (2, "y", 2.0), (3, "new", None), (None, "n", 0.0)], key=repr)
    assert rows(docstore.update(table, changes, "k")) == sorted([(1, "a", 1.0), (2, "y", 2.0), (None, "n", 0.0)], key=repr)
    assert rows(docstore.upsert(table.where("false"), changes.where("k = 3"), "k")) == [(3, "new", None)]
    assert rows(docstore.upsert(table, changes.where("false"), "k")) == rows(table)
    assert docstore.remove(table, changes, "k").count() == 1


def test_lookups(spark):
    table = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, s string")
    assert docstore.unique(table, k=2).collect() == [(2, "a")] and docstore.unique(table, k=9).count() == 0 and docstore.unique(table, s=None).collect() == [(3, None)]
    with pytest.raises(Exception, match="several rows"):
        docstore.unique(table, s="a").collect()
    assert docstore.find(table).count() == 3 and docstore.exists(table, s="z").first()[0] is False
    first = docstore.page(table, "k", size=2).collect()
    assert [(r["k"], r["next"]) for r in first] == [(3, 2), (2, 2)]
    assert [(r["k"], r["next"]) for r in docstore.page(table, "k", before=2, size=2).collect()] == [(1, None)]
    assert docstore.page(table.where("false"), "k").count() == 0 and docstore.search(table, "s", "((").count() == 0


def test_compare(spark):
    schema = "k int, s string, v double, t timestamp_ntz"
    row = lambda k, s="x", v=1.0, t="2024-01-01 00:00:00": (k, s, v, t)
    make = lambda rows: spark.createDataFrame(rows, "k int, s string, v double, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).to(spark.createDataFrame([], schema).schema)
    source = make([row(1), row(2), row(3, '{"a": [1]}'), row(4, None), row(5, v=None), row(6), row(None)])
    target = make([row(1, v=1.00001, t="2024-01-01 00:00:01"), row(2, "y", 2.0, "2024-01-01 00:00:03"), row(3, '{"a":[1]}'), row(4, ""), row(5), row(7), row(None)])
    got = {r["k"]: (r["state"], r["fields"]) for r in verify.compare(source, target, "k", ["s", "v", "t"]).collect()}
    assert got == {1: ("equal", []), 2: ("different", ["s", "v", "t"]), 3: ("equal", []), 4: ("different", ["s"]), 5: ("different", ["v"]), 6: ("missing", None), 7: ("extra", None), None: ("equal", [])}
    assert verify.summary(verify.compare(source.where("false"), target.where("false"), "k", "s")).first()["matches"] is True


CLAUSES = {
    "CHECK (v >= 0 AND v <= 10)": [True, False, True, None], "CHECK (((v >= (0)::numeric) AND (v <= (10)::numeric)))": [True, False, True, None],
    "CHECK (length(s) <= 2)": [True, True, False, None], "CHECK ((char_length((s)::text) >= 2))": [False, True, True, None], "CHECK (s IN ('a', 'bb'))": [True, True, False, None],
    "CHECK ((s = ANY (ARRAY['a'::text, 'ccc'::text])))": [True, False, True, None], "CHECK (v IS NOT NULL)": [True, True, True, False], "CHECK (NOT (v BETWEEN 1 AND 5))": [False, True, True, None],
    "CHECK (b = true)": [True, False, True, None], "CHECK (v > 50 OR s = 'a')": [True, True, False, None], "CHECK (v < w)": [True, False, True, None],
}


def test_check_clauses(spark):
    df = spark.createDataFrame([(0, "a", 1.0, True, 2.0), (1, "bb", 99.0, False, 3.0), (2, "ccc", 10.0, True, 11.0), (3, None, None, None, None)], "i int, s string, v double, b boolean, w double")
    for clause, want in CLAUSES.items():
        assert [r[0] for r in df.orderBy("i").select(checks.parsed(clause, df.columns)).collect()] == want, clause
    for bad in ("CHECK (s ~ '^a')", "CHECK (nothing > 1)", "CHECK (v > 1", "v > 1; DROP TABLE x", "CHECK (v >)", "", "CHECK (lower(s) = 'a')", "CHECK (v = ANY (s))"):
        with pytest.raises(checks.Unsupported):
            checks.parsed(bad, df.columns)
    fine, broken = checks.enforced(df, ["CHECK (v <= 10)", "CHECK (b)"])
    assert {r["i"] for r in fine.collect()} == {0, 2, 3} and [(r["i"], len(r["_errors"])) for r in broken.collect()] == [(1, 2)]


def test_graph():
    chain = [("posts", "users"), ("comments", "posts")]
    assert graph.order(chain, ["comments", "posts", "users"]) == ["users", "posts", "comments"]
    diamond = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]
    assert graph.levels(diamond) == {"a": 0, "b": 1, "c": 1, "d": 2} and graph.roots(diamond, "abcd") == ["a"] and graph.leaves(diamond, "abcd") == ["d"]
    assert graph.cycles([("a", "b"), ("b", "a"), ("c", "a")]) == [("a", "b")] and graph.cycles([("a", "b"), ("b", "c"), ("c", "a")]) == [("a", "b", "c")] and graph.cycles(diamond) == []
    assert graph.order([("a", "b"), ("b", "a"), ("c", "a")], ["c", "a", "b", "z"]) == ["z", "c", "a", "b"]
    assert graph.closure([("a", "b"), ("b", "a")], "a") == {"a", "b"} and graph.levels([], ["x"]) == {"x": 0}
    ring = catalog.Catalog.of((catalog.Table("a", (catalog.Column("b_id"),), foreign_keys=(catalog.ForeignKey("b_id", "b", "id"),)), catalog.Table("b", (catalog.Column("a_id", nullable=False),), foreign_keys=(catalog.ForeignKey("a_id", "a", "id"),))))
    assert graph.breaks(ring) == [("a", "b_id", "b")] and advice.mutual_pairs(ring) == [("a", "b")] and advice.blockers(ring) == []


def test_catalog():
    assert set(catalog.DRIVER.chosen(["orders"]).tables) == {"orders", "customer", "nation", "region"}
    assert catalog.parse_name("sales_orders", ["sales", "s"]) == ("sales", "orders") and catalog.parse_name("orders", ["sales"]) == ("public", "orders")
    twice = catalog.Catalog.of((catalog.Table("t", (catalog.Column("a"), catalog.Column("a", nullable=False, identity=True)), indexes=(catalog.Index("i", ("a",)), catalog.Index("j", ("a",)))), catalog.Table("p", schema="pg_catalog")))
    (t,) = twice.tables.values()
    assert len(t.columns) == len(t.indexes) == 1 and t.columns[0].identity and not t.columns[0].nullable
    assert projection.creatable(t) == {} and projection.filterable(advice.SHOP.tables["orders"]) == ["id", "user_id", "status", "deleted_at", "total"]
    assert advice.search_index(advice.SHOP.tables["products"]) == ("title", ["kind_type"]) and advice.is_auth_table(advice.SHOP.tables["users"]) and not advice.is_auth_table(advice.SHOP.tables["orders"])


def test_projection(spark):
    table = catalog.Table("t", (catalog.Column("id", nullable=False), catalog.Column("p_id", nullable=False)), ("id",), (catalog.ForeignKey("p_id", "p", "id"),))
    df = spark.createDataFrame([(1, 1, "x", ""), (2, 9, "y", "b"), (3, None, None, None)], "id int, p_id int, class string, some_text string")
    made = projection.Projection(table, empty_as_null=True).documents(df, {"p": spark.createDataFrame([(1,)], "id int")})
    got = {r["_id"]: (r["pId"], r["class_"], r["someText"], r["_errors"]) for r in made.collect()}
    assert got == {"t:0000000000000001": ("p:0000000000000001", "x", None, []), "t:0000000000000002": (None, "y", "b", ["pId"]), "t:0000000000000003": (None, None, None, ["pId"])}


def test_masks(spark):
    df = spark.createDataFrame([(1, "a@x.y", "Ann", None), (2, None, None, "c")], "id int, email string, user_name string, note string")
    got = masking.masked(df, {"email": ("email", {}), "missing": ("hash", {}), "note": lambda c: F.upper(c)}).orderBy("id").collect()
    assert [(r["email"], r["note"]) for r in got] == [("a*a@x.y", None), (None, "C")]
    made = masking.anonymized(df, "id").orderBy("id").collect()
    assert made == masking.anonymized(df.repartition(3), "id").orderBy("id").collect() and made[0]["user_name"] != "Ann" and made[1]["email"] is None and made[1]["note"] == "c"


def test_batches_and_chunks(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("k")).repartition(5)
    got = {r["k"]: (r["batch"], r["is_last"]) for r in summaries.batches(df, "k", 100).collect()}
    assert got == {k: (k // 100, k == 1002) for k in range(1003)} and summaries.batches(df.where("false"), "k", 10).count() == 0
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([50, 60, 500, 10, 20, 80])] + [("h", 0, 10)], "g string, k int, n int")
    assert [(r["g"], r["k"], r["chunk"]) for r in sorted(splits.byte_chunks(rows, "g", "k", "n", 100).collect())] == [("g", 0, 0), ("g", 1, 1), ("g", 2, 2), ("g", 3, 3), ("g", 4, 3), ("g", 5, 4), ("h", 0, 0)]


def test_ids_and_names_that_run_together(spark):
    df = spark.createDataFrame([("x|=y", "z"), ("x", "y|=z"), ("x", None), ("x", ""), ("1:a", "")], "a_b string, a__b string")
    assert df.select(projection.row_id("t", ["a_b", "a__b"])).distinct().count() == 5
    made = projection.Projection(catalog.Table("t")).documents(df)
    assert made.columns == ["_id", "aB", "aB2", "_errors"] and made.count() == 5


def test_conversions_by_type_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "n/a"), (3, "c", "x")], "id int, name string, code string")
    rule = projection.Projection(catalog.Table("t", primary_key=("id",)), types={"code": "code"}, convert={"code": lambda c: F.when(c != "n/a", F.upper(c)), "string": F.upper}, valid={"named": F.col("name").isNotNull()})
    made = rule.documents(df).orderBy("_id")
    assert [(r["name"], r["code"], r["_errors"]) for r in made.collect()] == [("A", None, []), (None, None, ["code", "named"]), ("C", "X", [])]
    assert [r[0] for r in made.select(projection.as_json("name", "code")).collect()] == ['{"name":"A"}', "{}", '{"name":"C","code":"X"}']
