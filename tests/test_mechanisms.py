"""Batches, the run ledger, change events, checksums, fuzzy joins and the text index on cases that the driver's tables lack."""

import json
import math
import random
import re
import sqlite3
from types import SimpleNamespace

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.catalog import Catalog, Column, ForeignKey, Table
from tidemill.functions import fuzzy
from tidemill.operators import checksums, splits, summaries, textindex, verify
from tidemill.plans import declare
from tidemill.operators.projection import Projection
from tidemill.plans.files import Folder
from tidemill.plans.migration import Migration
from tidemill.sources import connections
from tidemill.sources.ledger import Ledger
from tidemill.sources.sqlite import SqliteReader, SqliteSource
from tidemill.streaming import changes, incremental

WIDE = "id long, part string, text string"


@pytest.fixture
def settings(spark):
    """Set options for a test."""
    before = {}

    def put(**values):
        for name, value in values.items():
            name = f"spark.sql.{name.replace('__', '.')}"
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


@pytest.mark.parametrize("partitions", ["8", "200"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_batches_of_whole_rows(spark, settings, partitions, adaptive):
    settings(shuffle__partitions=partitions, adaptive__enabled=adaptive)
    rows = [(i * 7919 % 20_011, f"p{i % 3}", "x" * (i % 900)) for i in range(6_000)] + [(5, None, "same")] * 50 + [(None, "n", f"{i}") for i in range(20)]
    df = spark.createDataFrame(rows, WIDE).repartition(7)
    found = summaries.batches(df, "id", 100).collect()
    assert sorted(((r["id"], r["part"], r["text"]) for r in found), key=repr) == sorted(rows, key=repr)
    assert sum(r["is_last"] for r in found) == 1
    sizes = {}
    for r in found:
        sizes.setdefault(r["batch"], []).append(r["id"])
    assert sorted(sizes) == list(range(61)) and all(len(v) == (100 if b < 60 else 70) for b, v in sizes.items())
    first = lambda x: -1 if x is None else x
    flat = [first(x) for b in sorted(sizes) for x in sorted(sizes[b], key=first)]
    assert flat == sorted(flat)
    assert summaries.batches(df.where("false"), "id", 100).collect() == []


def test_scratch_is_shared():
    """Without the shared folder a cluster is an error, not the driver's own disk."""
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        declare.scratch(SimpleNamespace(conf={}, sparkContext=context), "x")
    assert declare.scratch(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:///shared/"}, sparkContext=context), "x").startswith("hdfs:///shared/x-")


def ids(df):
    return sorted((r["id"], r["run"]) for r in df.collect())


def test_ledger(spark, tmp_path):
    ledger, rows = Ledger(spark, str(tmp_path)), spark.range(100)
    assert ledger.read("t", rows.schema).collect() == [] and ledger.report().collect() == []
    ledger.write("a", "t", rows.where("id < 40"), "id")
    rows.where("id < 70").write.parquet(f"{tmp_path}/t/a-dead")  # written, never counted
    Ledger(spark, str(tmp_path)).resume("b", [("t", rows, "id")])
    ledger.resume("c", [("t", rows, "id")])  # nothing is left
    assert ids(ledger.read("t", rows.schema)) == [(i, "a" if i < 40 else "b") for i in range(100)]
    assert {(r["run"], r["n_batches"], r["n_rows"], r["first_key"], r["last_key"]) for r in ledger.report().collect()} == {("a", 1, 40, "0", "39"), ("b", 1, 60, "40", "99")}
    ledger.rollback("a")
    assert ids(ledger.read("t", rows.schema)) == [(i, "b") for i in range(40, 100)]
    assert len(Folder(spark, f"{tmp_path}/t").names()) == 1
    ledger.truncate("t")
    assert ledger.read("t", rows.schema).collect() == [] and Folder(spark, f"{tmp_path}/t").names() == []


def test_ledger_race(spark, tmp_path):
    """Another writer's manifest between reading and writing is kept."""
    ledger, other = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    entry = lambda run: {"run": run, "table_name": "t", "path": f"t/{run}", "n_rows": 1, "first_key": "1", "last_key": "1", "batch": None}
    raced = []

    def edit(entries):
        if not raced:
            raced.append(other.change(lambda e: [*e, entry("other")]))
        return [*entries, entry("own")]

    ledger.change(edit)
    assert [e["run"] for e in ledger.entries()] == ["other", "own"]
    assert not ledger.folder.put_new("1.json", "lost") and "other" in ledger.folder.read("1.json")


def test_failed_write_counts_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.write("a", "t", spark.range(5), "id")
    with pytest.raises(Exception, match="broken"):
        ledger.write("b", "t", spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), "id")
    assert ids(ledger.read("t", spark.range(1).schema)) == [(i, "a") for i in range(5)]


def test_changes_in_any_order(spark, tmp_path):
    """Three runs with restarts; the events of a key come in any order, and again."""
    random.seed(3)
    schema = "k long, version long, op string, v string"
    events = [(k, v, random.choice(["created", "updated", "updated", "deleted"]), f"{k}.{v}") for k in range(40) for v in range(12)]
    last = {}
    for e in events:
        last[e[0]] = max(last.get(e[0], e), e, key=lambda x: x[1])
    random.shuffle(events)
    out = str(tmp_path)
    for i in range(3):
        part = events[i * 160 : (i + 1) * 160] + random.sample(events[: (i + 1) * 160], 30) + [(None, 99, "updated", "no key"), (1, None, "updated", "no version")]
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{out}/arrived")
        stream = spark.readStream.schema(schema).parquet(f"{out}/arrived")
        changes.apply_changes(stream, ["k"], "version", "op", out)
    left = changes.current(spark, out, stream.schema, ["k"], "version", "op")
    assert sorted(tuple(r) for r in left.collect()) == sorted(e for e in last.values() if e[2] != "deleted")


def test_many_keys_are_one_piece_of_state(spark, tmp_path, monkeypatch):
    """Keys of several columns in three buckets, over two runs."""
    monkeypatch.setattr(changes, "BUCKETS", 3)
    schema, out, keys = "a long, b string, x double, version long, op string", str(tmp_path), ["a", "b", "x"]
    events = [(k, f"{k % 3}", (-0.0, 0.0, float("nan"))[(k + v) % 2 * (k % 2) or k % 2 * 2], v, "deleted" if v == k % 7 else "updated") for k in range(30) for v in range(7)]
    for half in (1, 0):
        spark.createDataFrame([e for e in events if e[3] % 2 == half], schema).coalesce(2).write.mode("append").parquet(f"{out}/arrived")
        changes.apply_changes(spark.readStream.schema(schema).parquet(f"{out}/arrived"), keys, "version", "op", out)
    every = spark.createDataFrame(events, schema)
    want = every.groupBy(*keys).agg(F.max_by(F.struct("version", "op"), "version").alias("e")).where("e.op != 'deleted'")
    left = changes.current(spark, out, every.schema, keys, "version", "op")
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.selectExpr("a", "b", "x + 0.0", "version").collect())
    assert plain(left) == plain(want.select(*keys, "e.version"))
    states = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/state")
    assert 0 < states.count() <= 3


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    schema, out = "k long, v string, at long", str(tmp_path)
    for rows in ([(1, "a", 1), (2, "b", 1), (3, "c", 1)], [(2, "B", 2), (2, "x", 1)], [(4, "d", 3), (1, None, 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{out}/arrived")
        state = incremental.upsert_stream(spark.readStream.schema(schema).parquet(f"{out}/arrived"), out, "k", "at")
    assert sorted(tuple(r) for r in state.collect()) == [(1, "a", 3), (2, "B", 2), (3, "c", 1), (4, "d", 3)]
    assert len([n for n in Folder(spark, out).names() if n.startswith("version-")]) == 2


def states(df):
    return sorted((tuple(r[c] if c != "fields" else tuple(r[c] or ()) for c in df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_checksums_say_what_compare_says(spark, monkeypatch, seed):
    monkeypatch.setattr(checksums, "RANGES", 8)
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(400)]), rng.choice("ab") * 3, rng.random()) for _ in range(600)]
    other = [(k, "zzz" if rng.random() < 0.02 else t, v + 1e-6 * (rng.random() < 0.1)) for k, t, v in rows if rng.random() > 0.02] + [(900 + i, "new", 0.5) for i in range(3)]
    s, t = (spark.createDataFrame(x, "k int, t string, v double") for x in (rows, other))
    want = states(verify.compare(s, t, "k", ["t", "v"]))
    assert states(checksums.verify_ranges(s, t, "k", ["t", "v"])) == want
    assert {x[1] for x in want} == {"equal", "different", "missing", "extra"}
    text = lambda df: df.withColumn("k", F.concat(F.lit("key "), F.col("k")))
    assert states(checksums.verify_ranges(text(s), text(t), "k", ["t", "v"])) == states(verify.compare(text(s), text(t), "k", ["t", "v"]))


def test_equal_ranges_are_not_joined(spark, tmp_path):
    s = spark.range(20_000).withColumn("v", F.col("id") * 2)
    s.write.parquet(f"{tmp_path}/s")
    s.withColumn("v", F.col("v") + (F.col("id") == 12_345).cast("int")).write.parquet(f"{tmp_path}/t")
    s, t = (spark.read.parquet(f"{tmp_path}/{x}") for x in "st")
    ranges, nulls = checksums.differing(s, t, "id", ["v"])
    assert not nulls and len(ranges) == 1 and ranges[0][0] <= 12_345 < ranges[0][1]
    assert s.where(checksums.in_any("id", ranges)).count() < 200
    plan = checksums.verify_ranges(s, t, "id", ["v"])._jdf.queryExecution().toString()
    assert f"GreaterThanOrEqual(id,{ranges[0][0]})" in plan and f"LessThan(id,{ranges[0][1]})" in plan
    assert checksums.differing(s, s, "id", ["v"]) == ([], False)
    assert checksums.verify_ranges(s, s, "id", ["v"]).where("state <> 'equal'").isEmpty()
    assert checksums.verify_ranges(s.where("false"), t, "id", ["v"]).groupBy("state").count().collect()[0]["count"] == 20_000


def test_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k int, v string")
    assert [r["state"] for r in verify.compare(rows, rows, "k", ["v"]).collect()] == ["equal"] * 3
    more = rows.union(spark.createDataFrame([(1, "c")], rows.schema))
    assert sorted(r["state"] for r in verify.compare(rows, more, "k", ["v"]).collect()) == ["equal"] * 3 + ["extra"]
    assert sorted(r["state"] for r in verify.verified(rows, rows, "k", ["v"], sample=3).collect()) == ["equal"] * 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 1.0])
def test_near_pairs_are_all_found(spark, threshold):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abAéx_1") for _ in range(rng.randint(0, 11)))
    values, names = [word() for _ in range(120)], [word() for _ in range(120)] + ["Customer#01", "customer#02"]
    edited = [n[:i] + rng.choice(["", "q", "qq"]) + n[i + rng.randint(0, 1) :] for n in names for i in (rng.randint(0, 6),)]
    values += edited + ["CUSTOMER#03", None]
    found = fuzzy.near_pairs(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(n,) for n in names], "name string"), threshold)
    score = lambda a, b: 1.0 if not a and not b else 1 - distance(a.lower(), b.lower()) / max(len(a), len(b))
    want = {(a, b) for a in set(values) - {None} for b in set(names) if score(a, b) >= threshold}
    assert {(r["value"], r["name"]) for r in found.collect()} == want and found.count() == len(want)


def test_one_match_for_a_value(spark):
    names = spark.createDataFrame([("Abc",), ("abc",), ("orders",), (None,)], "n string")
    found = fuzzy.best_matches(spark.createDataFrame([("ABC",), ("ordrs",), ("zzzz",), (None,)], "v string"), "v", names, "n")
    assert sorted(tuple(r) for r in found.collect()) == [("ABC", "abc", 1.0), ("ordrs", "orders", pytest.approx(5 / 6))]


def test_few_candidates(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(4000)]
    values, names = spark.createDataFrame([(w,) for w in words[:2000]], "value string"), spark.createDataFrame([(w,) for w in words[2000:]], "name string")
    assert fuzzy.candidates(values, names, 0.8).count() < 2000 * 2000 / 1000


def test_text_index(spark, tmp_path):
    texts = [(1, "The cat, the CAT and the dog"), (2, "a dog"), (3, None), (4, "été 2024: naïve"), (5, " .,"), (6, "cat " * 3000), (7, "dog cat")]
    textindex.build(spark.createDataFrame([(*r, 0) for r in texts], "id int, body string, term int"), ["id"], "body", str(tmp_path))
    hits = lambda q, n=20: [r["id"] for r in textindex.search(spark, str(tmp_path), q, ["id"], n).collect()]
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts if re.search(r"\w", t or "")}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    weight = lambda ws, w: math.log(1 + (n - (df := sum(w in x for x in words.values())) + 0.5) / (df + 0.5)) * (tf := ws.count(w)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    best = sorted((-sum(weight(ws, w) for w in ("cat", "dog")), i) for i, ws in words.items() if {"cat", "dog"} & set(ws))
    assert hits("cat dog") == [i for _, i in best] and hits("Été!") == [4] and hits("nothing") == [] and hits("") == [] and len(hits("cat dog", 2)) == 2
    plan = textindex.search(spark, str(tmp_path), "cat dog", ["id"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term, [cat,dog])" in plan
    buckets = {r[0] for r in spark.createDataFrame([("cat",), ("dog",)], "t string").select(textindex.bucket_of(F.col("t"))).collect()}
    read = textindex.postings(spark, str(tmp_path), ["cat", "dog"])
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == buckets


@pytest.fixture
def shop(tmp_path):
    path = str(tmp_path / "shop's.db")
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, "odd ""name" REAL, photo BLOB, UNIQUE (name));
        CREATE TABLE orders (user_id INT REFERENCES users(id), n INT, total DOUBLE, note VARCHAR(20), PRIMARY KEY (user_id, n)); CREATE TABLE bare (k INT, v TEXT);
        CREATE VIEW some AS SELECT id FROM users;""")
    db.executemany("INSERT INTO users VALUES (?, ?, ?, ?)", [(i, f"user {i}", None if i % 3 else i / 2, bytes([i % 256])) for i in range(1000)])
    db.executemany("INSERT INTO bare VALUES (?, ?)", [(None if i % 5 == 0 else i % 7, f"v{i}") for i in range(200)])
    db.commit()
    db.close()
    return path


def test_sqlite_catalog(spark, shop):
    source = connections.source("sqlite", spark, shop)
    assert source.tables() == ["bare", "orders", "some", "users"]
    users, orders = source.catalog.tables["users"], source.catalog.tables["orders"]
    assert [(c.name, c.type, c.nullable) for c in users.columns] == [("id", "bigint", False), ("name", "string", False), ('odd "name', "double", True), ("photo", "binary", True)]
    assert users.primary_key == ("id",) and orders.primary_key == ("user_id", "n") and [(k.column, k.parent, k.parent_column) for k in orders.foreign_keys] == [("user_id", "users", "id")]
    assert [(i.columns, i.unique) for i in users.indexes] == [(("name",), True)] and source.catalog.tables["some"].view


def test_sqlite_ranges_and_filters(spark, shop):
    source = SqliteSource(spark, shop)
    users = source.read("users", ranges=8)
    assert users.rdd.getNumPartitions() == 8 and users.count() == 1000
    sizes = [r[0] for r in users.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 126
    found = users.where((F.col("id") >= 10) & (F.col("id") < 500) & F.col("odd \"name").isNotNull() & F.col("name").isin("user 12", "user 15", "user 16", "user 600") & (F.col("photo") != b"x"))
    assert sorted((r["id"], r[2], bytes(r["photo"])) for r in found.collect()) == [(12, 6.0, b"\x0c"), (15, 7.5, b"\x0f")]
    bare = source.read("bare", key="k", ranges=4)
    assert bare.count() == 200 and bare.where("k IS NULL").count() == 40 and bare.where("NOT (k = 3)").count() == sum(1 for i in range(200) if i % 5 and i % 7 != 3)
    assert source.read("orders").collect() == []
    with pytest.raises(ValueError):
        SqliteSource(spark, "hdfs://host/x.db")


def test_sqlite_filters_reach_the_reader(shop):
    schema = StructType.fromDDL("id bigint, name string, photo binary")
    reader = SqliteReader(schema, {"table": "users", "key": "id", "paths": json.dumps([shop]), "ranges": "3"})
    asked = [ds.GreaterThan(("id",), 990), ds.EqualTo(("photo",), b"x"), ds.StringContains(("name",), "9"), ds.Not(ds.EqualTo(("name",), "user 995")), ds.EqualTo(("id",), "text")]
    assert list(reader.pushFilters(asked)) == [asked[1], asked[2], asked[4]]
    rows = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("id").to_pylist()]
    assert rows == [991, 992, 993, 994, 996, 997, 998, 999]


def test_batches_are_sent_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    for _ in range(2):
        assert ledger.write("a", "t", spark.range(5), "id", batch="1") == 5
    ledger.write("a", "t", spark.range(5, 8), "id", batch="2")
    assert ids(ledger.read("t", spark.range(1).schema)) == [(i, "a") for i in range(8)]
    ledger.write("b", "t", spark.range(2), "id", replace=True)
    assert ids(ledger.read("t", spark.range(1).schema)) == [(0, "b"), (1, "b")]


def test_migration_stops_and_goes_on(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    notes = spark.createDataFrame([(10, 1, "$5"), (11, 9, "$6"), (12, None, "$7"), (13, 2, "what")], "id int, user_id int, price string")
    linked = Table("notes", (Column("user_id", "int", nullable=False),), ("id",), (ForeignKey("user_id", "users", "id"),))
    shop = Catalog.of((Table("users", primary_key=("id",)), linked))
    new = lambda: Migration(spark, {"notes": notes, "users": users}, shop, str(tmp_path), {"notes": Projection(linked, types={"price": "money"})}, parts=2)
    migration = new()
    assert migration.order() == [("users", 0), ("notes", 1)] and {r["table_name"] for r in migration.dry_run().collect()} == {"users", "notes"}
    migration.run("one", ["users"])
    before = migration.ledger.entries()
    heard = []
    new().run("two", on_part=lambda *part: heard.append(part))
    assert [h[:2] for h in heard] == [("users", 0), ("users", 1), ("notes", 0), ("notes", 1)] and sum(h[2] for h in heard) == 3
    new().run("three")  # nothing is left
    assert [e["run"] for e in new().ledger.entries()] == ["one"] * 3 + ["two"] * 3 and new().ledger.entries()[:3] == before
    assert [r["price"] for r in new().target("notes").collect()] == [5.0]
    assert sorted(tuple(r["_errors"]) for r in new().rejected("notes").collect()) == [("price",), ("userId",), ("userId",)]
    found = {r["table_name"]: r for r in new().report().collect()}
    assert (found["notes"]["n_source"], found["notes"]["n_rejected"], found["notes"]["n_equal"], found["notes"]["matches"]) == (4, 3, 1, True)
    new().ledger.rollback("two")
    assert not {r["table_name"]: r["matches"] for r in new().report().collect()}["notes"] and new().target("users").count() == 2


@pytest.mark.parametrize(("most", "sizes"), [(100, (1, 60)), (100, (0, 3)), (5, (0, 12)), (100_000, (1, 60)), (1500, (1, 60))])
def test_splits_of_groups_over_many_ranges(spark, settings, most, sizes):
    """Chunks that end within a range, span several, or never end; empty and too large rows; a null group."""
    settings(shuffle__partitions="9", adaptive__coalescePartitions__enabled="false")
    rng = random.Random(most)
    rows = [(rng.choice(["a"] * 12 + ["b", "c", None]), i, rng.randint(*sizes) if rng.random() > 0.01 else rng.choice([0, most + 1, 7 * most])) for i in range(1200)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(3)
    want, state = [], {}
    for g, k, n in rows:
        chunk, filled = state.get(g, (0, 0))
        if filled and filled + n > most:
            chunk, filled = chunk + 1, 0
        state[g] = (chunk, filled + n)
        want.append((k, chunk))
    assert summaries.dealt_in_order(df, "g", "k").select("_range").distinct().count() == 9
    assert sorted((r["k"], r["chunk"]) for r in splits.byte_chunks(df, "g", "k", "n", most).collect()) == want


def test_split_of_nothing(spark):
    assert splits.byte_chunks(spark.createDataFrame([], "g string, k long, n long"), "g", "k", "n", 10).collect() == []


def test_ranges_of_splits_hold_few_rows(spark, monkeypatch):
    """A task holds a range whole, so ranges are cut by rows, in one large group too; chunks stay the greedy ones."""
    from tidemill.operators import splits, summaries

    monkeypatch.setattr(splits, "RANGE_ROWS", 50)
    df = spark.createDataFrame([("one", i, 40 + i * 7 % 90) for i in range(600)], "g string, k long, n long")
    dealt = summaries.dealt_in_order(df, "g", "k", rows=splits.RANGE_ROWS)
    assert max(r["count"] for r in dealt.groupBy("_range").count().collect()) < 200
    want, chunk, filled = {}, 0, 0
    for i in range(600):
        size = 40 + i * 7 % 90
        if filled and filled + size > 1000:
            chunk, filled = chunk + 1, 0
        filled, want[i] = filled + size, chunk
    assert {r["k"]: r["chunk"] for r in splits.byte_chunks(df, "g", "k", "n", 1000).collect()} == want


def test_words_are_counted_within_their_row(spark):
    from tidemill.operators import textindex

    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, ["x"]), (3, ["a", "a"])], "id long, t array<string>")
    got = df.select("id", F.inline(textindex.counted(F.col("t")))).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 1), (1, "b", 3), (1, "c", 1), (2, "x", 1), (3, "a", 2)]
