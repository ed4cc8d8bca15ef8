"""Stores and write requests: what is validated, what is told to the change log, views, parts, backups."""

import pytest
from pyspark.sql import functions as F

from wideleaf.dialect import results
from wideleaf.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, PermissionDenied
from wideleaf.operators import collect, requests, writes
from wideleaf.operators import rowfilters as R
from wideleaf.store import CELLS, VIEWS_OF_TABLE, Store
from wideleaf.streaming import changes

NOW = 1_700_000_000_000_000


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create_table("t", {"f": "bytes", "g": "bytes"}, gc={"g": collect.MaxVersions(1)})
    s.load("t", spark.createDataFrame([(k, f, 0, q, ts * 1000, b"%d" % ts, ts) for k in (b"a#1", b"a#2", b"b#1") for f in "fg" for q in (b"x", b"y") for ts in (1, 2)], CELLS))
    return s


def entries(spark, *rows):
    return spark.createDataFrame([(e, m, k, op, f, q, ts, end, v) for e, m, k, op, f, q, ts, end, v in rows], requests.ENTRIES)


def keyed(df):
    return sorted((bytes(r.row_key), r.family, bytes(r.qualifier), r.ts // 1000) for r in df.collect())


def test_statuses(spark, store):
    got = store.mutate("t", entries(
        spark, (0, 0, b"", "set", "f", b"x", 1000, None, b"v"), (1, 0, b"k" * 5000, "set", "f", b"x", 1000, None, b"v"), (2, 0, b"k", "set", "no", b"x", 1000, None, b"v"), (3, 0, b"k", "set", "f", b"x", 1000, None, b"v"),
        (3, 1, b"k", "set", "f", b"x", 1001, None, b"v"), (4, 0, b"k", "del_column", "f", b"x", 2000, 2000, None), (5, 0, b"k", "fly", "f", b"x", 2000, 2000, None), (6, 0, b"ok", "set", "f", b"x", -1, None, b"v"), (7, 0, b"k", "set", "f", b"x", -2, None, b"v"),
    ), NOW + 1)
    found = {r.entry_no: r.status for r in got.collect()}
    assert [found[k].split(":")[0] for k in range(8)] == ["INVALID_ARGUMENT"] * 2 + ["NOT_FOUND"] + ["INVALID_ARGUMENT"] * 3 + ["OK", "INVALID_ARGUMENT"]
    assert found[3] == "INVALID_ARGUMENT: mutation 1: a timestamp finer than the table's"
    # An entry with a fault leaves nothing behind; a time of -1 is now, to the millisecond.
    assert [(r.ts, bytes(r.value)) for r in store.cells("t").where("row_key >= X'6b'").collect()] == [(NOW, b"v")]


def test_writes_read_back(spark, store):
    store.mutate("t", entries(spark, (0, 0, b"a#1", "del_row", None, None, None, None, None), (0, 1, b"a#1", "set", "f", b"z", 5000, None, b"1"), (1, 0, b"a#1", "set", "f", b"z", 5000, None, b"2"), (2, 0, b"b#1", "del_column", "f", b"x", 0, 2000, None)), NOW)
    after = keyed(store.cells("t"))
    assert [x for x in after if x[0] == b"a#1"] == [(b"a#1", "f", b"z", 5)] and (b"b#1", "f", b"x", 1) not in after and (b"b#1", "f", b"x", 2) in after and sum(x[0] == b"a#2" for x in after) == 8
    log = changes.read(spark, store.changes_path("t")).collect()
    assert [(bytes(r.row_key), r.type, [m.op for m in r.mutations], [m.family for m in r.mutations]) for r in log] == [(b"a#1", "USER", ["del_family", "del_family", "set", "set"], ["f", "g", "f", "f"]), (b"b#1", "USER", ["del_column"], ["f"])]
    assert keyed(Store(spark, store.path).cells("t")) == after  # what another process finds
    store.compact("t", NOW)
    assert keyed(store.cells("t")) == [x for x in after if x[1] == "f" or x[3] == 2] and not store.table("t")["deltas"]
    collected = [r for r in changes.read(spark, store.changes_path("t")).collect() if r.type == "GARBAGE_COLLECTION"]
    assert {bytes(r.row_key): len(r.mutations) for r in collected} == {b"a#2": 2, b"b#1": 2} and collected[0].id > log[-1].id


def test_conditions(spark, store):
    keys = spark.createDataFrame([(b"a#1",), (b"none",)], "row_key binary")
    yes = entries(spark, (0, 0, b"a#1", "set", "f", b"m", 1000, None, b"yes"), (1, 0, b"none", "set", "nope", b"m", 1000, None, b"yes"))
    no = entries(spark, (2, 0, b"none", "set", "f", b"m", 1000, None, b"no"))
    # The predicate sees collected cells: of family g one version is left.
    predicate = R.Chain((R.FamilyRegex(b"g"), R.TimestampRange(0, 2000)))
    assert {bytes(r.row_key): r.matched for r in store.check_and_mutate("t", keys, predicate, no.limit(0), no.limit(0), NOW).collect()} == {b"a#1": False, b"none": False}
    got = {bytes(r.row_key): (r.matched, r.status) for r in store.check_and_mutate("t", keys, None, yes, no, NOW).collect()}
    assert got == {b"a#1": (True, "OK"), b"none": (False, "OK")}
    assert {bytes(r.row_key): bytes(r.value) for r in store.cells("t").where("qualifier = X'6d'").collect()} == {b"a#1": b"yes", b"none": b"no"}


def test_rules(spark, store):
    rules = [(b"a#1", "f", b"x", 0, b"!", None), (b"a#1", "f", b"x", 1, b"?", None), (b"n", "f", b"c", 0, None, 5), (b"n", "f", b"c", 1, None, -7), (b"b#1", "f", b"x", 0, None, 1)]
    made = store.read_modify_write("t", spark.createDataFrame(rules, writes.RULES), NOW)
    got = {bytes(r.row_key): (r.value and bytes(r.value), r.error) for r in made.collect()}
    assert got[b"a#1"] == (b"2!?", None) and got[b"n"] == ((-2).to_bytes(8, "big", signed=True), None) and got[b"b#1"][0] is None and "1 bytes" in got[b"b#1"][1]
    newest = store.cells("t").where("row_key = X'612331' and family = 'f' and qualifier = X'78'").orderBy(F.desc("ts")).first()
    assert (newest.ts, bytes(newest.value)) == (NOW, b"2!?")
    with pytest.raises(InvalidArgument):
        store.read_modify_write("t", spark.createDataFrame([(b"a", "nope", b"x", 0, b"!", None)], writes.RULES), NOW)


def test_tokens(spark):
    asked = spark.createDataFrame([(0, b"a", b"12345678"), (1, b"a", b"12345678"), (2, b"b", b"12345678"), (3, b"a", b""), (4, b"a", None), (5, b"a", b"1"), (6, b"c", b"12345678")], "entry_no long, row_key binary, token binary")
    seen = spark.createDataFrame([(b"b", b"12345678", NOW + 1), (b"c", b"12345678", NOW)], "row_key binary, token binary, expire_us long")
    got = requests.fresh(asked, seen, NOW)
    assert [r.status.split(":")[0] for r in got.orderBy("entry_no").collect()] == ["OK", "DONE", "DONE", "OK", "OK", "INVALID_ARGUMENT", "OK"]
    assert sorted((bytes(r.row_key), r.expire_us - NOW) for r in requests.remembered(got, NOW).collect()) == [(b"a", 900_000_000), (b"c", 900_000_000)]


def test_a_write_is_applied_once(spark, store):
    batch = lambda v: entries(spark, (0, 0, b"k", "set", "f", b"x", 1000, None, v), (1, 0, b"l", "set", "f", b"x", 1000, None, v), (2, 0, b"m", "set", "f", b"x", 1000, None, v))
    tokens = spark.createDataFrame([(0, b"token-of-k"), (1, b"short")], "entry_no long, token binary")
    status = lambda v, at: {r.entry_no: r.status.split(":")[0] for r in store.mutate("t", batch(v), at, tokens=tokens).collect()}
    value = lambda: {bytes(r.row_key): bytes(r.value) for r in store.cells("t").where("row_key > X'6a'").collect()}
    assert status(b"1", NOW) == {0: "OK", 1: "INVALID_ARGUMENT", 2: "OK"} and value() == {b"k": b"1", b"m": b"1"}
    assert status(b"2", NOW + 1) == {0: "OK", 1: "INVALID_ARGUMENT", 2: "OK"} and value() == {b"k": b"1", b"m": b"2"}
    assert status(b"3", NOW + requests.TOKEN_MICROS) == {0: "OK", 1: "INVALID_ARGUMENT", 2: "OK"} and value() == {b"k": b"3", b"m": b"3"}


def test_dropped_rows(spark, store):
    store.drop_row_range("t", b"a#", NOW)
    assert {x[0] for x in keyed(store.cells("t"))} == {b"b#1"}
    assert [(bytes(r.row_key), [(m.op, m.family) for m in r.mutations]) for r in changes.read(spark, store.changes_path("t")).collect()] == [(k, [("del_family", "f"), ("del_family", "g")]) for k in (b"a#1", b"a#2")]
    with pytest.raises(InvalidArgument):
        store.drop_row_range("t", b"", NOW)
    store.drop_row_range("t", None, NOW)
    assert store.sql("SELECT COUNT(*) AS n FROM t").first().n == 0


def test_views(spark, store):
    store.create_view("v", "SELECT _key, CAST(f['x'] AS STRING) AS x FROM t")
    assert store.sql("SELECT COUNT(*) AS n FROM v WHERE x = '2'").first().n == 3
    for wrong in ("SELECT nope FROM t", "SELECT 1 FROM nowhere", "SELEC 1"):
        with pytest.raises((InvalidArgument, NotFound)):
            store.create_view("w", wrong)
    with pytest.raises(AlreadyExists):
        store.create_view("t", "SELECT 1 AS a")
    with pytest.raises(InvalidArgument):
        store.create_materialised("h", "t", "@{allow_incomplete_view=true} SELECT _key, COUNT(*) AS n FROM t GROUP BY _key")
    store.create_materialised("m", "t", "SELECT CAST(f['x'] AS STRING) AS x, COUNT(*) AS n FROM t GROUP BY x")
    read = lambda: [tuple(r) for r in store.sql("SELECT x, n FROM m").collect()]
    assert store.is_stale("m") and read() == [("2", 3)] and not store.is_stale("m")
    store.mutate("t", entries(spark, (0, 0, b"c", "set", "f", b"x", 1000, None, b"7")), NOW)
    assert store.is_stale("m") and read() == [("2", 3), ("7", 1)]
    assert sorted((bytes(r.qualifier), int.from_bytes(r.value, "big")) for r in R.apply(store.view_cells("m"), R.FamilyRegex(b"default")).collect()) == [(b"n", 1), (b"n", 3)]
    for k in range(VIEWS_OF_TABLE - 1):
        store.create_materialised(f"m{k}", "t", "SELECT _key, COUNT(*) AS n FROM t GROUP BY _key")
    with pytest.raises(FailedPrecondition):
        store.create_materialised("more", "t", "SELECT _key, COUNT(*) AS n FROM t GROUP BY _key")
    with pytest.raises(FailedPrecondition):
        store.drop_table("t", NOW)


def test_authorised_parts(spark, store):
    store.create_authorised("p", "t", [b"a#"], {"f": ([b"x"], []), "g": ([], [b""])})
    assert {x[:3] for x in keyed(store.authorised("p"))} == {(k, f, q) for k in (b"a#1", b"a#2") for f, q in (("f", b"x"), ("g", b"x"), ("g", b"y"))}
    fine = [(0, 0, b"a#9", "set", "f", b"x", 1000, None, b"v"), (1, 0, b"a#9", "del_family", "g", None, None, None, None)]
    assert {r.status for r in store.mutate("t", entries(spark, *fine), NOW, view="p").collect()} == {"OK"}
    for bad in ((0, 0, b"b", "set", "f", b"x", 1000, None, b"v"), (0, 0, b"a#", "set", "f", b"y", 1000, None, b"v"), (0, 0, b"a#", "del_family", "f", None, None, None, None), (0, 0, b"a#", "del_row", None, None, None, None, None)):
        with pytest.raises(PermissionDenied):
            store.mutate("t", entries(spark, bad), NOW, view="p")


def test_catalogue(spark, store):
    token = store.token("t")
    assert store.is_consistent(token)
    store.alter_families("t", create={"h": "bytes"}, drop=["g"], gc={"f": collect.MaxAge(5000)})
    assert store.is_consistent(token) and {x[1] for x in keyed(store.cells("t"))} == {"f"} and not keyed(store.cells("t", NOW))
    with pytest.raises(InvalidArgument):
        store.is_consistent("t@99")
    for wrong in ({"create": {"f": "bytes"}}, {"drop": ["nope"]}):
        with pytest.raises((AlreadyExists, NotFound)):
            store.alter_families("t", **wrong)
    store.backup("b", "t", NOW + 10, NOW)
    store.copy_backup("b", "c", NOW + 20, NOW)
    store.drop_table("t", NOW)
    with pytest.raises(NotFound):
        store.cells("t")
    with pytest.raises(AlreadyExists):
        store.restore("b", "t", NOW)
    store.restore("c", "again", NOW + 15)
    assert len(keyed(store.cells("again"))) == 12 and store.backups(NOW + 15) == ["c"] and store.tables() == ["again"]
    with pytest.raises(NotFound):
        store.restore("b", "more", NOW + 15)
    store.delete_backup("c")
    week = 7 * 86_400_000_000
    with pytest.raises(NotFound):
        store.undelete_table("t", NOW + week + 1)
    store.undelete_table("t", NOW + week)
    store.drop_table("t", NOW)
    assert store.purge_tables(NOW + week + 1) == ["t"] and store.purge_tables(NOW + week + 1) == []


def test_results_resume(spark, store):
    result = store.sql("SELECT _key, CAST(f['x'] AS STRING) AS x FROM t")
    every = [r for b in results.stream(result) for r in b.rows()]
    small = list(results.stream(result, size=1))
    assert [b.token for b in small] == [b"1", b"2", b"3"] and [r for b in small for r in b.rows()] == every
    assert [r for b in results.stream(result, small[0].token) for r in b.rows()] == every[1:]
    with pytest.raises(InvalidArgument):
        results.Batch(small[0].data, 0, b"1").rows()
    with pytest.raises(InvalidArgument):
        next(results.stream(result, b"x"))


def test_ranges_reach_the_scan(spark, store):
    plan = store.sql("SELECT _key FROM t WHERE _key >= 'a#2' AND _key < 'b'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(row_key" in plan.split("PushedFilters")[1].split("\n")[0]
