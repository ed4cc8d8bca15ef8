"""Queries over stores and write requests, each with SQL for DuckDB.  Each makes its tables in a folder of its own."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideleaf.catalogue import _EV, _T15, _T20, _folder
from wideleaf.dialect import results
from wideleaf.errors import WideleafError
from wideleaf.operators import collect, requests, rows, writes
from wideleaf.operators import rowfilters as R
from wideleaf.plans import views
from wideleaf.sources import cells as C
from wideleaf.store import VIEWS_OF_TABLE, Store
from wideleaf.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_FAMILIES = requests.Families(("ev",))
#: Fixed value: as many batches are written at once.
_HELD = 1024


def _key() -> Column:
    return C.text("row_key").alias("row_key")


def _query(sql: str):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _entries(keys: DataFrame, number: Column, *mutations: dict) -> DataFrame:
    """An entry for each row of ``keys`` (row_key), with these mutations."""
    kinds = {"op": "string", "family": "string", "qualifier": "binary", "start_ts": "long", "end_ts": "long", "value": "binary"}
    listed = F.array(*[F.struct(F.lit(k).alias("mut_no"), *[(x if isinstance(x := m.get(n), Column) else F.lit(x)).cast(t).alias(n) for n, t in kinds.items()]) for k, m in enumerate(mutations)])
    return keys.select(number.cast("long").alias("entry_no"), "row_key", F.explode(listed).alias("m")).select("entry_no", "m.mut_no", "row_key", *[f"m.{n}" for n in kinds])


def _number() -> Column:
    return F.regexp_extract(C.text("row_key"), r"(\d+)$", 1).cast("long")


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events_by_user(spark, sf_dir).select("row_key").distinct()


def _loaded(spark: SparkSession, name: str, cells: DataFrame, families: dict[str, str], **options) -> Store:
    store = Store(spark, _folder(spark, name))
    store.create_table("t", families, **options)
    store.load("t", cells)
    return store


@_query("SELECT printf('c%06d#%08d', o_custkey, o_orderkey) AS row_key, o_orderstatus AS status FROM orders WHERE o_custkey BETWEEN 10 AND 19")
def store_key_range(spark, sf_dir):
    """A range of keys over stored cells: the plan's scan has the range among its pushed filters."""
    store = _loaded(spark, "orders", C.orders(spark, sf_dir), {"o": "bytes"})
    return store.sql("SELECT CAST(_key AS STRING) AS row_key, CAST(o['status'] AS STRING) AS status FROM t WHERE _key >= 'c000010' AND _key < 'c000020'", ordered=False)


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts, 'second' AS value FROM ev WHERE qualifier <> 'click'")
def write_ties(spark, sf_dir):
    """Of cells written twice at one time the last write holds, in whatever order they come; a delete of a column takes both."""
    old = C.events_by_user(spark, sf_dir)
    again = old.withColumn("seq", F.col("seq") + 10**9).withColumn("value", F.lit(b"second"))
    batch = _entries(_users(spark, sf_dir), _number(), {"op": "del_column", "family": "ev", "qualifier": b"click"})
    made = writes.fold(again.unionByName(old), requests.resolved(batch, _T20), {"ev": 0})
    return made.select(_key(), C.text("qualifier").alias("qualifier"), "ts", C.text("value").alias("value"))


@_query(f"""WITH {_EV}, m AS (SELECT row_key, bool_or(qualifier = 'purchase' AND ts >= {_T20}) AS hit FROM ev GROUP BY 1)
 SELECT row_key, qualifier, ts, value FROM ev JOIN m USING (row_key) WHERE hit OR qualifier <> 'click' UNION ALL SELECT row_key, 'mark', 1000, 'yes' FROM m WHERE hit""")
def check_and_mutate(spark, sf_dir):
    cells, users = C.events_by_user(spark, sf_dir), _users(spark, sf_dir)
    yes = _entries(users, _number(), {"op": "set", "family": "ev", "qualifier": b"mark", "start_ts": 1000, "value": b"yes"})
    no = _entries(users, _number(), {"op": "del_column", "family": "ev", "qualifier": b"click"})
    after, _ = requests.check_and_mutate(cells, users, R.Chain((R.QualifierRegex(b"purchase"), R.TimestampRange(_T20))), yes, no, _FAMILIES, _T20)
    return after.select(_key(), C.text("qualifier").alias("qualifier"), "ts", C.text("value").alias("value"))


@_query(f"WITH {_EV} SELECT row_key, bool_or(qualifier = 'purchase' AND ts >= {_T20}) AS matched, 'OK' AS status FROM ev GROUP BY 1")
def check_matched(spark, sf_dir):
    store = _loaded(spark, "checked", C.events_by_user(spark, sf_dir), {"ev": "bytes"})
    users = _users(spark, sf_dir)
    mark = lambda v: _entries(users, _number(), {"op": "set", "family": "ev", "qualifier": b"mark", "start_ts": -1, "value": v})
    found = store.check_and_mutate("t", users, R.Chain((R.QualifierRegex(b"purchase"), R.TimestampRange(_T20))), mark(b"yes"), mark(b"no"), _T20)
    return found.select(_key(), "matched", "status")


_STATUS = "CASE user_id % 5 WHEN 0 THEN 'NOT_FOUND: mutation 1: no family nope' WHEN 1 THEN 'INVALID_ARGUMENT: mutation 0: a timestamp finer than the table''s' ELSE 'OK' END"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(_number() % 5 == 0, "nope").otherwise("ev")
    return _entries(_users(spark, sf_dir), _number(), {"op": "set", "family": "ev", "qualifier": b"new", "start_ts": F.when(_number() % 5 == 1, 1001).otherwise(2000), "value": b"v"}, {"op": "del_column", "family": family, "qualifier": b"view"})


@_query(f"SELECT DISTINCT printf('u%06d', user_id) AS row_key, {_STATUS} AS status FROM events")
def mutate_statuses(spark, sf_dir):
    return requests.validate(_mixed(spark, sf_dir), _FAMILIES).select(_key(), "status")


@_query(f"WITH {_EV}, g AS (SELECT DISTINCT printf('u%06d', user_id) AS row_key, user_id % 5 > 1 AS good FROM events) SELECT row_key, qualifier, ts FROM ev JOIN g USING (row_key) WHERE NOT good OR qualifier <> 'view' UNION ALL SELECT row_key, 'new', 2000 FROM g WHERE good")
def mutate_rows(spark, sf_dir):
    """Entries that are in order apply, the others leave their rows as they were; read from a base and a delta."""
    store = _loaded(spark, "mutated", C.events_by_user(spark, sf_dir), {"ev": "bytes"})
    store.mutate("t", _mixed(spark, sf_dir), _T20)
    return store.cells("t").select(_key(), C.text("qualifier").alias("qualifier"), "ts")


@_query("SELECT DISTINCT printf('u%06d', user_id) AS row_key, CASE WHEN user_id % 3 = 0 THEN 'DONE' WHEN user_id % 3 = 1 THEN 'INVALID_ARGUMENT: a token of under 8 bytes' ELSE 'OK' END AS status FROM events")
def mutate_tokens(spark, sf_dir):
    users = _users(spark, sf_dir)
    token = F.when(_number() % 3 == 1, F.lit(b"short")).otherwise(F.lit(b"long enough"))
    seen = users.select("row_key", F.lit(b"long enough").alias("token"), F.when(_number() % 3 == 0, _T20 + 1).otherwise(_T20).cast("long").alias("expire_us"))
    asked = users.select(_number().alias("entry_no"), "row_key", token.alias("token"))
    return requests.fresh(asked, seen, _T20).select(_key(), "status")


@_query(f"WITH {_EV} SELECT row_key, count(*) AS n FROM ev WHERE row_key NOT LIKE 'u00000%' GROUP BY 1")
def drop_row_range(spark, sf_dir):
    store = _loaded(spark, "dropped", C.events_by_user(spark, sf_dir), {"ev": "bytes"})
    store.drop_row_range("t", b"u00000", _T20)
    return store.cells("t").groupBy(_key()).agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT row_key, count(*) AS n FROM ev WHERE ts >= {_T20} - 432000000000 GROUP BY 1")
def store_collected_scan(spark, sf_dir):
    """A query sees a table after garbage collection: rows that lose all their cells aren't there."""
    store = _loaded(spark, "collected", C.events_by_user(spark, sf_dir), {"ev": "bytes"}, gc={"ev": collect.MaxAge(432_000_000_000)})
    found = store.sql("SELECT CAST(_key AS STRING) AS row_key, ARRAY_LENGTH(ev['click']) AS c, ARRAY_LENGTH(ev['view']) AS v, ARRAY_LENGTH(ev['purchase']) AS p, ARRAY_LENGTH(ev['signup']) AS s, ARRAY_LENGTH(ev['error']) AS e FROM t(with_history => TRUE)", now=_T20, ordered=False)
    return found.select("row_key", sum((F.coalesce(c, F.lit(0)) for c in "vpse"), F.coalesce("c", F.lit(0))).alias("n"))


@_query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def view_refreshed(spark, sf_dir):
    """A materialised view whose table is written to between two reads."""
    store = _loaded(spark, "viewed", C.orders(spark, sf_dir), {"o": "bytes"})
    store.create_materialised("by_priority", "t", "SELECT CAST(o['priority'] AS STRING) AS priority, COUNT(*) AS n FROM t GROUP BY priority")
    store.sql("SELECT * FROM by_priority").count()
    finished = C.pick(store.cells("t"), "o", ["status"]).where("status = 'F'").select("row_key")
    store.mutate("t", _entries(finished, _number(), {"op": "del_row"}), _T20)
    return store.sql("SELECT priority, n FROM by_priority", ordered=False)


@_query("SELECT o_orderpriority AS row_key, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1")
def view_cells_filtered(spark, sf_dir):
    """A filter on the cells of a materialised view."""
    store = _loaded(spark, "viewed", C.orders(spark, sf_dir), {"o": "bytes"})
    store.create_materialised("sums", "t", "SELECT CAST(o['priority'] AS BYTES) AS _key, COUNT(*) AS n, SUM(CAST(CAST(o['cents'] AS STRING) AS INT64)) AS cents FROM t GROUP BY _key")
    kept = R.apply(store.view_cells("sums"), R.Chain((R.FamilyRegex(b"default"), R.QualifierRegex(b"c.*"))))
    return kept.select(_key(), writes.from_big_endian(F.col("value")).alias("cents"))


@_query(f"WITH {_EV} SELECT row_key, qualifier, arg_max(value, ts) || '+a+b' AS value FROM ev GROUP BY 1, 2")
def rmw_append(spark, sf_dir):
    cells = C.events_by_user(spark, sf_dir)
    columns = cells.select("row_key", "family", "qualifier").distinct()
    rules = [columns.select("row_key", "family", "qualifier", F.lit(k).alias("rule_no"), F.lit(x).alias("append"), F.lit(None).cast("long").alias("by")) for k, x in ((1, b"+b"), (0, b"+a"))]
    made = writes.read_modify_write(cells, rules[0].unionByName(rules[1]), _T20)
    return made.select(_key(), C.text("qualifier").alias("qualifier"), C.text("value").alias("value"))


@_query("SELECT DISTINCT printf('u%06d', user_id) AS row_key, CAST(user_id::HUGEINT + 9223372036854775800 - CASE WHEN user_id > 7 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS n FROM events")
def rmw_wraps(spark, sf_dir):
    """Sums beyond 64 bits wrap; a rule sees what the one before it left."""
    users = _users(spark, sf_dir).select("row_key", F.lit("ev").alias("family"), F.lit(b"n").alias("qualifier"))
    none = F.lit(None).cast("binary").alias("append")
    rules = users.select("*", F.lit(0).alias("rule_no"), none, F.lit(9223372036854775800).alias("by")).unionByName(users.select("*", F.lit(1).alias("rule_no"), none, _number().alias("by")))
    made = writes.read_modify_write(C.events_by_user(spark, sf_dir), rules, _T20)
    return made.select(_key(), writes.from_big_endian(F.col("value")).alias("n"))


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts FROM ev WHERE regexp_full_match(row_key, 'u[0-9]+[13579]') AND (qualifier = 'click' OR qualifier LIKE 'p%')")
def rf_patterns(spark, sf_dir):
    f = R.Chain((R.RowKeyRegex(rb"u[[:digit:]]+[13579]"), R.QualifierRegex(rb"\Qcl\Eick|p\pL\C*")))
    return R.apply(C.events_by_user(spark, sf_dir), f).select(_key(), C.text("qualifier").alias("qualifier"), "ts")


@_query(f"WITH {_EV} SELECT row_key, qualifier, count(*) AS n FROM ev WHERE qualifier = 'view' OR ts < {_T15} GROUP BY 1, 2")
def rf_sink(spark, sf_dir):
    """Cells that go into a sink come out as they are, whatever follows."""
    f = R.Interleave((R.Chain((R.QualifierRegex(b"view"), R.Sink(), R.BlockAll())), R.Chain((R.QualifierRegex(b"[^v].*"), R.TimestampRange(0, _T15))), R.Chain((R.PassAll(), R.BlockAll()))))
    return R.apply(C.events_by_user(spark, sf_dir), f).groupBy(_key(), C.text("qualifier").alias("qualifier")).agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT row_key, count(DISTINCT qualifier) AS columns, count(*) AS cells, max(ts) FILTER (WHERE qualifier = (SELECT min(qualifier) FROM ev e WHERE e.row_key = ev.row_key)) AS newest FROM ev GROUP BY 1")
def read_nested(spark, sf_dir):
    found = rows.nested(C.events_by_user(spark, sf_dir)).withColumn("c", F.col("families")[0]["columns"])
    return found.select(_key(), F.size("c").cast("long").alias("columns"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.size(x["cells"])).alias("cells"), F.col("c")[0]["cells"][0]["ts"].alias("newest"))


@_query(f"WITH {_EV} SELECT count(DISTINCT row_key) FILTER (WHERE seen) AS rows_seen, count(*) FILTER (WHERE seen) AS cells_seen, count(DISTINCT row_key) FILTER (WHERE seen AND qualifier = 'view') AS rows_returned, count(*) FILTER (WHERE seen AND qualifier = 'view') AS cells_returned FROM (SELECT *, row_key >= 'u000003' AS seen FROM ev)")
def read_statistics(spark, sf_dir):
    return rows.statistics(C.events_by_user(spark, sf_dir), row_ranges=[(b"u000003", None)], row_filter=R.QualifierRegex(b"view"))


@_query("SELECT row_key, status FROM (SELECT printf('c%06d#%08d', o_custkey, o_orderkey) AS row_key, o_orderstatus AS status FROM orders) ORDER BY row_key OFFSET 300")
def result_resumed(spark, sf_dir):
    """A result that is taken up again after 300 rows: the batches that follow, as rows in their order.  The driver writes
    them as they come and holds 16 MiB or so."""
    store = _loaded(spark, "resumed", C.orders(spark, sf_dir), {"o": "bytes"})
    result = store.sql("SELECT CAST(_key AS STRING) AS row_key, CAST(o['status'] AS STRING) AS status FROM t")
    path = _folder(spark, "resumed-rows")
    schema = T.StructType([T.StructField("place", T.LongType()), *result.schema])
    place, come = 300, results.stream(result, b"300", size=1 << 14)
    while held := [b.table() for b in islice(come, _HELD)]:
        table = pa.concat_tables(held)
        table = table.add_column(0, "place", pa.array(range(place, place + len(table)), pa.int64()))
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)
        place += len(table)
    kept = spark.read.schema(schema).parquet(path) if place > 300 else spark.createDataFrame([], schema)
    return kept.orderBy("place").drop("place")


@_query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def backup_restored(spark, sf_dir):
    """A table that is backed up, emptied, and restored under another name."""
    store = _loaded(spark, "backed", C.orders(spark, sf_dir), {"o": "bytes"})
    store.backup("b", "t", _T20 + 1, _T20)
    store.drop_row_range("t", None, _T20)
    store.restore("b", "again", _T20)
    return store.sql("SELECT CAST(o['status'] AS STRING) AS status, COUNT(*) AS n FROM again GROUP BY status", ordered=False)


@_query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def families_altered(spark, sf_dir):
    """A dropped family loses its data, also for a later family of its name; a dropped table comes back."""
    both = C.orders(spark, sf_dir).unionByName(C.orders(spark, sf_dir).withColumn("family", F.lit("extra")).withColumn("fam_order", F.lit(1)))
    store = _loaded(spark, "altered", both, {"o": "bytes", "extra": "bytes"})
    store.alter_families("t", drop=["extra"])
    store.alter_families("t", create={"extra": "bytes"})
    store.drop_table("t", _T15)
    store.undelete_table("t", _T15 + 1)
    return store.sql("SELECT CAST(o['priority'] AS STRING) AS priority, COUNT(*) AS n FROM t WHERE extra IS NULL GROUP BY priority", ordered=False)


#: What stores turn away: a name, and the error.
REFUSED = [
    ("a rule of 600 bytes", "InvalidArgument"), ("an age under a millisecond", "InvalidArgument"), ("a taken name", "AlreadyExists"), ("a view of nothing", "NotFound"), ("a view that can't be read", "InvalidArgument"), ("a sixth materialised view", "FailedPrecondition"), ("a materialised view with hints", "InvalidArgument"), ("a write beside the part", "PermissionDenied"),
    ("a row of the part deleted", "PermissionDenied"), ("an unknown token", "InvalidArgument"), ("a known token", "none"), ("changes from the future", "InvalidArgument"), ("changes from too long ago", "OutOfRange"), ("a retention of a month", "InvalidArgument"), ("a backup that expired", "NotFound"), ("a table with views dropped", "FailedPrecondition"), ("a table brought back too late", "NotFound"), ("a table brought back in time", "none"),
    ("a row limit below zero", "InvalidArgument"), ("rows of an empty prefix dropped", "InvalidArgument"), ("a rule for an unknown family", "InvalidArgument"),
]


@_query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n.replace(chr(39), chr(39) * 2)}{chr(39)}, {chr(39)}{e}{chr(39)})' for n, e in REFUSED)}) AS v(request, error)")
def store_refusals(spark, sf_dir):
    """Limits and checks of stores, one after another on one table."""
    store = _loaded(spark, "refusing", C.orders(spark, sf_dir).where("row_key < X'633030303031'"), {"o": "bytes"})
    other = Store(spark, _folder(spark, "other"))
    store.create_authorised("part", "t", [b"c000001#"], {"o": ([b"status"], [])})
    store.backup("b", "t", _T20 + 1, _T20)
    for k in range(VIEWS_OF_TABLE):
        store.create_materialised(f"m{k}", "t", "SELECT _key, COUNT(*) AS n FROM t GROUP BY _key")
    other.create_table("gone", {"f": "bytes"})
    other.drop_table("gone", _T15)
    one = spark.createDataFrame([(b"c000001#1",)], "row_key binary")
    cell = {"op": "set", "family": "o", "qualifier": b"cents", "start_ts": 1000, "value": b"1"}
    wide = collect.Union(tuple(collect.MaxVersions(300) for _ in range(200)))
    log = store.changes_path("t")
    tried = [
        lambda: collect.survivors(store.cells("t"), {"o": wide}, _T20), lambda: other.create_table("q", {"f": "bytes"}, gc={"f": collect.MaxAge(10)}), lambda: store.create_table("t", {}), lambda: store.create_view("v", "SELECT 2 FROM nowhere"), lambda: store.create_view("v", "SELECT nope FROM t"),
        lambda: store.create_materialised("more", "t", "SELECT _key, COUNT(*) AS n FROM t GROUP BY _key"), lambda: views.plan(spark, store._tables(), "@{allow_incomplete_view=true} SELECT _key, COUNT(*) AS n FROM t GROUP BY _key"), lambda: store.mutate("t", _entries(one, F.lit(0), cell), _T20, view="part"), lambda: store.mutate("t", _entries(one, F.lit(0), {"op": "del_row"}), _T20, view="part"),
        lambda: store.is_consistent("t@999"), lambda: store.is_consistent(store.token("t")), lambda: changes.read(spark, log, start_us=_T20 + 1, now=_T20), lambda: changes.read(spark, log, start_us=_T15 - 4 * 86_400_000_000, now=_T20), lambda: changes.purge(spark, log, _T20, 30 * 86_400_000_000), lambda: store.restore("b", "new", _T20 + 1), lambda: store.drop_table("t", _T20),
        lambda: other.undelete_table("gone", _T15 + 8 * 86_400_000_000), lambda: other.undelete_table("gone", _T15 + 1), lambda: rows.read_rows(store.cells("t"), limit=-1), lambda: store.drop_row_range("t", b"", _T20),
        lambda: store.read_modify_write("t", spark.createDataFrame([(b"k", "nope", b"q", 0, b"v", None)], writes.RULES), _T20),
    ]
    found = []
    for (name, _), f in zip(REFUSED, tried, strict=True):
        try:
            f()
            found.append((name, "none"))
        except WideleafError as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "request string, error string")
