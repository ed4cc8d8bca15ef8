"""The catalogue of queries over the driver tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wideleaf.dialect import Catalog, Table, run
from wideleaf.functions import scalars as S
from wideleaf.operators import collect, ranges, rows, temporal, writes
from wideleaf.operators import rowfilters as R
from wideleaf.plans import views
from wideleaf.sources import cells as C
from wideleaf.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: SQL of the cells of ``events_by_user``.
_EV = """ev AS (SELECT printf('u%06d', user_id) AS row_key, event_type AS qualifier, epoch_us(ts) AS ts,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value, event_id AS seq FROM events)"""
_T15, _T20 = 1705276800000000, 1705708800000000  # 15 and 20 January 2024


def _flat(cells: DataFrame) -> DataFrame:
    return cells.select(C.text("row_key").alias("row_key"), "family", C.text("qualifier").alias("qualifier"), "ts", C.text("value").alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key range, then counts and sums by type."""
    return group_by_type(spark, sf_dir)


@_query("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, min(CAST(round(value * 100) AS BIGINT)) AS least, max(CAST(round(value * 100) AS BIGINT)) AS most FROM events WHERE user_id BETWEEN 1 AND 7 GROUP BY 1")
def group_by_type(spark, sf_dir):
    cells = C.events_by_row(spark, sf_dir).where(ranges.predicate([ranges.between(b"u000001", b"u000008")]))
    r = C.pick(cells, "cf", ["type", "cents"]).withColumn("c", F.col("cents").cast("long"))
    return r.groupBy(F.col("type").alias("event_type")).agg(F.count("*").alias("n"), F.sum("c").alias("cents"), F.min("c").alias("least"), F.max("c").alias("most"))


@_query("SELECT printf('c%06d#%08d', o_custkey, o_orderkey) AS row_key, o_orderstatus AS status FROM orders ORDER BY 1 LIMIT 50 OFFSET 10")
def scan_limit(spark, sf_dir):
    r = C.pick(C.orders(spark, sf_dir), "o", ["status"]).select(C.text("row_key").alias("row_key"), "status")
    return r.orderBy("row_key").offset(10).limit(50)


@_query("SELECT printf('c%06d#%08d', o_custkey, o_orderkey) AS row_key, o_orderpriority AS priority FROM orders WHERE printf('c%06d#%08d', o_custkey, o_orderkey) LIKE 'c00001%'")
def key_prefix(spark, sf_dir):
    return C.pick(C.orders(spark, sf_dir).where(ranges.predicate([ranges.prefix(b"c00001")])), "o", ["priority"]).select(C.text("row_key").alias("row_key"), "priority")


@_query("SELECT printf('u%06d', user_id) AS row_key, count(*) AS n FROM events WHERE user_id IN (1, 3) OR user_id >= 9 GROUP BY 1")
def key_or(spark, sf_dir):
    rs = [ranges.point(b"u000001"), ranges.point(b"u000003"), (b"u000009", None)]
    return C.events_by_user(spark, sf_dir).where(ranges.predicate(rs)).groupBy(C.text("row_key").alias("row_key")).agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT row_key, qualifier, arg_max(value, ts) AS value FROM ev WHERE ts <= {_T15} GROUP BY 1, 2")
def as_of(spark, sf_dir):
    return C.newest(temporal.visible(C.events_by_user(spark, sf_dir), as_of=_T15)).select(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier"), C.text("value").alias("value"))


@_query(f"WITH {_EV} SELECT row_key, qualifier, count(*) AS n FROM ev WHERE ts > {_T15} AND ts < {_T20} GROUP BY 1, 2")
def after_before(spark, sf_dir):
    return temporal.visible(C.events_by_user(spark, sf_dir), after=_T15, before=_T20).groupBy(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier")).agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT row_key, 'ev' AS family, qualifier, ts, value FROM ev QUALIFY row_number() OVER (PARTITION BY row_key, qualifier ORDER BY ts DESC, seq DESC) <= 2")
def history_latest_n(spark, sf_dir):
    return _flat(temporal.visible(C.events_by_user(spark, sf_dir), latest_n=2))


@_query(f"WITH {_EV} SELECT row_key, ts, max(CASE WHEN qualifier = 'click' THEN value END) AS click, max(CASE WHEN qualifier = 'view' THEN value END) AS view FROM ev GROUP BY 1, 2")
def unpack(spark, sf_dir):
    u = temporal.unpack(C.events_by_user(spark, sf_dir), "ev", ["click", "view"])
    return u.select(C.text("row_key").alias("row_key"), F.unix_micros("_timestamp").alias("ts"), "click", "view")


@_query(f"WITH {_EV} SELECT row_key, 'ev' AS family, qualifier, ts, value FROM ev WHERE regexp_full_match(qualifier, 'c.*|p.*') AND ts >= {_T15}")
def rf_chain(spark, sf_dir):
    return _flat(R.apply(C.events_by_user(spark, sf_dir), R.Chain((R.QualifierRegex(b"c.*|p.*"), R.TimestampRange(_T15)))))


@_query(f"WITH {_EV} SELECT row_key, qualifier, label, count(*) AS n FROM (SELECT row_key, qualifier, 'a' AS label FROM ev UNION ALL SELECT row_key, qualifier, '' AS label FROM ev WHERE ts >= {_T15}) GROUP BY 1, 2, 3")
def rf_interleave(spark, sf_dir):
    out = R.apply(C.events_by_user(spark, sf_dir), R.Interleave((R.Label("a"), R.TimestampRange(_T15))))
    return out.groupBy(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier"), F.array_join("labels", ",").alias("label")).agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts, value FROM (SELECT *, max(CASE WHEN qualifier = 'purchase' AND ts >= {_T20} THEN 1 ELSE 0 END) OVER (PARTITION BY row_key) AS hit FROM ev) WHERE (hit = 1 AND qualifier = 'purchase') OR (hit = 0 AND qualifier = 'click')")
def rf_condition(spark, sf_dir):
    f = R.Condition(R.Chain((R.QualifierRegex(b"purchase"), R.TimestampRange(_T20))), R.QualifierRegex(b"purchase"), R.QualifierRegex(b"click"))
    return _flat(R.apply(C.events_by_user(spark, sf_dir), f)).drop("family")


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts FROM ev QUALIFY row_number() OVER (PARTITION BY row_key, qualifier ORDER BY ts DESC) <= 3")
def rf_cells_per_column(spark, sf_dir):
    return _flat(R.apply(C.events_by_user(spark, sf_dir), R.CellsPerColumn(3))).drop("family", "value")


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts FROM ev QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY qualifier, ts DESC) BETWEEN 3 AND 7")
def rf_row_limit_offset(spark, sf_dir):
    return _flat(R.apply(C.events_by_user(spark, sf_dir), R.Chain((R.CellsPerRow(7), R.CellsPerRowOffset(2))))).drop("family", "value")


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts, value FROM ev WHERE value >= '2' AND value < '5'")
def rf_value_range(spark, sf_dir):
    return _flat(R.apply(C.events_by_user(spark, sf_dir), R.ValueRange(b"2", b"5", end_open=True))).drop("family")


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts, '' AS value FROM ev WHERE qualifier >= 'l' AND qualifier <= 'signup'")
def rf_column_range_strip(spark, sf_dir):
    return _flat(R.apply(C.events_by_user(spark, sf_dir), R.Chain((R.ColumnRange("ev", b"l", b"signup"), R.StripValue())))).drop("family")


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts FROM ev WHERE length(value) = 4 AND ord(substr(value, 1, 1)) & 2 = 2")
def rf_bitmask(spark, sf_dir):
    return _flat(R.apply(C.events_by_user(spark, sf_dir), R.ValueBitmask(b"\x02\x00\x00\x00"))).drop("family", "value")


@_query(f"WITH {_EV}, first AS (SELECT DISTINCT row_key FROM ev WHERE row_key >= 'u000003' AND qualifier = 'view' ORDER BY 1 LIMIT 4) SELECT row_key, count(*) AS n FROM ev WHERE qualifier = 'view' AND row_key IN (SELECT row_key FROM first) GROUP BY 1")
def read_rows_limit(spark, sf_dir):
    out = rows.read_rows(C.events_by_user(spark, sf_dir), row_ranges=[(b"u000003", None)], row_filter=R.QualifierRegex(b"view"), limit=4)
    return out.groupBy(C.text("row_key").alias("row_key")).agg(F.count("*").alias("n"))


@_query("""WITH c AS (SELECT printf('c%06d#%08d', o_custkey, o_orderkey) AS k, length('status') + length(o_orderstatus) + length('cents') + length(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) + length('priority') + length(o_orderpriority) + length('date') + 10 + 4 * (16 + 8) AS size FROM orders),
 s AS (SELECT k, size, CAST(sum(size) OVER (ORDER BY k) AS BIGINT) AS o FROM c) SELECT k AS row_key, o AS offset_bytes FROM s WHERE o // 16384 > (o - size) // 16384""")
def sample_keys(spark, sf_dir):
    return rows.sample_keys(C.orders(spark, sf_dir), 16384).select(C.text("row_key").alias("row_key"), "offset_bytes")


@_query(f"WITH {_EV} SELECT row_key, qualifier, count(*) AS n FROM ev WHERE (row_key LIKE 'u00000%') AND (qualifier = 'click' OR qualifier LIKE 'p%') GROUP BY 1, 2")
def av_restrict(spark, sf_dir):
    return rows.restrict(C.events_by_user(spark, sf_dir), [b"u00000"], {"ev": ([b"click"], [b"p"])}).groupBy(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier")).agg(F.count("*").alias("n"))


def _gc(rule: str) -> str:
    return f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY row_key, qualifier ORDER BY ts DESC, seq DESC) AS v FROM ev) SELECT row_key, qualifier, ts FROM r WHERE NOT ({rule})"


def _collected(spark, sf_dir, rule):
    return _flat(collect.survivors(C.events_by_user(spark, sf_dir), {"ev": rule}, _T20)).drop("family", "value")


@_query(_gc("v > 3"))
def gc_versions(spark, sf_dir):
    return _collected(spark, sf_dir, collect.MaxVersions(3))


@_query(_gc(f"ts < {_T20} - 432000000000"))
def gc_age(spark, sf_dir):
    return _collected(spark, sf_dir, collect.MaxAge(432_000_000_000))


@_query(_gc(f"v > 3 OR ts < {_T20} - 432000000000"))
def gc_union(spark, sf_dir):
    return _collected(spark, sf_dir, collect.Union((collect.MaxVersions(3), collect.MaxAge(432_000_000_000))))


@_query(_gc(f"v > 3 AND ts < {_T20} - 432000000000"))
def gc_intersection(spark, sf_dir):
    return _collected(spark, sf_dir, collect.Intersection((collect.MaxVersions(3), collect.MaxAge(432_000_000_000))))


@_query(f"""WITH {_EV} SELECT row_key, qualifier, ts, value FROM ev WHERE row_key NOT IN ('u000002') AND NOT (row_key = 'u000003' AND qualifier = 'click' AND ts < {_T15})
 UNION ALL SELECT 'u000001', 'new', 5000, 'x' UNION ALL SELECT 'u000002', 'new', 7000, 'z'""")
def write_upsert_delete(spark, sf_dir):
    batch = [(b"u000001", "set", "ev", b"new", 5000, None, b"w", 1), (b"u000001", "set", "ev", b"new", 5000, None, b"x", 2), (b"u000002", "set", "ev", b"new", 7000, None, b"y", 3), (b"u000002", "del_row", None, None, None, None, None, 4), (b"u000002", "set", "ev", b"new", 7000, None, b"z", 5), (b"u000003", "del_column", "ev", b"click", None, _T15, None, 6)]
    return _flat(writes.fold(C.events_by_user(spark, sf_dir), spark.createDataFrame(batch, writes.MUTATIONS), {"ev": 0})).drop("family")


@_query("SELECT printf('u%06d', user_id) AS row_key, event_type AS qualifier, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def agg_family_sum(spark, sf_dir):
    added = C.events_by_user(spark, sf_dir).select("row_key", "family", "qualifier", F.lit(0).cast("long").alias("ts"), C.text("value").cast("long").alias("n"))
    return writes.aggregate(added.where(F.lit(False)), added, "sum").select(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier"), F.col("n").alias("total"))


@_query("SELECT printf('u%06d', user_id) AS row_key, event_type AS qualifier, count(*) * 2 AS n FROM events GROUP BY 1, 2")
def rmw_increment(spark, sf_dir):
    cells = C.events_by_user(spark, sf_dir)
    rules = cells.select("row_key", "family", "qualifier", F.lit(2).cast("long").alias("by"))
    made = writes.increment(cells.where(F.lit(False)), rules, _T20)
    return made.select(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier"), S.to_int64(F.col("value")).alias("n"))


@_query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def mv_group(spark, sf_dir):
    r = Catalog({"t": Table(C.events_by_row(spark, sf_dir).unionByName(_days(spark, sf_dir)), {"cf": "bytes"})})
    rows_, _ = views.plan(spark, r, "SELECT CAST(cf['type'] AS STRING) AS event_type, CAST(cf['day'] AS STRING) AS day, COUNT(*) AS n, SUM(CAST(CAST(cf['cents'] AS STRING) AS INT64)) AS cents FROM t GROUP BY event_type, day")
    return rows_.drop("_key")


def _days(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return C.from_columns(e, F.format_string("u%06d#%08d", "user_id", "event_id"), "cf", {"day": F.date_format("ts", "yyyy-MM-dd")}, C.micros(F.col("ts")))


@_query("SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS date, printf('c%06d#%08d', o_custkey, o_orderkey) AS source FROM orders WHERE o_orderstatus = 'F'")
def mv_index(spark, sf_dir):
    """A secondary index: rows whose key column is null, or fails to be computed, are left out."""
    t = Catalog({"t": Table(C.orders(spark, sf_dir), {"o": "bytes"})})
    rows_, _ = views.plan(spark, t, "SELECT IF(DIV(1, IF(CAST(o['status'] AS STRING) = 'P', 0, 1)) = 1, NULLIF(CAST(o['status'] AS STRING), 'O'), 'x') AS status, CAST(o['priority'] AS STRING) AS priority, CAST(o['date'] AS STRING) AS date, CAST(_key AS STRING) AS source FROM t ORDER BY status, priority, date, source")
    return rows_.select("priority", "date", "source")


@_query("SELECT printf('%s|%d', o_orderpriority, o_orderkey) AS fields, true AS ascends FROM orders")
def mv_keys(spark, sf_dir):
    """The ordered code of a view's key: its fields read back, and the order of keys is that of the fields."""
    t = Catalog({"t": Table(C.orders(spark, sf_dir), {"o": "bytes"}, (("customer", "STRING"), ("number", "STRING")))})
    rows_, _ = views.plan(spark, t, "SELECT CAST(o['priority'] AS STRING) AS priority, CAST(number AS INT64) AS number, COUNT(*) AS n FROM t GROUP BY priority, number")
    coded = Catalog({"k": Table(rows_.select(F.col("_key").alias("row_key"), F.lit("f").alias("family"), F.lit(0).alias("fam_order"), F.lit(b"n").alias("qualifier"), F.lit(0).cast("long").alias("ts"), F.lit(b"1").alias("value"), F.lit(0).cast("long").alias("seq")), {"f": "bytes"}, (("priority", "STRING"), ("number", "INT64")), ordered=True)})
    back = run(spark, coded, "SELECT _key, priority, number FROM k", ordered=False)
    before = F.lag("_key").over(Window.partitionBy("priority").orderBy("number"))
    return back.select(F.format_string("%s|%d", "priority", "number").alias("fields"), F.coalesce(before < F.col("_key"), F.lit(True)).alias("ascends"))


@_query(f"WITH {_EV} SELECT row_key, qualifier, ts FROM ev WHERE row_key IN (SELECT DISTINCT row_key FROM ev ORDER BY 1 DESC LIMIT 3)")
def reversed_scan(spark, sf_dir):
    """The last three rows, read from the last key on."""
    found = rows.in_order(rows.read_rows(C.events_by_user(spark, sf_dir), limit=3, reversed=True), reversed=True)
    return found.select(C.text("row_key").alias("row_key"), C.text("qualifier").alias("qualifier"), "ts")


@_query("SELECT 0 AS split, true AS about_half, true AS repeats")
def rf_sample(spark, sf_dir):
    """A sample takes rows whole, about as many as asked for, and the same each time."""
    cells = C.events_by_row(spark, sf_dir)
    kept = R.apply(cells, R.RowSample(0.5, 7)).groupBy("row_key").agg(F.count("*").alias("k"))
    again = R.apply(cells, R.RowSample(0.5, 7)).groupBy("row_key").agg(F.count("*").alias("a"))
    whole = cells.groupBy("row_key").agg(F.count("*").alias("n")).join(kept, "row_key", "left").join(again, "row_key", "left")
    return whole.agg(F.count_if(F.col("k") != F.col("n")).cast("int").alias("split"), (F.avg(F.col("k").isNotNull().cast("int")).between(0.4, 0.6)).alias("about_half"), F.bool_and(F.col("k").eqNullSafe(F.col("a"))).alias("repeats"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes: in the shared folder, or, in a local session without one, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="wideleaf-")
    return f"{top.rstrip('/')}/wideleaf/{name}-{uuid.uuid4().hex}"


@_query(f"WITH {_EV}, r AS (SELECT row_key, ts AS commit_us, count(*) AS cells, row_number() OVER (ORDER BY ts, row_key) AS place FROM ev GROUP BY 1, 2) SELECT row_key, commit_us, cells, place FROM r WHERE commit_us >= {_T15} AND commit_us <= {_T20} AND row_key >= 'u000002' AND row_key < 'u000009'")
def changes_range(spark, sf_dir):
    """A log that is appended to and read back: records in a time and a range of keys; ids are told by how many are below."""
    path = _folder(spark, "changes")
    changes.append(changes.of_cells(C.events_by_user(spark, sf_dir)), path)
    places = spark.read.parquet(path).select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("place"))
    log = changes.read(spark, path, start_us=_T15, end_us=_T20, row_ranges=[(b"u000002", b"u000009")])
    return log.join(places, "id").select(C.text("row_key").alias("row_key"), "commit_us", F.size("mutations").cast("long").alias("cells"), "place")


@_query(f"WITH {_EV}, r AS (SELECT row_key, ts, count(*) AS cells, row_number() OVER (ORDER BY ts, row_key) AS place FROM ev GROUP BY 1, 2) SELECT row_key, ts AS commit_us, cells FROM r WHERE place > 40 ORDER BY place LIMIT 25")
def changes_resumed(spark, sf_dir):
    """What a reader gets after a token: two polls, the second from where the first ended."""
    path = _folder(spark, "changes")
    changes.append(changes.of_cells(C.events_by_user(spark, sf_dir)), path)
    first = changes.poll(spark, path, 0, _T20, limit=40)
    token = first.agg(F.max("id")).first()[0]
    found = changes.poll(spark, path, token, _T20, limit=25)
    return found.select(C.text("row_key").alias("row_key"), "commit_us", F.size("mutations").cast("long").alias("cells"))


@_query(f"""WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY row_key, qualifier ORDER BY ts DESC, seq DESC) AS v FROM ev)
 SELECT row_key, 'GARBAGE_COLLECTION' AS type, count(*) AS cells FROM r WHERE v > 3 GROUP BY 1""")
def changes_collected(spark, sf_dir):
    records = changes.of_collected(C.events_by_user(spark, sf_dir), {"ev": collect.MaxVersions(3)}, _T20)
    return records.select(C.text("row_key").alias("row_key"), "type", F.size("mutations").cast("long").alias("cells"))


@_query("""SELECT printf('u%06d', user_id) AS row_key, 2 AS mutations, 'del_family,set' AS ops FROM events WHERE user_id < 5 GROUP BY 1
 UNION ALL SELECT 'v1', 2, 'set,del_family'""")
def changes_row_delete(spark, sf_dir):
    """Deletes of rows are told by family: of rows that were there, and of one that the same batch makes."""
    cells = C.events_by_user(spark, sf_dir)
    keys = cells.where(ranges.predicate([(b"u", b"u000005")])).select("row_key").distinct()
    none = F.lit(None)
    made = lambda op, seq, **f: [F.lit(op).alias("op"), *[f.get(n, none).cast(k).alias(n) for n, k in (("family", "string"), ("qualifier", "binary"), ("start_ts", "long"), ("end_ts", "long"), ("value", "binary"))], F.lit(seq).cast("long").alias("seq")]
    new = spark.range(1).select(F.lit(b"v1").alias("row_key"))
    cell = {"family": F.lit("ev"), "qualifier": F.lit(b"a"), "start_ts": F.lit(1000), "value": F.lit(b"b")}
    batch = keys.select("row_key", *made("del_row", 1)).unionByName(keys.select("row_key", *made("set", 2, **cell))).unionByName(new.select("row_key", *made("set", 1, **cell))).unionByName(new.select("row_key", *made("del_row", 2)))
    records = changes.of_mutations(batch, cells, _T20)
    return records.select(C.text("row_key").alias("row_key"), F.size("mutations").alias("mutations"), F.array_join(F.transform("mutations", lambda m: m["op"]), ",").alias("ops"))


@_query("SELECT n_name AS name, upper(n_name) AS up, length(n_name) AS len, substr(n_name, 2, 3) AS mid, reverse(n_name) AS rev, strpos(n_name, 'A') AS at FROM nation")
def fn_string(spark, sf_dir):
    n = F.col("n_name")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("name"), F.upper(n).alias("up"), F.length(n).cast("long").alias("len"), S.substr(n, 2, 3).alias("mid"), F.reverse(n).alias("rev"), F.instr(n, "A").cast("long").alias("at"))


@_query("""SELECT o_orderkey AS k, CAST(CAST(CAST(o_orderdate AS DATE) - CAST(extract(dow FROM o_orderdate) AS INTEGER) AS DATE) AS VARCHAR) AS week, CAST(last_day(o_orderdate) AS VARCHAR) AS last,
 date_diff('month', DATE '1995-06-15', CAST(o_orderdate AS DATE)) AS months, CAST(extract(isoyear FROM o_orderdate) AS BIGINT) AS isoyear FROM orders""")
def fn_date(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), C.text(S.week_start(d)).alias("week"), C.text(F.last_day(d)).alias("last"), S.month_diff(d, F.lit("1995-06-15").cast("date")).alias("months"), F.extract(F.lit("YEAROFWEEK"), d).cast("long").alias("isoyear"))


@_query("""SELECT a.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS l2, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine
 FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def fn_vector(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("v"))  # vec_id is a key: one row
    v = F.col("v")
    return e.join(F.broadcast(one), F.lit(True)).select(F.col("vec_id").alias("id"), F.round(S.euclidean(F.col("embedding"), v), 4).alias("l2"), F.round(S.cosine_distance(F.col("embedding"), v), 4).alias("cosine"))


@_query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, min_by(n_name, n_nationkey) AS first FROM nation GROUP BY 1")
def agg_string_ordered(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return t.groupBy(F.col("n_regionkey").alias("region")).agg(S.string_agg(F.col("n_name"), ",", F.col("n_nationkey")).alias("names"), S.first_value(F.col("n_name"), F.col("n_nationkey")).alias("first"))


@_query("""SELECT l_returnflag AS flag, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 4) AS r,
 round(covar_samp(l_quantity, l_discount), 4) AS c, bit_or(l_linenumber) AS bits, bool_and(l_quantity > 0) AS every FROM lineitem GROUP BY 1""")
def agg_stats(spark, sf_dir):
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.stddev_samp(q), 4).alias("sd"), F.round(F.var_pop(q), 4).alias("vp"), F.round(S.corr(q, p), 4).alias("r"), F.round(F.covar_samp(q, d), 4).alias("c"), F.bit_or("l_linenumber").alias("bits"), F.bool_and(q > 0).alias("every"))
