import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wideleaf import catalogue
from wideleaf.errors import InvalidArgument, OutOfRange
from wideleaf.operators import collect, ranges, rows, temporal, writes
from wideleaf.operators import rowfilters as R
from wideleaf.streaming import changes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CELL = "row_key binary, family string, fam_order int, qualifier binary, ts long, value binary, seq long"

keys = st.binary(max_size=3)


@given(st.lists(st.tuples(keys, st.one_of(st.none(), keys))), st.lists(st.tuples(keys, st.one_of(st.none(), keys))), keys)
def test_range_algebra(xs, ys, key):
    holds = lambda rs: any(a <= key and (b is None or key < b) for a, b in rs)
    assert holds(ranges.normalise(xs)) == holds(xs)
    assert holds(ranges.intersect(xs, ys)) == (holds(xs) and holds(ys))


@given(keys, keys)
def test_prefix(p, key):
    low, high = ranges.prefix(p)
    assert (low <= key and (high is None or key < high)) == key.startswith(p)


@pytest.fixture
def cells(spark):
    out = []
    for row in (b"a", b"b", b"c"):
        for q in (b"x", b"y"):
            out += [(row, "f", 0, q, ts * 1000, b"%d" % ts, ts) for ts in (1, 2, 3)]
    out.append((b"b", "g", 1, b"\xff", 1000, b"\x03", 0))
    return spark.createDataFrame(out, CELL)


def keyed(df):
    return sorted((bytes(r.row_key), r.family, bytes(r.qualifier), r.ts // 1000) for r in df.collect())


def test_filters(cells):
    only = lambda f: keyed(R.apply(cells, f))
    assert len(only(R.PassAll())) == 19 and only(R.BlockAll()) == []
    assert only(R.QualifierRegex(b"\xff")) == [(b"b", "g", b"\xff", 1)]
    assert only(R.Chain((R.RowKeyRegex(b"a|b"), R.CellsPerRow(1)))) == [(b"a", "f", b"x", 3), (b"b", "f", b"x", 3)]
    assert len(only(R.Interleave((R.PassAll(), R.QualifierRegex(b"x"))))) == 19 + 9
    assert only(R.Condition(R.FamilyRegex(b"g"), R.FamilyRegex(b"g"), None)) == [(b"b", "g", b"\xff", 1)]
    assert len(only(R.Condition(R.FamilyRegex(b"g"), None, R.PassAll()))) == 12
    assert [k[3] for k in only(R.ValueBitmask(b"\x03")) if k[1] == "f"] == [3] * 6  # '3' is 0x33, '1' and '2' lack a bit
    assert len(only(R.Chain((R.Sink(), R.PassAll())))) == 19
    assert len(only(R.CellsPerColumn(1))) == 7
    labels = R.apply(cells, R.Label("l")).select("labels").distinct().collect()
    assert [r.labels for r in labels] == [["l"]]


@pytest.mark.parametrize("f", [R.Chain((R.PassAll(),)), R.Condition(R.Sink()), R.TimestampRange(1), R.RowSample(1.0), R.CellsPerRow(0), R.ValueRegex(b"(a"), R.ValueRegex(b"(?=a)"), R.ValueRegex(rb"(a)\1"), R.ValueRegex(b"a++"), R.ValueRegex(b"a{2,1}"), R.ValueRegex(b"[b-a]"), R.ValueRegex(rb"\y"), R.Chain((R.Label("a"), R.Label("b")))])
def test_filters_rejected(cells, f):
    with pytest.raises(InvalidArgument):
        R.apply(cells, f)


def test_reads(cells):
    assert {bytes(r.row_key) for r in rows.read_rows(cells, limit=2).collect()} == {b"a", b"b"}
    assert {bytes(r.row_key) for r in rows.read_rows(cells, keys=[b"c", b"zz"]).collect()} == {b"c"}
    assert bytes(rows.in_order(rows.read_rows(cells), reversed=True).first().row_key) == b"c"
    assert len(keyed(temporal.visible(cells, as_of=2000))) == 13
    assert len(keyed(temporal.visible(cells, latest_n=2))) == 13
    with pytest.raises(InvalidArgument):
        temporal.visible(cells, as_of=1, before=2)


def test_collect(cells):
    gone = lambda rule: 19 - len(keyed(collect.survivors(cells, {"f": rule}, 4000)))
    versions, age = collect.MaxVersions(1), collect.MaxAge(2000)
    assert (gone(versions), gone(age)) == (12, 6)
    assert (gone(collect.Union((versions, age))), gone(collect.Intersection((versions, age))), gone(collect.Intersection(()))) == (12, 6, 0)


def test_fold(spark, cells):
    batch = [(b"a", "del_row", None, None, None, None, None, 1), (b"a", "set", "f", b"z", 9000, None, b"n", 2), (b"b", "del_family", "g", None, None, None, None, 3), (b"c", "set", "f", b"x", 3000, None, b"new", 4), (b"c", "del_column", "f", b"y", 2000, None, None, 5)]
    out = writes.fold(cells, spark.createDataFrame(batch, writes.MUTATIONS), {"f": 0, "g": 1})
    got = keyed(out)
    assert [k for k in got if k[0] == b"a"] == [(b"a", "f", b"z", 9)]
    assert not [k for k in got if k[1] == "g"] and len([k for k in got if k[0] == b"b"]) == 6
    assert [k[2:] for k in got if k[0] == b"c"] == [(b"x", 1), (b"x", 2), (b"x", 3), (b"y", 1)]
    assert [bytes(r.value) for r in out.where("row_key = X'63' and qualifier = X'78' and ts = 3000").collect()] == [b"new"]


def test_ties(spark):
    """Of cells of one time the last written holds, whatever the order of the rows; a mutation is later than all of them."""
    rows_ = [(b"a", "f", 0, b"x", 1000, b"old", 1), (b"a", "f", 0, b"x", 1000, b"new", 2), (b"a", "f", 0, b"y", 1000, b"old", 9), (b"b", "f", 0, b"x", 1000, b"gone", 1)]
    batch = spark.createDataFrame([(b"a", "set", "f", b"y", 1000, None, b"set", 1), (b"b", "del_row", None, None, None, None, None, 2), (b"b", "set", "f", b"x", 1000, None, b"again", 3)], writes.MUTATIONS)
    for order in (rows_, rows_[::-1]):
        out = writes.fold(spark.createDataFrame(order, CELL), batch, {"f": 0}).collect()
        assert sorted((bytes(r.row_key), bytes(r.qualifier), bytes(r.value)) for r in out) == [(b"a", b"x", b"new"), (b"a", b"y", b"set"), (b"b", b"x", b"again")]


def test_change_log(spark, cells, tmp_path):
    path = f"file://{tmp_path}/log"
    day = 86_400_000_000
    assert changes.last_id(spark, path) == 0
    for k in range(2):
        changes.append(changes.of_cells(cells.withColumn("ts", F.col("ts") + k * day)), path)
    every = changes.read(spark, path).collect()
    ids = [r.id for r in every]
    assert len(set(ids)) == len(ids) == 18 and [r.commit_us for r in every] == sorted(r.commit_us for r in every)
    # From every token on, just what follows; of several tokens the earliest.
    for k, token in enumerate(ids):
        assert [r.id for r in changes.read(spark, path, tokens=[token, ids[-1]]).collect()] == ids[k + 1 :]
    got, token = [], 0
    while not isinstance(found := changes.poll(spark, path, token, 7, limit=5), changes.Heartbeat):
        got += [r.id for r in found.collect()]
        token = got[-1]
    assert got == ids and found == changes.Heartbeat(ids[-1], 7)
    assert changes.read(spark, path, start_us=2000, end_us=2000).count() == 3 and changes.initial_partitions() == [(b"", None)]
    for wrong in ({"start_us": 9, "now": 8}, {"start_us": 9, "end_us": 8}, {"start_us": 1, "tokens": [1]}):
        with pytest.raises(InvalidArgument):
            changes.read(spark, path, **wrong)
    with pytest.raises(OutOfRange):
        changes.read(spark, path, start_us=1, now=9 * day)
    with pytest.raises(InvalidArgument):
        changes.purge(spark, path, 0, day - 1)
    assert changes.purge(spark, path, 3 * day, day) == 2 and changes.purge(spark, path, 3 * day, day) == 0


def test_change_stream(spark, cells, tmp_path):
    changes.append(changes.of_cells(cells), str(tmp_path / "log"))
    query = changes.stream(spark, str(tmp_path / "log"), row_ranges=[(b"b", None)]).writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("got").count() == 6


@pytest.mark.parametrize("pattern, text, hit", [
    (b"[[:alpha:]]+", b"b", True), (b"[[:^alpha:]]", b"b", False), (rb"\C*", b"x\ny\xff", True), (rb"\pN+", b"12", True), (rb"\Qa.b\E", b"a.b", True), (rb"\Qa.b\E", b"axb", False), (b"a.c", b"a\nc", False), (b"(?s)a.c", b"a\nc", True), (b"a.c", b"a\rc", True),
    (b"(?i)ab|C", b"c", True), (b"a{,2}", b"a{,2}", True), (rb"\xff\x{fe}", b"\xff\xfe", True), (b"\xff+", b"\xff\xff", True), (rb"\ba\b", b"a", True), (b"[]-]+", b"]-", True), (b"(?U)a+", b"aa", True), (b"(?P<n_1>a)", b"a", True), (rb"[^\d\W]", b"1", False), (b"a$", b"a\n", False), (rb"[&&a]", b"&", True),
])
def test_patterns(spark, pattern, text, hit):
    row = spark.createDataFrame([(text, "f", 0, b"q", 0, b"v", 0)], CELL)
    assert R.apply(row, R.RowKeyRegex(pattern)).count() == hit


def test_rules_of_collection():
    assert collect.size(collect.MaxVersions(300)) == 3 and collect.size(collect.MaxAge(1_000_000)) == 4
    with pytest.raises(InvalidArgument):
        collect._judged(None, {"f": collect.Union(tuple(collect.MaxVersions(300) for _ in range(200)))}, 0)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)
