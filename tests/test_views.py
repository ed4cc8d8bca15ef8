"""Views defined in the dialect, ordered keys, sketches and operators on bytes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wideleaf.dialect import Catalog, Table, run
from wideleaf.errors import InvalidArgument
from wideleaf.functions import keys as K
from wideleaf.functions import sketches
from wideleaf.operators import writes
from wideleaf.plans import views

INTS = st.integers(-(2**63), 2**63 - 1)
CELLS = "row_key binary, family string, fam_order int, qualifier binary, ts long, value binary, seq long"


@settings(max_examples=300, deadline=None)
@given(INTS, INTS, st.binary(max_size=5), st.binary(max_size=5))
def test_ordered_keys(a, b, x, y):
    one, two = [K.join([K.encode_int(i), t]) for i, t in ((a, x), (b, y))]
    assert K.decode_int(K.encode_int(a)) == a and (K.encode_int(a) < K.encode_int(b)) == (a < b)
    assert K.split(one, 2) == [K.encode_int(a), x]
    if x and y:
        assert (one < two) == ((a, x) < (b, y))


def test_codes_of_integers():
    assert [K.encode_int(v).hex() for v in (0, 63, 64, -1, -64, -65)] == ["80", "bf", "c040", "7f", "40", "3fbf"]
    for bad in (b"", b"\xc0\x00", b"\xff"):
        with pytest.raises(ValueError):
            K.decode_int(bad)
    assert K.join([b"", b""]) == b"\0\0" and K.split(b"", 2) == [b"", b""]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = []
    for i, (item, n) in enumerate([("a", "1"), ("b", "2"), ("a", "3"), ("b", "x"), (None, "5")]):
        key = f"k{i}".encode()
        rows += [(key, "cf", 0, b"n", 1000, n.encode(), i)] + ([(key, "cf", 0, b"item", 1000, item.encode(), i)] if item else [])
    cells = spark.createDataFrame(rows, CELLS)
    coded = cells.withColumn("row_key", K.encoder(["STRING", "INT64"])(F.lit("r"), F.substring(F.col("row_key").cast("string"), 2, 1).cast("long") - 2))
    return Catalog({"t": Table(cells, {"cf": "bytes"}), "coded": Table(coded, {"cf": "bytes"}, (("name", "STRING"), ("id", "INT64")), ordered=True)})


ITEM, N = "CAST(cf['item'] AS STRING)", "CAST(CAST(cf['n'] AS STRING) AS INT64)"


def test_grouped_view(spark, catalog, tmp_path):
    d = views.create(spark, catalog, "g", f"SELECT {ITEM} AS item, SUM({N}) AS total, COUNT(*) AS n FROM t GROUP BY item", str(tmp_path / "g"))
    assert (d.keys, d.values) == (("item",), ("total", "n"))
    assert [tuple(r) for r in run(spark, catalog, "SELECT * FROM g").collect()] == [("a", 4, 2), ("b", 2, 2)]
    assert [bytes(r[0]) for r in run(spark, catalog, "SELECT _key FROM g WHERE _key > 'a'").collect()] == [b"b"]


def test_index_view(spark, catalog, tmp_path):
    # k3 fails to be a number; k4 has a key but no value
    views.create(spark, catalog, "i", f"SELECT {N} AS n, {ITEM} AS item, _key AS source FROM t ORDER BY n, source", str(tmp_path / "i"))
    assert [(r[0], r[1], bytes(r[2])) for r in run(spark, catalog, "SELECT * FROM i").collect()] == [(1, "a", b"k0"), (2, "b", b"k1"), (3, "a", b"k2")]


@pytest.mark.parametrize("sql", [f"SELECT {ITEM} AS item FROM t", "SELECT * FROM t ORDER BY _key", f"SELECT {ITEM} AS x, COUNT(*) AS n FROM t GROUP BY x ORDER BY x", f"SELECT {ITEM}, COUNT(*) AS n FROM t GROUP BY 1", "SELECT RAND() AS x, COUNT(*) AS n FROM t GROUP BY x", f"SELECT {ITEM} AS x, ARRAY_AGG(_key) AS k FROM t GROUP BY x", f"SELECT {ITEM} AS x, COUNT(*) AS n FROM t GROUP BY x LIMIT 1", "SELECT DATE '2024-01-01' AS d, COUNT(*) AS n FROM t GROUP BY d"])
def test_views_turned_away(spark, catalog, sql):
    with pytest.raises(InvalidArgument):
        views.plan(spark, catalog, sql)


def test_ordered_key_fields(spark, catalog):
    assert [tuple(r) for r in run(spark, catalog, "SELECT name, id FROM coded").collect()] == [("r", i) for i in range(-2, 3)]


def test_bytes(spark):
    got = run(spark, Catalog(), "SELECT b'\\x0f' & b'\\x3c' AS a, b'\\x0f' | b'\\x30' AS o, ~b'\\x0f' AS n, b'\\x01\\x80' << 1 AS l, b'\\x01\\x80' >> 4 AS r, ISERROR(b'a' ^ b'ab') AS e").first()
    assert [bytes(x) for x in got[:5]] == [b"\x0c", b"\x3f", b"\xf0", b"\x03\x00", b"\x00\x18"] and got[5]


def test_sketches(spark):
    values = spark.range(100).select(F.lit(b"r").alias("row_key"), F.lit("h").alias("family"), F.lit(b"q").alias("qualifier"), F.lit(0).cast("long").alias("ts"), (F.col("id") % 40).cast("string").cast("binary").alias("value"))
    once = writes.add_to_sketches(values.limit(0), values)
    assert writes.merge_sketches(once, once).select(F.hll_sketch_estimate("value")).first()[0] == 40


def test_sketches_are_exact_while_few(spark):
    table = lambda n: spark.range(n).select(F.col("id").cast("string").cast("binary").alias("row_key"), F.lit("f").alias("family"), F.lit(0).alias("fam_order"), F.lit(b"v").alias("qualifier"), F.lit(0).cast("long").alias("ts"), F.when(F.col("id") > 0, F.concat(F.lit("p"), F.col("id") % 9000)).otherwise("").cast("binary").alias("value"), F.lit(0).cast("long").alias("seq"))
    view = lambda size: f"SELECT MOD(LENGTH(_key), 2) AS part, HLL_COUNT.INIT(CAST(f['v'] AS STRING), {size}) AS s FROM t GROUP BY 1"
    count = lambda n, size, sql: tuple(run(spark, Catalog({"t": Table(table(n), {"f": "bytes"})}, views={"v": view(size)}), sql).first())
    both = "SELECT HLL_COUNT.MERGE(s) AS a, HLL_COUNT.EXTRACT(HLL_COUNT.MERGE_PARTIAL(s)) AS b FROM v"
    assert count(20000, 15, both) == (9001, 9001)
    assert count(20000, 15, "SELECT HLL_COUNT.EXTRACT(HLL_COUNT.INIT(CAST(f['v'] AS STRING))) AS n FROM t") == (9001,)
    a, b = count(20000, 10, both)  # more than the hashes that are kept at this precision
    assert a == b and abs(a - 9001) < 0.15 * 9001


def test_sketches_without_hashes(spark):
    values = spark.range(6000).select(F.lit(b"r").alias("row_key"), F.lit("h").alias("family"), F.lit(b"q").alias("qualifier"), F.lit(0).cast("long").alias("ts"), F.col("id").cast("string").cast("binary").alias("value"))
    plain = values.groupBy("row_key", "family", "qualifier", "ts").agg(F.hll_sketch_agg("value", F.lit(14)).alias("value"))
    kept = writes.add_to_sketches(values.limit(0), values)
    counts = lambda cells: cells.select(sketches.count(F.col("value")), F.hll_sketch_estimate("value")).first()
    assert counts(kept)[0] == 6000 and counts(kept)[1] == counts(plain)[1]
    assert counts(writes.merge_sketches(plain, kept)) == counts(writes.merge_sketches(plain, plain))
    mixed = plain.unionByName(kept).agg(sketches.merged_count(F.col("value")).alias("n")).first().n
    assert abs(mixed - 6000) < 0.05 * 6000
