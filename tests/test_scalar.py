import pytest
from pyspark.sql import functions as F

from netloom.functions import scalar
from netloom.operators import sequence, spatial, timing


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def lit(x):
    return F.lit(x)


def test_fuzzy(spark):
    for a, b, equal in ((1.0, 1.0 + 1e-7, True), (1.0, 1.001, False), (0.0, 1e-16, True), (1e-14, 0.0, False), (-2.0, -2.0, True)):
        assert one(spark, scalar.fuzzy_equal(lit(a), lit(b))) is equal
        assert one(spark, scalar.fuzzy_less(lit(a), lit(b))) is (a < b and not equal)
    assert one(spark, scalar.worse(lit(2.0), lit(1.0), True)) and not one(spark, scalar.worse(lit(2.0), lit(1.0), False))


def test_globs(spark):
    for pattern, value, fits in (("u?/A*", "u1/A[0]", True), ("a.c", "abc", False), (r"a\*", "a*", True), (r"a\*", "ab", False), ("*", "", True)):
        assert one(spark, scalar.glob(lit(value), pattern)) is fits
    assert one(spark, scalar.glob(lit("ABC"), "a?c", True))


def test_numbers_and_ranges(spark):
    assert [one(spark, scalar.trim_zeros(lit(x))) for x in ("1.500", "10", "2.000", "0.10")] == ["1.5", "10", "2", "0.1"]
    assert one(spark, scalar.int_ranges(lit("1,2, 5-10,"))) == [1, 2, 5, 6, 7, 8, 9, 10]
    assert one(spark, scalar.key_values(lit("a=1,b=x"))) == {"a": "1", "b": "x"}
    assert one(spark, scalar.lenient_bool(lit(" Yes "))) and not one(spark, scalar.lenient_bool(lit("off")))
    assert one(spark, scalar.to_user(lit(1e-9), "n")) == pytest.approx(1.0)
    h = 5381
    for b in b"net1":
        h = (h * 33 % 2**32) ^ b
    assert one(spark, scalar.djb2_xor(lit("net1"))) == h


def test_bus_and_logic(spark):
    bus, bit = scalar.bus_parts(lit("a[3]"))
    assert (one(spark, bus), one(spark, bit)) == ("a", 3)
    assert one(spark, scalar.bus_parts(lit(r"a\[3]"))[0]) is None and one(spark, scalar.bus_parts(lit("a"))[0]) is None
    for a in (True, False):
        for b in (True, False):
            assert one(spark, scalar.boolean_function("!(A*B)+A^B", {"A": lit(a), "B": lit(b)})) is ((not (a and b)) or (a != b))
    for bad in ("A &", "(A", "Z", "A B"):
        with pytest.raises((ValueError, IndexError)):
            scalar.boolean_function(bad, {"A": lit(True), "B": lit(True)})


def test_special_floats(spark):
    assert [one(spark, scalar.special_float(lit(float(x)))) for x in ("nan", "inf", "-inf", "1.5")] == ['"NaN"', '"Infinity"', '"-Infinity"', "1.5"]


def test_grid_clamps(spark):
    assert [one(spark, spatial.grid_index(lit(x), 0, 10, 20)) for x in (-1, 0, 5, 15, 210)] == [0, 0, 0, 1, 19]


def test_journal(spark):
    j = [(1, "set", "i1", "x", "1"), (2, "set", "i2", "x", "1"), (3, "delete", "i2", None, None), (4, "set", "i1", "x", "2"), (5, "set", "i1", "y", "9")]
    out = sequence.replay(spark.createDataFrame(j, "seq long, op string, obj string, field string, value string"))
    assert sorted(map(tuple, out.collect())) == [("i1", "x", "2"), ("i1", "y", "9")]


def test_chains(spark):
    cells = spark.createDataFrame([("c", i >= 6, i) for i in range(8)], "domain string, falling boolean, cell long")
    out = {r.cell: (r.chain, r.place) for r in sequence.scan_chains(cells, 5).collect()}
    assert out[6] == (0, 0) and out[7] == (0, 1) and out[0] == (0, 2) and out[3] == (1, 0)


def test_path_arrival(spark):
    s = spark.createDataFrame([("p", 0, 0.23), ("p", 1, 0.08), ("p", 2, 0.10)], "path string, pos int, delay double")
    assert [round(r.arrival, 2) for r in timing.path_arrival(s).orderBy("pos").collect()] == [0.23, 0.31, 0.41]


def test_longest_run_of_none(spark):
    s = spark.createDataFrame([(1, 1, False), (2, 1, True), (2, 2, True), (2, 4, True)], "g int, p int, f boolean")
    assert {tuple(r) for r in sequence.longest_run(s, "g", "p", F.col("f")).collect()} == {(1, 0), (2, 2)}
