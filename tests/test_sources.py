"""Type inference over all rows of a CSV."""

import pytest

from kestrel.sources import io


@pytest.mark.parametrize("kinds,want", [(0, "string"), (1, "int"), (2, "long"), (3, "long"), (4, "double"), (7, "double"), (8, "timestamp"),
                                        (9, "string"), (12, "string"), (16, "string"), (31, "string"), (24, "string")])
def test_the_lattice(kinds, want):
    assert io.joined_type(kinds) == want


@pytest.mark.parametrize("value,want", [
    (None, 0), ("", 0), ("  ", 0), ("0", 1), ("-7", 1), ("+2147483647", 1), ("2147483648", 2), ("-9223372036854775808", 2),
    ("9223372036854775808", 4), ("1.", 4), (".5", 4), ("-1.5e-3", 4), ("1e5", 4), ("NaN", 16), ("Infinity", 16), ("1,5", 16), ("0x1F", 16),
    ("2020-02-29", 8), ("2021-02-29", 16), ("2020-01-01 23:59:59.123", 8), ("2020-01-01T00:00:00", 8), ("2020-01-01 25:00:00", 16),
    (" 12 ", 1), ("12 3", 16), ("true", 16), ("1f", 16), ("1d", 16)])
def test_kinds(spark, value, want):
    d = spark.createDataFrame([(value,)], "x string")
    assert d.select(io.value_kind("x")).first()[0] == want


def test_a_late_change_and_corrupt_rows(spark, tmp_path):
    lines = ["a,b,c,d,_corrupt"] + [f"{i},{i},2020-01-0{1 + i % 9},,x" for i in range(5000)]
    lines += ["5000,1.5,2020-01-01 10:00:00,,y", "9999999999,2,,,z", "1,2", "1,2,2020-01-01,,w,7,8", "6,oops,not a day"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows, types, bad = io.read_csv_inferred(spark, str(tmp_path / "t.csv"), ["a", "b", "c", "d", "_corrupt"])
    assert types == {"a": "long", "b": "double", "c": "timestamp", "d": "string", "_corrupt": "string"}
    assert bad == 3 and rows.count() == 5002
    assert [f.dataType.simpleString() for f in rows.schema.fields] == ["bigint", "double", "timestamp", "string", "string"]
    assert rows.filter("c is null").count() == 1 and rows.agg({"a": "max"}).first()[0] == 9999999999


def test_an_empty_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    rows, types, bad = io.read_csv_inferred(spark, str(tmp_path / "t.csv"), ["a", "b"])
    assert types == {"a": "string", "b": "string"} and bad == 0 and rows.count() == 0
