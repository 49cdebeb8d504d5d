from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import hashes, identity, paths, text, variants
from shelfmark.operators import sequences


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]


def test_decimal_identity(spark):
    values = ["001.50", "1e2", " 7 ", "+3", ".5", "5.", "-1", "NaN", "Infinity", "", None, "1.2.3", "-0", "0", "SP1"]
    expected = ["1.5", "100", "7", "3", "0.5", "5", None, None, None, None, None, None, "0", "0", None]
    assert column(spark, values, identity.decimal_identity) == expected


def test_natural_key_orders_numbers_of_any_length(spark):
    names = ["p10", "p2", "p2.5", "p02", "P1", "a1", "p" + "9" * 40, "p1" + "0" * 40, "1", "p2.50"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    ordered = [r.n for r in rows.orderBy(identity.natural_key(F.col("n")), "n").collect()]

    def key(name):
        import re
        parts = re.findall(r"[0-9]+(?:\.[0-9]+)?|[^0-9]+", name.lower())
        return [(0, Decimal(p), "") if p[0].isdigit() else (1, Decimal(0), p) for p in parts]

    assert [key(n) for n in ordered] == sorted(map(key, names))


def test_paths(spark):
    values = ["a/b.CBZ", ".cbz", "a.", "x/.zip", "a\\b.zip", "d/e.tar.gz", "..cbz"]
    assert column(spark, values, paths.suffix) == [".cbz", "", "", "", ".zip", ".gz", ".cbz"]
    unsafe = ["", "/a", "C:/a", "a/../b", "a\\..\\b", None, "a\0b"]
    safe = ["a/b", "./a", "a//b", "..a/b", "."]
    assert column(spark, unsafe, paths.unsafe_path) == [True] * 7
    assert column(spark, safe, paths.unsafe_path) == [False] * 5
    strict = ["a\\b", "a//b", "./a", "a/.", "a\tb", "/", "a/b/", "a.b"]
    assert column(spark, strict, paths.unsafe_member) == [True] * 6 + [False] * 2
    assert column(spark, ["./../a", ".\\b"], paths.record_path) == ["a", "b"]


def test_tokens(spark):
    stems = ["S Ch.003", "S Chapter 4.5", "match 5", "S Vol.02 Ch.1", "S v7", "SP01 x"]
    assert column(spark, stems, identity.chapter_token) == ["003", "4.5", None, "1", None, None]
    assert column(spark, stems, identity.volume_token) == [None, None, None, "02", "7", None]
    assert column(spark, stems, identity.special_name_token)[-1] == "01"


def test_dhash(spark):
    gray = [(r * 37 + c * c * 11) % 256 for r in range(8) for c in range(9)]
    rgb = [((i * 3) % 256, (i * 5) % 256, (i * 7) % 256) for i in range(64)]
    bits = 0
    for r in range(8):
        for c in range(8):
            bits = (bits << 1) | int(gray[r * 9 + c] > gray[r * 9 + c + 1])
    mean = [sum(p[k] for p in rgb) // 64 for k in range(3)]
    expected = f"{(bits << 24) | (mean[0] << 16) | (mean[1] << 8) | mean[2]:022x}"
    df = spark.createDataFrame([(gray, rgb)], "g array<int>, p array<struct<r:int,g:int,b:int>>")
    hi, color = hashes.dhash88(F.col("g"), F.col("p"))
    row = df.select(hashes.dhash_hex(hi, color).alias("x"), hi.alias("hi"), color.alias("color")).first()
    assert row.x == expected
    back = df.select(*(c.alias(n) for c, n in zip(hashes.parse_dhash(F.lit(expected)), ("hi", "color")))).first()
    assert (back.hi, back.color) == (row.hi, row.color)


def test_similar_aspect_is_exact(spark):
    sizes = [(100, 150, 101, 150), (100, 150, 102, 150), (0, 0, 0, 0), (1000, 1500, 1010, 1500), (99, 100, 100, 100)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "i int, a int, b int, c int, d int")
    got = [r.x for r in df.select("i", hashes.similar_aspect(*(F.col(k) for k in "abcd")).alias("x")).orderBy("i").collect()]

    def plain(a, b, c, d):
        left, right = a * d, c * b
        scale = max(left, right)
        return scale > 0 and abs(left - right) / scale <= 0.01

    assert got == [plain(*s) for s in sizes]


@pytest.mark.parametrize("record, expected", [
    ({"start": 1, "end": "4"}, (1, 4)), ({"start_page": 2, "end_page": 3, "start": 9, "end": 9}, (2, 3)),
    ({"start_page": None, "end_page": 3, "start": 9, "end": 9}, None), ({"span": "2..5"}, (2, 5)),
    ({"page_span": " 3 – 4 "}, (3, 4)), ({"span": [7, 8]}, (7, 8)), ({"span": [1, 2, 3]}, None),
    ({"start": 1.9, "end": True}, (1, 1)), ({"start": 1}, None), ({"span": "x", "page_span": "1-2"}, None),
])
def test_parse_span(spark, record, expected):
    df = spark.createDataFrame([(json.dumps(record),)], "j string").withColumn("v", variants.parse(F.col("j")))
    span = df.select(variants.parse_span(F.col("v")).alias("s")).first().s
    assert (tuple(span) if span else None) == expected


def test_high_confidence(spark):
    values = ["0.9", "1", "0.89", "true", '" High "', '"verified"', '"low"', "null", "[1]"]
    got = column(spark, values, lambda c: variants.is_high(variants.parse(c)))
    assert got == [True, True, False, False, True, True, False, False, False]


def test_gap_ranges(spark):
    values = ["3", '"3-4, 7,x, 9..8"', '{"from":2,"to":"5"}', '{"start":5,"end":2}', "[1]"]
    got = column(spark, values, lambda c: sequences.gap_ranges(variants.parse(c)))
    assert [[tuple(s) for s in g] if g else g for g in got] == [[(3, 3)], [(3, 4), (7, 7)], [(2, 5)], None, None]


def test_publisher(spark):
    df = spark.createDataFrame([("某社", "ゲンシャ"), ("某社", "原社"), ("A", "a"), ("某社", None)], "z string, o string")
    got = [r.x for r in df.select(text.publisher(F.col("z"), F.col("o")).alias("x")).collect()]
    assert got == ["某社（ゲンシャ）", "原社", "A", "某社"]


def test_numbers_of_any_length(spark):
    texts = {
        "123456789012345678901234567890": "123456789012345678901234567890",
        "0.0000000000000000000000012500": "0.00000000000000000000000125",
        "1.5e-3": "0.0015", "12.34e1": "123.4", "5.": "5", "-0.0": "0", "1e": None, "": None, "-1": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    got = {r.x: r.y for r in df.select("x", identity.decimal_identity(F.col("x")).alias("y")).collect()}
    assert got == texts


def test_members_of_an_object_are_its_fields(spark):
    values = ['{"a":null,"b":"","c":{"d":1},"e":[],"f":false,"g":0.50,"":7}', "{}", "[1]", '"a"', "null", "3", None, "{"]
    df = spark.createDataFrame([(j,) for j in values], "j string").withColumn("v", variants.parse(F.col("j")))
    df = df.withColumn("m", variants.members(F.col("v")))
    v, m, keys = F.col("v"), variants.Members(F.col("m")), ["a", "b", "c", "e", "f", "g", "h"]
    both = [[variants.raw(variants.field(x, k)) for k in keys] + [variants.raw(variants.first_field(x, ks)) for ks in (keys, ["h", "a", "b", "g"], ["e", "f"])]
            for x in (v, m)]
    for row in df.select(F.array(*both[0]).alias("by_path"), F.array(*both[1]).alias("by_member")).collect():
        assert row.by_path == row.by_member
    assert df.select(*both[1]).first()[7:] == ('{"d":1}', "0.5", "[]")


def test_values_are_looked_at_once(spark):
    # Every use of a number's text used to look its fields up again, a path at a time.
    plan = spark.range(1).select(sequences.gap_ranges(variants.parse(F.lit("{}"))))._jdf.queryExecution().analyzed().toString()
    assert plan.count("variant_get") < 50
