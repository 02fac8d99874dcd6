"""Casts and date expressions."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidegauge import functions as fn
from tidegauge.functions.dates import TIMESTAMP_PATTERN
from tidegauge.operators import cast_columns
from tidegauge.schema import CastRule


@pytest.fixture
def setting(spark):
    saved = {}

    def set_(key, value):
        saved.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield set_
    for key, value in saved.items():
        spark.conf.set(key, value)


def fold(df, rules):
    """The rules applied one at a time, by plain casts without ANSI mode."""
    for rule in rules:
        df = df.withColumn(rule.target, df[rule.source].cast(rule.type))
    return df


CHAINS = {
    "new columns": [("a", "x", "int"), ("b", "y", "double")],
    "in place": [("a", "a", "int")],
    "chain": [("a", "x", "int"), ("x", "y", "string"), ("y", "a", "double")],
    "source overwritten, then read": [("b", "a", "int"), ("a", "c", "string")],
    "swap": [("a", "t", "string"), ("b", "a", "string"), ("t", "b", "string")],
    "target twice": [("a", "x", "int"), ("b", "x", "string"), ("c", "y", "int")],
    "case differs": [("a", "X", "int"), ("B", "x", "string"), ("x", "A", "int")],
    "none": [],
}


@pytest.mark.parametrize("chain", CHAINS.values(), ids=CHAINS.keys())
def test_casts_fold_in_order(spark, setting, chain):
    setting("spark.sql.ansi.enabled", "false")
    df = spark.createDataFrame([("1", "2.5", "z"), (None, "x", "3")], "a string, b string, c string")
    rules = [CastRule(*r) for r in chain]
    got, want = cast_columns(df, rules), fold(df, rules)
    assert got.schema == want.schema
    assert got.collect() == want.collect()


def test_casts_in_a_case_sensitive_session(spark, setting):
    setting("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame([("1", "2")], "a string, A string")
    got = cast_columns(df, [CastRule("a", "x", "int"), CastRule("A", "X", "int"), CastRule("x", "a", "double")])
    assert got.collect() == [(1.0, "2", 1, 2)]


def test_malformed_text(spark, setting):
    df = spark.createDataFrame([("12",), ("twelve",)], "a string")
    rules = [CastRule("a", "n", "int")]
    assert [r.n for r in cast_columns(df, rules).collect()] == [12, None]
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        cast_columns(df, rules, strict=True).collect()
    setting("spark.sql.ansi.enabled", "false")
    assert [r.n for r in cast_columns(df, rules, strict=True).collect()] == [12, None]


WHOLE = ["12", " 12\t", "+12", "-12", "012", "x", "", " ", "+", "1 2", "1e3", "٣", "12\u2028", "2147483648", "99999999999999999999", None]


@pytest.mark.parametrize("type_", ["tinyint", "smallint", "int", "bigint"])
def test_whole_numbers_as_without_ansi(spark, setting, type_):
    texts = [*WHOLE, "12.", "12.9", "-12.9", "12.9.1", "12.x"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    setting("spark.sql.ansi.enabled", "false")
    want = df.select(F.col("a").cast(type_)).collect()
    setting("spark.sql.ansi.enabled", "true")
    got = cast_columns(df, [CastRule("a", "a", type_)]).collect()
    assert got == want
    assert got[0] == got[texts.index("12.9")] == (12,)


@pytest.mark.parametrize("type_", ["boolean", "double", "decimal(12,2)", "date", "timestamp", "binary", "string"])
def test_other_types_as_without_ansi(spark, setting, type_):
    texts = [*WHOLE, "t", "TRUE", " Yes ", "y", "1", "F", "false", "no", "N", "0", "2", "truex", "true\n",
             "1.5", "NaN", "-inf", "1e3", "2024-01-05", "2024-1-5", "2024-01-05 10:00:00", "2024-13-05"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    setting("spark.sql.ansi.enabled", "false")
    want = df.select(F.col("a").cast(type_).cast("string")).collect()
    setting("spark.sql.ansi.enabled", "true")
    got = cast_columns(df, [CastRule("a", "b", type_)]).select(F.col("b").cast("string")).collect()
    assert got == want


def test_a_number_out_of_range_is_null(spark):
    df = spark.createDataFrame([(1e10, 2**40), (1.9, 5)], "d double, l bigint")
    got = cast_columns(df, [CastRule("d", "d", "int"), CastRule("l", "l", "int")])
    assert got.collect() == [(None, None), (1, 5)]


def test_missing_source(spark):
    with pytest.raises(PySparkException):
        cast_columns(spark.range(1), [CastRule("nope", "x", "int")])


def test_any_type_name(spark):
    df = spark.createDataFrame([("1.25", ["1", "x"])], "a string, b array<string>")
    got = cast_columns(df, [CastRule("a", "d", "decimal(5,1)"), CastRule("b", "b", "array<int>")])
    assert got.dtypes == [("a", "string"), ("b", "array<int>"), ("d", "decimal(5,1)")]


def test_a_field_of_a_struct(spark):
    df = spark.sql("select named_struct('v', '12.5') s")
    assert cast_columns(df, [CastRule("s.v", "n", "int")]).select("n").collect() == [(12,)]


@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UNICODE_CI"])
def test_collated_text(spark, collation):
    df = spark.createDataFrame([("12.5", "YES")], "a string, b string")
    df = df.select(*(F.collate(c, collation).alias(c) for c in df.columns))
    got = cast_columns(df, [CastRule("a", "a", "int"), CastRule("b", "b", "boolean")])
    assert got.collect() == [(12, True)]


def test_one_projection_for_independent_rules(spark):
    rules = [CastRule("id", f"c{i}", "string" if i % 2 else "double") for i in range(60)]
    plan = cast_columns(spark.range(1), rules)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Project") == 1


def test_alternating_chain_grows_linearly(spark):
    kinds = ("int", "string", "boolean", "string")
    sizes = {}
    for n in (20, 40, 60):
        rules = [CastRule("t", "t", kinds[i % 4]) for i in range(n)]
        df = cast_columns(spark.createDataFrame([("1",), ("0",), ("x",)], "t string"), rules)
        sizes[n] = df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert sizes[60] - sizes[40] == sizes[40] - sizes[20] > 0
    assert df.collect() == [(None,)] * 3  # no truth value is a number
    once = cast_columns(spark.createDataFrame([("1",), ("0",), ("x",)], "t string"), rules[:4])
    assert [r.t for r in once.collect()] == ["true", "false", None]


@pytest.mark.parametrize("text", [".5", "-.5", "+.5", ".", "-.", "1.", "-3.9", "5", " 7 ", "x", "", "+", "1e3", "..", "1.2.3"])
def test_text_to_whole_number_as_without_ansi(spark, setting, text):
    setting("spark.sql.ansi.enabled", "false")
    df = spark.createDataFrame([(text, [text], (text,), {"k": text})], "t string, a array<string>, s struct<f: string>, m map<string, string>")
    rules = [CastRule("t", "t2", "int"), CastRule("a", "a2", "array<int>"), CastRule("s", "s2", "struct<f: int>"), CastRule("m", "m2", "map<string, int>")]
    row = cast_columns(df, rules).first()
    want = df.select(F.col("t").cast("int")).first()[0]
    assert (row.t2, row.a2, row.s2.f, row.m2) == (want, [want], want, {"k": want})


def test_type_pairs_as_without_ansi(spark, setting):
    setting("spark.sql.ansi.enabled", "false")
    df = spark.sql("select date'2024-01-02' d, timestamp'1970-01-01 00:00:00' z, timestamp'2024-01-02 03:04:05' t, true b, cast(null as boolean) n")
    pairs = [("d", "int"), ("d", "boolean"), ("z", "boolean"), ("t", "boolean"), ("b", "timestamp"), ("n", "timestamp")]
    got = cast_columns(df, [CastRule(c, f"{c}_{t}", t) for c, t in pairs]).first()
    want = df.select(*(F.col(c).cast(t).alias(f"{c}_{t}") for c, t in pairs)).first()
    assert [got[f"{c}_{t}"] for c, t in pairs] == list(want)


def test_stamp_of_time_without_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' t")
    assert df.select(fn.utc_stamp("t")).first()[0] == "2024-01-02 03:04:05"


@pytest.fixture(params=["true", "false"])
def ansi(request, setting):
    setting("spark.sql.ansi.enabled", request.param)


def test_parse_timestamp(spark, ansi):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01",), ("tomorrow",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.parse_timestamp("t")).collect()] == [
        datetime(2024, 1, 1, 10), datetime(2024, 1, 1), None, None,
    ]
    with pytest.raises(PySparkException, match="not a timestamp: tomorrow"):
        df.select(fn.parse_timestamp("t", strict=True)).collect()
    fine = df.where("t is null or t not like 't%'")
    assert fine.select(fn.parse_timestamp("t", strict=True)).collect() == fine.select(fn.parse_timestamp("t")).collect()
    shaped = spark.createDataFrame([("05/01/2024",), ("2024-01-05",)], "t string")
    assert [r[0] for r in shaped.select(fn.parse_timestamp("t", "dd/MM/yyyy")).collect()] == [datetime(2024, 1, 5), None]


def test_parse_date(spark, ansi):
    df = spark.createDataFrame([("2024-01-05",), ("2024-1-5",)], "t string")
    assert {r[0] for r in df.select(fn.parse_date("t")).collect()} == {datetime(2024, 1, 5)}
    bad = spark.createDataFrame([("2024-13-05",)], "t string")
    with pytest.raises(PySparkException, match="not a timestamp: 2024-13-05"):
        bad.select(fn.parse_date("t")).collect()
    assert bad.select(fn.parse_date("t", strict=False)).first()[0] is None


def test_format_date(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 5, 7, 8, 9, 999_999),)], "t timestamp")
    assert df.select(fn.format_date("t"), fn.format_date("t", TIMESTAMP_PATTERN)).first() == (
        "2024-01-05", "2024-01-05 07:08:09",
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_utc_stamp(spark, setting, zone):
    setting("spark.sql.session.timeZone", zone)
    # 02:30 on this day does not exist on a New York clock.
    instant = F.to_timestamp(F.lit("2024-03-10T02:30:15.75Z"))
    stamped = spark.range(1).select(fn.utc_stamp(instant), fn.utc_stamp()).first()
    assert stamped[0] == "2024-03-10 02:30:15"
    now = datetime.strptime(stamped[1], "%Y-%m-%d %H:%M:%S").replace(tzinfo=UTC)
    assert abs(datetime.now(UTC) - now) < timedelta(minutes=1)


def test_text_of_a_null_is_null(spark):
    row = spark.createDataFrame([(None,)], "t timestamp").select(fn.utc_stamp("t"), fn.format_date("t")).first()
    assert row == Row(None, None)


def test_a_field_is_read_after_its_struct_was_cast(spark):
    """Rules apply in order whether they share a call or not, for paths into structs too."""
    from tidegauge.operators import cast_columns
    from tidegauge.schema import CastRule

    df = spark.createDataFrame([(("12.9", ("7.5",)), "x")], "s struct<b:string,c:struct<d:string>>, `s.e` string")
    rules = [CastRule("s", "s", "struct<b:int,c:struct<d:int>>"), CastRule("s.b", "t", "string"), CastRule("s.c.d", "u", "string"), CastRule("s.e", "v", "string")]
    once = cast_columns(df, rules).select("t", "u", "v").first()
    apart = df
    for rule in rules:
        apart = cast_columns(apart, [rule])
    assert tuple(once) == tuple(apart.select("t", "u", "v").first()) == ("12", "7", "x")
