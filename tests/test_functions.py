"""Functions on single values: parsers, periods, names and maps."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import maps, numbers, periods, texts
from ledgerloom.operators import lookup


def one(spark, make, *values):
    """The results of a column function for each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_signed_numbers(spark):
    got = one(spark, numbers.signed_number, "( 1,234 )", "（1,234）", "1,234.5", "-7", "12%", "—", "", None, "abc")
    assert got == [-1234.0, -1234.0, 1234.5, -7.0, None, None, None, None, None]


def test_parsers_differ(spark):
    assert one(spark, numbers.fact_number, "12%", "(5)", "0", "無", None) == [12.0, -5.0, 0.0, None, None]
    assert one(spark, numbers.ratio_number, "12%", "(5)", "$1,000") == [0.12, None, 1000.0]
    assert one(spark, numbers.first_number, "about 12 (net)", "3 units", "none") == [-12.0, 3.0, None]
    assert one(spark, numbers.clean_number, "(1,234)", "1,234 TWD") == [-1234.0, None]


def test_zero_is_a_value(spark):
    assert one(spark, numbers.cell_state, "0", "—", "", None, "1") == ["value", "missing_value", "missing_value", "not_found", "value"]


def test_ratio(spark):
    df = spark.createDataFrame([("(1,234)", "10,000"), ("5", "0"), ("5", "—")], "n string, d string")
    ratio = numbers.percent_ratio(numbers.signed_number(F.col("n")), numbers.signed_number(F.col("d")))
    assert [r[0] for r in df.select(ratio).collect()] == [-12.34, None, None]
    status = lookup.ratio_status(numbers.signed_number(F.col("n")), numbers.signed_number(F.col("d")))
    assert [r[0].status for r in df.select(status).collect()] == ["ok", "not_computable", "not_computable"]


def test_comparison_labels(spark):
    df = spark.createDataFrame([(12.34, 12.34), (1.0, 2.0), (3.0, 2.0), (None, 1.0)], "x double, y double")
    a, b = F.lit("A"), F.lit("B")
    assert [r[0] for r in df.select(lookup.compared(a, F.col("x"), b, F.col("y"))).collect()] == ["相同", "較高: B", "較高: A", "無法比較"]
    assert [r[0] for r in df.select(lookup.winner(a, F.col("x"), b, F.col("y"))).collect()] == ["較高: A", "較高: B", "較高: A", None]
    assert [r[0] for r in df.select(lookup.trend(F.col("x"), F.col("y"))).collect()] == ["持平", "上升", "下降", None]


def test_periods(spark):
    assert one(spark, periods.western_label, "114Q4", "2025Q4", "x", None) == ["2025Q4", "2025Q4", "x", None]
    assert one(spark, periods.sort_key, "113Q2", "bad", None) == [1132, -1, -1]
    assert one(spark, periods.header_kind, "2024年1月1日至6月30日", "2024年6月30日", "附註") == ["duration", "instant", "unknown"]
    assert one(spark, periods.header_start, "113年1月1日至6月30日", "2024年6月30日") == ["2024-01-01", None]
    assert one(spark, periods.header_end, "2023年7月1日至2024年6月30日", "113年6月30日") == ["2024-06-30", "2024-06-30"]


def test_headers_of_one_date_share_a_key(spark):
    keys = one(spark, periods.header_key, "2025年6月30日 2025/6/30", "資產負債表Balance Sheet_2025年6月30日2025/6/30", "本期")
    assert keys == ["2025年6月30日", "2025年6月30日", "本期"]


def test_names(spark):
    assert one(spark, texts.company_key, "家登精密工業股份有限公司", "Acme, Co., Ltd.", "ac-me") == ["家登精密工業", "ACME", "ACME"]
    assert one(spark, texts.safe_id, "Foo  Bar!", "台積 電") == ["foo_bar", "台積_電"]
    assert one(spark, texts.native_part, "商譽 Goodwill") == ["商譽"]
    assert one(spark, texts.latin_part, "商譽 Goodwill") == ["Goodwill"]
    assert one(spark, texts.cell, " a 　 b\t", "nan", None) == ["a b", "", ""]
    assert one(spark, texts.bracketed, "【甲】與【乙】") == [["甲", "乙"]]
    assert one(spark, texts.answer, "<think>x</think> 12 %, ok", None) == ["12%ok", ""]
    assert one(spark, lambda c: texts.masked(c, ["台積", "台積電"]), "台積電與台積") == ["＿公司＿與＿公司＿"]


def test_maps_keep_the_last_value_and_inner_signs(spark):
    assert one(spark, lambda c: maps.value_of(c, "a"), "a=1; b=2; a=3", "a=1=2", "b=1", None) == ["3", "1=2", None, None]
    assert one(spark, maps.summary, "value_2=x; value_5=1,000; value_6=" + "9" * 130) == ["value_5=1,000"]


@pytest.mark.parametrize("name,base,instance", [("現金流量表_2", "現金流量表", 2), ("現金流量表", "現金流量表", 1)])
def test_table_names(spark, name, base, instance):
    assert one(spark, texts.table_base, name) == [base]
    assert one(spark, texts.table_instance, name) == [instance]
