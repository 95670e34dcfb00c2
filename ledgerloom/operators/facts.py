"""Facts in long form: unpivoting, enrichment and the views on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, periods, texts
from ledgerloom.operators.relax import keep_first

#: Words in the names of tables about single entities.
ENTITY_WORDS = (
    "被投資公司名稱", "列入合併財務報表之子公司", "母子公司間業務關係", "轉投資大陸地區之事業", "關係企業名稱", "關聯企業名稱", "投資公司名稱", "子公司名單", "關係人名錄",
)


def unpivot(wide: DataFrame, keep: Sequence[str], measures: dict[str, str], item: str = "item_name", value: str = "value_number") -> DataFrame:
    """One row per kept row and measure (column name to item name), without null values: one scan, no union."""
    long = wide.unpivot(list(keep), list(measures), "_measure", value)
    names = F.create_map(*[F.lit(x) for kv in measures.items() for x in kv])
    return long.where(F.col(value).isNotNull()).withColumn(item, names[F.col("_measure")]).drop("_measure")


def lookup_projection(facts: DataFrame) -> DataFrame:
    """The columns that lookups read, without blank values: pruned and filtered at the scan."""
    columns = ["seq", "company", "period", "table_name", "item_name", "column_header", "value_raw", "value_number"]
    return facts.select(*columns).where(F.trim("value_raw") != "")


def enrich(facts: DataFrame) -> DataFrame:
    """Adds what labels, headers and values say: periods, statement, names, sign, scale and a key."""
    h, p = F.col("column_header"), F.col("period")
    parsed = numbers.fact_number(F.col("value_raw"))
    return facts.withColumns({
        "fiscal_year": periods.fiscal_year(p), "year": periods.fiscal_year(p) + periods.ROC, "quarter": periods.quarter(p),
        "table_group": F.coalesce(texts.statement(F.col("table_name")), F.lit("other")), "is_main": texts.statement(F.col("table_name")).isNotNull(),
        "table_base": texts.table_base(F.col("table_name")), "table_instance": texts.table_instance(F.col("table_name")),
        "item_native": texts.native_part(F.col("item_name")), "item_latin": texts.latin_part(F.col("item_name")),
        "period_kind": periods.header_kind(h), "period_start": periods.header_start(h), "period_end": periods.header_end(h),
        "value_parsed": parsed, "value_sign": numbers.sign_name(parsed), "value_twd": parsed * 1000,
        "fact_key": texts.fact_key(F.col("company"), p, F.col("table_name"), F.col("item_name"), h, F.col("value_raw"), F.col("seq")),
    })


def duplicate_rank(facts: DataFrame, by: Sequence[str], seq: str = "seq") -> DataFrame:
    """Adds duplicate_rank (from 1, in order of disclosure) and is_duplicate within ``by``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(seq))
    return facts.withColumn("duplicate_rank", rank).withColumn("is_duplicate", F.col("duplicate_rank") > 1)


def is_entity_table(table_name: Column) -> Column:
    return F.coalesce(table_name.rlike("|".join(ENTITY_WORDS)), F.lit(False))


def current_view(facts: DataFrame) -> DataFrame:
    """The best row per company, item and period: durations first, the latest year in the header, then disclosure."""
    h = F.col("column_header")
    span = F.when(h.contains("至") | h.contains("To"), 1).otherwise(0)
    return keep_first(facts, ["company", "item_name", "period"], span.desc(), F.coalesce(periods.header_year(h), F.lit(0)).desc(), F.col("seq"))


def coverage(registry: DataFrame, facts: DataFrame, source: str) -> DataFrame:
    """Per registered source: number of facts, kinds of records and whether it has any; sources without facts too."""
    counts = facts.groupBy(source).agg(F.count("*").alias("n_facts"), F.array_join(F.sort_array(F.collect_set("record_type")), ",").alias("record_types"))
    return registry.join(counts, source, "left").select(source, F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("record_types", F.lit("")).alias("record_types"), F.col("n_facts").isNotNull().alias("has_facts"))
