"""Column headers, labels and file names as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.texts import cell

#: Titles of main statements that stand before a column's own name.
STATEMENT_TITLES = (
    "資產負債表", "Balance Sheet", "綜合損益表", "Statements of Comprehensive Income", "Statement of Comprehensive Income", "損益表", "Income Statement",
    "權益變動表", "Statements of Changes in Equity", "Statement of Changes in Equity", "現金流量表", "Statements of Cash Flows", "Statement of Cash Flows",
)
#: What the names of describing columns hold, and what those of value columns hold.
DESCRIBING = ("代號", "會計項目", "項目", "名稱", "說明", "備註", "附註", "關係人", "交易對象", "帳列項目", "科目", "編號", "公司名稱", "所在地區", "主要營業項目")
DESCRIBING_WHOLE = ("關係", "交易往來對象")
VALUES = (
    "本期", "去年同期", "上期", "前期", "期末", "期初", "金額", "餘額", "帳面金額", "取得價款", "交易金額", "股數", "比率", "比例", "百分比", "累計", "合計", "amount", "balance", "ratio", "shares",
)


def clean_header(c: Column) -> Column:
    """Without the date in slashes that repeats the one before it."""
    date = r"\d{4}/\d{1,2}/\d{1,2}"
    return F.trim(F.regexp_replace(cell(c), rf"(?i)\s+{date}(\s*To\s*(\d{{4}}/)?\d{{1,2}}/\d{{1,2}})?$", ""))


def flat_header(c: Column) -> Column:
    """A nested name without the table's name before the first underscore, if that holds a CJK character; a date or label
    and the Latin text that follows it get a blank between them."""
    tail = F.regexp_extract(c, r"(?s)^[^_]*[一-鿿][^_]*_(.+)$", 1)
    s = F.when(tail != "", tail).otherwise(c)
    return F.regexp_replace(F.regexp_replace(s, r"^(.*?\d{1,2}月\d{1,2}日)(\d{4}/.*)$", "$1 $2"), r"^(代號|會計項目)([A-Za-z].*)$", "$1 $2")


def header_words(c: Column) -> Column:
    """A column's own name: no ``Unnamed: n``, titles of statements or underscores."""
    s = F.regexp_replace(cell(c), r"(?i)Unnamed:\s*\d+(_level_\d+)?", "")
    for title in STATEMENT_TITLES:
        s = F.replace(s, F.lit(title), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.replace(s, F.lit("_"), F.lit(" ")), r"\s+", " "), r"^[ _-]+|[ _-]+$", "")


def is_describing(c: Column) -> Column:
    w = header_words(c)
    return w.isin(*DESCRIBING_WHOLE) | w.rlike("|".join(DESCRIBING))


def is_value(c: Column) -> Column:
    """Whether a column holds values: it does not describe, and its name has a date or a word of values."""
    both = F.concat(cell(c), F.lit("\n"), header_words(c))
    dated = both.rlike(r"\d{2,4}年\d{1,2}月\d{1,2}日|\d{4}/\d{1,2}/\d{1,2}")
    return ~is_describing(c) & (dated | F.lower(both).rlike("|".join(VALUES)))


def is_account_code(c: Column) -> Column:
    return F.regexp_replace(cell(c), "[, ]", "").rlike(r"(?i)^[A-Z]?\d{3,}[A-Z]?$")


def is_noise(header: Column, value: Column, number: Column) -> Column:
    """Ratios, blanks and dashes, and zeros are no evidence."""
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[,()]", "")))
    return header.contains("比率") | value.rlike("[%％]") | bare.isin("", "null", "nan", "none", "-", "－") | F.coalesce(F.abs(number) < 1e-12, F.lit(False))


def question_key(c: Column) -> Column:
    """Equal for questions that differ in blanks and brackets only."""
    return F.regexp_replace(c, r"[\s　（）()【】]", "")


def template_parts(question: Column) -> Column:
    """struct(company, header, item) of a question in the fixed form; null otherwise."""
    form = r"^\s*請教【(.+?)】在【(.+?)】的【(.+?)】是多少？"
    return F.when(question.rlike(form), F.struct(*[F.regexp_extract(question, form, i).alias(n) for i, n in enumerate(("company", "header", "item"), 1)]))


def segments(answer: Column) -> Column:
    """map of ``a: 1 ｜ b: 2``; of a repeated name the last value."""
    parts = F.filter(F.split(answer, r"\s*[｜|]\s*"), lambda s: s.rlike("[:：]"))
    pairs = F.transform(parts, lambda s: F.struct(F.trim(F.regexp_extract(s, r"(?s)^(.*?)(?::|：)(.*)$", 1)).alias("k"), F.trim(F.regexp_extract(s, r"(?s)^(.*?)(?::|：)(.*)$", 2)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def quarter_of(c: Column) -> Column:
    """The quarter of ``Qn``, else the first digit from 1 to 4, else 0."""
    text = F.upper(cell(c))
    named, digit = F.regexp_extract(text, "Q([1-4])", 1), F.regexp_extract(text, "([1-4])", 1)
    return F.when(named != "", named.cast("int")).when(digit != "", digit.cast("int")).otherwise(0)


def filter_list(c: Column) -> Column:
    """The distinct values of a list with commas, semicolons or blanks."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[,;\s]+"), lambda x: x != ""))


def visual_columns(line: Column) -> Column:
    """A printed line cut at two blanks or more; a line without any is one column, a blank line none."""
    return F.filter(F.transform(F.split(F.rtrim(line), r"[ \t]{2,}"), lambda x: F.trim(x)), lambda x: x != "")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def cut_bytes(c: Column, most: int) -> Column:
    """The longest beginning of whole characters within ``most`` bytes of UTF-8, trimmed."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(c), F.lit(most))), lambda n: F.octet_length(F.left(c, n)) <= most)
    return F.trim(F.left(c, F.array_max(fits)))


def file_name(c: Column, most: int = 180) -> Column:
    """A safe file name for CSV, within ``most`` bytes: blanks and what paths reserve are underscores."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\s]+', "_"), r"^[._\- ]+|[._\- ]+$", "")
    return F.concat(cut_bytes(F.when(F.regexp_replace(stem, "_+", "_") == "", "untitled").otherwise(F.regexp_replace(stem, "_+", "_")), most - 4), F.lit(".csv"))


def symbol(c: Column, fallback: str) -> Column:
    """A label or relation type: other characters than ASCII letters, digits and underscores are one underscore; what then
    begins with none of these but digits, or is empty, is ``fallback``."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z_]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(s.rlike("^[A-Za-z_]"), s).otherwise(fallback)


#: How the names of files end, or what they hold, that are no tables of a report.
OTHER_FILES, OTHER_FILES_HOLD = ("_facts.csv", "_source_table_index.csv", "_xbrl_notes.csv", "_xbrl_notes_structured.csv", "_numeric_facts.csv", "_coverage_report.csv"), ("_all_table_facts",)


def is_report_file(name: Column) -> Column:
    other = F.lit(False)
    for end in OTHER_FILES:
        other |= name.endswith(end)
    for part in OTHER_FILES_HOLD:
        other |= name.contains(part)
    return ~other
