"""Files of questions, and answers of models: JSON in text, boxed values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a file of questions on given evidence; exe_ans and answers may be numbers or texts.
SCHEMA = "id string, pre_text array<string>, table array<array<string>>, post_text array<string>, question string, answer string, exe_ans string, qa struct<question:string,answer:string,exe_ans:string,model_input:array<array<string>>>"
# What a boxed refusal says, and how numbers are printed.
BOXED_REFUSALS = ("找不到相關資料", "無法回答")
BOXED_NUMBER = re.compile(r"^\(?\s*-?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*\)?%?$|^\(?\s*-?\d+(?:\.\d+)?\s*\)?%?$")
_OPEN = re.compile(r"\\boxed\s*\{")


def evidence_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, context, question, answer; ids of skipped questions) of JSON arrays of questions in files below ``path``.

    The evidence is the gold evidence where it is given, else text, table and text. A question without words or answer is
    skipped. A file is one JSON value, so it is one task's; files are what is dealt.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    text = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    table = F.array_join(F.transform("table", lambda r: F.array_join(r, " | ")), "\n")
    own = F.array_join(F.filter(F.array(text("pre_text"), table, text("post_text")), lambda p: F.trim(p) != ""), "\n")
    gold = F.transform(F.filter("qa.model_input", lambda e: F.size(e) >= 2), lambda e: e[1])
    context = F.when(F.size("qa.model_input") > 0, F.array_join(gold, "\n")).otherwise(own)
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    question = F.coalesce(said("question"), said("qa.question"))
    answer = F.coalesce(said("qa.exe_ans"), said("qa.answer"), said("answer"), said("exe_ans"))
    rows = raw.select("id", context.alias("context"), question.alias("question"), answer.alias("answer"))
    whole = F.col("question").isNotNull() & F.col("answer").isNotNull()
    return rows.where(whole), rows.where(~whole).select("id")


def first_object(text: str | None) -> str | None:
    """The first JSON object in a text, printed anew; None without one.

    A text that is JSON as a whole, in a fence or not, is taken first; then one that begins with an object which was cut off
    is closed, if it then has a status; then the object whose opening brace comes first among those that close and are
    valid. Braces are matched in one pass with a stack, in which strings count as such.
    """
    s = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip(), flags=re.M).strip()
    closed = _parsed(s)
    if closed is not None:
        return closed
    ends, open_, quoted, escaped = {}, [], False, False
    for i, ch in enumerate(s):
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
        elif ch == '"' and open_:
            quoted = True
        elif ch == "{":
            open_.append(i)
        elif ch == "}" and open_:
            ends[open_.pop()] = i
    if s.startswith("{") and open_:
        tail = s.rstrip().rstrip(",") + ('"' if quoted else "")
        mended = _parsed(tail + "}" * len(open_))
        if mended is not None and "status" in json.loads(mended):
            return mended
    for start in sorted(ends):
        found = _parsed(s[start : ends[start] + 1])
        if found is not None:
            return found
    return None


def _parsed(s: str) -> str | None:
    try:
        value = json.loads(s)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None


def boxed_value(text: str | None) -> tuple[str | None, str]:
    """(value, state) of the one ``\\boxed{...}`` of an answer; braces inside may nest."""
    opens = list(_OPEN.finditer(text or ""))
    if len(opens) != 1:
        return None, "empty" if text is None else "multiple" if opens else "missing"
    depth, start = 1, opens[0].end()
    for brace in re.finditer(r"[{}]", text[start:]):
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            inner = text[start : start + brace.start()].strip()
            break
    else:
        return None, "unclosed"
    plain = re.sub(r"\\+%", "%", inner).strip()
    if plain in BOXED_REFUSALS:
        return inner, "ok_refusal"
    if not BOXED_NUMBER.match(plain.replace(" ", "")):
        return plain, "invalid_value"
    return plain, "normalized" if plain != inner else "ok"


def object_in(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(first_object, na_action="ignore").astype(object).where(lambda x: x.notna(), None), "string")(text)


def boxed(text: Column) -> Column:
    """struct(value, state) of a column of answers."""
    return F.pandas_udf(lambda s: pd.DataFrame([boxed_value(x) for x in s], columns=["value", "state"]), "struct<value:string,state:string>")(text)
