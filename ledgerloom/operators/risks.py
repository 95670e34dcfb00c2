"""Risk labels of a financial item or of a company, asked for in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import periods, texts
from ledgerloom.operators.checked import contained
from ledgerloom.operators.relations import period_fits
from ledgerloom.operators.relax import list_all, relax_filter
from ledgerloom.shared import kept

#: Characters of a company's name, a subject and an item's native part that count.
COMPANY, SUBJECT, SUBJECT_LEAST, NATIVE_LEAST = 4, 8, 4, 3
#: Edges that a direct answer reads, and how it is said.
MOST_EDGES = 10
SAID_ITEM, SAID_COMPANY = "根據風險圖譜顯示，{c}的{s}科目已被標記為{r}。", "根據風險圖譜顯示，{c}面臨的風險包括：{r}。"


def item_labels(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, answer, by: the risk labels of the item that a question is about, in order of disclosure, joined by ``;``.

    questions: qid, question, company, subject, quarter; evidence: company_name, item_name, period, label, seq. A company is found
    by its first characters within stored names; where no name has them, or none is asked, all are meant. The item is the
    longest native part of a stored name that stands in the question, and all names with that native part count, so that
    variants of an item join their labels (``by`` native). Else a subject names it, if all stored names that hold its
    first characters are one (subject), else the company's whole evidence answers (company). Periods, in either calendar,
    hold where any row has them. Questions without evidence are left out.

    Questions that ask for the same are one until their answer is known. Companies, items and subjects are matched as
    distinct names, evidence is one row per item, period and label of all companies that a start means, and a question
    meets the labels of its item, or of the whole company, only by equality.
    """
    start = F.coalesce(F.substring("company", 1, COMPANY), F.lit("")).alias("start")
    sub = F.when(F.length("subject") >= SUBJECT_LEAST, F.substring("subject", 1, SUBJECT)).otherwise("").alias("sub")
    asked = questions.select("qid", start, "question", sub, "quarter")
    spec = ["start", "question", "sub", "quarter"]
    specs = asked.select(*spec).distinct()
    native = texts.native_part(F.coalesce("item_name", F.lit("")))
    rows = evidence.where("label IS NOT NULL AND trim(label) != ''").select(F.coalesce("company_name", F.lit("")).alias("company_name"), F.coalesce("item_name", F.lit("")).alias("item_name"), native.alias("native"), F.coalesce("period", F.lit("")).alias("period"), "label", "seq")
    rows = kept(rows.groupBy("company_name", "item_name", "native", "period", "label").agg(F.min("seq").alias("seq")), "risk-evidence")
    names = rows.select("company_name").distinct()
    starts = specs.select("start").where("start != ''").distinct()
    held = kept(contained(names.withColumn("t", F.col("company_name")), starts, "company_name", "t", "start").select("start", "company_name"), "risk-starts")
    every, scope = F.lit("*"), F.concat(F.lit("="), "start").alias("scope")  # the scope of a question without a company is all rows
    scopes = rows.withColumn("scope", every).unionByName(rows.join(held.select("company_name", scope), "company_name")).drop("company_name")
    scopes = kept(scopes.groupBy("scope", "item_name", "native", "period", "label").agg(F.min("seq").alias("seq")), "risk-scopes")
    specs = specs.join(held.select("start", scope).distinct(), "start", "left").withColumn("scope", F.coalesce("scope", every))
    specs = kept(specs.withColumn("spec", F.monotonically_increasing_id()), "risk-questions")

    natives = rows.select("native").where(F.length("native") >= NATIVE_LEAST).distinct()
    met = contained(specs.select("question").distinct().withColumn("t", F.col("question")), natives, "question", "t", "native").select("question", "native")
    known = scopes.select("scope", "native").distinct()
    best = specs.join(met, "question").join(known, ["scope", "native"]).groupBy("spec").agg(F.max(F.struct(F.length("native").alias("n"), "native")).alias("b")).select("spec", F.col("b.native").alias("native"))
    best = kept(best, "risk-native")
    labels = lambda *by: scopes.groupBy("scope", *by, "period", "label").agg(F.min("seq").alias("seq"))
    by_native = best.join(specs, "spec").join(labels("native"), ["scope", "native"]).withColumn("by", F.lit("native"))

    rest = specs.join(best, "spec", "left_anti")
    subjects = rest.where("sub != ''").select("scope", "sub").distinct()
    items = rows.select("item_name").where("item_name != ''").distinct()
    holding = contained(items.withColumn("t", F.col("item_name")), subjects.select("sub").distinct(), "item_name", "t", "sub").select("sub", "item_name")
    one = subjects.join(holding, "sub").join(scopes.select("scope", "item_name").distinct(), ["scope", "item_name"])
    one = kept(one.groupBy("scope", "sub").agg(F.min("item_name").alias("item_name"), F.max("item_name").alias("other")).where("item_name = other").drop("other"), "risk-subject")
    by_subject = rest.join(one, ["scope", "sub"]).join(labels("item_name"), ["scope", "item_name"]).withColumn("by", F.lit("subject"))

    by_company = rest.join(one, ["scope", "sub"], "left_anti").join(labels(), "scope").withColumn("by", F.lit("company"))
    columns = ["spec", "quarter", "period", "label", "seq", "by"]
    found = by_native.select(*columns).unionByName(by_subject.select(*columns)).unionByName(by_company.select(*columns))
    found = relax_filter(found, ["spec"], (F.col("period") == F.col("quarter")) | (F.col("period") == periods.western_label(F.col("quarter"))))
    answers = specs.join(list_all(found, ["spec", "by"], F.col("label"), "seq", ";"), "spec").select(*[F.col(c).alias(f"_{c}") for c in spec], F.col("all_values").alias("answer"), "by")
    same = F.lit(True)
    for c in spec:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return asked.join(answers, same).select("qid", "answer", "by")


def direct_answers(questions: DataFrame, exposures: DataFrame) -> DataFrame:
    """qid, answer: a sentence on the risks that a company is exposed to.

    questions: qid, company_id, company_name, subject, quarters (array); exposures: source, period, matched, label, seq. Quarters and then the subject's
    first four characters within ``matched`` hold where any edge fits; the labels of the first MOST_EDGES edges are said.
    Exposures are joined by company; of equal edges of a company one is kept first.
    """
    edges = exposures.groupBy("source", "period", "matched", "label").agg(F.min("seq").alias("seq"))
    rows = questions.join(edges, questions["company_id"] == edges["source"])
    rows = relax_filter(rows, ["qid"], (F.size("quarters") > 0) & period_fits(F.col("period"), F.col("quarters")))
    rows = relax_filter(rows, ["qid"], (F.length("subject") >= 2) & F.coalesce(F.col("matched").contains(F.substring("subject", 1, 4)), F.lit(False)))
    first = rows.groupBy("qid", "company_name", "subject").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "label"))), 1, MOST_EDGES).alias("e"))
    labels = F.array_distinct(F.filter(F.transform("e", lambda x: x["label"]), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    said = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("【"), x, F.lit("】"))), "、")
    subject = F.coalesce("subject", F.lit(""))
    fill = lambda form: F.replace(F.replace(F.replace(F.lit(form), F.lit("{c}"), F.col("company_name")), F.lit("{s}"), subject), F.lit("{r}"), said)
    return first.where(F.size(labels) > 0).select("qid", F.when(subject != "", fill(SAID_ITEM)).otherwise(fill(SAID_COMPANY)).alias("answer"))
