"""Numbers in the text against the table row that a sentence names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.numbers import num, places
from .base import check, findings, say
from .claims import CAPTION

EPS = 1e-9


def cells(docs: DataFrame) -> DataFrame:
    """(doc_id, block, row, label, values): rows of tabulars with a label of three characters or more and decimals, as printed."""
    blocks = T.each(T.flavour(docs, "bare").where(F.col("t").contains("\\begin{")), F.regexp_extract_all("t", F.lit(P.TABULAR_LOOSE), F.lit(0)), "block", "b", "doc_id")
    rows = T.settled(T.each(blocks, F.split("b", r"\\\\", -1), "row", "r"), cells=F.split("r", "&", -1)).where(F.size("cells") >= 2)
    label = T.label_key(T.sub(F.get("cells", F.lit(0)), (P.PY_TABLE_RULES, " ")))
    values = F.flatten(F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: T.decimals_in(T.sub(c, (P.PY_PLUS_MINUS, " ")))))
    made = T.settled(rows, label=label, values=values).select("doc_id", "block", "row", "label", "values")
    return made.where((F.length("label") >= 3) & (F.size("values") > 0) & ~F.col("label").rlike(r"^[\d .+\-]+$"))


def prose(body: Column) -> Column:
    """A body up to the bibliography, floats as their captions, without tabulars."""
    body = F.get(F.split(body, P.PY_BIBLIOGRAPHY, 2), F.lit(0))
    floats = "(?s)" + P.PY_FLOAT
    pieces, raw = F.split(body, floats, -1), F.regexp_extract_all(body, F.lit(floats), F.lit(0))
    captions = F.transform(raw, lambda b: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(b, F.lit(CAPTION), F.lit(1)), ". "), F.lit(". ")))
    return T.sub(F.array_join(F.flatten(F.zip_with(pieces, captions, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), ""), (P.TABULAR_LOOSE, " "))


def _rounds_to(cell: Column, value: Column, digits: Column) -> Column:
    """Whether a cell, or its hundredfold or hundredth, rounds to the value at its digits, or the value to a coarser cell."""
    def one(factor: float, shift: int) -> Column:
        scaled, own = num(cell) * factor, F.greatest(places(cell) + shift, F.lit(0))
        return (F.abs(scaled - value) <= 0.5 * F.pow(F.lit(10.0), -digits.cast("double")) + EPS) | ((own < digits) & (F.abs(scaled - value) <= 0.5 * F.pow(F.lit(10.0), -own.cast("double")) + EPS))

    return one(1.0, 0) | one(100.0, -2) | one(0.01, 2)


@check("number_agreement", 1)
def prose_table(docs: DataFrame) -> DataFrame:
    """A decimal beside a row's label that is close to one of the row's cells and equal to no cell."""
    rows = cells(docs)
    labels = rows.groupBy("doc_id", "label").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "values"))), lambda x: x["values"])).alias("values"))
    tables = labels.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("label")).alias("n"), "label", "values"))).alias("labels"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.contains("&"))
    verbatim = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(P.DECIMAL.replace("-?", "")), F.lit(0)))))
    body = T.flavour(docs, "body").withColumnRenamed("t", "body")
    held = T.flavour(docs, "bare").join(body, "doc_id").join(tables, "doc_id")
    base = T.settled(T.settled(held, verbatim=verbatim, prose=prose(F.col("body"))), ss=F.split("prose", P.SPLIT_PROSE, -1))
    s = base.select("doc_id", "labels", "verbatim", F.posexplode("ss").alias("pos", "s"))
    figure_only = F.col("s").rlike("(?i)" + P.PY_FIGURE_REF) & ~F.col("s").rlike("(?i)" + P.PY_TABLE_REF)
    s = s.where(F.col("s").rlike(r"\d\.\d")).where(~F.col("s").rlike("(?i)" + P.PY_SUBSET) & ~figure_only)
    s = T.settled(s, numbers=T.decimals_in(F.col("s"))).where(F.size("numbers") > 0)
    plain = F.concat(F.lit(" "), T.label_key(F.col("s")), F.lit(" "))
    named = lambda lab: F.when(lab.rlike("[一-鿿]"), F.col("plain").contains(lab)).otherwise(F.col("plain").contains(F.concat(F.lit(" "), lab, F.lit(" "))))
    s = T.settled(T.settled(s, plain=plain), hits=F.filter("labels", lambda x: named(x["label"]))).where(F.size("hits") > 0)
    # Labels come longest first; one inside a label already named is the same mention.
    s = T.settled(s.withColumnRenamed("hits", "all_hits"), hits=F.aggregate("all_hits", F.slice("all_hits", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: y["label"].contains(x["label"])), acc).otherwise(F.array_append(acc, x))))
    s = s.where(~((F.size("hits") > 1) & (F.size("numbers") > 1)))
    each = s.select("doc_id", "verbatim", "labels", "pos", "s", "hits", F.posexplode("numbers").alias("i", "number"))
    at = F.call_function("locate", F.col("number"), F.col("s")) - 1
    spots = F.filter(F.transform("hits", lambda h: F.struct((F.call_function("locate", h["label"], F.lower("s")) - 1).alias("p"), h["label"].alias("label"), h["values"].alias("values"))), lambda x: (x["p"] >= 0) & (x["p"] < F.col("at")))
    each = T.settled(T.settled(each, at=at), before=F.array_max(spots)).where((F.size("hits") == 1) | F.col("before").isNotNull())
    one = F.size("hits") == 1
    each = each.withColumns({
        "label": F.when(one, F.get("hits", F.lit(0))["label"]).otherwise(F.col("before.label")), "cells": F.when(one, F.get("hits", F.lit(0))["values"]).otherwise(F.col("before.values")),
        "close": one | (F.col("at") - F.col("before.p") - F.length("before.label") <= P.LABEL_REACH), "value": num(F.col("number")), "digits": places(F.col("number")),
    })
    quoted = F.regexp_replace("number", r"([.\-])", r"\\$1")
    rough, setting = F.concat(F.lit("(?i)" + P.PY_APPROXIMATE), quoted, F.lit(r"(?!\d)")), F.concat(F.lit(r"[A-Za-z\\}]\s*=\s*\$?\s*"), quoted, F.lit(r"(?!\d)"))
    value, digits = F.col("value"), F.col("digits")
    each = each.where(~F.rlike("s", rough) & ~F.rlike("s", setting) & ~F.array_contains("verbatim", F.regexp_replace("number", "^-+", "")))
    each = each.where(~F.exists("labels", lambda x: F.exists(x["values"], lambda c: _rounds_to(c, value, digits))))
    near = F.get(F.filter("cells", lambda c: (num(c) != 0) & (F.abs(num(c) - value) <= P.NEAR_SHARE * F.abs(num(c))) & (F.abs(num(c) - value) <= P.NEAR_UNITS * F.pow(F.lit(10.0), -digits.cast("double")) + 1e-12)), F.lit(0))
    bad = T.settled(each, near=near).where(F.col("near").isNotNull()).withColumn("seq", F.col("pos") * 1000 + F.col("i"))
    first = bad.groupBy("doc_id", "label", "number").agg(F.min("seq").alias("seq"), F.min_by(F.struct("s", "near", "close"), "seq").alias("f")).select("doc_id", "label", "number", "seq", "f.*")
    contrast = F.col("s").rlike("(?i)" + P.PY_CONTRAST) | ~F.col("close")
    return findings(
        first, "number_agreement", "seq", "prose_table_number_disagreement", F.when(contrast, "minor").otherwise("major"), F.concat(F.lit("prose:"), F.col("label")),
        say("The text gives %s for '%s'; the row's nearest value is %s. Sentence: \"%s\"", F.col("number"), F.col("label"), F.col("near"), F.substring(F.trim(T.sub(F.col("s"), (r"(?U)\s+", " "))), 1, 240)),
        "Give one value in text and table, or name how one follows from the other.", [F.col("number"), F.col("near")], F.when(contrast, 0.4).otherwise(0.7),
    )
