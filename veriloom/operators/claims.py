"""Claims beyond their evidence, and figures and tables that text and captions disagree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.numbers import num
from .base import check, findings, say, snippet


@check("claim_interval", 7)
def directional_claims(docs: DataFrame) -> DataFrame:
    """A direction claimed where the sentence's own interval spans zero or its p value is not significant."""
    prose = T.sub(F.col("body"), (P.FLOATS, " "), (P.TABULAR_CLAIMS, " "))
    prose = F.split_part(F.split_part(prose, F.lit("\\begin{thebibliography}"), F.lit(1)), F.lit("\\bibliography{"), F.lit(1))
    texts = T.settled(T.flavour(docs, "body").withColumnRenamed("t", "body"), t=prose).select("doc_id", "t")
    # Without a number there is no interval and no p value.
    rows = T.sentences(texts, P.SPLIT_CLAIM).where(F.col("s").rlike("[0-9]")).withColumnRenamed("s", "as_printed")
    rows = T.settled(T.settled(rows, s=T.claim_plain(F.col("as_printed"))), claim=T.sub(F.col("s"), *P.ALGEBRA)).where(F.col("claim").rlike(P.DIRECTION) & ~F.col("s").rlike(P.CONCEDES))
    spans = F.filter(T.matches(F.col("s"), P.INTERVAL, ("lo", "hi")), lambda m: (num(m["lo"]) < 0) & (num(m["hi"]) > 0))
    levels = F.transform(T.matches(F.col("s"), P.STATED_ALPHA, ("percent", "value")), lambda m: F.coalesce(num(F.nullif(m["percent"], F.lit(""))) / 100, num(m["value"])))
    rows = T.settled(rows, spans=spans, alpha=F.coalesce(F.array_max(levels), F.lit(P.ALPHA)))
    loose = F.filter(T.matches(F.col("s"), P.CLAIM_P, ("op", "p")), lambda m: ((m["op"] == "=") & (num(m["p"]) > F.col("alpha")) & (num(m["p"]) < 1)) | ((m["op"] == ">") & (num(m["p"]) >= F.col("alpha"))))
    bad = T.settled(rows, loose=loose).where((F.size("spans") > 0) | (F.size("loose") > 0))
    why = F.concat(F.transform("spans", lambda m: F.concat(m["lo"], F.lit(" to "), m["hi"], F.lit(" includes 0"))), F.transform("loose", lambda m: F.concat(F.lit("P = "), m["p"])))
    numbers = F.concat(F.flatten(F.transform("spans", lambda m: F.array(m["lo"], m["hi"]))), F.transform("loose", lambda m: m["p"]))
    return findings(
        bad, "claim_interval", "pos", "directional_claim_against_interval", "major", snippet(F.col("s")),
        say("The sentence claims '%s', which its evidence does not carry: %s.", F.regexp_extract("claim", P.DIRECTION, 0), F.array_join(why, "; ")),
        "Say what the interval supports, or give the test that excludes zero.", numbers, 0.7,
    )


@check("claim_interval", 7)
def uncited_floats(docs: DataFrame) -> DataFrame:
    """Labels of tables and figures that no reference command names."""
    bare = T.flavour(docs, "bare").where(F.col("t").contains("\\label{"))
    labels = T.each(bare, F.array_distinct(F.regexp_extract_all("t", F.lit(P.FLOAT_LABEL), F.lit(1))), "k", "label", "doc_id").select("doc_id", "label")
    keys = F.flatten(F.transform(T.matches(F.col("t"), P.ANY_REFERENCE, ("a", "b")), lambda m: F.split(F.concat_ws(",", m["a"], m["b"]), ",")))
    refs = T.each(bare, F.transform(keys, lambda k: F.trim(k)), "k", "label", "doc_id").select("doc_id", "label").distinct()
    bad = labels.join(refs, ["doc_id", "label"], "left_anti")
    return findings(
        bad, "claim_interval", F.lit(1_000_000_000) + F.pmod(F.hash("label"), F.lit(1 << 30)), "uncited_float", "minor", F.col("label"),
        say("\\label{%s} is referred to nowhere in the text.", F.col("label")), "Refer to it where its result is discussed, or drop it.", None, 0.9,
    )


def _nested(depth: int) -> str:
    """Text in balanced braces, down to a depth."""
    return r"[^{}]*" if depth == 0 else rf"(?:[^{{}}]|\{{{_nested(depth - 1)}\}})*"


CAPTION = rf"\\caption(?:\[[^\]]*\])?\{{({_nested(4)})\}}"


@check("figure_panels", 8)
def panel_references(docs: DataFrame) -> DataFrame:
    """References to a panel letter beyond those a figure's caption marks."""
    bare = T.flavour(docs, "bare").where(F.col("t").contains("\\begin{figure"))
    blocks = T.each(bare, F.regexp_extract_all("t", F.lit(P.FIGURE), F.lit(0)), "b", "block", "doc_id")
    letters = F.array_distinct(F.filter(F.flatten(F.transform(T.matches(F.regexp_extract("block", CAPTION, 1), P.PANEL_MARK, ("a", "b", "c", "d")), lambda m: F.array(m["a"], m["b"], m["c"], m["d"]))), lambda x: x != ""))
    marked = T.settled(blocks, letters=letters).where(F.size("letters") >= 2)
    panels = T.each(marked, F.regexp_extract_all("block", F.lit(P.ANY_LABEL), F.lit(1)), "k", "label", "doc_id", "b", "letters")
    last = panels.groupBy("doc_id", "label").agg(F.max_by(F.array_max("letters"), "b").alias("last"))
    spots = T.each(bare, T.found(F.col("t"), P.PANEL_REFERENCE, ("label", "marks"), P.PANEL_REFERENCE), "i", "m")
    named = F.regexp_extract_all(T.sub(F.col("m.marks"), (r"\band\b", " ")), F.lit("([a-h])"), F.lit(1))
    refs = spots.select("doc_id", "i", F.trim("m.label").alias("label"), T.window_text(F.col("t"), F.col("m.start"), F.col("m.end") + 160).alias("near"), named.alias("letters")).withColumn("letter", F.explode("letters"))
    bad = refs.join(last, ["doc_id", "label"]).where(F.col("letter") > F.col("last")).groupBy("doc_id", "label", "letter", "last").agg(F.min("i").alias("i"), F.min_by("near", "i").alias("near"))
    return findings(
        bad, "figure_panels", "i", "panel_reference_beyond_caption", "major", F.concat_ws(":", "label", "letter"),
        say("Panel %s of %s is referred to; the caption marks a to %s. Context: \"%s\"", F.col("letter"), F.col("label"), F.col("last"), T.sub(F.col("near"), (r"(?U)\s+", " "))),
        "Point to the panel that shows the result, or restore the panel.", None, 0.85,
    )
