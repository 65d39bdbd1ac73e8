"""Test statistics, intervals, effect sizes and p values checked against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.distributions import p_columns
from ..functions.numbers import half_unit, num, p_text
from .base import check, findings, say, snippet


def _sentences(docs: DataFrame) -> DataFrame:
    """Sentences of the whole text, preamble and comments included."""
    return T.sentences(T.flavour(docs, "stat"), P.SPLIT_COUNT)


def _filled(*tokens: Column) -> Column:
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in tokens))


@check("stat_recompute", 6)
def p_values(docs: DataFrame) -> DataFrame:
    """A p value recomputed from the statistic printed before it, over the range that rounding leaves."""
    said = _sentences(docs).where(F.col("s").contains("=") & F.col("s").rlike(r"\b[pP]\s*[=<>]")).where(~F.col("s").rlike(P.STAT_SKIP))
    rows = T.each(said, T.matches(F.col("s"), P.TEST_RESULT, P.TEST_GROUPS), "i", "m", "doc_id", "pos")
    m = rows.select("doc_id", "pos", "i", "m.*")
    test = F.when(F.col("t") != "", "t").when(F.col("f") != "", "F").when(F.col("chi2") != "", "chi2").when(F.col("r") != "", "r").when(F.col("z") != "", "z").otherwise("bare")
    m = m.select(
        "doc_id", "pos", "i", "raw", "op", "stat", F.col("p").alias("p_txt"), test.alias("test"),
        num(_filled(F.col("tdf"), F.col("fdf1"), F.col("cdf"), F.col("rdf"))).alias("df1"), num(F.nullif(F.col("fdf2"), F.lit(""))).alias("df2"),
        num(F.col("p")).alias("p"), half_unit(F.col("p")).alias("hp"), F.abs(num(F.col("stat"))).alias("x"), half_unit(F.col("stat")).alias("hx"),
    )
    low = F.greatest(F.col("x") - F.col("hx"), F.lit(0.0))
    high = F.when(F.col("test") == "r", F.least(F.col("x") + F.col("hx"), F.lit(0.999999))).otherwise(F.col("x") + F.col("hx"))
    kind = F.when(F.col("test") == "bare", "z").otherwise(F.col("test"))
    m = m.withColumn("ps", p_columns(kind, F.array(low, high, F.col("x")), F.col("df1"), F.col("df2"))).where(F.get("ps", F.lit(0)).isNotNull())
    m = m.withColumns({"lo": F.array_min(F.slice("ps", 1, 2)), "hi": F.array_max(F.slice("ps", 1, 2)), "mid": F.get("ps", F.lit(2))})
    p, lo, hi, op, bare = F.col("p"), F.col("lo"), F.col("hi"), F.col("op"), F.col("test") == "bare"
    agrees = F.when(op == "=", (lo <= p + F.col("hp")) & (hi >= p - F.col("hp"))).when(op == "<", lo < p).otherwise(hi > p)
    said = F.when(op == "=", p < P.ALPHA).when(op == "<", p <= P.ALPHA).otherwise(F.lit(False))
    flips = (said != (hi < P.ALPHA)) & ((lo >= P.ALPHA) | (hi < P.ALPHA))
    # Without degrees of freedom the normal distribution gives the least p that any t can.
    impossible = (op != ">") & (p > 0) & (F.log10(F.greatest(lo, F.lit(1e-300))) - F.log10(p + F.col("hp")) > P.BARE_T_SLACK)
    bad = m.where(F.when(bare, impossible).otherwise(~agrees))
    grave = F.when(bare, (lo >= P.ALPHA) & (p < P.ALPHA)).otherwise(flips)
    why = F.when(bare, say("t = %s gives p of %s at least, whatever the degrees of freedom; p %s %s is printed.", F.col("stat"), p_text(lo), op, F.col("p_txt"))).otherwise(
        say("%s = %s gives p %s; p %s %s is printed.%s", F.col("test"), F.col("stat"), p_text(F.col("mid")), op, F.col("p_txt"), F.when(flips, " Significance changes with it.").otherwise(""))
    )
    return findings(
        bad, "stat_recompute", F.col("pos") * 1000 + F.col("i"), "pvalue_recompute_mismatch", F.when(grave, "major").otherwise("minor"), snippet(F.col("raw")), why,
        "Recompute p, or correct the statistic or its degrees of freedom; say so if the test was one-sided or corrected.", [F.col("p_txt"), F.col("stat")], F.when(bare | flips, 0.85).otherwise(0.7),
    )


@check("stat_recompute", 6)
def intervals(docs: DataFrame) -> DataFrame:
    """An estimate outside its interval, or else an interval and a p value that disagree on significance."""
    said = _sentences(docs).where(F.col("s").rlike("(?i)CI|confidence interval|credible interval")).where(~F.col("s").rlike(P.STAT_SKIP))
    rows = T.each(said, T.matches(F.col("s"), P.ESTIMATE, ("kind", "e", "l", "h", "op", "p")), "i", "m", "doc_id", "pos").select("doc_id", "pos", "i", "m.*")
    rows = rows.withColumns({"est": num(F.col("e")), "lo": num(F.col("l")), "hi": num(F.col("h")), "ratio": F.trim("kind").rlike(f"(?i)^{P.RATIO}$"), "slack": F.greatest(half_unit(F.col("e")), half_unit(F.col("l")), half_unit(F.col("h")))})
    est, lo, hi, slack, ratio, op, p = (F.col(c) for c in ("est", "lo", "hi", "slack", "ratio", "op", "p"))
    rows = rows.where((lo <= hi) & ~(ratio & ((lo <= 0) | (est <= 0))))
    outside = (est < lo - slack) | (est > hi + slack)
    null = F.when(ratio, 1.0).otherwise(0.0)
    excludes, includes = (lo - slack > null) | (hi + slack < null), (lo + slack < null) & (null < hi - slack)
    v = num(F.nullif(p, F.lit("")))
    significant, not_ = ((op == "=") & (v < P.ALPHA)) | ((op == "<") & (v <= P.ALPHA)), ((op == "=") & (v > P.ALPHA)) | (op == ">")
    clash = F.coalesce((op != "") & ((excludes & not_) | (includes & significant)), F.lit(False))
    bad = rows.where(outside | clash)
    why = F.when(outside, say("%s lies outside its own interval, %s to %s.", F.col("e"), F.col("l"), F.col("h"))).otherwise(
        say("The interval %s to %s %s the null value, and p %s %s says the opposite.", F.col("l"), F.col("h"), F.when(excludes, "excludes").otherwise("includes"), op, p)
    )
    return findings(
        bad, "stat_recompute", F.lit(1_000_000_000) + F.col("pos") * 1000 + F.col("i"), F.when(outside, "estimate_outside_interval").otherwise("interval_p_contradiction"), "major", snippet(F.col("raw")), why,
        "Compare the three with the analysis output and correct the one that is wrong.",
        F.when(outside, F.array("e", "l", "h")).otherwise(F.array("l", "h", "p")), F.when(outside, 0.85).otherwise(0.75),
    )


@check("stat_recompute", 6)
def effect_sizes(docs: DataFrame) -> DataFrame:
    """Partial eta squared follows from F and its degrees of freedom; plain eta squared is at most that."""
    rows = T.each(_sentences(docs).where(F.col("s").contains("eta")), T.matches(F.col("s"), P.ETA, ("d1", "d2", "f", "kind", "e")), "i", "m", "doc_id", "pos").select("doc_id", "pos", "i", "m.*")
    d1, d2, f, e = (num(F.col(c)) for c in ("d1", "d2", "f", "e"))
    share = lambda x: x * d1 / F.nullif(x * d1 + d2, F.lit(0.0))
    low, high, h = share(F.greatest(f - half_unit(F.col("f")), F.lit(0.0))), share(f + half_unit(F.col("f"))), half_unit(F.col("e"))
    bad = rows.where((e - h > high) | ((F.col("kind") == "etap2") & (e + h < low)))
    return findings(
        bad, "stat_recompute", F.lit(2_000_000_000) + F.col("pos") * 1000 + F.col("i"), "effect_size_mismatch", "minor", snippet(F.col("raw")),
        say("F(%s, %s) = %s gives a partial eta squared of %.3f; %s is printed.", F.col("d1"), F.col("d2"), F.col("f"), share(f), F.col("e")), "Correct the effect size, F or its degrees of freedom.", [F.col("e"), F.col("f")], 0.7,
    )


@check("pvalue", 11)
def p_clusters(docs: DataFrame) -> DataFrame:
    """Three or more printed p values just below 0.05."""
    near = F.filter(F.regexp_extract_all("t", F.lit(P.P_PRINTED), F.lit(1)), lambda p: (num(p) >= P.CLUSTER_FROM) & (num(p) < P.CLUSTER_TO))
    bad = T.settled(T.flavour(docs, "body"), ps=near).where(F.size("ps") >= P.CLUSTER_LEAST)
    return findings(bad, "pvalue", F.lit(0), "pvalue_clustering_below_0_05", "minor", F.lit("reported p-values"), say("%d p values stand just below 0.05: %s.", F.size("ps"), F.array_join("ps", ", ")), "Report exact values and the registration.", F.col("ps"), 0.4)


def _pairs(docs: DataFrame, pattern: str) -> DataFrame:
    rows = T.each(T.flavour(docs, "body"), T.matches(F.col("t"), pattern, ("stat", "p")), "i", "m", "doc_id").select("doc_id", "i", "m.*")
    return rows.withColumn("calc", F.get(p_columns(F.lit("z"), F.array(num(F.col("stat"))), F.lit(None), F.lit(None)), F.lit(0))).where((num(F.col("p")) > 0) & (F.col("calc") > 0))


@check("pvalue", 11, default=False)
def z_pairs(docs: DataFrame) -> DataFrame:
    """z and p that disagree by more than half a decade; off by default."""
    bad = _pairs(docs, P.Z_PAIR).where(F.abs(F.log10(num(F.col("p"))) - F.log10("calc")) > P.Z_SLACK)
    return findings(bad, "pvalue", F.lit(1_000_000) + F.col("i"), "pvalue_z_mismatch", "major", F.trim("raw"), say("z = %s gives p %s; %s is printed.", F.col("stat"), p_text(F.col("calc")), F.col("p")), "Recompute p from z.", [F.col("p")], 0.8)


@check("pvalue", 11, default=False)
def t_pairs(docs: DataFrame) -> DataFrame:
    """p more than a decade below what any t distribution gives; off by default."""
    bad = _pairs(docs, P.T_PAIR).where(F.log10("calc") - F.log10(num(F.col("p"))) > P.T_SLACK)
    return findings(bad, "pvalue", F.lit(2_000_000) + F.col("i"), "pvalue_t_impossible", "major", F.trim("raw"), say("t = %s gives p of %s at least; %s is printed.", F.col("stat"), p_text(F.col("calc")), F.col("p")), "Recompute p from t and its degrees of freedom.", [F.col("p")], 0.85)
