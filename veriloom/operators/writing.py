"""Chat residue, tortured phrases, abbreviations and declarations."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .base import check, findings, say

_TORTURED = P.U + r"(?i)\b(" + "|".join(re.escape(k) for k in sorted(P.TORTURED, key=len, reverse=True)) + r")\b"
_DEFINITION = P.U + P.PY_DEFINITION
_BODY_START = P.U + "(?im)" + P.PY_BODY_START


@check("text_hygiene", 9)
def residue(docs: DataFrame) -> DataFrame:
    """Chat replies and placeholders; a text is reported once, and a reason once on a line."""
    # One alternation finds the few texts that the patterns are then applied to one by one.
    any_ = P.U + "(?im)" + "|".join(f"(?:{p})" for p, _ in P.RESIDUE)
    body = T.flavour(docs, "lines").withColumnRenamed("t", "b").where(F.col("b").rlike(any_))

    table = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(P.U + "(?im)" + p).alias("rx"), F.lit(why).alias("why")) for i, (p, why) in enumerate(P.RESIDUE)))

    def row(p: Column, m: Column) -> Column:
        before = T.window_text(F.col("b"), F.lit(0), m["start"])
        back = F.locate("\n", F.reverse(before))
        first = F.when(back == 0, F.lit(-1)).otherwise(m["start"] - back)
        last = F.call_function("locate", F.lit("\n"), F.col("b"), m["end"] + 1)
        return F.struct(
            (p["rank"] * 100_000_000 + m["start"]).alias("seq"), m["raw"].alias("raw"), F.lower(m["raw"]).alias("key"), p["why"].alias("why"),
            F.concat_ws("|", p["why"], first.cast("string"), last.cast("string")).alias("spot"), T.window_text(F.col("b"), m["start"] - 60, m["end"] + 60).alias("near"),
        )

    # The patterns that a text has, as rows; then their places in it.
    held = body.select("doc_id", "b", F.explode(table).alias("p")).where(F.rlike("b", F.col("p.rx")))
    spots = T.settled(held, ms=T.found(F.col("b"), F.col("p.rx")))
    placed = T.settled(spots, hits=F.transform("ms", lambda m: row(F.col("p"), m))).select("doc_id", "p.rank", "hits")
    hits = placed.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hits"))), lambda x: x["hits"])).alias("hits"))
    # In order: a hit stays if neither its text nor its reason on its line is among those that stayed before.
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("keys"), empty.alias("spots"), F.array().cast("array<bigint>").alias("kept"))

    def step(s: Column, h: Column) -> Column:
        new = ~F.array_contains(s["keys"], h["key"]) & ~F.array_contains(s["spots"], h["spot"])
        return F.when(new, F.struct(F.array_append(s["keys"], h["key"]).alias("keys"), F.array_append(s["spots"], h["spot"]).alias("spots"), F.array_append(s["kept"], h["seq"].cast("long")).alias("kept"))).otherwise(s)

    kept = T.settled(hits, kept=F.aggregate("hits", start, step)["kept"])
    rows = T.each(kept, F.filter("hits", lambda h: F.array_contains(F.col("kept"), h["seq"].cast("long"))), "k", "h", "doc_id").select("doc_id", "h.*")
    return findings(
        rows, "text_hygiene", "seq", "assistant_residue", "major", F.substring("raw", 1, 80), say("The text holds %s: \"...%s...\"", F.col("why"), F.trim("near")),
        "Delete it, or put the real content in its place.", None, 0.9,
    )


@check("text_hygiene", 9)
def tortured(docs: DataFrame) -> DataFrame:
    """Fixed terms replaced word by word, counted by phrase in any case of letters."""
    terms = F.create_map(*(F.lit(x) for k, v in P.TORTURED.items() for x in (k.lower(), v)))
    rows = T.each(T.flavour(docs, "lines"), F.regexp_extract_all("t", F.lit(_TORTURED), F.lit(1)), "i", "raw", "doc_id")
    by = rows.groupBy("doc_id", F.lower("raw").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"))
    term = F.element_at(terms, F.col("phrase"))
    return findings(by, "text_hygiene", F.lit(10_000_000_000) + F.col("i"), "tortured_phrase", "minor", F.col("phrase"), say("\"%s\" (%d times) stands for \"%s\".", F.col("phrase"), F.col("n"), term), say("Write \"%s\".", term), None, 0.85)


def _in_order(letters: Column, abbreviation: Column) -> Column:
    """Whether the abbreviation's letters stand in order among the initials."""
    rest = F.aggregate(F.reverse(letters), abbreviation, lambda left, x: F.when((left != "") & (F.right(left, F.lit(1)) == x), F.substring(left, F.lit(1), F.length(left) - 1)).otherwise(left))
    return rest == ""


def _definitions(docs: DataFrame) -> DataFrame:
    """(doc_id, b, abbr, at, tail): abbreviations with the place of each definition and the words it abbreviates."""
    # A definition needs a bracket; without one nothing is looked for.
    begin = F.regexp_instr("t", F.lit(_BODY_START))
    whole = T.settled(T.flavour(docs, "body").where(F.col("t").contains("(")), begin=F.greatest(begin, F.lit(1)))
    body = T.settled(whole, b=T.sub(F.substring("t", F.col("begin"), F.length("t")), (P.U + P.PY_REFERENCE_ARGS, " "))).select("doc_id", "b")
    rows = T.each(body, T.found(F.col("b"), _DEFINITION, ("words", "abbr")), "i", "m").select("doc_id", "b", "i", "m.*")
    core = T.sub(F.col("abbr"), ("s+$", ""))
    letters = F.transform(F.filter(F.split("words", r"[\s\-]+"), lambda w: w != ""), lambda w: F.lower(F.substring(w, 1, 1)))
    rows = rows.where(~F.col("abbr").isin(*P.ABBREVIATION_SKIP) & _in_order(letters, F.lower(core)))
    words = F.split(F.trim("words"), P.U + r"\s+")
    n = F.length(core) + 1
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")
    at = F.col("start") + F.length(F.regexp_extract("raw", P.U + r"^([\s\S]*\(\s*)", 1))
    return rows.select("doc_id", "b", "i", core.alias("abbr"), at.alias("at"), tail.alias("tail"))


@check("text_hygiene", 9)
def early_abbreviations(docs: DataFrame) -> DataFrame:
    """An abbreviation used in the body before its definition."""
    first = _definitions(docs).groupBy("doc_id", "abbr").agg(F.min_by(F.struct("b", "at", "tail"), "i").alias("d"), F.min("i").alias("i")).select("doc_id", "abbr", "i", "d.*")
    use = F.regexp_instr("b", F.concat(F.lit(r"(?<![A-Za-z0-9\-])"), F.col("abbr"), F.lit(r"s?(?![A-Za-z0-9\-])"))) - 1
    bad = first.withColumn("use", use).where((F.col("use") >= 0) & (F.col("use") < F.col("at") - 2))
    near = F.trim(F.replace(T.window_text(F.col("b"), F.col("use") - 50, F.col("use") + F.length("abbr") + 50), F.lit("\n"), F.lit(" ")))
    return findings(bad, "text_hygiene", F.lit(20_000_000_000) + F.col("i") * 2, "abbreviation_before_definition", "minor", F.col("abbr"), say("%s is used (\"...%s...\") before it is defined as \"%s\".", F.col("abbr"), near, F.col("tail")), say("Define %s at its first use.", F.col("abbr")), None, 0.7)


@check("text_hygiene", 9)
def double_abbreviations(docs: DataFrame) -> DataFrame:
    """An abbreviation with two expansions."""
    words = F.filter(F.split(F.regexp_replace(F.lower("tail"), "[^a-z ]", " "), " +"), lambda w: w != "")
    n = F.length("abbr")
    norm = F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")
    by = _definitions(docs).withColumn("norm", norm).groupBy("doc_id", "abbr").agg(F.countDistinct("norm").alias("n"), F.min("i").alias("i"), F.array_sort(F.collect_list(F.struct("i", "tail"))).alias("ts")).where("n > 1")
    tails = F.array_join(F.transform(F.slice("ts", 1, 3), lambda t: F.concat(F.lit('"'), t["tail"], F.lit('"'))), " / ")
    return findings(by, "text_hygiene", F.lit(20_000_000_001) + F.col("i") * 2, "abbreviation_two_expansions", "minor", F.col("abbr"), say("%s stands for %s.", F.col("abbr"), tails), say("Use one expansion of %s.", F.col("abbr")), None, 0.6)


def statements(docs: DataFrame) -> DataFrame:
    """(doc_id, statement, found, quote): the usual declarations, present or not."""
    flat = T.settled(docs.select("doc_id", "text"), t=T.statement_flat(F.col("text"))).select("doc_id", "t")
    # Letters that patterns take for others in any case of letters are written as those.
    flat = T.settled(flat, low=F.lower(F.translate("t", "İſ", "is")))
    rows = []
    for name, pattern in P.STATEMENTS.items():
        rx = P.U + ("" if name == "reporting_guideline" else "(?i)") + pattern
        text = F.col("t" if name == "reporting_guideline" else "low")
        may = reduce(or_, (text.contains(a) for a in P.STATEMENT_ANCHORS[name]))
        rows.append(F.struct(F.lit(name).alias("statement"), F.when(may, F.regexp_instr("t", F.lit(rx))).otherwise(0).alias("at"), F.lit(rx).alias("rx")))
    # The place of each, once; what stands there is read only where something does.
    placed = T.settled(flat, xs=F.array(*rows)).select("doc_id", "t", F.explode("xs").alias("x")).select("doc_id", "t", "x.*")
    raw = F.regexp_substr(F.substring("t", F.col("at"), F.lit(400)), F.col("rx"))
    quote = F.when(F.col("at") > 0, F.trim(T.window_text(F.col("t"), F.col("at") - 81, F.col("at") - 1 + F.length(raw) + 120))).otherwise("")
    return placed.select("doc_id", "statement", (F.col("at") > 0).alias("found"), quote.alias("quote"))
