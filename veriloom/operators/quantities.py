"""Percentages, counts, changes, products and means recomputed from the numbers printed beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.numbers import half_unit, num, places, with_suffix
from .base import check, findings, say, snippet

#: Rounding of doubles never decides: comparisons allow this much.
EPS = 1e-9


def _count_sentences(docs: DataFrame) -> DataFrame:
    return T.sentences(T.flavour(docs, "count"), P.SPLIT_COUNT)


def _fractions(s: Column) -> Column:
    """k of n (p%) in both languages, in the order English first."""
    zh = F.transform(T.matches(s, P.FRACTION_ZH, ("n", "k", "p")), lambda m: F.struct(m["raw"].alias("raw"), m["k"].alias("k"), m["n"].alias("n"), m["p"].alias("p")))
    return F.concat(T.matches(s, P.FRACTION, ("k", "n", "p")), zh)


@check("grimmer", 4)
def percent_counts(docs: DataFrame) -> DataFrame:
    """k/n (p%): the percentage must be the count over the denominator, as printed."""
    rows = T.each(_count_sentences(docs).where(F.col("s").contains("%")), _fractions(F.col("s")), "i", "m", "doc_id", "pos").select("doc_id", "pos", "i", "m.*")
    k, p = (num(F.col(c)) for c in ("k", "p"))
    n = F.nullif(num(F.col("n")), F.lit(0.0))
    bad = rows.where((n > 0) & (k <= n) & (F.abs(100 * k / n - p) > half_unit(F.col("p")) + EPS))
    shown = F.call_function("format_number", 100 * k / n, F.greatest(places(F.col("p")), F.lit(1)))
    return findings(
        bad, "grimmer", F.col("pos") * 1000 + F.col("i"), "percent_count_mismatch", "major", snippet(F.col("raw"), 100),
        say("%s of %s makes %s%%, where %s%% is printed.", F.col("k"), F.col("n"), shown, F.col("p")),
        say("Print %s%%, or correct the count or the denominator.", shown), [F.col("p"), F.col("k"), F.col("n")], 0.85,
    )


@check("grimmer", 4)
def percent_denominators(docs: DataFrame) -> DataFrame:
    """Three or more k (p%) in a sentence: one whose denominator cannot be that of the others.

    A pair allows the denominators of an interval; the others' common interval is the greatest low end to
    the least high end, so each pair is left out in turn without listing denominators.
    """
    s = F.col("s")
    pairs = F.filter(T.matches(s, P.COUNT_PERCENT, ("k", "p")), lambda m: (num(m["p"]) > 0) & (num(m["p"]) < 100) & (num(m["k"]) > 0))
    low = lambda m: F.ceil(num(m["k"]) * 100 / (num(m["p"]) + half_unit(m["p"])) - EPS)
    high = lambda m: F.floor(num(m["k"]) * 100 / F.greatest(num(m["p"]) - half_unit(m["p"]), F.lit(EPS)) + EPS)
    ranged = F.transform(pairs, lambda m: F.struct(m["k"].alias("k"), m["p"].alias("p"), low(m).alias("lo"), high(m).alias("hi")))
    rows = _count_sentences(docs).where(s.contains("%")).where(F.size(_fractions(s)) == 0)
    rows = T.settled(rows, r=ranged).where(F.size("r") >= 3)
    rows = rows.where(~F.exists("r", lambda x: x["hi"] - x["lo"] >= P.WIDEST_RANGE))
    ends = lambda r: F.struct(F.array_max(F.transform(r, lambda x: x["lo"])).alias("lo"), F.array_min(F.transform(r, lambda x: x["hi"])).alias("hi"))
    rows = T.settled(rows, all=ends(F.col("r"))).where(F.col("all.lo") > F.col("all.hi"))
    each = rows.select("doc_id", "pos", "s", "r", F.posexplode("r").alias("i", "own")).withColumn("rest", ends(F.filter("r", lambda x, j: j != F.col("i"))))
    odd = each.where((F.col("rest.lo") <= F.col("rest.hi")) & ((F.col("own.lo") > F.col("rest.hi")) | (F.col("own.hi") < F.col("rest.lo"))))
    first = odd.groupBy("doc_id", "pos").agg(F.min_by(F.struct("s", "own", "rest"), "i").alias("f")).select("doc_id", "pos", "f.*")
    return findings(
        first, "grimmer", F.col("pos") * 1000 + 500, "percent_denominator_outlier", "minor", say("%s (%s%%)", F.col("own.k"), F.col("own.p")),
        say("The sentence's other counts are shares of %d; %s (%s%%) is not. Sentence: \"%s\"", F.col("rest.lo"), F.col("own.k"), F.col("own.p"), snippet(F.col("s"), 160)),
        "Compare this count with its table, and name its denominator where it differs.", [F.col("own.p"), F.col("own.k")], 0.6,
    )


def grimmer_possible(mean: Column, sd: Column, n: Column) -> Column:
    """Whether an integer sum and sum of squares of equal parity give the printed mean and deviation."""
    m, s, hm, hs = num(mean), num(sd), half_unit(mean), half_unit(sd)
    sums = F.sequence(F.ceil((m - hm) * n - EPS).cast("long"), F.greatest(F.ceil((m - hm) * n - EPS), F.floor((m + hm) * n + EPS)).cast("long"))

    def fits(total: Column) -> Column:
        base = total * total / n
        least = F.ceil((n - 1) * F.pow(F.greatest(s - hs, F.lit(0.0)), 2) + base - EPS)
        least = least + F.pmod(least - total, F.lit(2))
        return (total <= F.floor((m + hm) * n + EPS)) & (least <= (n - 1) * F.pow(s + hs, 2) + base + EPS)

    return (n < 2) | F.exists(sums, fits)


@check("grimmer", 4)
def grimmer(docs: DataFrame) -> DataFrame:
    """Mean and standard deviation of N integer answers that no answers give."""
    s = F.col("s")
    sizes = F.array_distinct(F.transform(T.matches(s, P.SAMPLE_SIZE, ("a", "b")), lambda m: F.nullif(num(F.when(m["a"] != "", m["a"]).otherwise(m["b"])), F.lit(0.0))))
    rows = _count_sentences(docs).where(s.rlike("(?i)" + P.INTEGER_SCALE + "|" + P.INTEGER_SCALE_ZH) & ~s.rlike(P.RUN_WORDS))
    rows = T.settled(rows, sizes=sizes).where((F.size("sizes") == 1) & F.get("sizes", F.lit(0)).between(2, P.LARGEST_GRIM_N))
    hits = T.each(rows.select("doc_id", "pos", "s", F.get("sizes", F.lit(0)).alias("n")), T.matches(s, P.MEAN_SD, ("a", "b", "c", "d")), "i", "m", "doc_id", "pos", "n")
    hits = hits.select("doc_id", "pos", "i", "n", "m.raw", F.when(F.col("m.a") != "", F.col("m.a")).otherwise(F.col("m.c")).alias("mean"), F.when(F.col("m.a") != "", F.col("m.b")).otherwise(F.col("m.d")).alias("sd"))
    mean, sd, n = F.col("mean"), F.col("sd"), F.col("n")
    whole = F.floor((num(mean) + half_unit(mean)) * n + EPS) >= F.ceil((num(mean) - half_unit(mean)) * n - EPS)
    bad = hits.where((places(mean) == 2) & (num(sd) != 0) & (num(mean) >= 1)).where(whole & ~grimmer_possible(mean, sd, n))
    return findings(
        bad, "grimmer", F.col("pos") * 1000 + F.col("i") - 500_000_000, "grimmer_infeasible_sd", "major", snippet(F.col("raw"), 100),
        say("No %d integer answers have mean %s and standard deviation %s: a sum and a sum of squares of one parity do not fall inside the rounding (GRIMMER).", n.cast("int"), mean, sd),
        "Recompute both from the answers, or correct N.", [mean, sd], 0.8,
    )


def grim_possible(mean: Column, decimals: Column, n: Column) -> Column:
    """Whether some integer total over n rounds to the printed mean; rounding is half to even."""
    scale = F.pow(F.lit(10.0), decimals.cast("double"))
    at = F.floor(num(mean) * n).cast("long")
    return F.exists(F.sequence(at - 1, at + 2), lambda k: (k >= 0) & (F.rint(k / n * scale) == F.rint(num(mean) * scale)))


@check("grim", 5)
def grim(docs: DataFrame) -> DataFrame:
    """Means of N integers that no integer total gives; the mean may stand before N or after it."""
    body = T.flavour(docs, "body").withColumnRenamed("t", "body")
    one = F.transform(T.found(F.col("body"), P.GRIM_MEAN_FIRST, ("mean", "tail", "n")), lambda m: F.struct(F.lit(0).alias("order"), m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), m["mean"].alias("mean"), m["n"].alias("n")))
    two = F.transform(T.found(F.col("body"), P.GRIM_SIZE_FIRST, ("n", "mean", "tail")), lambda m: F.struct(F.lit(1).alias("order"), m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), m["mean"].alias("mean"), m["n"].alias("n")))
    rows = T.each(body.where(F.col("body").rlike(r"\b[nN]\s*=")), F.concat(one, two), "k", "m").select("doc_id", "m.*", T.window_text(F.col("body"), F.col("m.start") - 200, F.col("m.end") + 120).alias("near"))
    n, mean = F.nullif(num(F.col("n")), F.lit(0.0)), F.col("mean")
    bad = rows.where(F.col("near").rlike(P.U + "(?i)" + P.INTEGER_SCALE) & (n > 1) & (n <= P.LARGEST_GRIM_N)).where(~grim_possible(mean, places(mean), n))
    return findings(
        bad, "grim", F.col("order") * 1_000_000_000 + F.col("start"), "grim_infeasible_mean", "major", snippet(F.col("raw"), 80),
        say("No total of %s integers gives a mean of %s as printed (GRIM).", F.col("n"), mean), "Recompute the mean from the total, or correct N.", [mean], 0.85,
    )


@check("consistency", 3)
def compute_budget(docs: DataFrame) -> DataFrame:
    """Tasks times seeds times the hours of one against the stated training budget."""
    body = T.flavour(docs, "body").where(F.col("t").rlike("(?i)seed") & F.col("t").rlike("(?i)GPU")).withColumnRenamed("t", "body")
    first = lambda p: num(F.nullif(F.regexp_extract("body", p, 1), F.lit("")))
    rows = T.settled(body, g=first(P.BUDGET_UNIT), t=first(P.BUDGET_TASKS), s=first(P.BUDGET_SEEDS), p=first(P.BUDGET_TOTAL))
    product = F.col("t") * F.col("s") * F.col("g")
    off = F.abs(product - F.col("p")) / F.greatest(F.col("p"), F.lit(1.0))
    bad = rows.where((F.col("g") > 0) & (F.col("t") > 0) & (F.col("s") > 0) & (F.col("p") > 0) & (off > P.BUDGET_SLACK))
    whole = lambda c: c.cast("long").cast("string")
    return findings(
        bad, "consistency", F.lit(0), "compute_budget_inconsistency", "critical", say("primary training budget: stated %s GPU-hours", whole(F.col("p"))),
        say("%s tasks, %s seeds and %s GPU-hours for each make %s GPU-hours; %s are stated.", whole(F.col("t")), whole(F.col("s")), F.col("g").cast("string"), product.cast("string"), whole(F.col("p"))),
        "Bring cost, tasks, seeds and total into agreement.", [whole(F.col("p")), whole(product)], 0.9,
    )


@check("consistency", 3)
def product_totals(docs: DataFrame) -> DataFrame:
    """total things (a x b [x c]): the factors must multiply to the total."""
    rows = T.each(T.flavour(docs, "body"), T.matches(F.col("t"), P.PRODUCT, ("total", "a", "b", "c")), "i", "m", "doc_id").select("doc_id", "i", "m.*")
    factors = F.filter(F.array(F.col("a"), F.col("b"), F.col("c")), lambda x: x != "")
    product = F.aggregate(factors, F.lit(1.0), lambda acc, x: acc * num(x))
    total = with_suffix(F.col("total"))
    soft = F.col("total").rlike("[~≈Kk]")
    off = F.abs(product - total) / F.greatest(total, F.lit(1.0))
    bad = rows.select("doc_id", "i", "raw", total.alias("t"), product.alias("p"), off.alias("off"), soft.alias("soft")).where(F.col("off") > F.when(F.col("soft"), P.PRODUCT_SLACK_SOFT).otherwise(P.PRODUCT_SLACK))
    whole = lambda c: c.cast("long").cast("string")
    return findings(
        bad, "consistency", F.lit(1_000_000) + F.col("i"), "product_total_mismatch", "major", snippet(F.col("raw"), 80),
        say("The factors multiply to %s; %s is stated.", whole(F.col("p")), whole(F.col("t"))), "Bring the factors and the total into agreement.", [whole(F.col("t")), whole(F.col("p"))], 0.8,
    )


@check("consistency", 3)
def split_shares(docs: DataFrame) -> DataFrame:
    """Shares of a train, validation and test partition that add up to over 100 %.

    Each percentage goes to the nearest partition word within 20 characters, and a word keeps its first.
    """
    body = T.flavour(docs, "body").withColumnRenamed("t", "body").where(F.col("body").rlike(P.ESCAPED_PERCENT))
    spots = T.each(body, T.found(F.col("body"), P.PARTITION), "i", "m")
    wins = T.settled(spots, w=T.window_text(F.col("body"), F.col("m.start") - 40, F.col("m.start") + 130)).select("doc_id", "i", "w").where(~F.col("w").rlike(P.PARTITION_SKIP))
    words = F.transform(T.found(F.col("w"), P.PARTITION_WORD), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substring(F.lower(m["raw"]), 1, 3).alias("word")))
    shares = T.found(F.col("w"), P.ESCAPED_PERCENT, ("value",))
    wins = T.settled(wins.where(F.col("w").rlike(P.ESCAPED_PERCENT)), words=words, shares=shares)
    rows = wins.select("doc_id", "i", "w", "words", F.posexplode("shares").alias("j", "p"))
    gap = lambda w: F.greatest(w["start"] - F.col("p.end"), F.col("p.start") - w["end"], F.lit(0))
    near = rows.withColumn("best", F.array_min(F.transform("words", lambda w: F.struct(gap(w).alias("gap"), w["word"].alias("word"))))).where(F.col("best.gap") <= 20)
    own = near.groupBy("doc_id", "i", F.col("best.word").alias("word")).agg(F.min_by("p.value", "j").alias("v"), F.min("j").alias("j"), F.first("w").alias("w"))
    by = own.groupBy("doc_id", "i").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("j", num(F.col("v")).alias("v")))).alias("vs"))
    parts = by.select("doc_id", "i", "w", F.filter(F.transform("vs", lambda x: x["v"]), lambda v: (v > 0) & (v < 100)).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    bad = parts.where(F.size("parts").between(2, 4) & (total > 101.5))
    first = bad.groupBy("doc_id", "parts").agg(F.min("i").alias("i"), F.min_by("w", "i").alias("w"))
    return findings(
        first, "consistency", F.lit(2_000_000) + F.col("i"), "split_percentages_exceed_100", "major", snippet(F.col("w"), 80),
        say("The partition's shares %s add up to %s%%.", F.array_join(F.col("parts").cast("array<string>"), ", "), total.cast("string")),
        "Give a partition whose shares add up to 100%.", F.col("parts").cast("array<string>"), 0.7,
    )


def _metric(metric: str) -> str:
    """metric = value, with no qualifying word wholly within reach on either side.

    The name comes first, so that the looks behind are taken at names alone.
    """
    before = "".join(rf"(?<!(?i:{w})[\s\S]{{0,{P.METRIC_REACH - len(w)}}}{metric})" for w in P.METRIC_QUALIFIERS)
    after = "".join(rf"(?![\s\S]{{0,{P.METRIC_REACH - len(w)}}}{w})" for w in P.METRIC_QUALIFIERS)
    # The name is matched as written; the qualifiers around it in any case.
    return rf"{P.U}({metric}){before}\s*[=:]\s*(\d+(?:\.\d+)?)(?![\d.]*\d)(?i:{after})"


@check("consistency", 3)
def cross_sections(docs: DataFrame) -> DataFrame:
    """A headline metric given three or more values without a qualifier nearby."""
    body = T.flavour(docs, "body").withColumnRenamed("t", "body")

    def values(m: str) -> Column:
        return F.transform(F.regexp_extract_all("body", F.lit(_metric(m)), F.lit(2)), lambda v: F.struct(F.lit(m).alias("metric"), v.alias("v")))

    each = F.concat(*map(values, P.METRICS))
    named = body.where(F.col("body").rlike("|".join(P.METRICS)))
    rows = T.each(named, each, "k", "x", "doc_id").select("doc_id", "x.*").where(~num(F.col("v")).isin(0.0, 100.0))
    by = rows.groupBy("doc_id", "metric").agg(F.array_sort(F.collect_set("v")).alias("vs")).where(F.size("vs") >= 3)
    rank = F.array_position(F.array(*map(F.lit, P.METRICS)), F.col("metric"))
    return findings(
        by, "consistency", F.lit(3_000_000) + rank, "cross_section_number_disagreement", "minor", say("metric %s", F.col("metric")),
        say("%s stands at %s in different places, without a word on what differs.", F.col("metric"), F.array_join("vs", ", ")), "Give one value, or name the subgroups.", F.col("vs"), 0.4,
    )


@check("relative_change", 2)
def relative_changes(docs: DataFrame) -> DataFrame:
    """One percentage that is a change beside one pair of numbers: some usual reading must give it."""
    s = F.col("s")
    rows = T.sentences(T.flavour(docs, "change"), P.SPLIT_PROSE).where(s.contains("%") & s.rlike(P.CHANGE_PAIR))
    rows = T.settled(rows, ps=T.found(s, P.PERCENT, ("v",), r"(\d+(?:\.\d+)?)\s*%"), pairs=T.found(s, P.CHANGE_PAIR)).where((F.size("pairs") == 1) & (F.size("ps") > 0))
    after = lambda m: F.substring(s, m["end"] + 1, F.length(s))
    is_change = lambda m: (after(m).rlike(P.CHANGE_AFTER) | T.window_text(s, m["start"] - P.CHANGE_LOOK_BACK, m["start"]).rlike(P.CHANGE_BEFORE)) & ~after(m).rlike(P.CHANGE_SHARE)
    rows = T.settled(rows.select("doc_id", "pos", "s", "ps", F.get("pairs", F.lit(0)).alias("pair")), changes=F.filter("ps", is_change)).where(F.size("changes") == 1)
    rows = rows.select("doc_id", "pos", "s", F.get("changes", F.lit(0)).alias("p"), "pair")
    gap = F.greatest(F.col("p.start") - F.col("pair.end"), F.col("pair.start") - F.col("p.end"))
    low, high = F.least("p.end", "pair.end"), F.greatest("p.start", "pair.start")
    rows = rows.where((gap <= P.CHANGE_GAP) & ~F.coalesce(F.substring(s, low + 1, F.greatest(high - low, F.lit(0))), F.lit("")).rlike(P.CLAUSE_BREAK))
    # The pair's two numbers are the first group of its form that is filled, and the next.
    rows = T.settled(rows, groups=F.filter(F.array(*(F.regexp_extract("pair.raw", P.CHANGE_PAIR, i) for i in range(1, 9))), lambda g: g != ""), zh=F.regexp_extract("pair.raw", P.CHANGE_PAIR, 5) != "")
    bare = lambda i: F.replace(F.get("groups", F.lit(i)), F.lit(","), F.lit(""))
    rows = rows.select("doc_id", "pos", "s", F.col("p.v").alias("c"), bare(0).alias("a"), bare(1).alias("b"), "zh")
    a, b, c = F.nullif(num(F.col("a")), F.lit(0.0)), F.nullif(num(F.col("b")), F.lit(0.0)), num(F.col("c"))
    rows = rows.where((a != b) & (c != a) & (c != b))
    slack = half_unit(F.col("c")) + c * (half_unit(F.col("a")) / a + half_unit(F.col("b")) / b) + EPS
    over_b, over_a, points = F.abs(a - b) / b * 100, F.abs(a - b) / a * 100, F.abs(a - b)
    readings = F.when(F.col("zh"), F.array(over_b, points)).otherwise(F.array(points, over_a, over_b, a / b * 100, b / a * 100))
    bad = rows.where(F.array_min(F.transform(readings, lambda r: F.abs(c - r))) > slack)
    return findings(
        bad, "relative_change", "pos", "relative_change_mismatch", "major", snippet(s),
        say("A change of %s%% is printed beside %s and %s, which give %.1f%% over the second and %.1f%% over the first; no usual reading gives %s%%.", F.col("c"), F.col("a"), F.col("b"), over_b, over_a, F.col("c")),
        say("Recompute the change from %s and %s wherever it is quoted.", F.col("a"), F.col("b")), [F.col("c"), F.col("a"), F.col("b")], 0.8,
    )


@check("relative_change", 2)
def same_changes(docs: DataFrame) -> DataFrame:
    """One phrase for a change quoted with two percentages."""
    rows = T.each(T.sentences(T.flavour(docs, "change"), P.SPLIT_PROSE).where(F.col("s").contains("%")), T.matches(F.col("s"), P.CHANGE_PHRASE, ("v", "words")), "i", "m")
    rows = rows.withColumn("phrase", F.array_join(F.split(F.trim(F.replace(F.lower("m.words"), F.lit("-"), F.lit(" "))), r"\s+"), " ")).where(~F.split_part("phrase", F.lit(" "), F.lit(1)).isin(*P.GENERIC_FIRST))
    order = F.col("pos") * 1000 + F.col("i")
    each = rows.groupBy("doc_id", "phrase", F.col("m.v").alias("v")).agg(F.min(order).alias("at"), F.min_by("s", order).alias("s"))
    by = each.groupBy("doc_id", "phrase").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct(num(F.col("v")).alias("x"), "v", "s"))).alias("vs")).where(F.size("vs") >= 2)
    values = F.transform("vs", lambda x: x["v"])
    return findings(
        by, "relative_change", F.lit(1_000_000_000) + F.col("at"), "same_change_different_values", "major", F.col("phrase"),
        say("The change '%s' is given as %s.", F.col("phrase"), F.array_join(F.transform(values, lambda v: F.concat(v, F.lit("%"))), " and ")), "Give one value, or name what differs.", values, 0.75,
    )


def _table_decimals(docs: DataFrame) -> DataFrame:
    """(doc_id, d): the decimals of tabulars, one after another."""
    blocks = T.each(T.flavour(docs, "bare"), F.regexp_extract_all("t", F.lit(P.TABULAR_STRICT), F.lit(0)), "k", "b", "doc_id")
    return T.each(blocks, F.regexp_extract_all(T.sub(F.col("b"), *P.TYPOGRAPHY), F.lit(P.TABLE_DECIMAL), F.lit(0)), "i", "d", "doc_id")


@check("benford", 10)
def terminal_digits(docs: DataFrame) -> DataFrame:
    """Last digits of table decimals far from even, by chi-square over ten digits."""
    rows = _table_decimals(docs).groupBy("doc_id", F.right("d", F.lit(1)).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    by = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    chi = 10 * F.col("squares") / F.col("n") - F.col("n")
    bad = by.withColumn("chi", chi).where((F.col("n") >= P.DIGIT_LEAST) & (F.col("chi") > P.DIGIT_LIMIT))
    return findings(bad, "benford", F.lit(0), "terminal_digit_nonuniform", "minor", F.lit("result-table terminal digits"), say("Over %d table numbers the last digits are far from even (chi-square %.1f, 9 degrees of freedom).", F.col("n"), F.col("chi")), "Verify that the numbers were measured.", None, 0.35)


def leading_digits(docs: DataFrame) -> DataFrame:
    """(doc_id, n, chi_square) of table numbers' first non-zero digits against Benford's law; a measure, not a check."""
    counts = _table_decimals(docs).select("doc_id", F.regexp_extract("d", "[1-9]", 0).alias("digit")).where("digit <> ''").groupBy("doc_id", "digit").agg(F.count(F.lit(1)).alias("o"))
    share = F.log10(1 + 1 / F.col("digit").cast("double"))
    # Digits that do not occur add their expected count; all expected counts add up to n.
    by = counts.groupBy("doc_id").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / share).alias("x"))
    return by.select("doc_id", "n", (F.col("x") / F.col("n") - F.col("n")).alias("chi_square"))
