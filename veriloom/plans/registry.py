"""Every query of the engine by name, and the SQL that states the same results.

The tables hold no manuscripts, so most queries write them first: sentences made from the tables' numbers,
with errors planted by arithmetic on keys.  Each query's numbers come from one base statement that both
engines run; the engine then reads the sentences, while the SQL works on the numbers and never on text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import base, citations, corrections, package, quantities, references, statistics, tables, writing  # noqa: F401
from ..functions import patterns as P
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _frames(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\{{{t}\}}", sql)}


def _base(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **_frames(spark, sf_dir, sql))


def _plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def tenths(n: str) -> Column:
    """A whole number of tenths as printed."""
    return F.expr(f"concat(cast({n} div 10 as string), '.', cast({n} % 10 as string))")


def hundredths(n: str) -> Column:
    return F.expr(f"concat(cast({n} div 100 as string), '.', lpad(cast({n} % 100 as string), 2, '0'))")


def thousandths(n: str) -> Column:
    return F.expr(f"concat(cast({n} div 1000 as string), '.', lpad(cast({n} % 1000 as string), 3, '0'))")


def text_of(template: str, **values: str | Column) -> Column:
    """A manuscript from a template with {names}; values are columns or names of them."""
    parts = re.split(r"<(\w+)>", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else (values[p] if isinstance(values.get(p), Column) else F.col(values.get(p, p))).cast("string") for i, p in enumerate(parts)))


def _printed(spec: str) -> Column:
    """tenths:n, hundredths:n or thousandths:n, or a column by its name."""
    form, _, n = spec.rpartition(":")
    return {"tenths": tenths, "hundredths": hundredths, "thousandths": thousandths}[form](n) if form else F.col(n)


def _compared(spec: str | int) -> Column:
    """A finding's number by its place, how many it has (#numbers), or a column by its name."""
    return number(spec) if isinstance(spec, int) else F.size("numbers").cast("long") if spec == "#numbers" else F.col(spec)


def check_query(name: str, check: str, base_sql: str, template: str, values: dict[str, str], out: dict[str, str | int], oracle: str) -> None:
    """Register a query: manuscripts from the base rows, a check over them, and the columns of each finding that are compared.

    Columns are named and made only when the query runs, as a session must be there for that.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = text_of(template, **{k: _printed(v) for k, v in values.items()})
        docs = _base(spark, sf_dir, base_sql).select("doc_id", text.alias("text"), F.lit("").alias("bib"))
        return base.CHECKS[check].run(docs).select("doc_id", "category", *(_compared(c).alias(n) for n, c in out.items()))

    QUERIES[name] = run
    ORACLES[name] = f"WITH base AS ({_plain(base_sql)}) {oracle}"


def number(i: int) -> Column:
    return F.get("numbers", F.lit(i)).cast("double")


# --- numbers ---
_ORDER_COUNTS = """SELECT o_custkey AS doc_id, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS k,
  CAST(floor((2000 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) + count(*)) / (2 * count(*))) AS BIGINT) + CASE WHEN o_custkey % 7 = 0 THEN 20 ELSE 0 END AS t
  FROM {orders} GROUP BY o_custkey"""
check_query(
    "percent_count", "percent_counts", _ORDER_COUNTS, r"\begin{document}Of the orders, <k>/<n> (<p>\%) were filled.\end{document}", {"p": "tenths:t"},
    {"severity": "severity", "p": 0, "k": 1, "n": 2},
    "SELECT doc_id, 'percent_count_mismatch' AS category, 'major' AS severity, t / 10.0::DOUBLE AS p, k::DOUBLE AS k, n::DOUBLE AS n FROM base WHERE abs(100.0::DOUBLE * k / n - t / 10.0::DOUBLE) > 0.05 + 1e-9",
)

_NATION_COUNTS = """SELECT CAST(c_nationkey AS BIGINT) AS doc_id, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS k1, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS k2, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS k3
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey"""
_NATION_SHARES = f"""SELECT doc_id, k1, k2, k3, CAST(floor((2000 * k1 + n) / (2 * n)) AS BIGINT) AS t1, CAST(floor((2000 * k2 + n) / (2 * n)) AS BIGINT) + CASE WHEN doc_id % 3 = 0 THEN 45 ELSE 0 END AS t2,
  CAST(floor((2000 * k3 + n) / (2 * n)) AS BIGINT) AS t3 FROM ({_NATION_COUNTS}) q WHERE k1 > 0 AND k2 > 0 AND k3 > 0"""
check_query(
    "percent_outlier", "percent_denominators", _NATION_SHARES, r"Orders were filled in <k1> (<p1>\%), open in <k2> (<p2>\%) and partial in <k3> (<p3>\%) cases.", {f"p{i}": f"tenths:t{i}" for i in (1, 2, 3)},
    {"p": 0, "k": 1},
    """, e AS (SELECT doc_id, unnest([{'i': 1, 'k': k1, 't': t1}, {'i': 2, 'k': k2, 't': t2}, {'i': 3, 'k': k3, 't': t3}], recursive := true) FROM base),
    r AS (SELECT *, ceil(k * 100 / (t / 10.0::DOUBLE + 0.05) - 1e-9) AS lo, floor(k * 100 / greatest(t / 10.0::DOUBLE - 0.05, 1e-9) + 1e-9) AS hi FROM e),
    g AS (SELECT doc_id, max(lo) AS lo, min(hi) AS hi, max(hi - lo) AS w, min(t) AS least, max(t) AS most FROM r GROUP BY doc_id),
    o AS (SELECT r.doc_id, r.i, r.k, r.t, (SELECT max(lo) FROM r x WHERE x.doc_id = r.doc_id AND x.i <> r.i) AS rlo, (SELECT min(hi) FROM r x WHERE x.doc_id = r.doc_id AND x.i <> r.i) AS rhi, r.lo, r.hi
          FROM r JOIN g ON r.doc_id = g.doc_id WHERE g.w < 5000 AND g.lo > g.hi AND g.least > 0 AND g.most < 1000),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM o WHERE rlo <= rhi AND (lo > rhi OR hi < rlo))
    SELECT doc_id, 'percent_denominator_outlier' AS category, t / 10.0::DOUBLE AS p, k::DOUBLE AS k FROM b WHERE rn = 1""",
)

_RANGES = """SELECT o_custkey AS doc_id, CAST(floor(min(o_totalprice)) AS BIGINT) AS a, CAST(floor(max(o_totalprice)) AS BIGINT) AS b FROM {orders} GROUP BY o_custkey"""
_CHANGES = f"""SELECT doc_id, a, b, CAST(floor((2000 * (b - a) + a) / (2 * a)) AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 53 ELSE 0 END AS t FROM ({_RANGES}) q WHERE b > a AND a > 0"""
check_query(
    "relative_change", "relative_changes", _CHANGES, r"\begin{document}Spending rose from <a> to <b>, a <c>\% increase over the year.\end{document}", {"c": "tenths:t"},
    {"c": 0, "a": 1, "b": 2},
    """, x AS (SELECT doc_id, a::DOUBLE AS a, b::DOUBLE AS b, t / 10.0::DOUBLE AS c FROM base),
    y AS (SELECT *, list_min([abs(c - (b - a)), abs(c - (b - a) / a * 100), abs(c - (b - a) / b * 100), abs(c - a / b * 100), abs(c - b / a * 100)]) AS gap, 0.05 + c * (0.5 / a + 0.5 / b) + 1e-9 AS slack FROM x)
    SELECT doc_id, 'relative_change_mismatch' AS category, c, a, b FROM y WHERE gap > slack AND c <> a AND c <> b""",
)

check_query(
    "same_change", "same_changes", "SELECT CAST(o_custkey AS BIGINT) AS doc_id, min(extract(day FROM o_orderdate)) AS x, max(extract(day FROM o_orderdate)) AS y FROM {orders} GROUP BY o_custkey",
    r"\begin{document}It reached a <x>\% delivery time reduction. Later it reached a <y>\% delivery time reduction.\end{document}", {}, {"x": 0, "y": 1},
    "SELECT doc_id, 'same_change_different_values' AS category, x::DOUBLE AS x, y::DOUBLE AS y FROM base WHERE x <> y",
)

check_query(
    "product_total", "product_totals", "SELECT p_partkey AS doc_id, CAST(p_size AS BIGINT) AS a, p_partkey % 9 + 2 AS b, p_size * (p_partkey % 9 + 2) * (CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END) AS total FROM {part}",
    "We store <total> pieces (<a> boxes x <b> layers) in all.", {}, {"total": 0, "product": 1},
    "SELECT doc_id, 'product_total_mismatch' AS category, total::DOUBLE AS total, (a * b)::DOUBLE AS product FROM base WHERE abs(a * b - total) / greatest(total, 1)::DOUBLE > 0.06",
)

check_query(
    "compute_budget", "compute_budget", "SELECT s_suppkey AS doc_id, s_suppkey % 7 + 2 AS t, s_suppkey % 5 + 1 AS s, s_suppkey % 11 + 3 AS g, (s_suppkey % 7 + 2) * (s_suppkey % 5 + 1) * (s_suppkey % 11 + 3) + CASE WHEN s_suppkey % 4 = 0 THEN 60 ELSE 0 END AS p FROM {supplier}",
    "It takes 3 hours per seed-task (<g> GPU-hours); <t> tasks x <s> seeds = <p> GPU-hours of primary training.", {}, {"severity": "severity", "stated": 0, "computed": 1},
    "SELECT doc_id, 'compute_budget_inconsistency' AS category, 'critical' AS severity, p::DOUBLE AS stated, (t * s * g)::DOUBLE AS computed FROM base WHERE abs(t * s * g - p) / greatest(p, 1)::DOUBLE > 0.15",
)

check_query(
    "cross_section", "cross_sections", "SELECT o_custkey AS doc_id, min(o_orderkey) % 90 + 1 AS x, max(o_orderkey) % 90 + 1 AS y, sum(o_orderkey) % 90 + 1 AS z FROM {orders} GROUP BY o_custkey",
    r"\begin{document}The first of our three sites has MAPE = <x> overall. " + "This long remark about weather and travel stands here so that the sites lie apart. " * 2 + r"The second site has MAPE = <y> overall. " + "This long remark about weather and travel stands here so that the sites lie apart. " * 2 + r"The third one has MAPE = <z> overall.\end{document}", {},
    {"severity": "severity"},
    "SELECT doc_id, 'cross_section_number_disagreement' AS category, 'minor' AS severity FROM base WHERE x <> y AND y <> z AND x <> z",
)

check_query(
    "split_shares", "split_shares", "SELECT o_orderkey AS doc_id, o_orderkey % 41 + 50 AS a, o_custkey % 31 + 5 AS b, o_orderkey % 13 + 3 AS c FROM {orders}",
    r"We take <a>\% train, <b>\% val and <c>\% test rows.", {}, {"severity": "severity"},
    "SELECT doc_id, 'split_percentages_exceed_100' AS category, 'major' AS severity FROM base WHERE a + b + c > 101.5",
)

_QUANTITIES = """SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS s, CAST(sum(l_quantity * l_quantity) AS BIGINT) AS q FROM {lineitem} GROUP BY l_orderkey"""
check_query(
    "grim", "grim", f"SELECT doc_id, n, CAST(floor((200 * s + n) / (2 * n)) AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS h FROM ({_QUANTITIES}) x WHERE n > 1",
    r"\begin{document}The mean rating was <m> on the scale (N = <n>).\end{document}", {"m": "hundredths:h"}, {"m": 0},
    "SELECT doc_id, 'grim_infeasible_mean' AS category, h / 100.0::DOUBLE AS m FROM base WHERE len(list_filter(range((floor(h / 100.0::DOUBLE * n))::BIGINT - 1, (floor(h / 100.0::DOUBLE * n))::BIGINT + 3), lambda k: k >= 0 AND round_even(k::DOUBLE / n * 100, 0) = h)) = 0",
)

check_query(
    "grimmer", "grimmer", f"SELECT doc_id, n, CAST(floor((200 * s + n) / (2 * n)) AS BIGINT) AS h, CAST(floor(100 * sqrt(greatest(q - CAST(s AS DOUBLE) * s / n, 0) / (n - 1)) + 0.5) AS BIGINT) + CASE WHEN doc_id % 4 = 0 THEN 7 ELSE 0 END AS d FROM ({_QUANTITIES}) x WHERE n > 1",
    r"\begin{document}The answers on the scale gave M = <m>, SD = <sd>, n = <n> in all.\end{document}", {"m": "hundredths:h", "sd": "hundredths:d"}, {"m": 0, "sd": 1},
    """, x AS (SELECT *, h / 100.0::DOUBLE AS m, d / 100.0::DOUBLE AS sd FROM base WHERE d > 0 AND h >= 100),
    y AS (SELECT *, ceil((m - 0.005) * n - 1e-9)::BIGINT AS a, floor((m + 0.005) * n + 1e-9)::BIGINT AS b FROM x),
    z AS (SELECT *, list_filter(range(a, b + 1), lambda t: ceil((n - 1) * greatest(sd - 0.005, 0) ** 2 + t * t / n::DOUBLE - 1e-9) + ((ceil((n - 1) * greatest(sd - 0.005, 0) ** 2 + t * t / n::DOUBLE - 1e-9)::BIGINT - t) % 2 + 2) % 2 <= (n - 1) * (sd + 0.005) ** 2 + t * t / n::DOUBLE + 1e-9) AS ok FROM y WHERE b >= a)
    SELECT doc_id, 'grimmer_infeasible_sd' AS category, m, sd FROM z WHERE len(ok) = 0""",
)

_CENTS = """SELECT l_suppkey AS doc_id, l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c FROM {lineitem}"""


def terminal_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's prices as a table; a third of the suppliers print rounded cents."""
    rows = _base(spark, sf_dir, _CENTS).withColumn("c", F.expr("case when doc_id % 3 = 0 then c - c % 5 else c end"))
    docs = rows.withColumn("cell", hundredths("c")).groupBy("doc_id").agg(F.array_join(F.collect_list("cell"), " & ").alias("cells"))
    docs = docs.select("doc_id", F.concat(F.lit("\\begin{tabular}{l} item & "), "cells", F.lit(" \\\\ \\end{tabular}")).alias("text"), F.lit("").alias("bib"))
    return quantities.terminal_digits(docs).select("doc_id", "category")


QUERIES["terminal_digits"] = terminal_digits
ORACLES["terminal_digits"] = f"""WITH d AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN c - c % 5 ELSE c END) % 10 AS d, count(*) AS n FROM ({_plain(_CENTS)}) GROUP BY ALL),
g AS (SELECT doc_id, sum(n) AS n, sum(n * n) AS q FROM d GROUP BY doc_id)
SELECT doc_id, 'terminal_digit_nonuniform' AS category FROM g WHERE n >= 20 AND 10.0 * q / n - n > 27.9"""


def leading_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base(spark, sf_dir, _CENTS).withColumn("cell", hundredths("c")).groupBy("doc_id").agg(F.array_join(F.collect_list("cell"), " & ").alias("cells"))
    docs = docs.select("doc_id", F.concat(F.lit("\\begin{tabular}{l} item & "), "cells", F.lit(" \\\\ \\end{tabular}")).alias("text"))
    return quantities.leading_digits(docs).select("doc_id", "n", F.round("chi_square", 4).alias("chi_square"))


QUERIES["leading_digits"] = leading_digits
ORACLES["leading_digits"] = f"""WITH d AS (SELECT doc_id, regexp_extract(c::VARCHAR, '[1-9]')::INT AS d, count(*) AS o FROM ({_plain(_CENTS)}) WHERE c > 0 GROUP BY ALL)
SELECT doc_id, sum(o)::BIGINT AS n, round(sum(o * o / log10(1 + 1.0::DOUBLE / d)) / sum(o) - sum(o), 4) AS chi_square FROM d GROUP BY doc_id"""

# --- statistics ---
# Printed p values come from a polynomial for the normal tail (error below 1e-6), the same in both engines.
_X = "(0.3275911 * z / 141.4213562373095)"
_TAIL = f"((((1.061405429 / (1 + {_X}) - 1.453152027) / (1 + {_X}) + 1.421413741) / (1 + {_X}) - 0.284496736) / (1 + {_X}) + 0.254829592) / (1 + {_X}) * exp(-(z / 141.4213562373095) * (z / 141.4213562373095))"
_Z = "SELECT o_orderkey AS doc_id, 20 + o_orderkey % 230 AS z FROM {orders}"
_PZ = f"SELECT doc_id, z, CAST(floor(1000 * ({_TAIL}) + 0.5) AS BIGINT) + CASE WHEN doc_id % 4 = 0 THEN 60 ELSE 0 END AS p FROM ({_Z}) x"
check_query(
    "pvalue_recompute", "p_values", _PZ, "The arms were compared, z = <zz>, p = <pp>.", {"zz": "hundredths:z", "pp": "thousandths:p"}, {"p": 0},
    "SELECT doc_id, 'pvalue_recompute_mismatch' AS category, p / 1000.0::DOUBLE AS p FROM base WHERE doc_id % 4 = 0",
)
check_query(
    "pvalue_z", "z_pairs", f"SELECT doc_id, z, CASE WHEN doc_id % 4 = 0 THEN greatest(1, CAST(floor(p / 8) AS BIGINT)) ELSE p END AS p, p AS was FROM ({_PZ.replace('60', '0')}) y WHERE p >= 40", "They report z = <zz>, p = <pp>.", {"zz": "hundredths:z", "pp": "thousandths:p"}, {"p": 0},
    "SELECT doc_id, 'pvalue_z_mismatch' AS category, p / 1000.0::DOUBLE AS p FROM base WHERE doc_id % 4 = 0",
)
check_query(
    "pvalue_t", "t_pairs", f"SELECT doc_id, z, CASE WHEN doc_id % 4 = 0 THEN greatest(1, CAST(floor(p / 20) AS BIGINT)) ELSE p END AS p FROM ({_PZ.replace('60', '0')}) y WHERE p >= 60", "They report t = <zz>, p = <pp>.", {"zz": "hundredths:z", "pp": "thousandths:p"}, {"p": 0},
    "SELECT doc_id, 'pvalue_t_impossible' AS category, p / 1000.0::DOUBLE AS p FROM base WHERE doc_id % 4 = 0",
)
_ESTIMATES = """SELECT c_custkey AS doc_id, c_custkey % 41 - 20 + CASE WHEN c_custkey % 9 = 0 THEN 40 ELSE 0 END AS m, c_custkey % 41 - 20 - c_custkey % 17 - 1 AS lo, c_custkey % 41 - 20 + c_custkey % 17 + 1 AS hi, CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 400 END AS p FROM {customer}"""
check_query(
    "intervals", "intervals", _ESTIMATES, "The mean difference was <m> (95% CI <lo> to <hi>, P = <pp>).", {"pp": "thousandths:p"}, {"a": 0, "b": 1, "c": 2},
    """SELECT doc_id, CASE WHEN m < lo - 0.5 OR m > hi + 0.5 THEN 'estimate_outside_interval' ELSE 'interval_p_contradiction' END AS category,
    CASE WHEN m < lo - 0.5 OR m > hi + 0.5 THEN m ELSE lo END::DOUBLE AS a, CASE WHEN m < lo - 0.5 OR m > hi + 0.5 THEN lo ELSE hi END::DOUBLE AS b, CASE WHEN m < lo - 0.5 OR m > hi + 0.5 THEN hi ELSE p / 1000.0::DOUBLE END::DOUBLE AS c FROM base
    WHERE m < lo - 0.5 OR m > hi + 0.5 OR ((lo - 0.5 > 0 OR hi + 0.5 < 0) AND p > 50) OR (lo + 0.5 < 0 AND hi - 0.5 > 0 AND p < 50)""",
)
check_query(
    "effect_size", "effect_sizes", "SELECT o_orderkey AS doc_id, o_orderkey % 3 + 1 AS d1, o_orderkey % 60 + 20 AS d2, o_orderkey % 97 + 3 AS f, CAST(floor(100 * ((o_orderkey % 97 + 3) / 10.0 * (o_orderkey % 3 + 1)) / ((o_orderkey % 97 + 3) / 10.0 * (o_orderkey % 3 + 1) + (o_orderkey % 60 + 20)) + 0.5) AS BIGINT) + CASE WHEN o_orderkey % 6 = 0 THEN 9 ELSE 0 END AS e FROM {orders}",
    "Scores rose, F(<d1>, <d2>) = <ff>, partial eta squared = <ee>.", {"ff": "tenths:f", "ee": "hundredths:e"}, {"e": 0, "f": 1},
    """, x AS (SELECT *, f / 10.0::DOUBLE AS fv, e / 100.0::DOUBLE AS ev FROM base WHERE e < 100)
    SELECT doc_id, 'effect_size_mismatch' AS category, ev AS e, fv AS f FROM x WHERE ev - 0.005 > (fv + 0.05) * d1 / ((fv + 0.05) * d1 + d2) OR ev + 0.005 < greatest(fv - 0.05, 0) * d1 / (greatest(fv - 0.05, 0) * d1 + d2)""",
)


def p_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir, "SELECT l_orderkey AS doc_id, 40 + CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS p FROM {lineitem}")
    docs = rows.groupBy("doc_id").agg(F.concat(F.lit("Tests gave p = "), F.array_join(F.collect_list(thousandths("p")), ", p = "), F.lit(".")).alias("text")).withColumn("bib", F.lit(""))
    return statistics.p_clusters(docs).select("doc_id", "category", F.size("numbers").cast("long").alias("n"))


QUERIES["p_clusters"] = p_clusters
ORACLES["p_clusters"] = "SELECT l_orderkey AS doc_id, 'pvalue_clustering_below_0_05' AS category, count(*) AS n FROM lineitem WHERE floor(l_discount * 100 + 0.5) BETWEEN 5 AND 9 GROUP BY l_orderkey HAVING count(*) >= 3"

# --- claims and figures ---
check_query(
    "directional_claim", "directional_claims", "SELECT c_custkey AS doc_id, c_custkey % 41 - 20 - c_custkey % 17 - 1 AS lo, c_custkey % 41 - 20 + c_custkey % 17 + 1 AS hi, c_custkey % 97 * 2 + 1 AS p FROM {customer}",
    r"\begin{document}The new route outperformed the old one by two points (95\% CI <lo> to <hi>, P = <pp>).\end{document}", {"pp": "thousandths:p"}, {"severity": "severity", "n": "#numbers"},
    "SELECT doc_id, 'directional_claim_against_interval' AS category, 'major' AS severity, (CASE WHEN lo < 0 AND hi > 0 THEN 2 ELSE 0 END + CASE WHEN p > 50 THEN 1 ELSE 0 END)::BIGINT AS n FROM base WHERE lo < 0 AND hi > 0 OR p > 50",
)
_LINES = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS n, l_returnflag AS flag, l_partkey AS part FROM {lineitem}"


def _listed(spark: SparkSession, sf_dir: str, item: Column, where: str = "true") -> DataFrame:
    rows = _base(spark, sf_dir, _LINES).where(where)
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(item)), " ").alias("x"))


def uncited_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _listed(spark, sf_dir, F.concat(F.lit("\\label{tab:t"), "n", F.lit("}")))
    refs = _listed(spark, sf_dir, F.concat(F.lit("\\tabref{tab:t"), "n", F.lit("}")), "flag <> 'N'").withColumnRenamed("x", "y")
    docs = labels.join(refs, "doc_id", "left").select("doc_id", F.concat_ws(" ", "x", "y").alias("text"), F.lit("").alias("bib"))
    return base.CHECKS["uncited_floats"].run(docs).select("doc_id", "category", "target")


QUERIES["uncited_float"] = uncited_floats
ORACLES["uncited_float"] = "SELECT l_orderkey AS doc_id, 'uncited_float' AS category, 'tab:t' || l_linenumber AS target FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(CASE WHEN l_returnflag <> 'N' THEN 1 END) = 0"

check_query(
    "panel_reference", "panel_references", "SELECT o_orderkey AS doc_id, substring('abcdefgh', CAST(o_orderkey % 7 + 2 AS INT), 1) AS last, substring('abcdefgh', CAST(o_custkey % 8 + 1 AS INT), 1) AS ref FROM {orders}",
    r"See Figure~\ref{fig:one}<ref> for more. \begin{figure}\caption{(a) First. (<last>) Last.}\label{fig:one}\end{figure}", {}, {"target": "target"},
    "SELECT doc_id, 'panel_reference_beyond_caption' AS category, 'fig:one:' || ref AS target FROM base WHERE ref > last",
)


def prose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base(spark, sf_dir, _TOTALS.replace("sum(o_totalprice)", _IN_ORDER)).select("doc_id", text_of("\\begin{document}The yearly spend reached <v> dollars.\n\\begin{table}\\begin{tabular}{lc}\nItem & Value \\\\\nYearly spend & <w> \\\\\n\\end{tabular}\\end{table}\\end{document}", v=hundredths("t"), w=hundredths("c")).alias("text"), F.lit("").alias("bib"))
    return tables.prose_table(docs).select("doc_id", "category", "severity", number(0).alias("text_value"), number(1).alias("cell"))


_TOTALS = "SELECT o_custkey AS doc_id, CAST(floor(sum(o_totalprice)) AS BIGINT) * 100 + o_custkey % 89 AS c, CAST(floor(sum(o_totalprice)) AS BIGINT) * 100 + o_custkey % 89 + CASE WHEN o_custkey % 4 = 0 THEN 7 WHEN o_custkey % 4 = 1 THEN 30 ELSE 0 END AS t FROM {orders} GROUP BY o_custkey"
#: A sum of doubles depends on its order, and its floor with it: here it goes by the orders' keys, wherever they lie.
_IN_ORDER = "aggregate(array_sort(collect_list(struct(o_orderkey, o_totalprice))), CAST(NULL AS DOUBLE), (a, x) -> coalesce(a + x.o_totalprice, a, x.o_totalprice))"
QUERIES["prose_table"] = prose_table
ORACLES["prose_table"] = f"WITH base AS ({_plain(_TOTALS)}) SELECT doc_id, 'prose_table_number_disagreement' AS category, 'major' AS severity, t / 100.0::DOUBLE AS text_value, c / 100.0::DOUBLE AS cell FROM base WHERE t <> c AND t - c <= 9"


# --- citations ---
def _cite_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = _listed(spark, sf_dir, F.concat(F.lit("\\cite{Part"), "part", F.lit("}")))
    items = _listed(spark, sf_dir, F.concat(F.lit("\\bibitem{part"), F.col("part") + F.when(F.col("part") % 7 == 0, F.col("n") * 10_000_000).otherwise(0), F.lit("} A.")), "part % 11 <> 0").withColumnRenamed("x", "y")
    return cites.join(items, "doc_id", "left").select("doc_id", F.concat(F.lit("\\begin{document}"), "x", F.lit(" "), F.coalesce("y", F.lit("")), F.lit("\\end{document}")).alias("text"), F.lit("").alias("bib"))


_CITES = """WITH cited AS (SELECT DISTINCT l_orderkey AS doc_id, 'part' || l_partkey AS k FROM lineitem),
items AS (SELECT l_orderkey AS doc_id, 'part' || (l_partkey + CASE WHEN l_partkey % 7 = 0 THEN l_linenumber * 10000000 ELSE 0 END) AS k FROM lineitem WHERE l_partkey % 11 <> 0),
missing AS (SELECT c.* FROM cited c ANTI JOIN items i ON c.doc_id = i.doc_id AND c.k = i.k),
n AS (SELECT c.doc_id, count(*) AS n, (SELECT count(*) FROM missing m WHERE m.doc_id = c.doc_id) AS m FROM cited c WHERE c.doc_id IN (SELECT doc_id FROM items) GROUP BY c.doc_id),
trusted AS (SELECT doc_id FROM n WHERE m <= greatest(3, 0.3 * n)) """
QUERIES["citation_undefined"] = lambda spark, d: citations.undefined_citations(_cite_docs(spark, d)).select("doc_id", "category", "target")
ORACLES["citation_undefined"] = _CITES + "SELECT doc_id, 'citation_undefined' AS category, 'P' || k[2:] AS target FROM missing WHERE doc_id IN (SELECT doc_id FROM trusted)"
QUERIES["reference_never_cited"] = lambda spark, d: citations.uncited_entries(_cite_docs(spark, d)).select("doc_id", "category", "target")
ORACLES["reference_never_cited"] = _CITES + "SELECT i.doc_id, 'reference_never_cited' AS category, k AS target FROM items i WHERE doc_id IN (SELECT doc_id FROM trusted) AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = i.doc_id AND c.k = i.k)"


def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base(spark, sf_dir, "SELECT p_partkey AS doc_id, p_name AS name, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_name, ' two') END AS other FROM {part}")
    bib = text_of("@article{a1,\n title={Observations of <name> and <kind>},\n}\n@book{b1,\n title = {Observations of <other> and <kind>},\n}\n")
    return citations.duplicate_entries(docs.select("doc_id", F.lit("\\begin{document}\\cite{a1,B1}\\end{document}").alias("text"), bib.alias("bib"))).select("doc_id", "category", "target")


QUERIES["reference_duplicate"] = duplicate_entries
ORACLES["reference_duplicate"] = "SELECT p_partkey AS doc_id, 'reference_duplicate' AS category, 'a1 / b1' AS target FROM part WHERE p_partkey % 3 = 0 AND length('Observations of ' || p_name || ' and ' || p_type) > 20"

_NUMBERED = "SELECT o_orderkey AS doc_id, o_orderkey % 6 + 5 AS e, o_custkey % 9 + 3 AS c, o_custkey % 5 AS w FROM {orders}"


def _numbered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.expr("array_join(transform(sequence(1, cast(e as int)), i -> concat('[', i, '] Author ', i, '. Title.')), '\\n')")
    return _base(spark, sf_dir, _NUMBERED).select("doc_id", F.concat(F.lit("Known since [1-"), F.col("c").cast("string"), F.lit("] and ["), (F.col("e") + F.col("w")).cast("string"), F.lit("].\nReferences\n"), entries).alias("text"), F.lit("").alias("bib"))


QUERIES["citation_beyond_list"] = lambda spark, d: citations.citations_beyond(_numbered_docs(spark, d)).select("doc_id", "category", F.size("numbers").cast("long").alias("n"))
ORACLES["citation_beyond_list"] = f"WITH base AS ({_plain(_NUMBERED)}), b AS (SELECT *, len(list_filter(list_distinct(list_concat(range(1, c + 1), [e + w])), lambda x: x > e)) AS n, len(list_filter(list_distinct(list_concat(range(1, c + 1), [e + w])), lambda x: x <= e)) AS inside FROM base) SELECT doc_id, 'citation_beyond_list' AS category, least(n, 10)::BIGINT AS n FROM b WHERE n > 0 AND inside >= e / 2.0"
QUERIES["numbered_never_cited"] = lambda spark, d: citations.numbers_never_cited(_numbered_docs(spark, d)).select("doc_id", "category", "target")
ORACLES["numbered_never_cited"] = f"WITH base AS ({_plain(_NUMBERED)}), b AS (SELECT *, list_filter(range(1, e + 1), lambda x: x > c AND x <> e + w) AS free, len(list_filter(list_distinct(list_concat(range(1, c + 1), [e + w])), lambda x: x <= e)) AS inside FROM base) SELECT doc_id, 'reference_never_cited' AS category, list_reduce(list_transform(free[1:15], lambda x: '[' || x || ']'), lambda a, x: a || ', ' || x) AS target FROM b WHERE len(free) > 0 AND inside >= e / 2.0"

# --- writing ---
_PARTS = "SELECT p_partkey AS doc_id, p_partkey % 5 AS a, p_partkey % 7 AS b, p_partkey % 3 AS c, p_name AS name FROM {part}"


def _insert(column: str, value: int, text: str) -> Column:
    return F.when(F.col(column) == value, F.lit(text)).otherwise("")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("\\begin{document}\n\\section{Introduction}\nWe study the "), F.col("name"), F.lit(".\n"), _insert("c", 0, "We train a CNN on parts.\n"), F.lit("A convolutional neural network (CNN) is trained.\n"),
        _insert("b", 0, "Another central news network (CNN) reports it.\n"), _insert("a", 0, "We use profound learning and Profound Learning again.\n"), _insert("a", 1, "An irregular woodland is grown.\n"),
        _insert("b", 1, "Certainly! Here is the text.\n"), _insert("b", 2, "As shown in Figure ?? before.\n"), _insert("b", 3, "It is known [insert citation] and [Insert Citation].\n"), F.lit("\\end{document}"),
    )
    return _base(spark, sf_dir, _PARTS).select("doc_id", text.alias("text"), F.lit("").alias("bib"))


QUERIES["tortured_phrase"] = lambda spark, d: writing.tortured(_written(spark, d)).select("doc_id", "category", "target", F.regexp_extract("reasoning", r"\((\d+) times", 1).cast("long").alias("n"))
ORACLES["tortured_phrase"] = f"WITH base AS ({_plain(_PARTS)}) SELECT doc_id, 'tortured_phrase' AS category, CASE WHEN a = 0 THEN 'profound learning' ELSE 'irregular woodland' END AS target, (2 - a)::BIGINT AS n FROM base WHERE a < 2"
QUERIES["assistant_residue"] = lambda spark, d: writing.residue(_written(spark, d)).select("doc_id", "category", "target")
ORACLES["assistant_residue"] = f"WITH base AS ({_plain(_PARTS)}) SELECT doc_id, 'assistant_residue' AS category, CASE b WHEN 1 THEN 'Certainly! Here is' WHEN 2 THEN 'Figure ??' ELSE '[insert citation]' END AS target FROM base WHERE b IN (1, 2, 3)"
QUERIES["abbreviation_early"] = lambda spark, d: writing.early_abbreviations(_written(spark, d)).select("doc_id", "category", "target")
ORACLES["abbreviation_early"] = f"WITH base AS ({_plain(_PARTS)}) SELECT doc_id, 'abbreviation_before_definition' AS category, 'CNN' AS target FROM base WHERE c = 0"
QUERIES["abbreviation_twice"] = lambda spark, d: writing.double_abbreviations(_written(spark, d)).select("doc_id", "category", "target")
ORACLES["abbreviation_twice"] = f"WITH base AS ({_plain(_PARTS)}) SELECT doc_id, 'abbreviation_two_expansions' AS category, 'CNN' AS target FROM base WHERE b = 0"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.statements(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "statement", "found")


QUERIES["statements"] = statements
ORACLES["statements"] = " UNION ALL ".join(
    "SELECT doc_id, '{}' AS statement, regexp_matches(regexp_replace(replace(text, '\\%', '%'), '\\s+', ' ', 'g'), '{}') AS found FROM documents".format(n, ("" if n == "reporting_guideline" else "(?i)") + p.replace("'", "''")) for n, p in P.STATEMENTS.items()
)


# --- flavours ---
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base(spark, sf_dir, "SELECT p_partkey AS doc_id, p_size AS n FROM {part}")
    return docs.select("doc_id", T.language(F.concat(F.repeat(F.lit("研究"), F.col("n") * 4), F.repeat(F.lit("abcde "), F.col("n") * F.col("n")))).alias("language"))


QUERIES["language"] = languages
ORACLES["language"] = "SELECT p_partkey AS doc_id, CASE WHEN 8 * p_size > greatest(200, 0.05 * (8 * p_size + 6 * p_size * p_size)) THEN 'zh' ELSE 'en' END AS language FROM part"


def full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base(spark, sf_dir, "SELECT p_partkey AS doc_id, CAST(p_partkey AS STRING) AS k, CAST(p_size AS STRING) AS n FROM {part}")
    wide = lambda c: F.translate(c, "0123456789", "０１２３４５６７８９")
    return docs.select("doc_id", T.normalize(F.concat(wide("k"), F.lit("，"), wide("n"), F.lit("％（甲）；乙：丙＝丁"))).alias("text"))


QUERIES["normalize"] = full_width
ORACLES["normalize"] = r"SELECT p_partkey AS doc_id, p_partkey || ', ' || p_size || '\%(甲); 乙: 丙=丁' AS text FROM part"

# --- released files ---
_SERIES = "SELECT s_suppkey AS doc_id, s_suppkey % 90 + 10 AS a, s_suppkey % 7 + 1 AS d, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS j FROM {supplier}"


def constructed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda i: tenths(f"(a * 10 + {i} * d + {i} * {i} * j + 1)")
    content = F.concat(F.lit('{"m": {"score": {'), *(x for i in range(5) for x in (F.lit(f'"{i}": '), step(i), F.lit(", " if i < 4 else "}}, \"seeds\": [1, 2, 3, 4]}"))))
    files = _base(spark, sf_dir, _SERIES).select("doc_id", F.lit("results/grid.json").alias("rel_path"), F.lit(".json").alias("ext"), F.lit(1).alias("size"), content.alias("content"))
    return package.constructed_series(files).select("doc_id", "category", "target")


QUERIES["constructed_series"] = constructed_series
ORACLES["constructed_series"] = f"WITH base AS ({_plain(_SERIES)}), v AS (SELECT doc_id, list_transform(range(5), lambda i: a * 10 + i * d + i * i * j + 1) AS v FROM base) SELECT doc_id, 'constructed_series_json' AS category, 'grid.json' AS target FROM v WHERE len(list_filter(v, lambda x: x % 10 <> 0)) > 0 AND v[2] - v[1] = v[3] - v[2] AND v[3] - v[2] = v[4] - v[3] AND v[4] - v[3] = v[5] - v[4]"

_RUNS = "SELECT s_suppkey AS doc_id, s_suppkey * 37 % 4000 + 1000 AS m, s_suppkey % 13 + 1 AS d, s_suppkey % 4 AS off FROM {supplier}"


def back_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of two columns in millionths around a mean in thousandths; the offset decides whether the mean is exact."""
    shifts = (-2, -1, 0, 1, 2)
    micro = lambda k, i: F.expr(f"concat(cast((m * 1000 + {shifts[i]} * d * {k} * 11 + {5 if i == 2 else 0} * off * 7) div 1000000 as string), '.', lpad(cast((m * 1000 + {shifts[i]} * d * {k} * 11 + {5 if i == 2 else 0} * off * 7) % 1000000 as string), 6, '0'))")
    content = F.concat(F.lit("seed,a,b\n"), *(x for i in range(5) for x in (F.lit(f"{i},"), micro(1, i), F.lit(","), micro(3, i), F.lit("\n"))))
    files = _base(spark, sf_dir, _RUNS).select("doc_id", F.lit("results/runs.csv").alias("rel_path"), F.lit(".csv").alias("ext"), F.lit(1).alias("size"), content.alias("content"))
    return package.back_solved_means(package.csv_cells(files)).select("doc_id", "category", "target")


QUERIES["back_solved"] = back_solved
ORACLES["back_solved"] = f"WITH base AS ({_plain(_RUNS)}) SELECT doc_id, 'back_solved_mean' AS category, 'runs.csv' AS target FROM base WHERE (m * 5000 + 35 * off) % 5000 = 0"


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 3 == 0, "def shape(y, target_auroc, seed):\n    return seed\n").when(F.col("doc_id") % 3 == 1, "def evaluate(y, p):\n    return roc_auc_score(y, p)\n").otherwise("def reach(y, z, goal):\n    while True:\n        got = roc_auc_score(y, z)\n        if got >= goal:\n            return z\n")
    files = _base(spark, sf_dir, "SELECT s_suppkey AS doc_id FROM {supplier}").select("doc_id", F.lit("code/make.py").alias("rel_path"), F.lit(".py").alias("ext"), F.lit(1).alias("size"), code.alias("content"))
    return package.label_derived_scores(files).select("doc_id", "category", "target")


QUERIES["label_derived_score"] = label_scores
ORACLES["label_derived_score"] = "SELECT s_suppkey AS doc_id, 'label_derived_score' AS category, 'code/make.py' AS target FROM supplier WHERE s_suppkey % 3 <> 1"


def unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir, "SELECT s_suppkey AS doc_id, s_suppkey % 800 + 100 AS a FROM {supplier}")
    values = [thousandths(f"(a + {i * 37})") for i in range(4)]
    docs = rows.select("doc_id", F.concat(F.lit("\\begin{document}Values "), *(x for v in values for x in (v, F.lit(" and "))), F.lit("the rest.\\end{document}")).alias("text"), F.lit("").alias("bib"))
    held = F.concat(*(x for i in range(4) for x in (thousandths(f"(a + {i * 37} + case when doc_id % 2 = 0 then 0 else 11 end)"), F.lit("\n"))))
    name = F.when(F.col("doc_id") % 5 == 0, "results/named.csv").otherwise("results/free.csv")
    files = rows.select("doc_id", name.alias("rel_path"), F.lit(".csv").alias("ext"), F.lit(100).cast("long").alias("size"), held.alias("content"))
    tests = rows.select("doc_id", F.lit("tests/test_it.py").alias("rel_path"), F.lit(".py").alias("ext"), F.lit(100).cast("long").alias("size"), F.lit("read('named.csv')").alias("content"))
    return package.unbound_records(docs, files.union(tests)).select("doc_id", "category", "target")


QUERIES["unbound_record"] = unbound
ORACLES["unbound_record"] = "SELECT s_suppkey AS doc_id, 'unbound_released_record' AS category, 'results/free.csv' AS target FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0"

# --- references ---
_REFS = "SELECT p_partkey AS doc_id, p_name AS name, p_type AS kind FROM {part}"
_TITLE = "A study of <name> under <kind> load in part <doc_id>"


def reference_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference with a DOI a part; the key decides what the registries hold."""
    rows = _base(spark, sf_dir, _REFS)
    k = F.col("doc_id") % 6
    bib = text_of("@article{r, title={" + _TITLE + "}, journal={Journal}, year={2001}, doi={10.1000/p<doc_id>}}\n")
    docs = rows.select("doc_id", F.lit("\\begin{document}\\cite{r}\\end{document}").alias("text"), bib.alias("bib"))
    title = F.when(k == 1, F.lit("Entirely different matters of birdsong")).otherwise(text_of(_TITLE))
    notice = F.when(k == 2, F.lit(', "updated-by": [{"type": "retraction", "DOI": "10.1/n", "source": "w"}]')).when(k == 3, F.lit(', "updated-by": [{"type": "expression_of_concern", "DOI": "10.1/n", "source": "w"}]')).otherwise("")
    work = F.when(k == 0, F.lit('{"_status": 404}')).otherwise(F.concat(F.lit('{"message": {"DOI": "10.1000/p'), F.col("doc_id").cast("string"), F.lit('", "title": ["'), title, F.lit('"], "issued": {"date-parts": [['), F.when(k == 4, "1990").otherwise("2001"), F.lit("]]}"), notice, F.lit("}}")))
    lookups = rows.select(F.concat(F.lit(references.WORK + "10.1000/p"), F.col("doc_id").cast("string")).alias("url"), work.alias("body"))
    lookups = lookups.union(rows.where("doc_id % 6 = 0").select(F.concat(F.lit(references.HANDLE + "10.1000/p"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 4 == 0, '{"responseCode": 1}').otherwise('{"responseCode": 100}')))
    v = references.verdicts(references.entries(docs), lookups)
    return v.select("doc_id", "status", F.array_join(F.transform("problems", lambda p: p["category"]), ",").alias("problems"))


QUERIES["reference_verdicts"] = reference_verdicts
ORACLES["reference_verdicts"] = """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 6 = 0 AND p_partkey % 4 <> 0 THEN 'problem' WHEN p_partkey % 6 IN (1, 2) THEN 'problem' ELSE 'verified' END AS status,
CASE WHEN p_partkey % 6 = 0 AND p_partkey % 4 <> 0 THEN 'reference_doi_unresolved' WHEN p_partkey % 6 = 1 THEN 'reference_doi_mismatch' WHEN p_partkey % 6 = 2 THEN 'reference_retracted' WHEN p_partkey % 6 = 3 THEN 'reference_concern' WHEN p_partkey % 6 = 4 THEN 'reference_year_mismatch' ELSE '' END AS problems FROM part"""


# --- reports ---
def _small_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\begin{document}\section{Results} Of the orders, <k>/<n> (<p>\%) were filled. We use profound learning. It is known [insert citation].\end{document}"
    return _base(spark, sf_dir, _ORDER_COUNTS).select("doc_id", text_of(text, p=tenths("t")).alias("text"), F.lit("").alias("bib"), F.lit("en").alias("language"))


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _small_corpus(spark, sf_dir)
    raw = report.raw_findings(docs, names=("percent_counts", "tortured", "residue"))
    return report.ranked(report.normalized(raw, docs)).select("doc_id", "id", "group", "category", "severity", "order", "where")


QUERIES["ranked_findings"] = ranked_findings
_WRONG = "abs(100.0::DOUBLE * k / n - t / 10.0::DOUBLE) > 0.05 + 1e-9"
ORACLES["ranked_findings"] = f"""WITH base AS ({_plain(_ORDER_COUNTS)}), f AS (
SELECT doc_id, 1 AS g, 'numbers' AS "group", 'percent_count_mismatch' AS category, 'major' AS severity, 'first' AS "order" FROM base WHERE {_WRONG}
UNION ALL SELECT doc_id, 2, 'writing', 'assistant_residue', 'major', 'second' FROM base UNION ALL SELECT doc_id, 3, 'writing', 'tortured_phrase', 'minor', 'second' FROM base)
SELECT doc_id, 'S' || row_number() OVER (PARTITION BY doc_id ORDER BY g) AS id, "group", category, severity, "order", 'Results' AS "where" FROM f"""


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(ranked_findings(spark, sf_dir)).select(*(F.coalesce(c, F.lit("all")).alias(c) for c in ("group", "category", "severity")), "n", "first_order")


QUERIES["finding_summary"] = finding_summary
ORACLES["finding_summary"] = f"""WITH r AS ({ORACLES["ranked_findings"]}) SELECT coalesce("group", 'all') AS "group", coalesce(category, 'all') AS category, coalesce(severity, 'all') AS severity, count(*) AS n, count(CASE WHEN "order" = 'first' THEN 1 END) AS first_order FROM r GROUP BY ROLLUP ("group", category, severity)"""


def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.ranked(report.normalized(report.raw_findings(docs := _small_corpus(spark, sf_dir), names=("percent_counts", "tortured", "residue")), docs))
    ids = docs.select("doc_id")
    edits = ids.where("doc_id % 2 = 0").select("doc_id", F.lit("S1").alias("id"), F.explode(F.array(F.struct(F.lit("severity").alias("field"), F.lit("critical").alias("value")), F.struct(F.lit("id").alias("field"), F.lit("X").alias("value")))).alias("e")).select("doc_id", "id", "e.*")
    dismissed = ids.where("doc_id % 3 = 0").select("doc_id", F.lit("S2").alias("id"), F.lit("misread").alias("reason"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("where", "evidence", "calculation", "fix", "context")]
    added = ids.where("doc_id % 5 = 0").select("doc_id", F.lit(1).alias("n"), F.lit("Causal words").alias("title"), F.lit("claims").alias("group"), F.lit("major").alias("severity"), F.lit("first").alias("order"), F.lit("X causes Y").alias("quote"), *blank)
    kept, _ = report.reviewed(found, edits, dismissed, added)
    return kept.select("doc_id", "id", "severity", "position")


QUERIES["review_merge"] = review_merge
ORACLES["review_merge"] = f"""WITH r AS ({ORACLES["ranked_findings"]}), k AS (
SELECT doc_id, id, CASE WHEN id = 'S1' AND doc_id % 2 = 0 THEN 'critical' ELSE severity END AS severity, "order", id[2:]::BIGINT AS p FROM r WHERE NOT (id = 'S2' AND doc_id % 3 = 0)
UNION ALL SELECT DISTINCT doc_id, 'R1', 'major', 'first', 1048577 FROM r WHERE doc_id % 5 = 0)
SELECT doc_id, id, severity, (row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN "order" = 'first' THEN 0 ELSE 1 END, CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, p))::INT AS position FROM k"""

_VERSIONS = "SELECT o_custkey AS doc_id, CAST(sum(o_orderkey) % 900 + 100 AS BIGINT) AS a, CAST(sum(o_orderkey) % 900 + 100 AS BIGINT) + CASE WHEN o_custkey % 3 = 0 THEN 3 ELSE 0 END AS b FROM {orders} GROUP BY o_custkey"


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir, _VERSIONS)
    text = "We found a score of <x> over all sites, and a second of 0.500 there."
    return corrections.corrected_numbers(rows.select("doc_id", text_of(text, x=thousandths("a")).alias("old"), text_of(text, x=thousandths("b")).alias("new"))).select("doc_id", F.col("old").cast("double").alias("old"), F.col("new").cast("double").alias("new"))


QUERIES["corrected_numbers"] = corrected
ORACLES["corrected_numbers"] = f"WITH base AS ({_plain(_VERSIONS)}) SELECT doc_id, a / 1000.0::DOUBLE AS old, b / 1000.0::DOUBLE AS new FROM base WHERE a <> b"


def caught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of printed percentages that a finding on the first version names."""
    rows = _base(spark, sf_dir, _ORDER_COUNTS)
    text = r"\begin{document}Of the orders, <k>/<n> (<p>\%) were filled.\end{document}"
    docs = rows.select("doc_id", text_of(text, p=tenths("t")).alias("text"), F.lit("").alias("bib"))
    fixed = rows.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("n"), tenths("t").alias("old"), tenths("(t - 20)").alias("new"))
    found = quantities.percent_counts(docs).withColumn("evidence", F.col("reasoning"))
    return corrections.caught(fixed, found).select("doc_id", F.col("old").cast("double").alias("old"))


QUERIES["caught_corrections"] = caught
ORACLES["caught_corrections"] = f"WITH base AS ({_plain(_ORDER_COUNTS)}) SELECT doc_id, t / 10.0::DOUBLE AS old FROM base WHERE {_WRONG} AND doc_id % 2 = 0"
