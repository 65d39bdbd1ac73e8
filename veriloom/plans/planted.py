"""More queries with SQL: tests with degrees of freedom, ratios, references without a DOI, findings' details, readers and results.

As in the registry, both engines get the same numbers; the engine reads sentences or files, the SQL only the numbers.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import corrections, package, references, statistics, writing
from ..sources import readers
from . import report
from .registry import _ORDER_COUNTS, _WRONG, ORACLES, QUERIES, _base, _plain, _small_corpus, check_query, hundredths, number, tenths, text_of, thousandths  # noqa: F401


def query(name: str, oracle: str):
    """Register a function as a query with its SQL."""

    def register(run):
        QUERIES[name], ORACLES[name] = run, oracle
        return run

    return register


def document(text: Column, bib: Column | None = None) -> list[Column]:
    return [F.col("doc_id"), text.alias("text"), (F.lit("") if bib is None else bib).alias("bib")]


# --- statistics: p values that have closed forms ---
# t and r with 2 degrees of freedom, F with 2 and n, chi-square with 2.  x is the statistic in hundredths.
_X = "(h / 100.0)"


def _closed(x: str) -> str:
    return f"""CASE k WHEN 0 THEN 1 - {x} / sqrt({x} * {x} + 2) WHEN 1 THEN pow(n / (n + 2 * {x}), n / 2.0) WHEN 2 THEN exp(-{x} / 2) ELSE 1 - least({x}, 0.999999) END"""


_TESTS = f"""SELECT doc_id, k, n, h, CAST(floor(1000 * CAST({_closed(_X)} AS DOUBLE) + 0.5) AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 40 WHEN doc_id % 7 = 0 THEN -3 ELSE 0 END AS p
  FROM (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k, CAST(o_custkey % 40 + 10 AS DOUBLE) AS n, CASE WHEN o_orderkey % 4 = 3 THEN 20 + o_orderkey % 70 ELSE 60 + o_orderkey % 390 END AS h FROM {{orders}}) q"""


@query(
    "pvalue_tests",
    f"""WITH base AS ({_plain(_TESTS)}), r AS (SELECT doc_id, p / 1000.0::DOUBLE AS p, {_closed("((h + 0.5)::DOUBLE / 100)")} AS lo, {_closed("((h - 0.5)::DOUBLE / 100)")} AS hi FROM base WHERE p BETWEEN 4 AND 950)
    SELECT doc_id, 'pvalue_recompute_mismatch' AS category, CASE WHEN (p < 0.05) <> (hi < 0.05) AND (lo >= 0.05 OR hi < 0.05) THEN 'major' ELSE 'minor' END AS severity, p FROM r WHERE lo > p + 0.0005 OR hi < p - 0.0005""",
)
def pvalue_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, F, chi-square and r, one sentence each."""
    rows = _base(spark, sf_dir, _TESTS).where("p BETWEEN 4 AND 950")
    x, p, n = hundredths("h"), thousandths("p"), F.col("n").cast("int").cast("string")
    test = F.when(F.col("k") == 0, "t(2) = ").when(F.col("k") == 1, F.concat(F.lit("F(2, "), n, F.lit(") = "))).when(F.col("k") == 2, r"$\chi^2$(2) = ").otherwise("r(2) = ")
    docs = rows.select(*document(F.concat(F.lit("The arms were compared, "), test, x, F.lit(", p = "), p, F.lit("."))))
    return statistics.p_values(docs).select("doc_id", "category", "severity", number(0).alias("p"))


_RATIOS = """SELECT c_custkey AS doc_id, c_custkey % 150 + 60 + CASE WHEN c_custkey % 9 = 0 THEN 200 ELSE 0 END AS e, c_custkey % 150 + 30 - c_custkey % 17 AS lo, c_custkey % 150 + 90 + c_custkey % 31 AS hi, CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 400 END AS p FROM {customer}"""
check_query(
    "ratio_intervals", "intervals", _RATIOS, "The odds ratio was <ee> (95% CI <ll> to <hh>, P = <pp>).", {"ee": "hundredths:e", "ll": "hundredths:lo", "hh": "hundredths:hi", "pp": "thousandths:p"}, {"a": 0, "b": 1, "c": 2},
    """SELECT doc_id, CASE WHEN e < lo - 0.5 OR e > hi + 0.5 THEN 'estimate_outside_interval' ELSE 'interval_p_contradiction' END AS category,
    CASE WHEN e < lo - 0.5 OR e > hi + 0.5 THEN e ELSE lo END / 100.0::DOUBLE AS a, CASE WHEN e < lo - 0.5 OR e > hi + 0.5 THEN lo ELSE hi END / 100.0::DOUBLE AS b,
    CASE WHEN e < lo - 0.5 OR e > hi + 0.5 THEN hi / 100.0::DOUBLE ELSE p / 1000.0::DOUBLE END AS c FROM base
    WHERE lo > 0 AND (e < lo - 0.5 OR e > hi + 0.5 OR ((lo - 0.5 > 100 OR hi + 0.5 < 100) AND p > 50) OR (lo + 0.5 < 100 AND hi - 0.5 > 100 AND p < 50))""",
)
check_query(
    "eta_squared", "effect_sizes", "SELECT o_orderkey AS doc_id, o_orderkey % 3 + 1 AS d1, o_orderkey % 60 + 20 AS d2, o_orderkey % 97 + 3 AS f, o_custkey % 45 + 1 AS e FROM {orders}",
    "Scores rose, F(<d1>, <d2>) = <ff>, eta squared = <ee>.", {"ff": "tenths:f", "ee": "hundredths:e"}, {"e": 0, "f": 1},
    "SELECT doc_id, 'effect_size_mismatch' AS category, e / 100.0::DOUBLE AS e, f / 10.0::DOUBLE AS f FROM base WHERE e / 100.0::DOUBLE - 0.005 > (f / 10.0::DOUBLE + 0.05) * d1 / ((f / 10.0::DOUBLE + 0.05) * d1 + d2)",
)
check_query(
    "product_suffix", "product_totals", "SELECT p_partkey AS doc_id, CAST(p_size AS BIGINT) * 10 AS a, p_partkey % 9 + 12 AS b, p_partkey % 5 + 11 AS c, CAST(floor(p_size * 10 * (p_partkey % 9 + 12) * (p_partkey % 5 + 11) / 100) AS BIGINT) + CASE WHEN p_partkey % 6 = 0 THEN 90 ELSE 0 END AS t FROM {part}",
    "We store ~<tt>K pieces (<a> boxes x <b> layers x <c> rows) in all.", {"tt": "tenths:t"}, {"total": 0, "product": 1},
    "SELECT doc_id, 'product_total_mismatch' AS category, (t * 100)::DOUBLE AS total, (a * b * c)::DOUBLE AS product FROM base WHERE abs(a * b * c - t * 100.0::DOUBLE) / greatest(t * 100, 1)::DOUBLE > 0.10",
)

# --- writing: every kind of residue ---
#: What is written, and what of it is the finding's target.
_RESIDUES = (
    ("As an AI language model, I cannot know.", "As an AI language model"), ("As of my last knowledge cutoff it was so.", "As of my last knowledge cutoff"), ("Sure, here is the text.", "Sure, here is"),
    ("Here is a revised version of it.", "Here is a revised version"), ("I hope this helps you.", "I hope this helps"), ("Regenerate response", "Regenerate response"), ("It holds [citation here] for all.", "[citation here]"),
    ("This is so, citation needed.", "citation needed"), ("Lorem ipsum dolor.", "Lorem ipsum"), ("It was shown (Author, 20XX).", "(Author, 20XX)"), ("See Table ?? there.", "Table ??"), ("As told [?].", "[?]"),
    ("作为一个AI语言模型，我不能。", "作为一个AI语言模型"), ("当然！以下是结果。", "当然！以下是"), ("以下是润色后的文字。", "以下是润色后的"), ("希望对你有帮助。", "希望对你有帮助"), ("【此处待补】如此。", "【此处待补】"), ("已知（作者，年份）。", "（作者，年份）"), ("Nothing of the kind.", None),
)
_sql = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"


@query("residue_kinds", "SELECT * FROM (SELECT p_partkey AS doc_id, 'assistant_residue' AS category, CASE p_partkey % " + str(len(_RESIDUES)) + "".join(f" WHEN {i} THEN {_sql(t)}" for i, (_, t) in enumerate(_RESIDUES)) + " END AS target FROM part) WHERE target IS NOT NULL")
def residue_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*(F.lit(s) for s, _ in _RESIDUES)), (F.col("doc_id") % len(_RESIDUES)).cast("int"))
    docs = _base(spark, sf_dir, "SELECT p_partkey AS doc_id FROM {part}").select(*document(F.concat(F.lit("\\begin{document}\nWe begin.\n"), said, F.lit("\nWe end.\n\\end{document}"))))
    return writing.residue(docs).select("doc_id", "category", "target")


@query("statements_planted", "SELECT p_partkey AS doc_id, s.statement, p_partkey % 10 = s.k AS found FROM part, (SELECT unnest(['ethics_approval', 'informed_consent', 'conflict_of_interest', 'funding', 'data_availability', 'code_availability', 'trial_registration', 'author_contributions', 'ai_use_disclosure', 'reporting_guideline']) AS statement, unnest(range(10)) AS k) s")
def statements_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration a part."""
    said = ("The ethics committee agreed.", "Written informed consent came first.", "The authors declare no competing interests.", "Funding came from a bank.", "The data are publicly available.", "See github.com for it.", "It is NCT12345678 there.", "Author contributions: all wrote.", "ChatGPT was used here.", "We follow PRISMA there.")
    text = F.get(F.array(*map(F.lit, said)), (F.col("doc_id") % 10).cast("int"))
    return writing.statements(_base(spark, sf_dir, "SELECT p_partkey AS doc_id FROM {part}").select(*document(F.concat(F.lit("We went there. "), text, F.lit(" We came back."))))).select("doc_id", "statement", "found")


@query("quantities_in_typography", "SELECT p_partkey AS doc_id, (p_partkey % 900 + 100) / 100.0::DOUBLE AS x FROM part")
def quantities_in_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, widths and definitions are no numbers of a text; the one beside them is."""
    docs = _base(spark, sf_dir, "SELECT p_partkey AS doc_id, p_partkey % 900 + 100 AS h FROM {part}")
    text = text_of(r"\hspace{1.5cm} \renewcommand{\arraystretch}{1.3} p{2.5cm} a width of 3.25 cm and <x> v1.5", x=hundredths("h"))
    return docs.select("doc_id", F.explode(T.decimals_in(text)).alias("x")).select("doc_id", F.col("x").cast("double").alias("x"))


# --- what a finding tells ---
_SHOWN = "('Of the orders, ' || k || '/' || n || ' (' || (t // 10) || '.' || (t % 10) || '%) were filled.')"
_TRIMMED = "(CASE WHEN t % 10 = 0 THEN (t // 10)::VARCHAR ELSE (t // 10) || '.' || (t % 10) END)"


@query(
    "finding_details",
    f"""WITH base AS ({_plain(_ORDER_COUNTS)}), f AS (SELECT *, floor(10000.0::DOUBLE * k / n + 0.5)::BIGINT AS c FROM base WHERE {_WRONG})
    SELECT doc_id, {_SHOWN} AS quote, 'Results: We counted. ' || {_SHOWN} || ' We stopped.' AS context, 'Results' AS "where", k || ' / ' || n || ' = ' || (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') || '%; printed: ' || {_TRIMMED} || '%' AS calculation FROM f""",
)
def finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\begin{document}\section{Results} We counted. Of the orders, <k>/<n> (<p>\%) were filled. We stopped.\end{document}"
    docs = _base(spark, sf_dir, _ORDER_COUNTS).select(*document(text_of(text, p=tenths("t")))).withColumn("language", F.lit("en"))
    return report.normalized(report.raw_findings(docs, names=("percent_counts",)), docs).select("doc_id", "quote", "context", "where", "calculation")


@query(
    "result_documents",
    f"""WITH base AS ({_plain(_ORDER_COUNTS)}) SELECT doc_id, 2 + CASE WHEN {_WRONG} THEN 1 ELSE 0 END AS findings, CASE WHEN {_WRONG} THEN 1 ELSE 0 END::BIGINT AS first, 1::BIGINT AS major, 1::BIGINT AS minor, 2 AS gaps FROM base""",
)
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a manuscript, read back."""
    docs = _small_corpus(spark, sf_dir)
    found = report.ranked(report.normalized(report.raw_findings(docs, names=("percent_counts", "tortured", "residue")), docs))
    made = report.results(docs, found, writing.statements(docs), report.not_verified(docs))
    get = lambda path: F.get_json_object("result", path).cast("long")
    size = lambda path: F.json_array_length(F.get_json_object("result", path))
    return made.select("doc_id", size("$.findings").alias("findings"), get("$.counts.first").alias("first"), get("$.counts.major").alias("major"), get("$.counts.minor").alias("minor"), size("$.not_verified").alias("gaps"))


@query("findings_by_check", f"""WITH base AS ({_plain(_ORDER_COUNTS)}) SELECT * FROM (SELECT 'grimmer' AS "check", count(CASE WHEN {_WRONG} THEN 1 END) AS n FROM base UNION ALL SELECT 'text_hygiene', 2 * count(*) FROM base) WHERE n > 0""")
def findings_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.by_check(report.raw_findings(_small_corpus(spark, sf_dir), names=("percent_counts", "tortured", "residue")))


@query("corpus_summary", f"""WITH base AS ({_plain(_ORDER_COUNTS)}) SELECT count(*) AS documents_with_findings, count(*) + count(CASE WHEN {_WRONG} THEN 1 END) AS majors FROM base""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.corpus_summary(report.raw_findings(_small_corpus(spark, sf_dir), names=("percent_counts", "tortured", "residue"))).select("documents_with_findings", "majors")


# --- references without a DOI ---
_REFS = "SELECT p_partkey AS doc_id, p_name AS name FROM {part}"
_TITLE = "A study of <name> under load in part <doc_id>"
_STATUS = "CASE p_partkey % 8 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_found' WHEN 2 THEN 'verified' WHEN 3 THEN 'unverifiable' WHEN 4 THEN 'verified' WHEN 5 THEN 'problem' WHEN 6 THEN 'problem' ELSE 'unverifiable' END"
_REASON = "CASE p_partkey % 8 WHEN 3 THEN 'no article' WHEN 7 THEN 'lookup failed' ELSE '' END"


def _preprint(key: Column) -> Column:
    """A preprint's number that no other of a thousand million keys in a row has; its first part counts the hundred thousands."""
    return F.concat(F.lpad(((2101 + F.floor(key / 100_000)) % 10_000).cast("string"), 4, "0"), F.lit("."), F.lpad((key % 100_000).cast("string"), 5, "0"))


def _search_verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A reference a part that is sought by its words or its preprint's number; the key decides what is known of it."""
    rows = _base(spark, sf_dir, _REFS).withColumn("kind", F.col("doc_id") % 8)
    rows = rows.withColumns({"title": text_of(_TITLE), "preprint": _preprint(F.col("doc_id"))})
    kind = F.col("kind")
    bib = F.concat(
        F.when(kind == 3, "@misc{r, title={").otherwise("@article{r, title={"), "title", F.when(kind == 3, "}, year={2001}").otherwise("}, journal={Heft}, year={2001}"),
        F.when(kind.isin(4, 5, 6), F.concat(F.lit(", eprint={"), "preprint", F.lit("}, archiveprefix={arXiv}"))).otherwise(""), F.lit("}\n"),
    )
    docs = rows.select(*document(F.lit("\\begin{document}\\cite{r}\\end{document}"), bib))
    raw = F.concat("title", F.when(kind == 3, ". 2001").otherwise(". Heft. 2001"))
    none, item = F.lit('{"message": {"items": []}}'), lambda t: F.concat(F.lit('{"message": {"items": [{"DOI": "10.1000/x", "title": ["'), t, F.lit('"], "issued": {"date-parts": [[2001]]}}]}}'))
    search = rows.where(kind.isin(0, 1, 2, 3)).select(references._url(references.search_url, raw).alias("url"), F.when(kind == 0, item(F.col("title"))).otherwise(none).alias("body"))
    second = F.concat(F.lit('{"results": [{"doi": "https://doi.org/10.1000/y", "title": "'), "title", F.lit('", "publication_year": 2001}]}'))
    fallback = rows.where(kind.isin(1, 2, 3)).select(references._url(references.fallback_url, F.col("title")), F.when(kind == 2, second).otherwise('{"results": []}'))
    entry = F.when(kind == 4, F.col("title")).when(kind == 5, F.lit("Error")).otherwise(F.lit("Entirely different matters of birdsong"))
    preprints = rows.where(kind.isin(4, 5, 6)).select(F.concat(F.lit(references.ARXIV), "preprint"), F.to_json(F.struct(F.concat(F.lit("<title>query</title><title>"), entry, F.lit("</title>")).alias("_text"))))
    return docs, references.verdicts(references.entries(docs), search.union(fallback).union(preprints))


@query("reference_search", f"SELECT p_partkey AS doc_id, {_STATUS} AS status, {_REASON} AS reason, CASE p_partkey % 8 WHEN 1 THEN 'reference_not_found' WHEN 5 THEN 'reference_arxiv_unresolved' WHEN 6 THEN 'reference_arxiv_mismatch' ELSE '' END AS problems, CASE p_partkey % 8 WHEN 0 THEN '10.1000/x' WHEN 2 THEN '10.1000/y' ELSE '' END AS doi FROM part")
def reference_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, v = _search_verdicts(spark, sf_dir)
    return v.select("doc_id", "status", "reason", F.array_join(F.transform("problems", lambda p: p["category"]), ",").alias("problems"), F.coalesce("matched.doi", F.lit("")).alias("doi"))


@query("reference_findings", "SELECT p_partkey AS doc_id, CASE p_partkey % 8 WHEN 1 THEN 'reference_not_found' WHEN 5 THEN 'reference_arxiv_unresolved' ELSE 'reference_arxiv_mismatch' END AS category, 'major' AS severity, 'r A study of ' || p_name || ' under load in part ' || p_partkey || '. Heft. 2001' AS target FROM part WHERE p_partkey % 8 IN (1, 5, 6)")
def reference_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.reference_findings(_search_verdicts(spark, sf_dir)[1]).select("doc_id", "category", "severity", "target")


@query("not_verified", f"SELECT p_partkey AS doc_id, 'Code and data' AS item, 'no code or data folder was given' AS reason FROM part UNION ALL SELECT p_partkey, 'Reference r', {_REASON} FROM part WHERE p_partkey % 8 IN (3, 7)")
def not_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, v = _search_verdicts(spark, sf_dir)
    return report.not_verified(docs, None, v)


_LISTS = "SELECT p_partkey AS doc_id, p_partkey % 4 + 3 AS m, p_partkey % 3 AS k, 1990 + p_partkey % 30 AS y FROM {part}"


@query("reference_lists", f"SELECT doc_id, i - 1 AS n, CASE k WHEN 2 THEN '#' || i WHEN 1 THEN 'key' || i ELSE '[' || i || ']' END AS label, 'The slow growth of dune number ' || i AS title, y::VARCHAR AS year, '10.1000/d' || i AS doi FROM (SELECT *, unnest(range(1, m + 1))::INT AS i FROM ({_plain(_LISTS)}))")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists, hand-written items, and lists with the author first."""
    title = lambda i: F.concat(F.lit("The slow growth of dune number "), i)
    tail = lambda i: F.concat(F.lit(". Heft. "), F.col("y").cast("string"), F.lit(";3(2):1-9. doi:10.1000/d"), i, F.lit("."))
    numbered = lambda i: F.concat(F.lit("["), i, F.lit("] Marsh AB, Reed C. "), title(i), tail(i))
    item = lambda i: F.concat(F.lit("\\bibitem{key"), i, F.lit("} Marsh AB, Reed C. \\emph{"), title(i), F.lit("}"), tail(i))
    loose = lambda i: F.concat(F.lit("Marsh, A. ("), F.col("y").cast("string"), F.lit("). "), title(i), tail(i))
    lines = lambda form: F.array_join(F.transform(F.sequence(F.lit(1), F.col("m").cast("int")), lambda i: form(i.cast("string"))), "\n")
    text = F.when(F.col("k") == 0, F.concat(F.lit("Known.\nReferences\n"), lines(numbered))).when(F.col("k") == 1, F.concat(F.lit("Known.\n\\begin{thebibliography}{9}\n"), lines(item), F.lit("\n\\end{thebibliography}"))).otherwise(F.concat(F.lit("Known.\nReferences\n"), lines(loose)))
    docs = _base(spark, sf_dir, _LISTS).select(*document(text))
    return references.entries(docs).select("doc_id", "n", "label", "title", "year", "doi")


@query("citing_passages", "SELECT p_partkey AS doc_id, i - 1 AS n, CASE WHEN i <= b THEN array_to_string(['Dunes grow [1-' || b || '].', 'It ends [' || i || '].'][:CASE WHEN i = p_partkey % 4 + 1 THEN 2 ELSE 1 END], ' | ') ELSE 'It ends [' || i || '].' END AS passages FROM (SELECT p_partkey, p_partkey % 3 + 2 AS b, unnest(range(1, 7))::INT AS i FROM part) WHERE i <= b OR i = p_partkey % 4 + 1")
def citing_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and single numbers, and the passages around them."""
    entries = "".join(f"[{i}] Writer {i}. A title of work number {i} here. Journal. 2001.\n" for i in range(1, 7))
    text = F.concat(F.lit("We begin. Dunes grow [1-"), (F.col("doc_id") % 3 + 2).cast("string"), F.lit("]. Much sand.\n\nThen rain. It ends ["), (F.col("doc_id") % 4 + 1).cast("string"), F.lit("]. So it was.\nReferences\n" + entries))
    docs = _base(spark, sf_dir, "SELECT p_partkey AS doc_id FROM {part}").select(*document(text))
    cited = references.citing_sentences(docs.withColumn("text", F.split_part("text", F.lit("\nReferences"), F.lit(1))), references.entries(docs))
    return cited.select("doc_id", "n", F.array_join("cited_in", " | ").alias("passages"))


@query("abstracts", "SELECT '10.1000/p' || p_partkey AS doi, 'sand' || p_partkey || ' and sand' || p_partkey || ' grow' AS abstract FROM part")
def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"results": [{"doi": "https://doi.org/10.1000/P'), k, F.lit('", "abstract_inverted_index": {"grow": [3], "sand'), k, F.lit('": [0, 2], "and": [1]}}]}'))
    return references.abstracts(_base(spark, sf_dir, "SELECT p_partkey AS doc_id FROM {part}").select(F.lit("u").alias("url"), body.alias("body")))


# --- released files ---
_GROUPED = "SELECT s_suppkey AS doc_id, s_suppkey * 37 % 4000 + 1000 AS m, s_suppkey % 13 + 1 AS d, s_suppkey % 4 AS off FROM {supplier}"


@query("back_solved_groups", f"WITH base AS ({_plain(_GROUPED)}) SELECT doc_id, 'back_solved_mean' AS category, 'grouped.csv' AS target FROM base WHERE (m * 5000 + 35 * off) % 5000 = 0")
def back_solved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of five runs: one averages onto three decimals if the offset is zero, the other never does."""

    def cell(i: int, k: int, exact: bool) -> Column:
        shift = (i - 2) * 11 * k
        extra = "off * 35" if exact else "23"
        n = f"(m * 1000 + {shift} * d + {'(' + extra + ')' if i == 2 else '0'})"
        return F.expr(f"concat(cast({n} div 1000000 as string), '.', lpad(cast({n} % 1000000 as string), 6, '0'))")

    lines = [x for g, exact in (("first", True), ("second", False)) for i in range(5) for x in (F.lit(f"{g},"), cell(i, 1, exact), F.lit(","), cell(i, 3, exact), F.lit("\n"))]
    files = _base(spark, sf_dir, _GROUPED).select("doc_id", F.lit("results/grouped.csv").alias("rel_path"), F.lit(".csv").alias("ext"), F.lit(1).alias("size"), F.concat(F.lit("arm,a,b\n"), *lines).alias("content"))
    return package.back_solved_means(package.csv_cells(files)).select("doc_id", "category", "target")


@query("unbound_globs", "SELECT s_suppkey AS doc_id, ['results/free.csv', 'results/named.csv', 'results/part_a.csv', 'results/stemmed.csv'][s_suppkey % 4 + 1] AS rel_path FROM supplier WHERE s_suppkey % 4 = 0")
def unbound_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files that a test names by name, by a glob or by stem, and one that it does not."""
    rows = _base(spark, sf_dir, "SELECT s_suppkey AS doc_id FROM {supplier}")
    name = F.get(F.array(*(F.lit(f"results/{n}.csv") for n in ("free", "named", "part_a", "stemmed"))), (F.col("doc_id") % 4).cast("int"))
    files = rows.select("doc_id", name.alias("rel_path"), F.lit(".csv").alias("ext"), F.lit(9).cast("long").alias("size"), F.lit("0.123\n").alias("content"))
    test = F.lit("read('named.csv'); glob('out/part_*.csv'); load('stemmed')")
    tests = rows.select("doc_id", F.lit("tests/test_it.py"), F.lit(".py"), F.lit(9).cast("long"), test)
    return package.unbound_files(files.union(tests)).select("doc_id", "rel_path")


# --- readers: files written from the nations, and read again ---
def _archive(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _word(name: str) -> bytes:
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={json.dumps(style)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Place", "Share"), (name, "12.5%"))) + "</w:tbl>"
    return _archive({"word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{p("Methods", "Heading1")}{p(f"We went to {name}.")}{p("Table 1. Shares")}{table}</w:body></w:document>'})


def _nation_files(key: int, name: str) -> dict[str, bytes]:
    """A manuscript's files: the key decides its form."""
    bib = f"@article{{a, title={{On {name}}}, year={{2001}}}}\n"
    tex = f"\\documentclass{{article}}\\begin{{document}}\\section{{Start}}\n\\input{{parts/body}}\n\\bibliography{{refs}}\\end{{document}}"
    package_ = {"companion/results/r.csv": "0.1\n", "companion/tests/t.py": "x", "other/readme.txt": "no"}
    latex = {"main.tex": tex, "parts/body.tex": f"We went to {name}.", "refs.bib": bib, "unused.bib": "@misc{z, title={Not named}}", **package_}
    md = f"# Methods\n\nWe went to {name}, 5% of all.\n\nTable 1. Shares\n\n| Place | Share |\n|---|---|\n| {name} | 12.5% |\n"
    forms = ({k: v.encode() for k, v in latex.items()}, {"all.zip": _archive(latex)}, {"paper.md": md.encode()}, {"paper.docx": _word(name)}, {"paper.txt": f"Methods\nWe went to {name}.\n".encode(), "code/results/r.csv": b"0.2\n"})
    return forms[key % 5]


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder on the session's own file system with a sub-folder for each of the 25 nations."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{where}/veriloom-nations-{uuid.uuid4().hex}")
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(top)
    for key, name in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # 25 rows
        for path, body in _nation_files(int(key), name).items():
            stream = files.create(jvm.org.apache.hadoop.fs.Path(f"{top.toString()}/n{key:02d}/{path}"), True)
            stream.write(bytearray(body))
            stream.close()
    return top.toString()


@query(
    "read_manuscripts",
    """SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') || ['/main.tex', '/main.tex', '/paper.md', '/paper.docx', '/paper.txt'][n_nationkey % 5 + 1] AS path, ['latex', 'latex', 'markdown', 'docx', 'text'][n_nationkey % 5 + 1] AS kind, true AS names_place,
    n_nationkey % 5 IN (2, 3) AS has_table, n_nationkey % 5 < 4 AS has_section, CASE WHEN n_nationkey % 5 < 2 THEN 'On ' || n_name ELSE '' END AS bib_title, 'en' AS language FROM nation""",
)
def read_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX with inputs and bibliography, the same in an archive, Markdown, Word and plain text."""
    docs = readers.manuscripts(spark, _written(spark, sf_dir))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("root"), "n_name")
    rows = docs.withColumn("root", F.split_part("path", F.lit("/"), F.lit(1))).join(F.broadcast(names), "root")
    table = F.col("text").contains("\\begin{tabular}") & F.col("text").contains("12.5\\%") & F.col("text").contains("\\caption{Table 1. Shares}")
    return rows.select("path", "kind", F.col("text").contains(F.concat(F.lit("We went to "), "n_name")).alias("names_place"), table.alias("has_table"), F.col("text").rlike(r"\\section\{(Start|Methods)\}").alias("has_section"), F.regexp_extract("bib", r"title=\{([^}]*)\}", 1).alias("bib_title"), "language")


@query("read_packages", "SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS root, unnest(CASE WHEN n_nationkey % 5 < 2 THEN ['results/r.csv', 'tests/t.py'] ELSE ['results/r.csv'] END) AS rel_path FROM nation WHERE n_nationkey % 5 IN (0, 1, 4)")
def read_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is released beside a manuscript, under companion/ or code/."""
    files = readers.package_files(spark, _written(spark, sf_dir))
    roots = spark.range(25).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("root")).withColumn("doc_id", F.xxhash64("root"))
    return files.join(F.broadcast(roots), "doc_id").select("root", "rel_path")


# --- whole texts ---
@query("sentence_counts", r"SELECT doc_id, (1 + len(regexp_extract_all(text, '[.!?;]\s+[A-Z(\[一-鿿]')) + 2)::BIGINT AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with two sentences in Chinese put behind, which end without white space."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit("研究完成。结果很好！")).alias("t"))
    return T.sentences(docs, P.SPLIT_COUNT).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))

