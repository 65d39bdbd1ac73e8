"""Each check on one text that fails it and one that passes."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

DOC = "\\begin{document}\n%s\n\\end{document}"

CASES = [
    ("percent_counts", "Of the plants, 30/120 (27\\%) died.", ["percent_count_mismatch"], "Of the plants, 30/120 (25\\%) died."),
    ("percent_counts", "共有200例，200例中有50例(30\\%)好转。", ["percent_count_mismatch"], "共有200例，200例中有50例(25\\%)好转。"),
    ("percent_denominators", "Causes were frost in 20 (10.0\\%), drought in 50 (25.0\\%) and pests in 30 (18.0\\%) plots.", ["percent_denominator_outlier"], "Causes were frost in 20 (10.0\\%), drought in 50 (25.0\\%) and pests in 30 (15.0\\%) plots."),
    ("grimmer", "Raters (n = 4) scored it on a scale (M = 2.00, SD = 1.00).", ["grimmer_infeasible_sd"], "Raters (n = 4) scored it on a scale (M = 2.50, SD = 1.29)."),
    ("grim", "The mean score was 3.41 points (N = 12).", ["grim_infeasible_mean"], "The mean score was 3.42 points (N = 12)."),
    ("grim", "The N = 12 raters gave a mean score of 3.41.", ["grim_infeasible_mean"], "The N = 12 sites had a mean height of 3.41."),
    ("compute_budget", "It costs 2 hours per seed-task (4 GPU-hours); 10 tasks x 3 seeds = 300 GPU-hours of primary training.", ["compute_budget_inconsistency"], "It costs 2 hours per seed-task (4 GPU-hours); 10 tasks x 3 seeds = 120 GPU-hours of primary training."),
    ("product_totals", "We kept 500 pots (20 trays x 40 rows).", ["product_total_mismatch"], "We kept 800 pots (20 trays x 40 rows)."),
    ("product_totals", "We kept ~2K pots (20 trays x 40 rows x 3 years).", ["product_total_mismatch"], "We kept ~2.4K pots (20 trays x 40 rows x 3 years)."),
    ("split_shares", "We use 70\\% train, 25\\% val and 15\\% test rows.", ["split_percentages_exceed_100"], "We use 70\\% train, 15\\% val and 15\\% test rows."),
    ("relative_changes", "Cost fell from 400 to 300, a 35\\% reduction.", ["relative_change_mismatch"], "Cost fell from 400 to 300, a 25\\% reduction."),
    ("relative_changes", "产量从 200 提高到 300，提高了 80\\%。", [], "产量为 300，较 200 提高了 50\\%。"),
    ("same_changes", "It gives a 12\\% water use reduction. We saw a 15\\% water use reduction.", ["same_change_different_values"], "It gives a 12\\% water use reduction. We saw a 12\\% water use reduction."),
    ("p_values", "The groups differed, t(30) = 1.10, p = .01.", ["pvalue_recompute_mismatch"], "The groups differed, t(30) = 2.75, p = .010."),
    ("p_values", "They differed (t = 1.10, p = 0.001).", ["pvalue_recompute_mismatch"], "They differed (t = 3.50, p = 0.001)."),
    ("p_values", "They differed, F(2, 60) = 1.50, p < .01.", ["pvalue_recompute_mismatch"], "A one-sided test gave F(2, 60) = 1.50, p < .01."),
    ("intervals", "Risk rose (OR = 1.50, 95\\% CI 0.80 to 2.80, p = .01).", ["interval_p_contradiction"], "Risk rose (OR = 1.50, 95\\% CI 1.10 to 2.05, p = .01)."),
    ("intervals", "Risk fell (HR 0.50, 95\\% CI 0.60-0.90).", ["estimate_outside_interval"], "Risk fell (HR 0.70, 95\\% CI 0.60-0.90)."),
    ("effect_sizes", "Yields differed, F(2, 40) = 5.00, $\\eta_p^2 = .50$.", ["effect_size_mismatch"], "Yields differed, F(2, 40) = 5.00, $\\eta_p^2 = .20$."),
    ("p_clusters", "We found p = 0.046, p = 0.047 and p = 0.049.", ["pvalue_clustering_below_0_05"], "We found p = 0.046, p = 0.2 and p = 0.049."),
    ("z_pairs", "They give z = 1.00, p = 0.01.", ["pvalue_z_mismatch"], "They give z = 2.58, p = 0.01."),
    ("t_pairs", "They give t(9) = 1.00, p = 0.001.", ["pvalue_t_impossible"], "They give t(9) = 4.78, p = 0.001."),
    ("directional_claims", "The drug was better by 2 points (95\\% CI -1.0 to 5.0).", ["directional_claim_against_interval"], "The drug was not better (95\\% CI -1.0 to 5.0)."),
    ("directional_claims", "The drug was better (P = 0.30).", ["directional_claim_against_interval"], "The drug was better (P = 0.08) at the 10\\% level."),
    ("uncited_floats", "\\label{tab:x} \\label{fig:y} See \\figref{fig:y}.", ["uncited_float"], "\\label{tab:x} See Table~\\ref{tab:x}."),
    ("panel_references", "See \\ref{fig:m}d. \\begin{figure}\\caption{(a) Map. (b) Inset.}\\label{fig:m}\\end{figure}", ["panel_reference_beyond_caption"], "See \\ref{fig:m}b. \\begin{figure}\\caption{\\textbf{a}, Map. (b--d) Inset.}\\label{fig:m}\\end{figure}"),
    ("residue", "Sure, here is the section.\nIt is known [todo: cite].", ["assistant_residue"] * 2, "Here we show it [12]."),
    ("tortured", "We train a choice tree and an AI calculation.", ["tortured_phrase"] * 2, "We train a decision tree."),
    ("early_abbreviations", "\\section{Introduction} The BWR was run. A boiling water reactor (BWR) was built.", ["abbreviation_before_definition"], "\\section{Introduction} A boiling water reactor (BWR) was built. The BWR was run."),
    ("double_abbreviations", "\\section{Introduction} A boiling water reactor (BWR) stands. A big water ring (BWR) lies.", ["abbreviation_two_expansions"], "\\section{Introduction} A boiling water reactor (BWR) stands. The boiling water reactor (BWR) runs."),
    ("prose_table", "Our plan scores 0.734 overall.\n\\begin{tabular}{lc}\nName & Score \\\\\nOur plan & 0.738 \\\\\n\\end{tabular}", ["prose_table_number_disagreement"], "Our plan scores 0.738 overall.\n\\begin{tabular}{lc}\nName & Score \\\\\nOur plan & 0.738 \\\\\n\\end{tabular}"),
]


@pytest.mark.parametrize("name,bad,want,good", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_check(categories, name, bad, want, good):
    assert categories(DOC % bad, names=[name]) == want
    assert categories(DOC % good, names=[name]) == []


def test_prose_table_guards(categories):
    table = "\n\\begin{tabular}{lc}\nName & Score \\\\\nOur plan & 0.738 \\\\\n\\end{tabular}"
    for s in ("Our plan scores about 0.734 overall.", "Our plan with $x = 0.734$ wins.", "Our plan scores 0.612 overall.", "In the subgroup our plan scores 0.734.", "Figure~\\ref{fig:a} has our plan at 0.734."):
        assert categories(DOC % (s + table), names=["prose_table"]) == [], s
    caption = "\\begin{table}\\caption{Our plan at \\textbf{0.734}.}" + table + "\\end{table}"
    assert categories(DOC % caption, names=["prose_table"]) == ["prose_table_number_disagreement"]


def test_cross_sections(categories):
    far = "Many words about weather and travel stand here in a row. " * 4
    assert categories(DOC % f"First MAPE = 3.1 there. {far} Next MAPE: 4.2 there. {far} Last MAPE = 5.3 there.", names=["cross_sections"]) == ["cross_section_number_disagreement"]
    assert categories(DOC % f"First MAPE = 3.1 there. {far} Next worst MAPE: 4.2 there. {far} Last MAPE = 5.3 there.", names=["cross_sections"]) == []


def test_terminal_digits(categories):
    table = lambda ds: "\\begin{tabular}{l} a & " + " & ".join(f"1.2{d}" for d in ds) + " \\\\ \\end{tabular}"
    assert categories(table("5" * 15 + "0123456"), names=["terminal_digits"]) == ["terminal_digit_nonuniform"]
    assert categories(table("0123456789" * 3), names=["terminal_digits"]) == []
    assert categories(table("5" * 15), names=["terminal_digits"]) == []


def test_latex_citations(categories):
    names = ["undefined_citations", "uncited_entries", "duplicate_entries"]
    text = DOC % "\\citep{ka, kb} \\citet[p.~2]{kc} \\bibitem{KA} A. \\bibitem{kc} C. \\bibitem{kd} D."
    assert categories(text, names=names) == ["citation_undefined", "reference_never_cited"]
    assert categories(DOC % "\\nocite{*} \\cite{kz} \\bibitem{ka} A.", names=names) == []
    assert categories(DOC % "\\cite{k1,k2,k3,k4,k5} \\bibitem{k5} E.", names=names) == []  # most are missing: not the whole list
    bib = "@article{k1,\n title={The slow growth of coastal dunes},\n}\n@book{K2,\n title = {The Slow Growth of Coastal {Dunes}},\n}\n"
    assert categories(DOC % "\\cite{k1,k2}", bib, names) == ["reference_duplicate"]


def test_numbered_citations(categories):
    names = ["citations_beyond", "numbers_never_cited"]
    refs = "\nReferences\n" + "".join(f"[{i}] Writer {i}. Title.\n" for i in range(1, 7))
    assert categories("Seen [1-4] and [9]." + refs, names=names) == ["citation_beyond_list", "reference_never_cited"]
    assert categories("Seen [1-4] and [5, 6]." + refs, names=names) == []
    assert categories("Seen [1]." + refs, names=names) == []


def test_statements(spark):
    from veriloom.operators.writing import statements

    docs = spark.createDataFrame([(1, "Approved by the IRB. Informed consent was obtained. We follow PRISMA. 利益冲突：无。"), (2, ""), (3, None)], "doc_id long, text string")
    rows = statements(docs).collect()
    assert {r.statement for r in rows if r.doc_id == 1 and r.found} == {"ethics_approval", "informed_consent", "reporting_guideline", "conflict_of_interest"}
    assert not any(r.found for r in rows if r.doc_id != 1) and len(rows) == 30


def test_grim_and_grimmer_by_enumeration(spark):
    from pyspark.sql import functions as F

    from veriloom.operators.quantities import grim_possible, grimmer_possible

    rng = random.Random(5)
    rows = [(i, f"{rng.randint(0, 800) / 100:.2f}", f"{rng.randint(1, 250) / 100:.2f}", rng.randint(2, 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, mean string, sd string, n int").withColumn("n", F.col("n").cast("double"))
    got = {r.i: (r.a, r.b) for r in df.select("i", grim_possible(F.col("mean"), F.lit(2), F.col("n")).alias("a"), grimmer_possible(F.col("mean"), F.col("sd"), F.col("n")).alias("b")).collect()}

    def possible(mean, sd, n):
        m, s, h = Fraction(mean), Fraction(sd), Fraction(1, 200)
        for total in range(math.ceil((m - h) * n), math.floor((m + h) * n) + 1):
            lo, hi = (n - 1) * max(s - h, 0) ** 2 + Fraction(total * total, n), (n - 1) * (s + h) ** 2 + Fraction(total * total, n)
            if any(q % 2 == total % 2 for q in range(math.ceil(lo), math.floor(hi) + 1)):
                return True
        return False

    for i, mean, sd, n in rows:
        assert got[i][0] == any(round(k / n * 100) == round(float(mean) * 100) for k in range(0, 9 * n)), (mean, n)
        assert got[i][1] == possible(mean, sd, n), (mean, sd, n)


def test_distributions():
    from veriloom.functions.distributions import p_value

    known = [("z", 1.959964, None, None, 0.05), ("t", 2.048407, 28, None, 0.05), ("t", 12.7062, 1, None, 0.05), ("F", 4.195972, 1, 28, 0.05), ("F", 3.885294, 2, 12, 0.05), ("chi2", 3.841459, 1, None, 0.05), ("chi2", 11.0705, 5, None, 0.05), ("r", 0.361007, 28, None, 0.05)]
    for test, x, a, b, p in known:
        assert abs(p_value(test, x, a, b) - p) < 2e-6, test
    assert p_value("t", 0.0, 5, None) == pytest.approx(1) and p_value("F", 1.0, 0, 3) is None
    assert p_value("chi2", 100.0, 2, None) == pytest.approx(math.exp(-50), rel=1e-9)
    assert p_value("t", 3.0, 2, None) == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-9)


def test_empty_and_null(spark):
    from veriloom.plans import report

    docs = spark.createDataFrame([(1, "", ""), (2, None, None), (None, "text", "")], "doc_id long, text string, bib string")
    assert report.raw_findings(docs).count() == 0
    assert report.raw_findings(docs.where("false")).count() == 0


def test_preprints_a_hundred_thousand_keys_apart(spark, tmp_path):
    """Each planted reference meets its own lookup and no other's."""
    from veriloom.plans.planted import reference_search

    keys = [4, 100_004, 1_200_004, 100_005, 5]
    spark.createDataFrame([(k, f"steel {k}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.doc_id, r.status) for r in reference_search(spark, str(tmp_path)).collect())
    assert got == sorted((k, "verified" if k % 8 == 4 else "problem") for k in keys)


def test_spend_does_not_depend_on_where_orders_lie(spark, tmp_path):
    """A total of doubles is added up in the order of the orders' keys, as the SQL does in one thread."""
    from veriloom.plans.registry import prose_table

    prices = [(3, 20528.6), (1, 68603.49), (4, 14980.48), (2, 213023.43)]
    rows = spark.createDataFrame([(c * 10 + k, c, p) for c in (4, 8, 12) for k, p in prices] + [(1, 16, None)], "o_orderkey long, o_custkey long, o_totalprice double")
    for n, at in enumerate((1, 4)):
        rows.repartition(at, "o_orderkey").sortWithinPartitions("o_totalprice").write.parquet(f"{tmp_path}/{n}/orders.parquet")
        got = {r.doc_id: r.cell for r in prose_table(spark, f"{tmp_path}/{n}").collect()}
        assert got == {c: 317135 + c / 100 for c in (4, 8, 12)}
