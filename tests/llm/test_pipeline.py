"""The pipeline's stages, each on what its predecessor kept."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline as C
    from tests.llm.test_texts import check_packing
    from veriloom.llm.queries import tokenizer

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        sizes.append((name, docs.count()))
        assert docs.columns == columns
    counts = dict(sizes)
    assert counts["toxicity"] >= counts["quality"] >= counts["near_dedup"] > 0
    last = C.STAGES[-1][1](spark, docs, SF)
    check_packing([r.asDict() for r in last.collect()], docs, 2048, tokenizer("word_bpe_49k.json"))
    whole = C.run(spark, SF)
    assert whole.columns == last.columns and whole.count() == last.count()


def test_registered_queries():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op2_poisson_mixing", "op3_exact_topk"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    a, b = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    tidy = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert cols == sorted(b.columns) and tidy(a).equals(tidy(b))
