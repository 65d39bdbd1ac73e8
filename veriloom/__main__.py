"""python -m veriloom check FOLDER --out OUT [--lookups PATH] [--lang en|zh] [--json] [--fail-on WEIGHT] | python -m veriloom render OUT [--review PATH]"""

from __future__ import annotations

import argparse
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.references import entries, reference_items, verdicts
from .operators.writing import statements
from .plans import report
from .session import session
from .sources import readers

#: What makes the exit status 1: findings of this weight or a graver one.
FAIL_ON = ("never", *report.WEIGHTS)
#: A review, one JSON document a line: what it changes, dismisses and adds of a manuscript, and what it says on the whole.
REVIEW = """path string, summary string, guideline string, items array<struct<item:string,status:string,where:string,note:string>>,
edits array<struct<id:string,field:string,value:string>>, dismissed array<struct<id:string,reason:string>>,
added array<struct<title:string,group:string,severity:string,order:string,where:string,quote:string,evidence:string,calculation:string,fix:string,context:string>>"""


def _form(of, result: Column, lang: Column) -> Column:
    """A report's form over columns, a batch at a time."""

    def run(results: pa.Array, langs: pa.Array) -> pa.Array:
        return pa.array([of(r, "zh" if k == "zh" else "en") for r, k in zip(results.to_pylist(), langs.to_pylist(), strict=True)], pa.string())

    run.__annotations__ = {"results": pa.Array, "langs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(result, lang)


def _table(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A table that a check wrote, if it did."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(f"{out}/{name}") if there else None


def _reviewed(spark: SparkSession, docs: DataFrame, findings: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings after a review, those it put aside, and what it says on the whole."""
    held = spark.read.schema(REVIEW).json(path).join(docs.select("doc_id", "path"), "path")
    edits = held.select("doc_id", F.explode("edits").alias("e")).select("doc_id", "e.*")
    dismissed = held.select("doc_id", F.explode("dismissed").alias("d")).select("doc_id", "d.*")
    added = held.select("doc_id", F.posexplode("added").alias("n", "a")).select("doc_id", (F.col("n") + 1).alias("n"), "a.*")
    kept, aside = report.reviewed(findings, edits, dismissed, added)
    return kept, aside, held.select("doc_id", "summary", "guideline", F.coalesce("items", F.array()).alias("items"))


def results(spark: SparkSession, out: str, review: str | None = None) -> DataFrame:
    """The result documents of a checked folder, after a review if there is one."""
    docs, findings = _table(spark, out, "manuscripts"), _table(spark, out, "findings")
    aside = said = None
    if review:
        findings, aside, said = _reviewed(spark, docs, findings, review)
    return report.results(docs, findings, _table(spark, out, "statements"), _table(spark, out, "not_verified"), _table(spark, out, "references"), aside, said)


def render(spark: SparkSession, out: str, review: str | None) -> None:
    results(spark, out, review).write.mode("overwrite").parquet(f"{out}/results")
    rows = spark.read.parquet(f"{out}/results")
    lang = F.get_json_object("result", "$.language")
    rows.select("doc_id", _form(report.as_markdown, F.col("result"), lang).alias("markdown"), _form(report.as_html, F.col("result"), lang).alias("html")).write.mode("overwrite").parquet(f"{out}/reports")


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    docs, files = readers.manuscripts(spark, a.folder), readers.package_files(spark, a.folder)
    if a.lang:
        docs = docs.withColumn("language", F.lit(a.lang))
    docs.write.mode("overwrite").parquet(f"{a.out}/manuscripts")
    docs = spark.read.parquet(f"{a.out}/manuscripts")
    readable = docs.where(F.col("text").isNotNull())
    lookups = spark.read.parquet(a.lookups) if a.lookups else None
    made = report.check_corpus(readable, files, lookups)
    made.write.mode("overwrite").parquet(f"{a.out}/findings")
    made.prepared.unpersist()
    statements(readable).write.mode("overwrite").parquet(f"{a.out}/statements")
    verdict = verdicts(entries(readable), lookups) if lookups is not None else None
    report.not_verified(docs, files, verdict).write.mode("overwrite").parquet(f"{a.out}/not_verified")
    if verdict is not None:
        reference_items(readable, verdict, lookups).write.mode("overwrite").parquet(f"{a.out}/references")
    results(spark, a.out).write.mode("overwrite").parquet(f"{a.out}/results")
    shown = spark.read.parquet(f"{a.out}/results").join(docs.select("doc_id", "path"), "doc_id").orderBy("path")
    for row in shown.select("result").toLocalIterator():  # a manuscript at a time
        print(row["result"] if a.json else report.as_text(row["result"], a.lang or "en") + "\n")
    if docs.where(F.col("text").isNull()).limit(1).count():
        return 3
    grave = report.WEIGHTS[: FAIL_ON.index(a.fail_on)]
    return int(not spark.read.parquet(f"{a.out}/findings").where(report.weight().isin(*grave)).isEmpty()) if grave else 0


def main(args: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if args and args[0] not in ("check", "render", "-h", "--help"):
        args.insert(0, "check")
    parser = argparse.ArgumentParser(prog="veriloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("check", help="check a folder of manuscripts")
    one.add_argument("folder")
    one.add_argument("--out", required=True)
    one.add_argument("--lookups", help="Parquet table of lookups(url, body); without it references are not looked up")
    one.add_argument("--lang", choices=("en", "zh"))
    one.add_argument("--json", action="store_true", help="print each manuscript's result as a line of JSON instead of a report")
    one.add_argument("--fail-on", choices=FAIL_ON, default="first", help="exit with status 1 at findings of this weight or a graver one")
    two = sub.add_parser("render", help="write Markdown and HTML of the results under OUT")
    two.add_argument("out")
    two.add_argument("--review", help="JSON lines: what a review changes, dismisses and adds, by the manuscript's path")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "render":
        render(spark, a.out, a.review)
        return 0
    return check(spark, a)


if __name__ == "__main__":
    sys.exit(main())
