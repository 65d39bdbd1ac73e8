"""Manuscripts and released files as DataFrames, from paths that Spark can read.

manuscripts(doc_id, path, kind, text, bib, language, notes) with LaTeX-flavoured text whatever the format;
package_files(doc_id, rel_path, ext, size, content).  Bytes are read by Spark and parsed in Arrow batches.
"""

from __future__ import annotations

import io
import posixpath
import re
import shutil
import subprocess
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

KINDS = {".tex": "latex", ".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".text": "text", "": "text"}
PDF_NOTE = "Read from PDF: table cells are not told apart; the source or a Word file gives fuller results."
DEEPEST = 10
# How captions, rows and rules of tables are written.
_CAPTION = re.compile(r"^\s*(?:table|tab\.|表)\s*[\dSIVX]+", re.I)
_ROW, _RULE = re.compile(r"^\s*\|(.+)\|\s*$"), re.compile(r"^\s*\|?\s*:?-{3,}")
_HEADING = re.compile(r"^\s*#{1,6}\s+(.*)")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _percent(text: str) -> str:
    return re.sub(r"(?<!\\)%", r"\\%", text)


def table(caption: str, rows: list[list[str]]) -> str:
    """A table in LaTeX with its caption; cells are escaped."""
    lines = [" & ".join(_percent(c.replace("&", r"\&").strip()) for c in r) + r" \\" for r in rows]
    columns = "l" * max((len(r) for r in rows), default=1)
    return "\n".join(["", r"\begin{table}", rf"\caption{{{_percent(caption)}}}", rf"\begin{{tabular}}{{{columns}}}", *lines, r"\end{tabular}", r"\end{table}", ""])


def markdown(text: str) -> str:
    """Headings as sections and pipe tables as tabulars, captioned by a line like a caption just before."""
    out: list[str] = []
    rows: list[list[str]] | None = None
    lines = text.splitlines()
    for i, line in enumerate([*lines, ""]):
        row = _ROW.match(line)
        if rows is not None:
            if row:
                if not _RULE.match(line):
                    rows.append([c.strip() for c in row[1].split("|")])
                continue
            last = next((x for x in reversed(out[-3:]) if x.strip()), "")
            out.append(table(last if _CAPTION.match(last.lstrip("#* ")) else "", rows))
            rows = None
        if i == len(lines):
            break
        if row and i + 1 < len(lines) and _RULE.match(lines[i + 1]):
            rows = [] if _RULE.match(line) else [[c.strip() for c in row[1].split("|")]]
        else:
            heading = _HEADING.match(line)
            out.append(rf"\section{{{heading[1].strip()}}}" if heading else _percent(line))
    return "\n".join(out)


def docx(data: bytes) -> str:
    """Paragraphs and tables of a Word file in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": " ", f"{_W}br": "\n", f"{_W}cr": "\n"}
    words = lambda p: "".join((n.text or "") if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in p.iter())
    out, last = [], ""
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            text = words(child)
            style = child.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and re.match("(?i)heading|标题", style.get(f"{_W}val", "")) and text.strip()
            out.append(f"\n\\section{{{text.strip()}}}" if heading else _percent(text))
            last = out[-1].strip() or last
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join(words(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")] for row in child.iter(f"{_W}tr")]
            out.append(table(last.replace(r"\%", "%") if _CAPTION.match(last) else "", rows))
    return "\n".join(out)


def pdf(data: bytes) -> str | None:
    """Text of a PDF by the optional program or library; none without either."""
    if shutil.which("pdftotext"):
        done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=data, capture_output=True)
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def to_text(data: bytes | None, kind: str) -> str | None:
    """LaTeX-flavoured text of a file's bytes; none where it cannot be read here."""
    if data is None:
        return None
    try:
        if kind == "docx":
            return docx(data)
        if kind == "pdf":
            made = pdf(data)
            return None if made is None else _percent(made)
        text = data.decode("utf-8", "replace")
        return text if kind == "latex" else markdown(text) if kind in ("markdown", "text") else None
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, ValueError):
        return None


def unzip(data: bytes) -> list[tuple[str, bytes]]:
    """Members of an archive; one that would leave its folder makes the archive unreadable."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.startswith("/") or posixpath.normpath(name).startswith("..") or "\\" in name:
                raise ValueError(f"unsafe path: {name}")
        return [(posixpath.normpath(i.filename), z.read(i)) for i in z.infolist() if not i.is_dir()]


def _udf(function, kind: str, type_: pa.DataType, *columns: Column) -> Column:
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([function(*v) for v in zip(*(a.to_pylist() for a in arrays), strict=True)], type_)

    if len(columns) == 1:
        def call(a: pa.Array) -> pa.Array:
            return run(a)
    else:
        def call(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    call.__annotations__ = {**dict.fromkeys("ab"[: len(columns)], pa.Array), "return": pa.Array}
    return F.arrow_udf(call, kind)(*columns)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(root, rel_path, ext, size, data): the files under a folder of manuscripts, one sub-folder or file for each; archives are opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^.*?" + re.escape(path.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/?", "")
    rows = raw.select(below.alias("below"), F.col("length").alias("size"), F.col("content").alias("data"))
    rows = rows.select(F.split_part("below", F.lit("/"), F.lit(1)).alias("root"), F.when(F.col("below").contains("/"), F.regexp_replace("below", "^[^/]*/", "")).otherwise(F.col("below")).alias("rel_path"), "size", "data")
    zipped = rows.where(extension(F.col("rel_path")) == ".zip")

    def members(data: bytes | None) -> list[dict] | None:
        try:
            return [{"name": n, "data": d} for n, d in unzip(data or b"")]
        except (ValueError, zipfile.BadZipFile):
            return None

    opened = zipped.select("root", F.explode(_udf(members, "array<struct<name:string,data:binary>>", pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())])), F.col("data"))).alias("m"))
    opened = opened.select("root", F.col("m.name").alias("rel_path"), F.octet_length("m.data").cast("long").alias("size"), F.col("m.data").alias("data"))
    both = rows.where(extension(F.col("rel_path")) != ".zip").unionByName(opened)
    return both.withColumn("ext", extension(F.col("rel_path"))).select("root", "rel_path", "ext", "size", "data")


def expand_inputs(main: DataFrame, parts: DataFrame) -> DataFrame:
    """main(root, rel_path, text) with its inputs inlined from parts(root, rel_path, text), by at most DEEPEST rounds of joins.

    A name is looked for beside the main file and one folder up; one that is not found stays as it stands.
    """
    now = main.withColumn("folder", F.regexp_replace("rel_path", "[^/]*$", ""))
    names = parts.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("rel_path", "text"))).alias("held"))
    now = now.join(names, "root", "left")
    command = r"\\(?:input|include)\{([^}]+)\}"
    for _ in range(DEEPEST):
        pieces, hits = F.split("text", command, -1), F.regexp_extract_all("text", F.lit(command), F.lit(1))

        def inlined(name: Column) -> Column:
            file = F.when(F.trim(name).endswith(".tex"), F.trim(name)).otherwise(F.concat(F.trim(name), F.lit(".tex")))
            here, above = F.concat("folder", file), F.concat(F.regexp_replace("folder", "[^/]*/$", ""), file)
            # What is not found keeps its command, marked so that it is not looked for again.
            return F.coalesce(F.try_element_at("held", here), F.try_element_at("held", above), F.concat(F.lit("\\input\u200b{"), name, F.lit("}")))

        joined = F.array_join(F.flatten(F.zip_with(pieces, F.transform(hits, inlined), lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")
        now = now.withColumn("text", F.when(F.size(hits) > 0, joined).otherwise(F.col("text")))
    return now.withColumn("text", F.replace("text", F.lit("\u200b{"), F.lit("{"))).drop("held", "folder")


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file or sub-folder of `path`: its main document as text, with bibliography, language and notes.

    The main document is LaTeX with a document class (main.tex before others, then the least deep, then
    the largest), else the first PDF, Word, Markdown or text file in that order.  Files that cannot be
    read here have a null text and a note.
    """
    all_ = files(spark, path)
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("ext")]
    typed = all_.withColumn("kind", kind)
    text = _udf(to_text, "string", pa.string(), F.col("data"), F.col("kind"))
    tex = typed.where("kind = 'latex'").withColumn("text", text).select("root", "rel_path", "size", "kind", "text")
    depth = F.size(F.split("rel_path", "/"))
    order = Window.partitionBy("root").orderBy((F.regexp_extract("rel_path", "[^/]*$", 0) != "main.tex"), depth, F.desc("size"), "rel_path")
    sole = Window.partitionBy("root")
    mains = tex.withColumn("n", F.count(F.lit(1)).over(sole)).where(F.col("text").contains("\\documentclass") | (F.col("root") == F.col("rel_path"))).withColumn("k", F.row_number().over(order)).where("k = 1").drop("n", "k", "size")
    latex = expand_inputs(mains, tex.select("root", "rel_path", "text"))
    rank = F.array_position(F.array(*map(F.lit, ("pdf", "docx", "markdown", "text"))), F.col("kind"))
    rest = typed.where((F.col("kind") != "latex")).join(mains.select("root"), "root", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(rank, "rel_path"))).where("k = 1")
    rest = rest.withColumn("text", text).select("root", "rel_path", "kind", "text")
    docs = latex.select("root", "rel_path", "kind", "text").unionByName(rest)

    bibs = all_.where(F.col("ext").isin(".bib", ".bbl")).select("root", F.col("rel_path").alias("bib_path"), "ext", F.decode("data", "UTF-8").alias("b"))
    named = F.transform(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\\(?:bibliography|addbibresource)\{([^}]+)\}"), F.lit(1)), lambda g: F.split(g, ","))), lambda n: F.regexp_replace(F.trim(n), r"\.bib$", ""))
    wanted = docs.where("kind = 'latex'").select("root", named.alias("named")).join(bibs, "root")
    stem = F.regexp_replace(F.regexp_extract("bib_path", "[^/]*$", 0), r"\.[^.]*$", "")
    graded = wanted.withColumn("grade", F.when((F.col("ext") == ".bib") & F.array_contains("named", stem), 0).when(F.col("ext") == ".bib", 1).otherwise(2))
    graded = graded.withColumn("best", F.min("grade").over(sole)).where("grade = best")
    bib = graded.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bib_path", "b"))), lambda x: x["b"]), "\n").alias("bib"))
    out = docs.join(bib, "root", "left").withColumn("text", T.normalize(F.col("text")))
    notes = F.when(F.col("text").isNull(), F.array(F.lit("This file cannot be read here; save it as .docx, .md, .txt or LaTeX."))).when(F.col("kind") == "pdf", F.array(F.lit(PDF_NOTE))).otherwise(F.array().cast("array<string>"))
    return out.select(F.xxhash64("root").alias("doc_id"), F.concat_ws("/", "root", "rel_path").alias("path"), "kind", "text", F.coalesce("bib", F.lit("")).alias("bib"), T.language(F.col("text")).alias("language"), notes.alias("notes"))


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, rel_path, ext, size, content): files of each manuscript's released package, as text.

    The package is the first of companion/, code/, the manuscript's folder, the folder above it and the companion/ there
    that holds results/; the folder above counts where the main file lies in a sub-folder of the manuscript's own.
    """
    rows = files(spark, path).where(F.col("rel_path").contains("/"))
    mains = manuscripts(spark, path).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), F.regexp_replace(F.regexp_replace("path", "^[^/]*/?", ""), "[^/]*$", "").alias("folder"))
    above = F.regexp_replace("folder", "[^/]*/$", "")
    places = F.array_distinct(F.array(F.concat("folder", F.lit("companion/")), F.concat("folder", F.lit("code/")), F.col("folder"), above, F.concat(above, F.lit("companion/")), F.lit("companion/"), F.lit("code/"), F.lit("")))
    near = mains.select("root", F.posexplode(places).alias("rank", "base"))
    holds = rows.join(near, "root").where(F.col("rel_path").startswith(F.concat("base", F.lit("results/"))))
    base = holds.groupBy("root").agg(F.min_by("base", "rank").alias("base"))
    mine = rows.join(base, "root").where(F.col("rel_path").startswith(F.col("base")))
    rel = F.substring(F.col("rel_path"), F.length("base") + 1, F.length("rel_path"))
    return mine.select(F.xxhash64("root").alias("doc_id"), rel.alias("rel_path"), "ext", "size", F.decode("data", "UTF-8").alias("content"))
