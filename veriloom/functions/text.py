"""Text expressions that stay in the JVM: flavours of a manuscript, sentence splitting, and matches with their places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def sub(text: Column, *rules: tuple[str, str]) -> Column:
    """Rewrites applied in order; replacements use $1."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def strip_comments(text: Column) -> Column:
    return sub(text, (P.COMMENT, ""))


def _from_begin(bare: Column) -> Column:
    at = F.locate("\\begin{document}", bare)
    return F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise(bare)


def body_text(text: Column) -> Column:
    """From the begin of the document on, without comments."""
    return _from_begin(strip_comments(text))


def claim_plain(text: Column) -> Column:
    return sub(text, *P.CLAIM_PLAIN)


def change_prose(text: Column) -> Column:
    """Body without tabulars, percent signs and typesetting made plain."""
    return sub(sub(body_text(text), (P.TABULAR_STRICT, " ")), *P.CHANGE_PLAIN)


def count_plain(text: Column) -> Column:
    return sub(body_text(text), *P.COUNT_PLAIN)


def stat_plain(text: Column) -> Column:
    return sub(text, *P.STAT_PLAIN)


def hygiene_lines(text: Column) -> Column:
    return sub(body_text(text), (r"\\%", "%"))


def statement_flat(text: Column) -> Column:
    return sub(text, (r"\\%", "%"), (r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Full-width digits and punctuation as ASCII."""
    ones, longer = P.FULL_WIDTH_ONE, P.FULL_WIDTH_LONG
    out = F.translate(text, "".join(ones), "".join(ones.values()))
    for a, b in longer.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_percent(text: Column) -> Column:
    return sub(text, (r"(?<!\\)%", r"\\%"))


def language(text: Column) -> Column:
    """zh where CJK characters are more than 200 and more than 5 % of all."""
    cjk = F.regexp_count(text, F.lit("[一-鿿]"))
    return F.when(cjk > F.greatest(F.lit(200.0), 0.05 * F.length(text)), "zh").otherwise("en")


def label_key(cell: Column) -> Column:
    """A table label or a sentence as lower-case words with single spaces."""
    text = sub(cell, (P.TEXT_COMMAND, "$1"), (P.ANY_COMMAND, " "))
    return F.trim(sub(F.lower(text), ("[^a-z0-9+\\-一-鿿]+", " ")))


def decimals_in(fragment: Column) -> Column:
    """Decimals as text, after lengths and column widths are taken out."""
    return F.regexp_extract_all(sub(fragment, *P.TYPOGRAPHY), F.lit(P.DECIMAL), F.lit(0))


def display(text: Column) -> Column:
    """LaTeX source made readable for a quote."""
    return F.trim(sub(text, *P.DISPLAY))


def found(text: Column, pattern: str | Column, groups: Sequence[str] = (), inner: str | None = None) -> Column:
    """array<struct<start, end, raw, groups...>>: all matches with places from 0.

    Places follow from the pieces between matches, so matches must not be empty.  Groups are taken from
    each match by itself; `inner` is the pattern for that where `pattern` looks beyond the match.
    """
    pieces = F.split(text, pattern, -1)
    raw = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,raw:string>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        a = s["at"] + F.length(z["piece"])
        b = a + F.length(z["raw"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("start"), b.alias("end"), z["raw"].alias("raw")))).alias("out"))

    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(raw)), raw, lambda p, m: F.struct(p.alias("piece"), m.alias("raw")))
    placed = F.aggregate(zipped, start, step)["out"]
    if not groups:
        return placed
    each = [F.lit(inner or pattern)]
    return F.transform(placed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"), *(F.regexp_extract(m["raw"], inner or pattern, i + 1).alias(g) for i, g in enumerate(groups)))) if each else placed


def matches(text: Column, pattern: str, groups: Sequence[str], inner: str | None = None) -> Column:
    """array<struct<raw, groups...>>: all matches without places."""
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(raw, lambda m: F.struct(m.alias("raw"), *(F.regexp_extract(m, inner or pattern, i + 1).alias(g) for i, g in enumerate(groups))))


#: Forms of a manuscript that several checks read, each from one that stands before it.
FLAVOURS = {"bare": ("text", strip_comments), "body": ("bare", lambda t: _from_begin(t)), "count": ("body", lambda t: sub(t, *P.COUNT_PLAIN)), "lines": ("body", lambda t: sub(t, (r"\\%", "%"))), "stat": ("text", stat_plain), "change": ("body", lambda t: sub(sub(t, (P.TABULAR_STRICT, " ")), *P.CHANGE_PLAIN))}


def prepared(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Manuscripts dealt by doc_id once, with their flavours as columns, for many checks to read; to be persisted.

    All that checks group or join by is a document's own, so nothing is dealt again.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = docs.repartition(n, "doc_id")
    for name, (source, of) in FLAVOURS.items():
        out = settled(out, **{f"flavour_{name}": of(F.col(source if source == "text" else f"flavour_{source}"))})
    return out


def flavour(docs: DataFrame, name: str, *keep: str) -> DataFrame:
    """(doc_id, kept columns, t): a flavour of each manuscript, as prepared or else made here, once."""
    if f"flavour_{name}" in docs.columns:
        return docs.select("doc_id", *keep, F.col(f"flavour_{name}").alias("t"))
    chain = [name]
    while FLAVOURS[chain[-1]][0] != "text":
        chain.append(FLAVOURS[chain[-1]][0])
    out = docs.select("doc_id", *keep, F.col("text").alias("t")) if "text" not in keep else docs.select("doc_id", *keep).withColumn("t", F.col("text"))
    for step in reversed(chain):
        out = settled(out.withColumnRenamed("t", "__before"), t=FLAVOURS[step][1](F.col("__before"))).drop("__before")
    return out


def sentences(texts: DataFrame, splitter: str) -> DataFrame:
    """(doc_id, pos, s): one row per sentence of texts(doc_id, t)."""
    return each(texts, F.split("t", splitter, -1), "pos", "s", "doc_id")


def each(df: DataFrame, array: Column, pos: str, item: str, *keep: str) -> DataFrame:
    """One row for each element of an array that is computed once.

    Where an array is exploded straight away, the optimiser adds a filter on its size, and computes it twice.
    """
    made = settled(df, each_of=array)
    return made.select(*(keep or df.columns), F.posexplode("each_of").alias(pos, item))


def window_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] for places from 0, cut at the text's begin."""
    a = F.greatest(start, F.lit(0))
    return F.substring(text, a + 1, F.greatest(end - a, F.lit(0)))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns whose values are computed once.

    A projection that is used several times may be merged into its uses and computed for each; what a
    generator makes is not.
    """
    names = [x for n, c in columns.items() for x in (F.lit(n), c)]
    return df.select("*", F.inline(F.array(F.named_struct(*names))))
