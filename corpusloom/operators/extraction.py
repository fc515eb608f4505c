"""Dates, citations and timelines taken from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def dates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i, start, end, kind: ranges in order of appearance, then single years; years in citations don't count."""
    # Texts without a year are most; they are left out before the costly patterns.
    found = df.filter(F.col(text).rlike(T.PLAIN_YEAR)).select(key, T.year_ranges(F.col(text)).alias("r"), T.years(F.col(text)).alias("y"))
    r = F.transform("r", lambda p: F.struct(p["s"].alias("start"), p["e"].alias("end"), F.lit("range").alias("kind")))
    s = F.transform(T.single_years(F.col("y"), F.col("r")), lambda y: F.struct(y.alias("start"), F.lit(None).cast("int").alias("end"), F.lit("single").alias("kind")))
    return found.select(key, F.posexplode(F.concat(r, s)).alias("i", "d")).select(key, "i", "d.start", "d.end", "d.kind")


def timeline(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """event_id, key, start, end, kind, in order of start."""
    d = dates(df, key, text)
    return d.select(F.concat(F.col(key).cast("string"), F.lit("-date"), F.col("i").cast("string")).alias("event_id"), key, "start", "end", "kind").orderBy("start", key, "event_id")


def ticks(events: DataFrame, step: int = 25, padding: float = 0.0, empty: tuple[int, int] = (1900, 2000)) -> DataFrame:
    """tick: the axis of a timeline from its extent."""
    x = events.agg(F.min("start").alias("lo"), F.max(F.coalesce("end", "start")).alias("hi"))
    lo, hi = F.coalesce("lo", F.lit(empty[0])) - padding, F.coalesce("hi", F.lit(empty[1])) + padding
    first = (F.ceil(lo / step) * step).cast("int")
    last = F.floor(hi).cast("int")
    return x.select(F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))).alias("tick"))


def citations(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 25) -> DataFrame:
    """key, i, citation: distinct citations in order of appearance."""
    return df.select(key, F.posexplode(T.citations(F.col(text), most)).alias("i", "citation"))


def paragraph_citations(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, para, i, citation: all citations of each paragraph."""
    return paras.select(key, "para", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(f"({T.CITATION})"), F.lit(1))).alias("i", "citation"))


def notes(paras: DataFrame, key: str = "doc_id", width: int = 130) -> DataFrame:
    """key, para, i, ref, author, year, fraction, context: citations in parentheses with their place; paras: key, para, text."""
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col("text"), F.lit(f"({T.NOTE})"), F.lit(g)).alias(n) for g, n in ((1, "ref"), (2, "author"), (3, "year"))])
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    x = paras.select(key, "para", "text", n.alias("n")).select(key, "para", "text", "n", F.posexplode(parts).alias("i", "c"))
    return x.select(key, "para", "i", "c.ref", "c.author", "c.year", F.round(F.col("para") / F.col("n"), 4).alias("fraction"), F.concat(F.substring(T.strip(F.col("text")), 1, width), F.lit("…")).alias("context"))
