"""Document graphs: shared keywords, neighbours, isolated nodes, referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_links(keywords: DataFrame, key: str, groups: Sequence[str] = (), least: int = 2) -> DataFrame:
    """groups, source, target, shared_keywords, weight: documents of a group with enough common terms.

    keywords: groups, key, term, distinct.  Documents meet by term, never by a
    cross product; the weight is the Jaccard similarity, to 4 decimals.
    """
    g = list(groups)
    size = keywords.groupBy(*g, key).agg(F.count(F.lit(1)).alias("size"))
    k = keywords.join(size, [*g, key])
    a = k.select(*g, "term", F.col(key).alias("source"), F.col("size").alias("na"))
    b = k.select(*g, "term", F.col(key).alias("target"), F.col("size").alias("nb"))
    pairs = a.join(b, [*g, "term"]).filter("source < target").groupBy(*g, "source", "target", "na", "nb").agg(F.array_sort(F.collect_list("term")).alias("shared_keywords"))
    n = F.size("shared_keywords")
    return pairs.filter(n >= least).select(*g, "source", "target", "shared_keywords", F.round(n / (F.col("na") + F.col("nb") - n), 4).alias("weight"))


def nodes(documents: DataFrame, keywords: DataFrame, key: str, top_n: int = 5) -> DataFrame:
    """documents with their first keywords; keywords: key, term, rank."""
    head = keywords.filter(F.col("rank") <= top_n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("top_keywords"))
    return documents.join(head, key, "left")


def neighbours(links: DataFrame) -> DataFrame:
    """node, neighbour: both directions, and each linked node itself."""
    both = links.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).union(links.select(F.col("target").alias("node"), F.col("source").alias("neighbour")))
    return both.union(both.select("node", F.col("node").alias("neighbour"))).distinct()


def isolated(node_ids: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """Nodes in no link."""
    ends = links.select(F.col("source").alias(key)).union(links.select(F.col("target").alias(key)))
    return node_ids.join(ends, key, "left_anti")


def broken_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows that point at nothing; a null pointer points at nothing."""
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the table's columns, and whether they were found."""
    return rows.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def incremental(previous: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, status: new, changed, reused or removed, by comparing fingerprints."""
    a = previous.select(key, F.col(fingerprint).alias("before"), F.lit(1).alias("had"))
    b = current.select(key, F.col(fingerprint).alias("after"), F.lit(1).alias("has"))
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "reused").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def indexed_status(files: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """key, status: whether a file is among the indexed ones."""
    marks = indexed.select(key).distinct().withColumn("hit", F.lit(1))
    return files.select(key).distinct().join(marks, key, "left").select(key, F.when(F.col("hit").isNull(), "unindexed").otherwise("indexed").alias("status"))


def upload_status(files: DataFrame, known: DataFrame, name: str, kind: str, size: str, types: tuple[str, ...] = ("pdf", "txt", "md", "csv"), most: int = 100_000_000) -> DataFrame:
    """files with status: why a file may not be added (no name, its type, its size, a file of that name), or accepted; known: name."""
    marks = known.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("_known", F.lit(True))
    bad = ~F.coalesce(F.col(kind).isin(list(types)), F.lit(False))
    status = F.when(F.col(name).isNull(), "no name").when(bad, "type not allowed").when(F.col(size) > most, "too large").when(F.col("_known"), "exists").otherwise("accepted")
    return files.join(marks, name, "left").withColumn("status", status).drop("_known")


def merged_sets(df: DataFrame, keys: list[str], value: str, members: str) -> DataFrame:
    """keys, value (sorted distinct values), members (sorted union of the arrays) of each key."""
    values = df.select(*keys, value).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(value))
    each = df.select(*keys, F.explode_outer(members).alias(members)).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(members)).alias(members))
    same = [values[k].eqNullSafe(each[k]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return values.join(each, on).select(*[values[k] for k in keys], value, members)
