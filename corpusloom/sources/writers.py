"""Sinks: tables, JSON documents, reports and pages."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tables(frames: dict[str, DataFrame], folder: str, kinds: Sequence[str] = ("parquet",)) -> dict[str, str]:
    """Each non-empty frame in each format (csv, json, parquet); what was done by name."""
    done = {}
    for name, df in frames.items():
        if df.isEmpty():
            done[name] = "empty"
            continue
        for kind in kinds:
            w = df.write.mode("overwrite")
            (w.option("header", True).csv if kind == "csv" else getattr(w, kind))(f"{folder}/{name}.{kind}")
        done[name] = "written"
    return done


def json_document(df: DataFrame, name: str = "rows") -> DataFrame:
    """One row with a JSON document of all rows, for small results."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(name))).alias("document"))


def parts(df: DataFrame, folder: str, rows: int = 15_000) -> None:
    """CSV files of at most so many rows."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(folder)


def metrics(row: DataFrame) -> DataFrame:
    """metric, value of a frame of one row."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("m")).select("m.*")


def annotation_lines(df: DataFrame) -> DataFrame:
    """value: annotations as text, grouped by source, in order of paragraph; df: source, para_idx, quote, note."""
    one = F.concat(F.lit("["), F.col("para_idx").cast("string"), F.lit("] "), F.coalesce("quote", F.lit("")), F.lit("\n    "), F.coalesce("note", F.lit("")))
    x = df.select("source", F.struct("para_idx", one.alias("line")).alias("s"))
    return x.groupBy("source").agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.concat(F.lit("## "), "source", F.lit("\n"), F.array_join(F.transform("s", lambda s: s["line"]), "\n")).alias("value"))


def correction_lines(df: DataFrame) -> DataFrame:
    """value: corrections as readable text."""
    return df.orderBy("correction_id").select(F.concat(F.lit("Q: "), "question", F.lit("\nwrong: "), F.coalesce("wrong_answer", F.lit("")), F.lit("\nright: "), F.coalesce("correct_answer", F.lit("")), F.lit("\n")).alias("value"))


def publish(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version of a table and point CURRENT at it; readers never see a half-written one."""
    df.write.mode("error").parquet(f"{folder}/{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{folder}/CURRENT")
    return f"{folder}/{version}"


def merged(base: dict, over: dict) -> dict:
    """Settings laid over others, through all levels."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def warnings(nodes: list[dict], links: list[dict], timeline: list[dict]) -> list[str]:
    """What is wrong with a graph: nodes without id or label, links and events that point at nothing."""
    ids = {n.get("id") for n in nodes}
    out = [f"node {i} has no {k}" for i, n in enumerate(nodes) for k in ("id", "label") if not n.get(k)]
    out += [f"link {x.get('source')} - {x.get('target')} has an unknown end" for x in links if x.get("source") not in ids or x.get("target") not in ids]
    return out + [f"event {e.get('id')} belongs to no node" for e in timeline if e.get("doc_id") not in ids]


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><div id="root"></div>
<script id="data" type="application/json">{data}</script><script>
const d = JSON.parse(document.getElementById("data").textContent), root = document.getElementById("root");
for (const [name, rows] of Object.entries(d)) {{ if (!Array.isArray(rows)) continue; const h = document.createElement("h2"); h.textContent = name + " (" + rows.length + ")"; root.append(h);
  const pre = document.createElement("pre"); pre.textContent = rows.map(r => JSON.stringify(r)).join("\\n"); root.append(pre); }}
</script></body></html>"""


def page(data: dict, title: str, path: str) -> str:
    """A page that holds a small result as JSON, safe inside a script element."""
    Path(path).write_text(_PAGE.format(title=html.escape(title), data=json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/")), encoding="utf-8")
    return path


def rows_of(df: DataFrame, most: int = 5000) -> list[dict]:
    """The rows of a result small enough for a page; a larger one is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows don't fit a page")
    return [r.asDict(recursive=True) for r in rows]


def chat_log(messages: DataFrame, folder: str, stamp: str) -> str:
    """Messages (role, content) as a log chat_<stamp>.json, one JSON object a line."""
    path = f"{folder}/chat_{stamp}.json"
    messages.select("role", "content").write.mode("error").json(path)
    return path


def converted(docs: DataFrame, folder: str) -> DataFrame:
    """path, target, error of read documents, each text written as a file name.md in a folder; a file per document, by its worker.

    docs: path, text, error, as from readers.documents(); those that couldn't be read are reported and skipped.
    """

    def work(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for x in batches:
            targets = []
            for path, text in zip(x["path"], x["text"]):
                target = None
                if text is not None:
                    target = f"{folder}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.md"
                    Path(target).write_text(text, encoding="utf-8")
                targets.append(target)
            yield x[["path", "error"]].assign(target=targets)[["path", "target", "error"]]

    return docs.select("path", "text", "error").mapInPandas(work, "path string, target string, error string")


def site(nodes: list[dict], sources: dict[str, str], folder: str) -> tuple[list[dict], list[str]]:
    """A page for each node with a source; (nodes with detail_url, ids without a source)."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out, missing = [], []
    for n in nodes:
        text = sources.get(n["id"])
        if text is None:
            missing.append(n["id"])
            out.append(n)
            continue
        page({"paragraphs": [{"index": i, "text": p} for i, p in enumerate(text.split("\n\n"))]}, str(n.get("label") or n["id"]), f"{folder}/{n['id']}.html")
        out.append(n | {"detail_url": f"{n['id']}.html"})
    return out, missing
