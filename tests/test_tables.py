"""Tabular, graph, retrieval, memory, learning, stream operators, sources and sinks on literals."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import graph as G
from corpusloom.operators import learning as L
from corpusloom.operators import memory as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import tabular as B
from corpusloom.sources import readers, writers
from corpusloom.streaming import windows as W


@pytest.fixture(scope="module")
def staff(spark):
    rows = [("a", "x", 1, 2.0), ("b", "x", 2, None), ("c", None, 2, 4.0), ("d", "y", None, 4.0)]
    return spark.createDataFrame(rows, "name string, dept string, age int, pay double")


def test_profile_matches_pandas(staff):
    pdf = staff.toPandas()
    got = {r["column"]: r for r in B.describe(staff).collect()}
    for c in ("age", "pay"):
        want = pdf[c].describe()
        for a, b in zip(("count", "mean", "std", "min", "p25", "p50", "p75", "max"), want):
            assert got[c][a] == pytest.approx(b)
    assert {(r["column"], r["nulls"]) for r in B.nulls(staff).collect()} == {("name", 0), ("dept", 1), ("age", 1), ("pay", 1)}
    assert B.describe(staff.limit(0)).count() == 2


def test_groups_modes_and_ranks(staff):
    assert {r["dept"]: r["count"] for r in B.group_stats(staff, ["dept"], "pay").collect()} == {"x": 1, "y": 1}
    assert B.mode(staff, "pay").first()[0] == 4.0
    ranks = {r["name"]: r["r"] for r in staff.select("name", B.average_rank(staff, [], "pay").alias("r")).collect()}
    assert ranks["c"] == ranks["d"] == 1.5 and ranks["a"] == 3
    tied = {r["pay"]: (r["rank"], r["percent"]) for r in B.ranked_counts(staff, "pay").collect()}
    assert tied == {2.0: (3.0, pytest.approx(100 / 3, abs=1e-5)), 4.0: (1.5, pytest.approx(250 / 3, abs=1e-5))}
    assert B.not_in(staff, "dept", ["x"]).count() == 2
    assert {r["dept"]: r["code"] for r in B.codes(staff, "dept").select("dept", "code").distinct().collect()} == {"x": 0, "y": 1, None: -1}


def test_crosstab_margins(staff):
    got = {r["dept"]: r.asDict() for r in B.crosstab(staff, "dept", "age", [1, 2]).collect()}
    assert got["All"]["All"] == 2 and got["x"]["1"] == 1 and got["x"]["2"] == 1


def test_parts_samples_and_splits(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert sorted(r["n"] for r in B.numbered_parts(df, "k", 30).groupBy("part").agg(F.count("*").alias("n")).collect()) == [10, 30, 30, 30]
    assert B.sample(df, "k", 7).collect() == B.sample(df.repartition(5), "k", 7).collect()
    assert {r["part"] for r in B.split(df, "k").collect()} == {"train", "test"}


def test_links_and_neighbours(spark):
    kw = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("b", "y"), ("c", "x")], "id string, term string")
    links = G.keyword_links(kw, "id")
    assert [tuple(r) for r in links.collect()] == [("a", "b", ["x", "y"], 0.6667)]
    ids = kw.select("id").distinct()
    assert [r[0] for r in G.isolated(ids, links).collect()] == ["c"]
    assert {(r[0], r[1]) for r in G.neighbours(links).collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}
    assert G.keyword_links(kw.limit(0), "id").count() == 0
    before = spark.createDataFrame([(1, "f"), (2, "g"), (3, None)], "k int, f string")
    after = spark.createDataFrame([(2, "h"), (3, None), (4, "i")], "k int, f string")
    assert {r["k"]: r["status"] for r in G.incremental(before, after, "k", "f").collect()} == {1: "removed", 2: "changed", 3: "reused", 4: "new"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-3.0, -4.0]), (4, None), (5, [1.0])], "k int, vec array<float>")
    got = {r["k"]: r["s"] for r in df.select("k", R.scores(df, [3.0, 4.0]).alias("s")).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0, 4: None, 5: None}
    assert [r["k"] for r in R.top_k(df, [3.0, 4.0], "k", 3, 0.3).collect()] == [1]
    u = df.filter("k in (1, 2)").select("k", V.unit(F.col("vec")).alias("u")).orderBy("k").collect()
    assert u[0]["u"] == pytest.approx([0.6, 0.8]) and u[1]["u"] == [0.0, 0.0]


def test_chunkers(spark):
    text = "One two three. " * 60
    pieces = R.recursive_split(text, 100, 20)
    assert all(len(p) <= 100 for p in pieces) and "".join(pieces).count("One") >= 60
    assert R.recursive_split("x" * 1200, 500, 50)[0] == "x" * 500
    assert R.packed_sentences("too short") == [] and len(R.packed_sentences("One two three four five six. " * 60)) == 2
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in R.recursive_chunks(df, ["doc_id"]).collect()} == {1}
    e = R.embed(df).select("vec").collect()
    assert np.linalg.norm(e[0]["vec"]) == pytest.approx(1, abs=1e-5) and not any(e[1]["vec"])


def test_feedback(spark):
    rows = [(1, "p", "t", "in", "out", "fin", "accept"), (2, "p", "t", "in", "out", "fin2", "edit"), (3, "p", "t", "in2", "o", "", "accept"), (4, "p", "t", "in3", "o", None, "reject"), (5, "p", "", "i", "o", "f", "accept"), (6, "p", "t", "i", "o", "f", None)]
    df = spark.createDataFrame(rows, "id long, project string, task string, input_text string, output_text string, final_text string, action string").withColumn("vec", F.array().cast("array<float>"))
    good, bad = M.record(df)
    assert {r["id"] for r in good.collect()} == {1, 2, 4} and bad.count() == 3
    assert [(r["text"], r["edited"]) for r in M.overrides(good).collect()] == [("fin2", True)]
    assert [r["id"] for r in M.examples(good, "p", "t", "none").collect()] == [2, 1]


def test_answers(spark):
    q = spark.createDataFrame([(1, "q1", [1.0, 0.0]), (2, "q2", [0.0, 1.0]), (3, "q3", [-1.0, 0.0])], "question_id long, question string, vec array<float>")
    corrections = spark.createDataFrame([([1.0, 0.01], "known")], "question_embedding array<float>, correct_answer string")
    chunks = spark.createDataFrame([([0.1, 1.0], "passage")], "vec array<float>, text string")
    model = lambda x: x.withColumn("answer", F.coalesce("context", F.lit("guess"))).withColumn("verdict", F.when(F.col("context").isNotNull(), "YES").otherwise("NO"))
    got = {r["question_id"]: (r["answer"], r["path"]) for r in M.answer(q, corrections, chunks, model).collect()}
    assert got[1] == ("known", ["memory"]) and got[2] == ("[1] passage", ["retrieval"])
    assert got[3] == ("guess", ["model", "retry 1", "retry 2", "unverified"])


def test_nearest_equals_pairwise_cosines(spark, monkeypatch):
    rng = random.Random(5)
    v = lambda d=4: [float(round(rng.gauss(0, 1), 1)) for _ in range(d)]
    rows = [(v(), f"t{rng.randrange(40):02}") for _ in range(300)]
    rows += rows[:60] + [(x, "a" + t) for x, t in rows[:60]] + [(x, None) for x, _ in rows[:5]]
    rows += [([0.0] * 4, "zero"), ([1.0, None, 0.0, 0.0], "gap"), ([float("nan"), 0.0, 0.0, 1.0], "nan"), (v(3), "short"), ([], "empty"), (None, "none")]
    asked = [(i, x) for i, (x, _) in enumerate(rows[::9])] + [(0, v()), (901, [0.0] * 4), (902, v(3)), (903, None), (904, [None] * 4), (905, [])]
    table = spark.createDataFrame(rows, "vec array<float>, text string").repartition(3)
    q = spark.createDataFrame(asked, "question_id long, qv array<float>")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "text")
    for asked_at_once in (20_000, 11):
        monkeypatch.setattr(R, "ASKED", asked_at_once)
        for n, least in ((1, 0.85), (3, 0.3), (4, 0.0)):
            want = table.crossJoin(q).withColumn("score", V.cosine(F.col("vec"), F.col("qv"))).filter(F.col("score") >= least).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
            key = lambda x: sorted(map(str, x.select("question_id", "score", "text", "r").collect()))
            assert key(R.nearest(q, table, "vec", ["text"], n, least)) == key(want)


def test_hits_are_the_best_whatever_the_blocks(monkeypatch):
    monkeypatch.setattr(R, "STEP", 7)
    monkeypatch.setattr(R, "HELD", 20)
    x, y = (np.random.default_rng(s).normal(size=(n, 3)).round(1) for s, n in ((1, 400), (2, 30)))
    hits = R._Hits(y, 3, 0.2)
    for i in range(0, 400, 50):
        hits.add(x[i : i + 50], pa.RecordBatch.from_arrays([pa.array(range(i, i + 50))], ["row"]))
    got = sorted((int(c), s, r) for a, b, rows in hits.hits() for c, s, r in zip(a, b, rows.column(0).to_pylist()))
    every = np.array([R._cosines(x, np.repeat(v[None], 400, axis=0)) for v in y])
    want = sorted((c, s, r) for c in range(30) for r, s in enumerate(every[c]) if s >= max(0.2, np.sort(every[c])[-3]))
    assert [(c, float(s), r) for c, s, r in got] == [(c, float(s), r) for c, s, r in want]


def test_answers_compare_blocks_of_vectors(spark):
    got = R.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, qv array<float>"), spark.createDataFrame([([1.0, 0.5], "x")], "vec array<float>, text string"), "vec", ["text"], 1, 0.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert [(r["question_id"], r["text"]) for r in got.collect()] == [(1, "x")]


def test_characters(spark):
    rows = [("p", "Ann Lee", 5, 0, [1]), ("p", "Bo Lee", 4, 0, [2, 1]), ("p", "Lee", 9, 0, None), ("p", "Ann", 3, None, [3]), ("p", "Mark", 3, 9, [1]), ("p", None, 9, 0, [1]), ("q", "Mrs Lee", 3, 0, [4]), ("q", "Mr Lee", 4, 0, [4]), ("q", "Lee", 1, 0, [5])]
    df = spark.createDataFrame([(p, t, "PERSON", n, low, q) for p, t, n, low, q in rows], "project string, text string, label string, mention_count int, lower_count int, paras array<int>")
    got = {(r["project"], r["canonical"]): r for r in L.project_characters(df).collect()}
    assert set(got) == {("p", "Ann Lee"), ("p", "Bo Lee"), ("p", "Lee"), ("q", "Mr Lee"), ("q", "Mrs Lee")}
    ann = got["p", "Ann Lee"]
    assert (ann["count"], ann["paras"], ann["tokens"], [tuple(a) for a in ann["aliases"]]) == (8, [1, 3], ["ann", "lee"], [("Ann Lee", 5), ("Ann", 3)])
    assert got["p", "Lee"]["ambiguous"] and got["p", "Lee"]["candidates"] == ["Ann Lee", "Bo Lee"]
    assert got["q", "Mr Lee"]["count"] == 5 and got["q", "Mrs Lee"]["gender"] == "f"
    assert L.project_characters(df.limit(0)).count() == 0


@pytest.mark.parametrize("a, b, others, yes", [(["ann", "lee"], ["ann", "lee", "may"], [], True), (["ann", "lee"], ["ann", "ray"], [], False), (["ann"], ["ann", "ray"], [["ann", "lee"]], True), (["kit"], ["ann", "ray"], [], True), (["kit"], ["ann", "ray"], [["kit", "lee"]], False)])
def test_merges_that_are_possible(a, b, others, yes):
    assert L.may_merge(a, b, others) is yes


def test_decisions_on_characters():
    c = lambda name, freq, *tokens: {"name": name, "aliases": [name], "freq": freq, "paras": [freq], "tokens": list(tokens), "ambiguous": False}
    got = L.decided_characters([c("Ann Lee", 10, "ann", "lee"), c("Bo Ray", 6, "bo", "ray"), c("Ann", 3, "ann"), c("Table", 2, "table")], {"merge": [[1, 3], [1, 2], "x", [9, 1]], "discard": [4, 2, "1"], "descriptions": {"1": "'a reader'", "2": "x" * 161, "9": "y"}})
    assert [(x["name"], x["freq"], x["desc"]) for x in got] == [("Ann Lee", 13, "a reader"), ("Bo Ray", 6, "")] and got[0]["paras"] == [3, 10]
    assert L.decided_characters([], {"discard": None}) == []


def test_topics(spark):
    pieces = ["red apple fruit garden " * 3, "apple fruit tree garden " * 3, "engine wheel motor road " * 3, "motor engine road car " * 3, "wheel car motor road " * 2, ""]
    df = spark.createDataFrame([(1, i, 0, p) for i, p in enumerate(pieces)] + [(2, 0, 0, "too short"), (3, 0, 0, None)], "doc_id long, para int, piece int, chunk string")
    found = L.document_topics(df).collect()
    assert {r["doc_id"] for r in found} == {1} and found == sorted(found, key=lambda r: -r["share"])
    assert any({"engine", "motor", "road"} <= set(r["words"]) and r["paras"][0] in (2, 3, 4) for r in found) and sum(r["share"] for r in found) == pytest.approx(1, abs=0.01)
    assert all(r["weights"] == sorted(r["weights"], reverse=True) for r in found)
    words = spark.createDataFrame([(1, w, 5) for w in "engine motor road wheel car".split()], "doc_id long, word string, freq long")
    known = L.known_topics(L.document_topics(df), words).collect()
    assert known and all(set(r["related"]) <= {"engine", "motor", "road", "wheel", "car"} and r["freq"] == 5 * len(r["related"]) for r in known)
    said = spark.createDataFrame([(1, '{"clusters":[{"name":"Cars","related":["engine","unicorn","road"]},{"name":"None","related":["unicorn"]}]}'), (1, "no JSON"), (2, None)], "doc_id long, answer string")
    assert [tuple(r) for r in L.proposed_topics(said, words).collect()] == [(1, "Cars", "engine", ["engine", "road"], 10)]
    assert L.document_topics(df.limit(0)).count() == 0


def test_factors_are_those_of_the_matrix():
    rng = np.random.default_rng(0)
    a, b = np.abs(rng.normal(size=(12, 3))), np.abs(rng.normal(size=(9, 3)))
    x = a @ b.T
    i, j = np.nonzero(x)
    w, h = L.nmf(L.Sparse(i, j, x[i, j]), 3)
    assert (w >= 0).all() and (h >= 0).all() and np.linalg.norm(x - w @ h.T) < 0.05 * np.linalg.norm(x)


def test_regression_finds_its_formula(spark):
    df = readers.housing(spark, 2000)
    fit = {r["feature"]: r["coefficient"] for r in L.linear_fit(df, ["sqft", "bedrooms", "age", "distance_km"], "price").collect()}
    assert fit["sqft"] == pytest.approx(100, rel=0.05) and fit["distance_km"] == pytest.approx(-2000, rel=0.1)
    scaled = L.standardise(df.select("sqft", F.lit(1.0).alias("flat")), ["sqft", "flat"]).toPandas()
    assert scaled["sqft"].std(ddof=0) == pytest.approx(1) and (scaled["flat"] == 0).all()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(48)]
    df = spark.createDataFrame(rows, W.EVENTS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = W.drain(W.tumbling(W.stream(spark, str(tmp_path / "in"), files_per_batch=10), late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    done = {tuple(r) for r in live.collect()}
    assert done <= {tuple(r) for r in W.tumbling(df).collect()}
    assert W.sessions(df, "2 hours").count() == 48 and W.sessions(df, "3 hours").count() == 3
    assert W.sliding(df).agg(F.sum("n")).first()[0] == 96


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("h\xe9".encode("cp1252"))
    (tmp_path / "b.html").write_text("<html><script>x</script><p>One&amp;two</p><nav>no</nav><div>three</div></html>")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "hé" and got["b.html"]["text"] == "One&two\n\nthree"
    assert "unsupported" in got["c.xyz"]["error"] and got["d.pdf"]["error"] and got["d.pdf"]["text"] is None
    assert {r["name"] for r in readers.files(spark, str(tmp_path)).collect()} == {"a.txt", "d.pdf"}
    assert readers.manifest(readers.documents(spark, str(tmp_path))).count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.md").write_text("# Hi\n```\ncode\n```\n*there*")
    assert readers.markdown(spark, str(tmp_path / "m")).first()["text"] == "Hi there"
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    table = readers.csv(spark, str(tmp_path / "t.csv"), ";")
    assert {r["text"] for r in readers.rows_as_documents(table).collect()} == {"a: 1\nb: x", "a: 2\nb: y"}
    (tmp_path / "w.list").write_text("# c\nThe\n\nand\n")
    assert readers.stopwords(spark, str(tmp_path / "w.list")) == ["and", "the"]
    assert len(readers.language_stopwords("french")) > 100 and readers.language_stopwords("xx") == readers.language_stopwords("english")
    (tmp_path / "log").mkdir()
    for day in ("1", "2"):
        (tmp_path / "log" / f"chat_{day}.json").write_text(json.dumps([{"role": "user", "content": day}]))
    assert [r["content"] for r in readers.latest_log(spark, str(tmp_path / "log")).collect()] == ["2"]


def test_writers(spark, tmp_path, staff):
    assert writers.tables({"s": staff, "none": staff.limit(0)}, str(tmp_path), ("csv", "json", "parquet")) == {"s": "written", "none": "empty"}
    assert json.loads(writers.json_document(staff.select("name").orderBy("name")).first()[0])["rows"][0] == {"name": "a"}
    writers.publish(staff, str(tmp_path / "t"), "v1")
    assert spark.read.text(str(tmp_path / "t/CURRENT")).first()[0] == "v1"
    path = writers.page({"rows": [{"a": "</script>"}]}, "t<", str(tmp_path / "p.html"))
    assert "</script>\"" not in open(path).read() and "t&lt;" in open(path).read()
    assert writers.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert writers.warnings([{"id": 1}], [{"source": 1, "target": 2}], [{"id": "e", "doc_id": 3}]) and not writers.warnings([{"id": 1, "label": "x"}], [], [])
    nodes, missing = writers.site([{"id": "a", "label": "A"}, {"id": "b"}], {"a": "x\n\ny"}, str(tmp_path / "site"))
    assert nodes[0]["detail_url"] == "a.html" and missing == ["b"]
    notes = spark.createDataFrame([("s", 2, "q", "n"), ("s", 1, None, "m")], "source string, para_idx int, quote string, note string")
    assert writers.annotation_lines(notes).first()[0].startswith("## s\n[1] ")
    assert writers.metrics(staff.agg(F.count("*").alias("n"))).first()["value"] == "4"


def test_best_match_compares_all_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_300, 8)).astype(np.float32)
    label = np.where(np.arange(len(x)) < 1_700, "a", np.where(np.arange(len(x)) < 3_280, "b", "c"))
    df = spark.createDataFrame([(int(i), str(g), v.tolist()) for i, (g, v) in enumerate(zip(label, x))], "id long, g string, v array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        s = unit[label == a] @ unit[label == b].T
        want[a, b] = pytest.approx((s.max(axis=1).mean() + s.max(axis=0).mean()) / 2, abs=6e-5)
    assert {(r["a"], r["b"]): r["score"] for r in R.best_match(df, "g", "id", "v").collect()} == want
    pair = spark.createDataFrame([("c", "a")], "a string, b string")
    assert [r["score"] for r in R.best_match(df, "g", "id", "v", pairs=pair).collect()] == [want["a", "c"]]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<table><tr><th>City</th><td>Paris</td><td>1900</td></tr></table>", "City\n\nParis\n\n1900"), ("a<!-- <p> -->b<br>c", "ab\n\nc"), ("<nav><nav>x</nav>y</nav>z", "z"), ("<script>if (a<b) {'</p>'}</script>t", "t"),
        ("<svg/>t<form>u", "t"), ("1 < 2 &lt;p&gt; <b>x</b>y", "1 < 2 <p> xy"), ("", ""), ("<p title='a>b'>c", "c"), ("</nav>t", "t"),
    ],
)
def test_html(page, want):
    assert readers.html_text(page) == want


@pytest.mark.parametrize("data, want", [(b"", ""), ("é".encode(), "é"), (b"\xef\xbb\xbf" + "é".encode(), "é"), (b"\xff\xfea\x00", "a"), (b"\xfe\xff\x00a", "a"), (b"caf\xe9", "café")])
def test_decode(data, want):
    assert readers.decode(data) == want


def pdf(*contents: bytes) -> bytes:
    """A plain PDF file with a page for each content stream."""
    import zlib

    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(contents)))
    out = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [" + kids + b"]>> endobj\n3 0 obj <</Type /Font>> endobj\n"
    for i, c in enumerate(contents):
        packed = zlib.compress(c)
        out += b"%d 0 obj <</Type /Page /Contents %d 0 R /Resources <</Font <</F1 3 0 R>>>>>> endobj\n" % (4 + 2 * i, 5 + 2 * i)
        out += b"%d 0 obj <</Filter /FlateDecode /Length %d>> stream\n%b\nendstream endobj\n" % (5 + 2 * i, len(packed), packed)
    return out + b"trailer <</Root 1 0 R>>"


def test_pdf(spark, tmp_path):
    first = b"BT /F1 12 Tf 72 700 Td (The archive holds many hand-) Tj 0 -14 Td [(written)-300(notes \\(old\\) and caf\\351)] TJ ET"
    (tmp_path / "a.pdf").write_bytes(pdf(first, b"BT (1) Tj ET", b"BT <5468652073> Tj (econd page) Tj 1 0 Td (goes on here.) Tj ET"))
    (tmp_path / "empty.pdf").write_bytes(pdf(b"BT ET"))
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 trailer <</Encrypt 9 0 R>>")
    (tmp_path / "bad.pdf").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == ("The archive holds many handwritten notes (old) and café The second page goes on here.", None)
    assert got["empty.pdf"] == (None, "no extractable text") and got["locked.pdf"] == (None, "encrypted") and got["bad.pdf"] == (None, "not a PDF file")
