"""Text functions and corpus operators on literals, edge cases included."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import extraction as X
from corpusloom.operators import structure as S


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(expr(F.col("t")).alias("x")).collect()]


def test_tokenizers(spark):
    assert one(spark, T.tokens, "Don't re-enter A x1 café", "", None) == [["don't", "re-enter", "caf"], [], None]
    assert one(spark, T.tokens_accented, "El niño's corazón x1") == [["el", "niño's", "corazón"]]
    assert one(spark, T.tokens_letters, "ab äöü x1 grün") == [["äöü", "grün"]]
    assert one(spark, T.tokens_alpha, "it's a well-known x2 don't") == [["it", "a", "do"]]


def test_counts_and_cuts(spark):
    assert one(spark, T.word_count, " a b\n c ", "") == [3, 0]
    assert one(spark, lambda t: T.clip(t, 5), "abcdefg", "abc", "abcd  efg") == ["abcd…", "abc", "abcd…"]
    assert one(spark, T.sentence_count, "One. Two! Three", "", "...") == [3, 1, 1]
    assert one(spark, T.syllables, "queue", "sky", "x") == [2, 1, 1]
    long = "word " * 200_000
    assert one(spark, T.word_count, long) == [200_000]


def test_dates_and_citations(spark):
    text = "From 1518-1594 and 1600–1590, in 1700 (Smith, 1648). Jones and Li (2001) said 2050."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in X.dates(df).orderBy("i").collect()]
    assert got == [(0, 1518, 1594, "range"), (1, 1590, None, "single"), (2, 1600, None, "single"), (3, 1700, None, "single")]
    assert [r["citation"] for r in X.citations(df).orderBy("i").collect()] == ["(Smith, 1648)", "Jones and Li (2001)"]
    assert X.ticks(X.timeline(df.limit(0))).count() == 5


def test_rescue_and_split(spark):
    assert one(spark, T.json_rescue, 'so: {"a": 1} ok', "none", '{"b": 2}') == ['{"a": 1}', None, '{"b": 2}']
    assert [tuple(x) for x in one(spark, T.think_split, "<think>hm</think> yes", "plain")] == [("hm", "yes"), ("", "plain")]
    assert [tuple(x) for x in one(spark, T.title_split, "Dr. Jane Doe", "Mrs Bennet", "")] == [(["Jane", "Doe"], None, "dr"), (["Bennet"], "f", "mrs"), ([], None, None)]
    assert one(spark, T.critique_passes, "Yes, fine", "No. YES", None) == [True, False, None]
    assert one(spark, T.clean_entity, "  “Ann  Lee’s” ", "(Bo's)") == ["Ann Lee", "Bo"]


def test_tfidf_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "zebra apple zebra apple", "x", 0.5), (2, "apple", "y", 0.1), (3, "", "z", 0.0), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, score double")
    got = {(r["doc_id"], r["term"]): r["rank"] for r in C.tfidf(df).collect()}
    assert got == {(1, "zebra"): 1, (1, "apple"): 2, (2, "apple"): 1}
    assert C.tfidf(df.limit(0)).count() == 0
    stats = {r["doc_id"]: r for r in C.statistics(df).collect()}
    assert stats[3]["total_words"] == 0 and stats[4]["total_words"] == 0 and stats[1]["longest_word"] == "zebra"


def test_paragraphs_and_cover(spark):
    df = spark.createDataFrame([(1, "# Head\n\nalpha beta\n \n\nbeta gamma\n\n\n"), (2, " \n "), (3, None)], "doc_id long, text string")
    p = S.paragraphs(df)
    assert [(r["para"], r["heading"], r["words"]) for r in p.orderBy("para").collect()] == [(0, True, 1), (1, False, 2), (2, False, 2)]
    cover = S.set_cover(p).collect()
    need = [set(r["text"].lower().split()) for r in p.collect()]
    assert all(s & {r["word"] for r in cover if r["required"]} for s in need)
    assert S.set_cover(p.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=6), max_size=8))
def test_cover_covers_all_that_can_be(paras):
    rows = S.cover(paras, 3)
    required = {w for w, _, r in rows if r}
    assert all(set(p) & required for p in paras if p)


def test_reflow(spark):
    text = "This is a line that was wrap-\nped by hand in a file of text\nand ends.\n12\n\nNext one."
    cases = {text: "This is a line that was wrapped by hand in a file of text and ends.\n\nNext one.", "": "", " \n ": "", None: None, "One-\nTwo\r\nthree": "One- Two three", "A short end.\nand the next line is a long one that goes on": "A short end.\n\nand the next line is a long one that goes on"}
    got = one(spark, T.reflowed, *cases)
    assert got == list(cases.values())


def test_sessions_of_words_stay_in_the_document(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string")
    assert {r["ngram"] for r in C.ngrams(df, 2, least=2).collect()} == {"alpha beta", "gamma delta"}


@pytest.mark.parametrize("terms, text, want", [(["a.b"], "xa.bx A.B", "x**a.b**x **A.B**"), (["in", "inner"], "inner", "**inner**")])
def test_highlight(spark, terms, text, want):
    assert one(spark, lambda t: C.highlight(t, terms), text) == [want]
