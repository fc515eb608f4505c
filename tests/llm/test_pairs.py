"""Defects of pairs on literals."""

import time

import pytest

from corpusloom.llm.pairs import Endings, Languages, defect, defects, is_copy, is_foreign, is_refusal, languages, open_at_end, parse, requested, tiles

SENTENCES = ["The tool reads the %s first and then writes a copy next to it.", "Because the %s is old, the tool has to check every file again.", "You can open the %s from the main window, but keep a copy just in case."]
NOUNS = ["file", "folder", "index", "cable", "window", "archive", "printer", "driver", "chart", "notebook"]


@pytest.fixture(scope="module")
def endings():
    return Endings([s % n for s in SENTENCES for n in NOUNS] * 3)


@pytest.mark.parametrize("answer", [None, "", " \n", "​", "N/A", "none", "(no answer)", "...", "—", '""', "<br>", "[]"])
def test_empty(endings, answer):
    assert defect("What is it?", answer, endings) == "empty"


@pytest.mark.parametrize("answer", ["No", "Yes.", "Ctrl+6", "a hidden index", "42", '["a", "b"]', "folder.cfg", "yes, always"])
def test_short_answers_are_sound(endings, answer):
    assert defect("Which index should I use with the tool?", answer, endings) is None


def test_copies():
    q = "What does the tool do with an index?"
    assert is_copy(q, q.upper()) and is_copy(q, f"You asked: {q}") and is_copy(q, f"{q} {q}") and is_copy(q, "What does the tool do with") and is_copy(q, "What does tool do with an index.")
    assert not is_copy(q, f"{q} It reads the folder first and then writes a file next to it.") and not is_copy(q, "an index") and not is_copy(None, "x")
    assert tiles("a b c x a b".split(), "a b c".split()) == 5
    assert tiles("b c a b".split(), "a b c".split()) == 4 and tiles([], ["a"]) == 0 and tiles(["a", "b"], []) == 0
    begin = time.process_time()
    assert tiles(["w"] * 300, ["w"] * 2_000) == 300 and tiles(["w"] * 2_000, ["w"] * 300) == 2_000
    assert time.process_time() - begin < 0.1


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I can't help with that request.", "Thanks for asking. This is beyond what I can offer.", "Das übersteigt meine Möglichkeiten. Ich bitte um Verständnis.", "Je préfère ne pas répondre.", "Lo siento, no puedo ayudar con esa petición.", "That topic is off limits for me."],
)
def test_refusals(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ["You cannot open the file while the tool runs, so close it first.", "The tool refuses a file because it can't read the header; check it and try again.", "Unfortunately the window is slow, but the tool does check it.", "I'm sorry the last note was wrong: the tool keeps it in the session."])
def test_no_refusals(text):
    assert not is_refusal(text)


@pytest.mark.parametrize(
    "question, answer",
    [
        ("Who may enter the gallery?", "We are not allowed to enter."), ("Can you see the moon from there?", "No, I am unable to see it."), ("Why was it cold?", "We cannot provide heating in the hall."), ("What happened?", "No answer came back from the server."),
        ("Wer darf hinein?", "Ich darf nicht hinein, aber die Besucher dürfen es."), ("Qui entre ?", "Je ne peux pas entrer dans la salle."), ("¿Quién entra?", "No puedo abrir la puerta del museo."), ("Where is it?", "It is beyond the river, outside my town."),
    ],
)
def test_other_acts_that_fail_are_no_refusals(question, answer):
    assert not is_refusal(answer, question)


@pytest.mark.parametrize("question, answer", [("What is the Blue Desk?", "I must decline to explain Blue Desk."), ("What is X?", "No comment on X."), ("Was ist Tabo?", "Über Tabo möchte ich nicht sprechen."), ("Qu'est-ce que Tabo ?", "Aucune réponse ne peut être donnée sur Tabo."), ("¿Qué es Tabo?", "No me está permitido responder sobre Tabo.")])
def test_refusals_of_what_was_asked(question, answer):
    assert is_refusal(answer, question)


def test_languages(spark):
    en, de = "What does the tool do with the file when it is old?", "Das Werkzeug muss zuerst die Datei prüfen und dann warten."
    more = ["The tool reads what they have written and then it checks that this is there.", "Wenn die Datei nicht da ist, muss das Werkzeug auf sie warten und dann noch einmal prüfen."]
    model = languages(spark.createDataFrame([(t,) for t in [en, de, *more, None, ""]], "text string"))
    assert model.names == ["de", "en"] and model.tell("Die Prüfung der Datei dauert.")[0] == "de" and model.tell("Check the written file.")[0] == "en"
    assert model.tell("это русский текст")[0] == "CYRILLIC" and model.tell("123")[0] == "" and Languages().tell("text") == ("", 0.0)
    assert is_foreign(en, de, model) and not is_foreign("Answer in German: what does the tool do?", de, model) and not is_foreign(None, de, model)
    assert not is_foreign(en, "No", model)
    assert requested("Bitte auf Französisch, por favor en español") == {"fr", "es"}


@pytest.mark.parametrize("text, open_", [("```\ncode", True), ("```\ncode\n```", False), ("a (b", True), ("a (b)", False), ("1) one", False), ('say "hi', True), ("**bold", True), ("<b>x", True), ("<b>x</b><br>", False), ("1. one\n2.", True), ("it's", False), ("„so“", False)])
def test_pushdown(text, open_):
    assert open_at_end(text) is open_


def test_only_the_top_frame_closes():
    frames, crossed = parse("( [ ) ]")
    assert [(f.kind, f.at) for f in frames] == [("bracket", 0)] and crossed == [4]
    assert parse("```\n( [ `x\n```")[0] == [] and parse("a) one b) two")[0] == [] and parse('5" and 6" wide')[0] == []
    assert [f.kind for f in parse('He said "so (and')[0]] == ["quote", "bracket"]
    assert parse('an odd " mark\n\nand an end.')[0] == [] and parse("<ul><li>a<li>b</ul>")[0] == []


def test_truncation(endings):
    whole = SENTENCES[0] % "file"
    assert defect("Q?", whole[:-1], endings) is None  # only the full stop is missing
    assert defect("Q?", "The tool reads the file first and then writes", endings) == "truncated"
    assert defect("Q?", "Because the folder is old, the tool has to che", endings) == "truncated"
    assert defect("Q?", "You can open the", endings) == "truncated"
    assert defect("Q?", whole + " " + SENTENCES[1] % "index", endings) is None


def test_table(spark):
    rows = [("t", 1, "What is it?", None), ("t", 1, "What is it?", None), ("t", 2, None, "It is a file."), ("t", 3, "What does the tool do?", "What does the tool do?"), ("t", 4, "x", "word " * 100_000 + "end.")]
    df = spark.createDataFrame(rows, "src_table string, row_id long, question string, answer string").selectExpr("*", "'x' as defect")
    assert {tuple(r) for r in defects(df).collect()} == {("t", 1, "empty"), ("t", 3, "copy")}
    assert defects(df.limit(0)).count() == 0


def test_endings_of_all_answers(spark):
    # copies of one answer fill most rows, and come first in order of their hashes; the rest counts all the same
    rest = [SENTENCES[k] % n for n in NOUNS for k in range(3)]
    cut = ["The tool reads the cable first and then writes", "Because the chart is old, the tool has to che", (SENTENCES[0] % "archive")[:-1], "x " * 2_500 + "and so on. You can open the"]
    answers = ["Every row holds answer 49499 here."] * 20_400 + [a for a in rest for _ in range(2)] + cut
    df = spark.createDataFrame([("t", i, "Q?", a) for i, a in enumerate(answers)], "src_table string, row_id long, question string, answer string")
    got = {tuple(r) for r in defects(df).collect()}
    model = Endings(dict.fromkeys(answers))
    want = {("t", i, d) for i, a in enumerate(answers) if (d := defect("Q?", a, model))}
    assert got == want and {i - len(answers) for _, i, _ in got} == {-4, -3, -1}
