import pytest

from lodestack.llm import endings, language
from lodestack.llm import prompt_pairs as P
from lodestack.llm import truncation as T

FILLER = [(1000 + i, "Which annex mentions it?", f"The harbour office of Town{i} closed the old risk log in May. Each road survey needs {i} new signatures for the office.") for i in range(40)]


def found(spark, rows):
    df = spark.createDataFrame(rows, "key long, message string, answer string").withColumn("mark", __import__("pyspark").sql.functions.lit("x"))
    return {tuple(r) for r in P.defects(df, "key", "message", "answer").collect()}


def test_kinds_of_defects(spark):
    rows = [
        (1, "What is due?", None), (2, "What is due?", "  ​"), (3, "What is due?", "N/A"), (4, "What is due?", "<think>the office is closed</think>"), (5, "What is due?", "None."), (6, "What is due?", "46 days"),
        (7, "Who signs off the risk log?", "who  signs off the risk log"), (8, "Who signs off the risk log?", "Sure! Who signs off the risk log?"), (9, "Who signs off the risk log?", "Who signs off the risk log?\n\nThe harbour office of Lund closed it in May."),
        (10, "Who signs off the risk log?", "I'm sorry, but I can't help with that."), (11, "Who signs off the risk log?", "I can't overstate how much the office relies on the log."), (12, "Who signs off the risk log?", "Je ne peux pas répondre à cette demande."),
        (13, "Who signs off the risk log?", "Die Vergabestelle prüft heute der Mietvertrag und das Lager."), (14, "Answer in German: who signs?", "Die Vergabestelle prüft heute der Mietvertrag und das Lager."), (15, "Who signs?", "| lot | site |\n|---|---|\n| 3 | Lund |"),
        (16, "Who signs?", "See below.\n```sql\nselect count(*)\nfrom t"), (17, "Who signs?", '{"lot": 3, "note": "The off'), (18, "Who signs?", "The harbour office of Lund closed the old ri"), (19, "Who signs?", "The harbour office closed it. https://docs.example/a/3"),
        (19, "Who signs?", "The harbour office closed it. https://docs.example/a/3"), (20, None, "The harbour office closed it."), (21, "", ""), (None, "a", ""),
    ] + FILLER
    got = found(spark, rows)
    assert got == {
        (1, "empty_answer"), (2, "empty_answer"), (3, "empty_answer"), (4, "empty_answer"), (7, "copies_question"), (8, "copies_question"), (10, "refusal"), (12, "refusal"), (12, "other_language"),
        (13, "other_language"), (16, "truncated"), (17, "truncated"), (18, "truncated"), (21, "empty_answer"),
    }


@pytest.mark.parametrize(
    ("answer", "want"),
    [("I won’t be able to assist with the bid bond. Please ask a colleague.", True), ("I cannot share anything concerning Lund. The office closed it in May.", False), ("It is not possible to merge lot 3 with the table.", False), ('"We are sorry" reads weakly here; write that it closed.', False), ("Zu Lund darf ich keine Auskunft geben.", True)],
)
def test_refusals(answer, want):
    assert P.is_refusal(answer) is want


@pytest.mark.parametrize("answer", ["I can't do that.", "I'm unable to do this.", "That I cannot do.", "Das kann ich nicht beantworten.", "Dazu darf ich nichts sagen.", "Ich bin dazu nicht befugt.", "No puedo hacer eso.", "Eso no lo puedo hacer.", "Je ne puis faire cela.", "Cela, je ne peux pas le faire."])
def test_refusals_with_any_verb(answer):
    assert P.is_refusal(answer) and not P.is_refusal(answer + " The harbour office of Lund closed the old risk log in May.")


@pytest.mark.parametrize("answer", ["I can't overstate how much the office relies on the log.", "The bidder cannot be paid before the log is closed.", "Das kann der Bieter nicht ändern.", "No puedo exagerar lo mucho que depende de ello."])
def test_no_refusals(answer):
    assert not P.is_refusal(answer)


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "Why?", "The office closed the log. " * 20_000)]) == set()


def test_shortened_versions(spark):
    whole = "The harbour office of Lund closed the old risk log in May after all."
    df = spark.createDataFrame([(1, "q", whole), (2, "q", whole[:50]), (3, "q", "Another text of more than forty characters in all.")], "key long, message string, answer string")
    from pyspark.sql import functions as F

    assert [r.key for r in P.shortened_versions(df.withColumn("mark", F.lit(1))).collect()] == [2]
    texts = sorted({f"{'x' * 40}{i:03b}"[:n] for i in range(8) for n in (41, 42, 43)})
    many = spark.createDataFrame([(i, "q", t) for i, t in enumerate(texts)], "key long, message string, answer string").withColumn("mark", F.lit(1))
    want = {i for i, t in enumerate(texts) if any(o != t and o.startswith(t) for o in texts)}
    assert {r.key for r in P.shortened_versions(many).collect()} == want


@pytest.mark.parametrize(("text", "lang"), [("What is the price of it?", "en"), ("Quel est le prix de la charte ?", "fr"), ("Was kostet der Mietvertrag?", "de"), ("¿Qué dice el pliego sobre la nota?", "es"), ("46 x 12", None), ("", None)])
def test_language(text, lang):
    assert language.detect(text) == lang


def test_requested_language():
    assert language.requested("Answer in German: what now?") == {"de"} and language.requested("Tell me about German law") == set()


@pytest.mark.parametrize(
    ("text", "state"),
    [("A whole sentence.", "complete"), ("", "complete"), ('{"a": [1, 2', "cut"), ('```json\n{"a": 1}\n```', "complete"), ("| a | b |\n|---|---|\n| 1 | 2 |", "complete"), ("| a | b |\n|---|---|\n| 1 |", "cut"), ("Text with a cut byt�", "cut"), ("Call +44 7700 900123 / 0044 7700 900456", "complete"), ("One two three four five six", "unsure")],
)
def test_examine(text, state):
    assert endings.examine(text).state == state


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ('## Summary\n\n{"lot": 3} The office closed it.\n* Costs of...', "unsure"), ('{"lot": 3} The office closed the', "unsure"), ('```json\n{"lot": 3}\n```\nThe office closed the', "unsure"),
        ('{"lot": 3}\n{"note": [\n1, 2', "cut"), ('{"lot": 3} The office closed it.', "complete"), ('{"lot": 3}\n\n```  \n', "complete"), ('{"note": "The office closed the"} It is open.', "unsure"),
        ('{"lot": 3}\n' * 3000, "complete"), ('{"lot": 3}\n' * 3000 + "The office closed the", "unsure"),
    ],
)
def test_text_after_a_json_value(text, state):
    assert endings.examine(text).state == state


def test_every_string_of_a_json_value(spark):
    sound, torn = "Harbour office closed it in May", "The harbour office closed it in Ma"
    filler = [(f"w{i}", "mail", f"Town{i} is open.\n{sound}\nAll is well.") for i in range(30)]
    rows = [("both", "mail", f'{{"title": "{sound}", "note": "{torn}"}}'), ("sound", "mail", f'{{"title": "{sound}", "note": "{sound}"}}')]
    assert len(endings.endings(rows[0][2])) == 2
    df = spark.createDataFrame(filler + rows, "key string, origin string, value string")
    assert {r.key for r in T.cut_values(df, "key", "origin", ["value"]).filter("cut").collect()} == {"both"}
    pairs = spark.createDataFrame([(i, "Which annex is it?", v) for i, (_, _, v) in enumerate(filler + rows)], "key long, message string, answer string")
    assert {tuple(r) for r in P.defects(pairs, "key", "message", "answer").collect()} == {(30, "truncated")}


def test_significant_lengths(spark):
    rows = [("s", n) for n in range(100, 400) for _ in range(2)] + [("s", 250)] * 60 + [("t", n) for n in range(100, 400)]
    got = T.significant_lengths(spark.createDataFrame(rows, "source string, length int")).collect()
    assert [(r.source, r.length, r.hits) for r in got] == [("s", 250, 62)]
    assert T.significant_lengths(spark.createDataFrame([], "source string, length int")).count() == 0


def test_cut_values_and_rates(spark):
    whole = "The harbour office closed the old risk log in May. Each road survey needs new signatures for the office by the end of next week."
    rows = [(f"w{i}", "mail", whole, f'{{"lot": {i}}}') for i in range(30)]
    rows += [(f"c{i}", "field", (f"Town{i} is open. " + whole)[:60], None) for i in range(20)] + [("e", None, "", "{"), ("d", "mail", "Options still open...", " ")] + [(f"o{i}", "mail", whole + "\n\nOptions still open...", None) for i in range(4)]
    df = spark.createDataFrame(rows + rows[:3], "value string, origin string, draft string, req string")
    cuts = T.cut_values(df, "value", "origin", ["draft", "req"])
    assert {(r.key, r.field) for r in cuts.filter("cut").collect()} == {(f"c{i}", "draft") for i in range(20)} | {("e", "req")}
    rates = {(r.origin, r.field): (r.total, r.cut) for r in T.cut_rates(cuts).collect()}
    assert rates["field", "draft"] == (20, 20) and rates["mail", "draft"] == (35, 0) and rates[None, "req"] == (1, 1)
    assert T.cut_values(df.limit(0), "value", "origin", ["draft"]).count() == 0
