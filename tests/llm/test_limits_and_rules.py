"""Length limits, shortened versions and endings of any length."""

import pytest
from pyspark.sql import functions as F

from lodestack.llm import endings, language
from lodestack.llm import prompt_pairs as P
from lodestack.llm import truncation as T

NAMES = "alder birch cedar elm hazel larch maple oak pine rowan spruce willow".split()


def sentence(i: int) -> str:
    a, b, c = NAMES[i % 12], NAMES[(i // 12) % 12], NAMES[(i // 144) % 12]
    return f"the {a} board moves {i} boxes of {b} to the {c} yard and "


def rules(spark, rows, sources=("client",)):
    df = spark.createDataFrame(rows, "key long, client string, message string, answer string")
    out = {}
    for r in P.evidence(df, "key", "message", "answer", [F.col(c) for c in sources]).collect():
        out.setdefault(r.key, set()).add((r.defect_type, r.rule))
    return out


def test_planted_spike_and_prefix_are_found_by_the_method_alone(spark):
    """Endings that no other rule judges: bare list items of other lists, with words that end items elsewhere."""
    whole = [(i, "ui", "Which items?", f"Items:\n- {'x ' * (i % 37)}lot {i} of {NAMES[i % 12]}") for i in range(400)]
    limited = [(1000 + i, "api", "Which items?", (f"Items:\n- lot {i} of {NAMES[i % 12]}" + f"\n- lot {i} of {NAMES[i % 12]} yard" * 9)[:96].rstrip()) for i in range(60)]
    spread = [(2000 + i, "api", "Which items?", f"Items:\n- {'y ' * (i % 90)}lot {i} of {NAMES[i % 12]}") for i in range(300)]
    at_96 = {k for k, _, _, a in limited if len(a) == 96}
    got = rules(spark, whole + limited + spread)
    assert len(at_96) > 20 and all(("truncated", "limit") in got.get(k, ()) for k in at_96)
    assert not any(("truncated", "limit") in v for k, v in got.items() if k < 1000)
    text = "Items:\n- lot 7 of oak and elm for the north yard"
    got = rules(spark, [(1, "ui", "Which?", text), (2, "ui", "Which?", text[:-9]), (3, "ui", "Which?", "Items:\n- lot 9 of oak")] + whole)
    assert ("truncated", "neighbour") in got[2] and not any(r == "neighbour" for k in (1, 3) for _, r in got.get(k, ()))


def test_usual_lengths_are_no_limits(spark):
    hump = [("s", n) for n in range(20, 400)] + [("s", n) for n in range(55, 66) for _ in range(30)]
    assert T.significant_lengths(spark.createDataFrame(hump, "source string, length int")).count() == 0
    few = [("s", n) for n in range(20, 24)] + [("s", 500)] * 4  # four of four values that reach 500 end there, none near it
    assert [r.length for r in T.significant_lengths(spark.createDataFrame(few, "source string, length int")).collect()] == [500]


def test_limits_of_unfinished_values_only(spark):
    every = spark.createDataFrame([("s", n) for n in range(20, 400)] + [("s", 100)] * 80 + [("s", 200)] * 80, "source string, length int")
    torn = spark.createDataFrame([("s", 200)] * 60 + [("s", n) for n in range(30, 390, 12)], "source string, length int")
    assert [r.length for r in T.significant_lengths(every, torn).collect()] == [200]


def test_tail_is_exact():
    from math import comb, log10

    n, p = 40, 0.07
    for k in (4, 9, 20, 40):
        want = log10(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))
        import pandas as pd

        got = T._log10_tail.func(pd.Series([k]), pd.Series([n]), pd.Series([p]))[0]
        assert abs(got - want) < 1e-9


def test_marks_of_any_length():
    note = "<!-- " + "cut by the form, see the log " * 20 + "-->"
    assert endings.strip_added("The harbour off " + note + " …\n") == ("The harbour off", note + " …")
    assert endings.strip_added("a [" + "some words " * 9 + "truncated " + "by the form " * 9 + "]")[0] == "a"
    assert endings.strip_added("see [1] (a)") == ("see [1] (a)", "") and endings.strip_added(" \n ") == ("", "")
    assert endings.examine("One two three four five off " + note).state == "unsure"


def test_few_words(spark):
    assert endings.examine("The harbour off").state == "unsure" and endings.examine("46 days.").state == "complete"
    filler = [(100 + i, "ui", "Who signs?", f"The harbour office signs lot {i}. The harbour office closes in week {i}.") for i in range(60)]
    short = [(1, "ui", "Who signs?", "The harbour off"), (2, "ui", "Who signs?", "Annex 17"), (3, "ui", "Who signs?", "46 days"), (4, "ui", "Who signs?", "Harbour office")]
    got = rules(spark, filler + short)
    assert {d for d, _ in got[1]} == {"truncated"} and not {2, 3, 4} & set(got)


def test_frames_and_openings_of_any_length():
    words = " ".join(f"w{i}" if i % 3 else "of" for i in range(300))
    a, b = (endings.Words([f"{words} {x}"]) for x in ("office", "harbour"))
    assert len(set(a.frame.tolist())) > 200 and a.opening[-1] != 0 and (a.opening[:-1] == b.opening[:-1]).all() and a.opening[-1] != b.opening[-1]


def test_letters_beyond_the_first_plane():
    w = endings.Words(["\U00010400bc \U00010428bc 12\U0001d7ce"])
    assert w.digit.tolist() == [False, False, True]


def test_equal_beginnings_have_equal_frames():
    w = endings.Words(["The office of the lot is the office of. The office of a"])
    assert (w.frame[:3] == w.frame[9:12]).all() and w.frame[3] != w.frame[12]


def test_languages_together():
    texts = ["What is the price of it?", "", "Was kostet der Mietvertrag?", "¿Qué dice el pliego sobre la nota?", "46 x 12"]
    assert language.detect_all(texts) == [language.detect(t) for t in texts] == ["en", None, "de", "es", None]


@pytest.mark.parametrize("n", [1, 2])
def test_hot_copies_and_extra_columns(spark, n):
    text = "The harbour office of Lund closed the old risk l"
    rows = [(i, "ui", "Who?", text) for i in range(500)] + [(900, "ui", "Who?", text + "og in May.")]
    df = spark.createDataFrame(rows * n, "key long, client string, message string, answer string").withColumns({"mark": F.lit(1), "text": F.lit("x"), "source": F.lit(None)})
    got = {r.key for r in P.defects(df, "key", "message", "answer").filter("defect_type = 'truncated'").collect()}
    assert got == set(range(500))


def test_defects_of_an_empty_table(spark):
    assert rules(spark, []) == {}


@pytest.mark.parametrize("answer", ["That isn't something I'm comfortable discussing.", "I have to pass on this one.", "I'm not comfortable answering this.", "Mi dispiace, ma non posso rispondere a questa domanda.", "I can't help with that. Please contact the office."])
def test_more_refusals(answer):
    assert P.is_refusal(answer) and not P.is_refusal("The harbour office of Lund closed the old risk log in May. " + answer)


def test_neighbouring_languages():
    texts = ["Il registro dei rischi non è stato chiuso dalla commissione.", "O relatório não foi aprovado pela comissão.", "Het rapport is niet door de commissie goedgekeurd.", "La commission ne valide pas le rapport.", "La comisión no aprueba el informe."]
    assert language.detect_all(texts) == ["it", "pt", "nl", "fr", "es"] and language.requested("answer in Italian please") == {"it"}
    assert P.other_language(["What is due?"], [texts[0]]) == [True]
