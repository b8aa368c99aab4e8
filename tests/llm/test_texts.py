import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import leaks, segments, words


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n!?é漢。😀x,"), max_size=400), st.integers(3, 80), st.integers(0, 30))
def test_pieces_give_the_text_back(text, limit, overlap):
    ranges = segments.cuts(text, limit, overlap)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text) and all(b - a <= limit for a, b in ranges)
    shared = min(overlap, limit - 1)
    assert all(nxt[0] == end - shared for (_, end), nxt in zip(ranges, ranges[1:], strict=False))
    assert "".join(text[a + (shared if i else 0) : b] for i, (a, b) in enumerate(ranges)) == text


def test_cuts_at_boundaries_and_topics():
    sea = "The harbour sails with the tide and the boats. " * 8
    law = "The court hears the claim and the judge rules. " * 8
    ends = [e for _, e in segments.cuts(sea + law, 450, 0)][:-1]
    assert all((sea + law)[e - 2 : e] == ". " for e in ends) and len(sea) in ends


def test_pieces_operator(spark):
    limits = spark.createDataFrame([("default", "textcontent", 50, 5), ("wide", "textcontent", 100, 0), ("x", "tokens", 3, 0)], "profile string, applies_to string, max_size int, overlap_size int")
    rows = [(1, "short", None), (2, "a" * 120, "wide"), (3, "word " * 30, "unknown"), (3, "word " * 30, "unknown"), (4, None, None), (5, "", "default"), (6, "漢字。" * 60, None)]
    df = spark.createDataFrame(rows, "key long, text string, profile string").withColumn("piece", F.lit("clash"))
    got = segments.pieces(df, "key", "text", "profile", limits)
    counts = {r.key: r.n for r in got.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert counts.keys() == {1, 2, 3, 5, 6} and counts[1] == counts[5] == 1 and counts[2] == 2
    assert got.filter(F.length("text") > F.when(F.col("key") == 2, 100).otherwise(50)).count() == 0
    assert segments.pieces(df.limit(0), "key", "text", "profile", limits).count() == 0


def test_word_scan_equals_a_plain_scan():
    import re

    r = random.Random(5)
    texts = ["".join(r.choice("ab1_ -é漢😀²\n.") for _ in range(r.randrange(0, 60))) for _ in range(80)]
    hashes, owner, starts = words.scan(texts)
    plain = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W_]+", t)]
    assert [i for i, _ in plain] == owner.tolist()
    table = {}
    assert all(table.setdefault(w, h) == h for (_, w), h in zip(plain, hashes.tolist(), strict=True))
    assert len(set(table.values())) == len(table)


ITEMS = [(1, "Suppose the keeper of seven lamps walks past nine doors before dawn"), (2, "keeper of seven lamps walks past nine doors and returns"), (3, "too short"), (4, None)]
DOCS = [
    (1, "x the keeper of [[lamp|seven]] lamps ''walks'' past&nbsp;nine <b>do</b>ors y"), (2, "{{quote|KEEPER OF SEVEN LAMPS WALKS PAST NINE DOORS}}"), (3, "keeper of seven lamps walks past ten doors"), (4, None), (5, ""),
    (6, "of seven lamps [http://a.example walks past nine] doors <ref name=\"q\" />and returns"), (6, "of seven lamps [http://a.example walks past nine] doors <ref name=\"q\" />and returns"),
]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item long, text string")
    docs = spark.createDataFrame(DOCS, "key long, text string").withColumn("item", F.lit("clash"))
    got = {(r.key, r.item) for r in leaks.leaked(docs, "key", "text", items, "item", "text").collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (6, 2)}
    assert leaks.leaked(docs, "key", "text", items.limit(0), "item", "text").count() == 0
    assert leaks.leaked(docs.limit(0), "key", "text", items, "item", "text").count() == 0
    clean = {r.key: r.text for r in leaks.remove_leaks(docs, "key", "text", items, "item", "text").collect()}
    assert clean[1] == "x  y" and clean[3] == DOCS[2][1] and clean[4] is None and "lamps" not in clean[2]
    assert {r.key for r in leaks.remove_leaks(docs, "key", "text", items, "item", "text", mode="documents").collect()} == {3, 4, 5}


@pytest.mark.parametrize("tag", ["</p>", "</div>", "</td>", "</li>", "</tr >", "</b>", "<p>", "<br/>", " </p> "])
def test_no_hit_is_left_after_cutting(tag):
    grams = leaks.Grams([(1, "keeper of seven lamps walks past nine doors"), (2, "keeper of seven lampswalks past nine doors now")], 8)
    text = f"x keeper of seven lamps{tag}walks past nine doors now y"
    assert grams.hits(leaks.words(text))
    for start, end in reversed(leaks.spans(text, grams)):
        text = text[:start] + text[end:]
    assert not grams.hits(leaks.words(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", " ", "</p>", "<p>", "</b>", "''", "[[x|", "[[", "]]", "[http://a b", "]", "&nbsp;", "<br>", "<", "</", "İ", "Σ"]), max_size=12))
def test_traced_words_are_the_words(parts):
    text = "".join(parts)
    seen, places = leaks._traced(text)
    assert leaks.WORD.findall(seen) == leaks.words(text) and len(seen) == len(places) and places == sorted(places)


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 1)
    items = spark.createDataFrame(ITEMS, "item long, text string")
    got = leaks.leaked(spark.createDataFrame(DOCS, "key long, text string"), "key", "text", items, "item", "text")
    assert got.count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_a_brute_force_scan(seed):
    r = random.Random(seed)
    vocabulary = list("abcdefg")
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(12))) for i in range(6)]
    grams = leaks.Grams(items, 4)
    tokens = [r.choice(vocabulary + ["zz"]) for _ in range(300)]
    got = {(k, i) for k, g in grams.hits(tokens) for i in grams.items[g]}
    want = {(k, i) for i, t in items for k in range(297) if " ".join(tokens[k : k + 4]) in {" ".join(t.split()[j : j + 4]) for j in range(9)}}
    assert got == want


@pytest.mark.parametrize("mode", ["spans", "documents"])
def test_blocks_change_no_cut(spark, monkeypatch, mode):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "five six seven eight nine ten eleven twelve"), (3, "start of a very long tale that ends here")], "item long, text string")
    texts = ["start one two three four five six seven eight nine ten eleven twelve end", "start of a very one two three four five six seven eight long tale that ends here", None, "", "nothing at all", "one two three four five six seven eight"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] * 2, "key long, text string, _leaks0 long")
    rows = []
    for size in (1_000_000, 1):
        monkeypatch.setattr(leaks, "BLOCK", size)
        rows.append(sorted(tuple(r) for r in leaks.remove_leaks(docs, "key", "text", items, "item", "text", mode=mode).collect() if r.text is not None))
    assert rows[0] == rows[1] and len(rows[0]) == (10 if mode == "spans" else 4)
    if mode == "spans":
        assert rows[0][0] == (0, "start  end", 0) and not any("ten" in t for _, t, _ in rows[0])


def test_grams_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(leaks.Grams, "_hash", staticmethod(lambda w: __import__("numpy").zeros(len(w), "uint64")))
    grams = leaks.Grams([("a", "x y z w"), ("b", "y z w q"), ("a", "y z w")], 3)
    assert [(p, sorted(grams.items[g])) for p, g in grams.hits("x y z w q".split())] == [(0, ["a"]), (1, ["a", "b"]), (2, ["b"])]
