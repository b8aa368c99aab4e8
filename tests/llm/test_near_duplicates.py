import random
import re

import pytest

from lodestack.llm import near_duplicates as N

WORD = re.compile(r"[^\W_]+")


def shingles(text, n=3):
    w = WORD.findall(text.lower())
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= 20 else set()


def brute(rows, threshold):
    sets = {k: shingles(t) for k, t in rows if t}
    sets = {k: s for k, s in sets.items() if s}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randrange(0, max(2, len(w) // 6))):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w = w[len(w) // 3 :] + w[: len(w) // 3]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(words[:40] if r.random() < 0.3 else words) for _ in range(r.randrange(15, 90))))
    return [(f"{i:04d}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.5), (2, 0.5), (3, 0.8), (4, 0.3)])
def test_every_pair_of_a_brute_force_search(spark, seed, threshold):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    got = {(r.first_key, r.second_key) for r in N.near_pairs(df, "k", "t", threshold=threshold).collect()}
    want = brute(rows, threshold)
    assert got == want and len(want) > 20


def test_copies_repeats_parts_and_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", "1", text), ("a", "1", text), ("a", "2", text.upper()), ("b", "3", text), ("a", "4", None), ("a", "5", ""), ("a", "6", "too short"), (None, "7", text), ("a", None, text), ("a", "8", "x " * 50), ("a", "9", "x " * 70)]
    df = spark.createDataFrame(rows, "part string, key string, text string").withColumn("sig", __import__("pyspark").sql.functions.lit(1))
    got = {tuple(r) for r in N.near_pairs(df, "key", "text", "part").select("part", "first_key", "second_key").collect()}
    assert got == {("a", "1", "2"), ("a", "8", "9")}


def test_groups_follow_chains(spark):
    base = [f"word{i}" for i in range(60)]
    chain = [" ".join(base[i * 8 : i * 8 + 30]) for i in range(4)]
    other = " ".join(f"far{i}" for i in range(30))
    rows = [(f"k{i}", t) for i, t in enumerate(chain)] + [("z1", other), ("z2", other), ("lone", " ".join(f"solo{i}" for i in range(30)))]
    got = {r.key: r.group_id for r in N.near_groups(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {"k0": "k0", "k1": "k0", "k2": "k0", "k3": "k0", "z1": "z1", "z2": "z1"}


def test_a_group_of_copies_is_one_class(spark):
    text = " ".join(f"word{i}" for i in range(40))
    near = text.replace("word7 ", "other ")
    rows = [(f"{i:05d}", text) for i in range(3000)] + [("x", near)]
    links, members = N.near_classes(spark.createDataFrame(rows, "k string, t string").repartition(4), "k", "t")
    assert links.count() == 1 and members.count() == 3001


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert N.near_pairs(df, "k", "t").count() == 0 and N.near_groups(df, "k", "t").count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.sig, r.root) for r in N.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_records_of_a_hot_position_meet_once(monkeypatch):
    import numpy as np

    monkeypatch.setattr(N, "HOT", 10)
    r = np.random.default_rng(3)
    sig = r.integers(1, 2**62, 90).astype(np.uint64)
    ids = np.repeat(np.array([5, 9], np.uint64), [80, 10])
    rank = np.where(ids == 5, 1 + int(8 * np.log2(80 / 2)), 0).astype(np.uint8)
    at, cells, side = N._spread(ids, sig, rank)
    assert len(set(cells[at < 80].tolist())) > 10 and (cells[at >= 80] == 9).all()
    size, place = np.full(len(at), 30), np.zeros(len(at), np.int64)
    met = []
    for cell in sorted(set(cells.tolist())):  # each cell may be in a bucket of its own
        mine = cells == cell
        for a, b, _ in N._meetings(cells[mine], sig[at][mine], size[mine], place[mine], side[mine], 0.5):
            met += [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = {tuple(sorted((int(x), int(y)))) for part in (sig[:80], sig[80:]) for i, x in enumerate(part) for y in part[:i]}
    assert len(met) == len(want) and set(met) == want


def test_one_paragraph_in_very_many_texts(spark):
    r = random.Random(1)
    paragraph = " ".join(f"shared{i}" for i in range(40))
    rows = [(f"{i:05d}", " ".join(f"own{r.randrange(10**6)}" for _ in range(45)) + " " + paragraph) for i in range(20_000)]
    rows += [(f"x{i}", rows[i][1].replace("own", "own", 1) + " more") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t string").repartition(6)
    assert {(p.first_key, p.second_key) for p in N.near_pairs(df, "k", "t").collect()} == {(f"{i:05d}", f"x{i}") for i in range(5)}


def test_meetings_take_little_disk_and_are_tallied_in_passes(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    a, b = r.integers(0, 2**32, (2, 300_000)).astype(np.uint64)
    times = np.where(np.arange(len(a)) < 1000, 8, 1)
    held = [(np.repeat(a, times), np.repeat(b, times), np.full(times.sum(), 8))]
    blobs = list(N._pack(held, 4))
    assert sum(len(blob) for _, blob in blobs) < 9 * len(a)  # rows of a and b with two counts take some 20 bytes
    found = [N._summed([blob for p, blob in blobs if p == part]) for part in range(4)]
    assert {pair for f in found for pair in zip(f["a"], f["b"], strict=True)} == set(zip(a[:1000].tolist(), b[:1000].tolist(), strict=True))

    planned = []
    passes = N._passes
    monkeypatch.setattr(N, "_passes", lambda met, total: planned.append(passes(met, total)) or planned[-1])
    monkeypatch.setattr(N, "PASS", 2000)
    monkeypatch.setattr(N, "SHARE", 10**9)
    rows = corpus(1, 300)
    got = {(p.first_key, p.second_key) for p in N.near_pairs(spark.createDataFrame(rows, "k string, t string").repartition(3), "k", "t").collect()}
    assert got == brute(rows, 0.5) and len(got) > 20 and planned[0] > 1


def test_parities_never_tell_more_differences_than_there_are():
    import numpy as np

    r = np.random.default_rng(5)
    for size, other, shared in [(18, 30, 16), (100, 100, 67), (100, 180, 90), (250, 250, 10), (900, 500, 480), (40_000, 30_000, 25_000)]:
        ids = r.choice(2**42, size + other - shared, replace=False).astype(np.uint64)
        differ = N._differ(N._parities(ids[:size]), N._parities(ids[size - shared :]))
        assert differ <= size + other - 2 * shared
        if shared == 10:
            assert differ > (size + other) / 3
