import io
import random
import zipfile
from datetime import datetime

import numpy as np
import pytest

from lodestack.functions import cron, embedding, html, paths
from lodestack.functions import json as J
from lodestack.operators import chunking, retry
from lodestack.operators import relational as R
from lodestack.operators import retrieval as V
from lodestack.operators import windows as W
from lodestack.plans import pipeline
from lodestack.sources import files, sql, writers
from pyspark.sql import functions as F


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return out.getvalue()


def test_splitter():
    text = "This is a test text for splitting. It is long enough to be cut into several pieces. Ok."
    for size, overlap in ((20, 0), (30, 20), (10, 3)):
        pieces = chunking.split(text, size, overlap)
        assert all(len(p) <= size for p in pieces) and all(w in " ".join(pieces) for w in text.split())
    assert chunking.split("", 10, 0) == [] and chunking.split("a" * 25, 10, 0) == ["a" * 10, "a" * 10, "a" * 5]
    assert chunking.split("one two\n\nthree", 8, 0) == ["one two", "three"]
    with pytest.raises(ValueError):
        chunking.split("x", 5, 6)


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, "a b c d e", "H:"), (2, None, "H:"), (3, "", None)], "key long, text string, chunk string")
    got = chunking.chunks(df, "key", "text", 3, 0, "chunk", "q: ").collect()
    assert [(r.key, r.chunk_ix, r.chunk) for r in got] == [(1, 0, "q: H:a b"), (1, 1, "q: H:c d"), (1, 2, "q: H:e")]


def test_json_repair_and_paths():
    assert J.parse('Here it is:\n```json\n{"a": [1, 2], "b": {"c": "x"}}\n```') == {"a": [1, 2], "b": {"c": "x"}}
    assert J.parse('{"a": [1, 2, "thr') == {"a": [1, 2]} and J.parse('{"a": 1, "b') == {"a": 1}  # an unfinished string is dropped
    assert J.close('{"a": {"b": [1, ') == '{"a": {"b": [1]}}'
    assert J.parse('{"a": 1, "b":') is None and J.parse("no") is None
    value = {"a": {"b": [{"c d": 5}]}}
    assert J.get(value, "a.b[0]['c d']") == "5" and J.get(value, "a.x") == "" and J.get(value, "a.b") == '[{"c d": 5}]'
    assert J.substitute("v=${a.b[0]['c d']} ${none}", value) == "v=5 ${none}"


def test_html():
    page = "<nav>no</nav><article><h1>Top</h1><p>A <b>bold</b> <a href='/x'>link</a>[3]<img src='data:x'></p><ul><li>one<li>two</ul><p style='display: none'>no</p><a href='%s'>far</a></article><p>out</p>" % ("/y" * 120)
    assert html.to_markdown(page, "https://a.example") == "# Top\n\nA **bold** [link](https://a.example/x)\n\n- one\n- two\nfar"
    assert html.to_markdown("") == ""


def test_office_files(spark, tmp_path):
    doc = archive(word__document_xml="<w xmlns:w='u'><w:p><w:t>Hello </w:t><w:t>there</w:t></w:p><w:p><w:t>Again</w:t></w:p></w>")
    (tmp_path / "a.docx").write_bytes(doc)
    sheets = {"xl__workbook_xml": "<w><sheet name='One'/><sheet name='Two'/></w>", "xl__worksheets__sheet1_xml": "<s><row><c r='A1' t='inlineStr'><is><t>x, y</t></is></c><c r='C1'><v>3</v></c></row></s>", "xl__worksheets__sheet2_xml": "<s/>"}
    (tmp_path / "b.xlsx").write_bytes(archive(**sheets))
    (tmp_path / "c.mbox").write_bytes(b"From a@b Thu Jan 1 00:00:00 2026\nSubject: Hi\n\nBody one\n\nFrom a@b Thu Jan 1 00:00:00 2026\nSubject: Empty\n\n\n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.weird").write_bytes(bytes(range(9)) * 50)
    (tmp_path / "f.weird").write_text("plain text")
    got = {(r.path.rsplit("/", 1)[1], r.part): (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx", ""][0] == "Hello there\n\nAgain" and got["b.xlsx", "One"][0] == '"x, y",,3' and got["c.mbox", "Hi"][0] == "Body one"
    assert "converter" in got["d.pdf", None][1] and "unknown" in got["e.weird", None][1] and got["f.weird", ""][0] == "plain text" and len(got) == 6
    assert files.merge_sheets([("One", "a,b")]) == "\nSheet: One\na,b"
    namespaces = {r.namespace for r in files.ingest_folders(spark, {"x": str(tmp_path)}).collect()}
    assert namespaces == {"x"}


def test_tables():
    assert files.sniff("a;b,c;d") == ";" and files.sniff("a") == "," and files.read_table('a,b\n\n"x, y",2\n') == [["a", "b"], ["x, y", "2"]]


def test_connection_strings():
    c = sql.parse_connection("mysql://us%40er:p%2Fw@h1:3307,h2/db?ssl=true&x=a%20b")
    assert c == {"scheme": "mysql", "username": "us@er", "password": "p/w", "hosts": [{"host": "h1", "port": 3307}, {"host": "h2", "port": None}], "endpoint": "db", "options": {"ssl": "true", "x": "a b"}}
    assert sql.jdbc_options("mssql://u:p@h/db", "select 1")["url"] == "jdbc:sqlserver://h:1433;databaseName=db"
    with pytest.raises(ValueError):
        sql.parse_connection("nothing")


@pytest.mark.parametrize("bad", ["drop table x", "select 1; select 2", "insert into t values (1)", "with a as (select 1) insert into t select * from a", "/* select */ delete from t", "set x=1"])
def test_only_selects(spark, bad):
    with pytest.raises(sql.NotReadOnly):
        sql.run_select(spark, bad)
    assert sql.answer(spark, bad)["error"]


def test_select_answers(spark):
    assert sql.answer(spark, "select 'drop; table' as a -- note\n;") == {"rows": [{"a": "drop; table"}], "count": 1, "error": None}


def test_cron():
    assert cron.is_valid("*/5 0-3 * jan mon-fri") and not cron.is_valid("61 * * * *") and not cron.is_valid("* * *")
    assert cron.next_run("30 9 * * 1", datetime(2026, 1, 1, 10)) == datetime(2026, 1, 5, 9, 30)
    assert cron.next_run("0 0 29 2 *", datetime(2026, 1, 1)) == datetime(2028, 2, 29)
    assert cron.shift_to_utc("30 1 * * 2", 120) == "30 23 * * 2" and cron.shift_to_utc("*/5 1 * * *", 60) == "*/5 1 * * *"


@pytest.mark.parametrize(("outer", "inner", "want"), [("/a", "/a/b", True), ("/a", "/a", False), ("/a", "/a/../b", False), ("/a", "/ab", False), ("/a", "a/b", False)])
def test_paths(outer, inner, want):
    assert paths.is_within(outer, inner) is want
    assert paths.normalise("../../x/./y") == "x/y"


def test_embedding(spark):
    df = embedding.embed(spark.createDataFrame([("a b",), (None,), ("",)], "t string"), "t").collect()
    assert abs(np.linalg.norm(df[0].embedding) - 1) < 1e-6 and df[1].embedding is None and not any(df[2].embedding)


def test_search_forms_agree_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [("n", i, rng.standard_normal(8).tolist()) for i in range(200)] + [("n", 900, [0.0] * 8)]
    v = spark.createDataFrame(rows + [("n", 201, rows[3][2])], "namespace string, vec_id long, embedding array<double>")
    q = v.filter("vec_id in (3, 5)").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = v.crossJoin(q.select("query_id", F.col("embedding").alias("q"))).select("query_id", "vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("d")).collect()
    for n in (3, 5):
        want = sorted((1e9 if r.d is None else r.d, r.vec_id) for r in pairs if r.query_id == n)
        for top in (5, 500):
            got = V.nearest(v.repartition(3), q, top).filter(f"query_id = {n}").orderBy("place").collect()
            assert [r.vec_id for r in got] == [i for _, i in want[:top]]
    assert got[-1].distance is None and V.search(v, q, 500, None).filter("vec_id = 900 and score = 0").count() == 2
    mine = q.withColumn("namespace", F.when(F.col("query_id") == 3, "n").otherwise("other"))
    assert {r.query_id for r in V.search(v, mine, 5, None, same_namespace=True).collect()} == {3}
    assert V.search(v, q.limit(0), 5).count() == 0 and V.search(v.limit(0), q, 5).count() == 0


def test_backfill_takes_hits_first_then_newest_history(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, "a", 1), ("q", 2, 0.8, "b", 2)], "key string, id long, score double, text string, place long")
    past = [("q", 2, 0.5, "b", 9, 0), ("q", 3, 0.5, "c", 7, 0), ("q", 4, 0.5, "d", 8, 0), ("q", 5, None, "e", 9, 0), ("q", 6, 0.5, None, 9, 0), ("q", 7, 0.5, "g", 9, 0), ("r", 1, 0.4, "z", 1, 0)]
    history = spark.createDataFrame(past, "key string, id long, score double, text string, turn long, place long")
    pinned = spark.createDataFrame([("q", 7)], "key string, id long")
    got = {(r.key, r.id, r.origin) for r in V.backfill(hits, history, 3, pinned).collect()}
    assert got == {("q", 1, 0), ("q", 2, 0), ("q", 4, 1), ("r", 1, 1)}
    assert V.backfill(hits.limit(0), history.limit(0), 3).count() == 0


def test_rerank(spark):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(["risk vault", "vault", "risk vault", "none"])], "k string, id long, text string")
    got = V.rerank(df, V.overlap_score(F.lit("the risk and the vault"), F.col("text")), ["k"], 3).orderBy("place").collect()
    assert [r.id for r in got] == [0, 2, 1] and got[0].score == got[1].score == 0.5


def test_similarity_of_distances(spark):
    df = spark.createDataFrame([(None,), (1.4,), (-0.2,), (0.3,)], "d double").select(V.similarity(F.col("d")).alias("s"), V.similarity(F.col("d"), True).alias("c"))
    assert [(round(r.s, 6), round(r.c, 6)) for r in df.collect()] == [(0, 0), (-0.4, 1), (0.8, 0.8), (0.7, 0.7)]


def test_rolling_count_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), int(t)) for i, t in enumerate(rng.integers(0, 500, 300))] + [(999, 1, None)]
    df = spark.createDataFrame(rows, "id long, k long, s long")
    got = {r.id: r.recent for r in W.rolling_count(df, ["k"], F.col("s") * 1_000_000, 60).collect()}
    assert got == {i: (None if s is None else sum(k2 == k and s2 is not None and s - 60 <= s2 <= s for _, k2, s2 in rows)) for i, k, s in rows}


def test_budget_sessions_changes(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 5, 5, None, 5])], "k string, i long, c long")
    assert [r.i for r in W.within_budget(df, ["k"], "i", F.col("c"), 11, 2).orderBy("i").collect()] == [0, 1, 2]
    assert [r.session for r in W.sessions(df, ["k"], F.when(F.col("i") > 2, F.col("i") + 100).otherwise(F.col("i")) * 1_000_000, 10, "i").orderBy("i").collect()] == [0, 0, 0, 1, 1]
    assert [r.i for r in W.changes(df.withColumn("t", F.timestamp_seconds(F.col("i") * 2_000_000)), ["k"], "t", "i", F.col("c")).orderBy("i").collect()] == [3, 4]


def test_split_windows_equal_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 9, 200), strict=True))] + [(None, 900 + i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    sums = {r.i: r.s for r in W.running_sum(df, ["k"], F.floor(F.col("i") / 17), ["i"], F.col("v"), "s").collect()}
    back = {r.i: r.p and r.p.value for r in W.previous(df, ["k"], F.floor(F.col("i") / 17), ["i"], F.col("v"), "p").collect()}
    for k, i, _ in rows:
        earlier = [v for k2, j, v in rows if k2 == k and j < i]
        assert sums[i] == sum(earlier) and back[i] == (earlier[-1] if earlier else None)


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (2, "c", 5), (3, None, 7)], "k long, v string, n long")
    assert R.where(df, n=None, v=R.ABSENT).count() == 1 and R.where(df, k=[1, 3]).count() == 2
    assert R.page(df, [F.asc("k"), F.asc("v")], -1, 1).collect()[0].v == "b"
    assert R.stable(df, ["k"], [F.asc("v")]).count() == 3
    merged = R.upsert(df, spark.createDataFrame([(2, "z", 0)], df.schema), ["k"])
    assert sorted(r.k for r in merged.collect()) == [1, 2, 3]
    first = R.first_delivery(df.withColumn("t", F.timestamp_seconds("n")), "k", "t")
    assert first.count() == 3 and first.columns == [*df.columns, "t"]
    done = retry.retry(df.select("k", F.lit(0).alias("n")), F.col("n") >= F.col("k"), lambda d: d.withColumn("n", F.col("n") + 1), 2)
    assert sorted((r.k, r.n) for r in done.collect()) == [(1, 1), (2, 2), (2, 2), (3, 2)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, 1, "user", "b"), (1, 1, 1, "user", "a"), (1, 0, 0, "system", None)], "workspace_id long, chat_id long, part long, role string, content string")
    writers.write_conversations(df, str(tmp_path / "c"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert sorted(lines)[0] == '{"workspace_id":1,"role":"system","content":null}' and len(lines) == 3
    writers.write_documents(df, str(tmp_path / "d"), {"id": "workspace_id", "pageContent": "content"})
    assert set(spark.read.json(str(tmp_path / "d")).columns) == {"id", "pageContent"}
    writers.write_vectors(df, str(tmp_path / "v"), "workspace_id")
    assert spark.read.parquet(str(tmp_path / "v")).filter("workspace_id = 1").count() == 2
    writers.write_drafts(df, "role", "content", str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).filter("value <> ''").count() == 2


def test_tools_and_summaries(spark):
    pipeline.tool("shout", "string")(lambda s: None if s is None else s.upper())
    pipeline.install(spark, "shout")
    assert spark.sql("select shout('a') as a").collect()[0].a == "A"
    assert pipeline.summarise("abcdefghij", 10, lambda t: t[-2:]) == "ij"


def test_repeats_are_dropped_after_filters(spark):
    from lodestack.operators.relational import Once

    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", None), (None, "c", 1), (None, "c", 1)], "id long, name string, n int")
    once = Once(df, "id")
    assert once.count() == 3 and once.filter("n > 2").select("id", "name").collect() == [(1, "a")]
    assert sorted(r.name for r in once.select(F.upper("name").alias("name")).collect()) == ["A", "B", "C"] and once.dropna(["n"]).count() == 2
    plan = once.filter(F.col("name") == "a").select("id", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
    assert Once(df.limit(0), "id").count() == 0


def test_holds_are_not_renewed(spark):
    from lodestack.operators import windows as W

    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, *range(400)]) if i % 40 == 0 else r.randrange(400)) for i in range(900)] + [(900 + i, "hot", i // 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, at long")
    got = {x.id: x.fresh for x in W.holds(df, ["key"], F.col("at"), F.lit(7), "id").collect()}
    want, last = {}, {}
    for i, k, at in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[0])):
        want[i] = k not in last or at - last[k] > 7
        last[k] = at if want[i] else last[k]
    assert got == want
    assert W.holds(df.limit(0), ["key"], F.col("at"), F.lit(7), "id").count() == 0


def test_answer_counts_the_whole_result(spark):
    from lodestack.sources import sql

    assert sql.answer(spark, "select id from range(25)", 10)["count"] == 25 and len(sql.answer(spark, "select id from range(25)", 10)["rows"]) == 10
    assert sql.answer(spark, "select id from range(4)")["count"] == 4


def test_slug_letters(spark):
    from lodestack.functions import text as X

    rows = [("Ärger & Straße",), ("Łódź œuvre, São João!",), (None,), ("",), ("Ελλ x",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(X.slug("t")).collect()] == ["arger-and-strasse", "lodz-oeuvre-sao-joao", None, "", "x"]
