import datetime as dt

from hypothesis import given, settings, strategies as st
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomdoc.functions import payload as P, text as X
from fathomdoc.functions.scoring import retry_after
from fathomdoc.operators import admission as AD, history as H, limits as L, skew, sqltool as Q, trace as TR
from fathomdoc.operators.admission import Rule, cuts, decide, sliding_admission
from fathomdoc.operators.sqltool import without_comments
from fathomdoc.streaming import jobs

START = dt.datetime(2024, 1, 1)


def plain(times, rule):
    memory, out = [], []
    for t in times:
        memory = [m for m in memory if not rule.expired(m, t)]
        out.append(None if len(memory) < rule.limit else memory[0])
        if out[-1] is None:
            memory.append(t)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120), st.integers(1, 4), st.integers(1, 40), st.booleans(),
       st.integers(0, 120))
def test_blocks_decide_like_a_plain_loop(times, limit, window, inclusive, split):
    """Also when the key's times are spread over two tasks, and blocks are tiny."""
    times, rule = np.sort(np.array(times, dtype=np.int64)), Rule(limit, window, inclusive)
    sizes, (AD.MIN_BLOCK, AD.MAX_BLOCK) = (AD.MIN_BLOCK, AD.MAX_BLOCK), (3, 11)
    try:
        out, memory = [], []
        for part, starts in ((times[:split], True), (times[split:], split == 0)):
            for a, b, fresh in cuts(part, rule, starts) if len(part) else []:
                memory = part[max(0, a - limit):a].tolist() if fresh else memory
                begins, ends, oldest, memory = decide(part[a:b], rule, list(memory))
                block = [None] * (b - a)
                for x, y, o in zip(begins, ends, oldest):
                    block[x:y] = [o] * (y - x)
                out += block
    finally:
        AD.MIN_BLOCK, AD.MAX_BLOCK = sizes
    assert out == plain(times.tolist(), rule)


def arrivals(spark, seconds, client="c"):
    rows = [(client, START + dt.timedelta(seconds=s), n) for n, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long")


@pytest.mark.parametrize("seconds, service, client", [
    ([0, 10, 20], "yyn", "yyn"), ([0, 10, 60], "yyn", "yyy"), ([0, 10, 50, 61], "yyny", "yyny")])
def test_admission_rules(spark, seconds, service, client):
    for expected, inclusive in ((service, True), (client, False)):
        rows = sliding_admission(arrivals(spark, seconds), "client", "ts", "id", 2, 60, inclusive).orderBy("id").collect()
        assert "".join("y" if r.admitted else "n" for r in rows) == expected


def test_admission_with_one_hot_client(spark):
    """A third of all requests from one client, some at one instant; blocks far smaller than its share."""
    rng = np.random.default_rng(3)
    rows = [("hot" if n % 3 == 0 else f"c{n % 50}", START + dt.timedelta(seconds=int(s)), n)
            for n, s in enumerate(rng.integers(0, 40000, 6000))]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, id long").repartition(8)
    sizes, (AD.MIN_BLOCK, AD.MAX_BLOCK) = (AD.MIN_BLOCK, AD.MAX_BLOCK), (16, 64)
    try:
        found = {r.id: (r.admitted, r.retry_after) for r in
                 sliding_admission(df, "client", "ts", "id", 3, 60).collect()}
    finally:
        AD.MIN_BLOCK, AD.MAX_BLOCK = sizes
    assert len(found) == len(rows)
    rule = Rule(3, 60, False)
    for client in {r[0] for r in rows}:
        own = sorted((int((ts - START).total_seconds()), n) for c, ts, n in rows if c == client)
        for (t, n), oldest in zip(own, plain([t for t, _ in own], rule)):
            assert found[n] == ((True, None) if oldest is None else (False, max(0, oldest + 60 - t + 1)))


def test_retry_after(spark):
    row = spark.range(1).select(retry_after(F.lit(0), F.lit(20_500_000), 60, False),
                                retry_after(F.lit(0), F.lit(20_500_000), 60, True),
                                retry_after(F.lit(None).cast("long"), F.lit(0), 60, True)).head()
    assert tuple(row) == (39, 40, None)


def test_request_rate_counts_edges(spark):
    df = arrivals(spark, [0, 0, 30, 60, 61, 500])
    for inclusive, expected in ((True, [2, 2, 3, 4, 3, 1]), (False, [2, 2, 3, 2, 3, 1])):
        rows = L.request_rate(df, "client", "ts", 60, inclusive).orderBy("id").collect()
        assert [r.demand for r in rows] == expected


def test_running_total_and_last_items_cross_stretches(spark):
    df = spark.createDataFrame([("k", n, 1, str(n)) for n in (0, 1, 2, 50, 51, 120, 900)],
                               "key string, at long, one int, name string")
    totals = skew.running_total(df, ["key"], "at", "one", 10, "total").orderBy("at").collect()
    assert [r.total for r in totals] == list(range(1, 8))
    last = skew.last_items(df, ["key"], "at", F.col("name"), 4, 10, "last").orderBy("at").collect()
    assert last[-1]["last"] == ["50", "51", "120", "900"] and last[1]["last"] == ["0", "1"]
    left = spark.createDataFrame([("k", n) for n in range(50)], "key string, n int")
    right = spark.createDataFrame([("k", "v")], "key string, v string")
    assert skew.salted_join(left, right, ["key"], "left", F.col("n")).filter("v = 'v'").count() == 50


def admitted(spark, files):
    df = spark.createDataFrame([(1, n, *f) for n, f in enumerate(files)], "batch int, file_no int, file_name string, size long")
    return L.admit_batches(df).head()["reason"]


def test_upload_admission(spark):
    mib = 1024 * 1024
    assert admitted(spark, [("a.txt", 5 * mib)] * 10) is None
    assert admitted(spark, [("a.exe", 1)] * 11) == "file_count"
    assert admitted(spark, [("a.txt", 10 * mib), ("b.txt", 10 * mib + 1)]) == "file_size"
    assert admitted(spark, [("a.txt", 9 * mib)] * 6) == "total_size"
    assert admitted(spark, [("a.exe", 1), ("b.txt", 99 * mib)]) == "file_type"


GUARD = [
    ("SELECT 1", "SELECT 1"), ("select 1;", "select 1"), ("WITH t AS (SELECT 1) SELECT * FROM t", "WITH t AS (SELECT 1) SELECT * FROM t"),
    ("SELECT 1; SELECT 2", None), ("SELECT ';' AS c", None), ("SELECT updated_at FROM t", "SELECT updated_at FROM t"),
    ("SELECT a FROM t GROUP BY GROUPING SETS ((a),())", "SELECT a FROM t GROUP BY GROUPING SETS ((a),())"),
    ("SELECT * FROM t WHERE a = 'update'", None), ("SELECT a INTO b FROM t", None), ("SELECT a FROM t FOR UPDATE", None),
    ("(SELECT 1)", None), ("VALUES (1)", None), ("EXPLAIN SELECT 1", None),
    ("SELECT /* drop /* x */ y */ 1", "SELECT   1"), ("SELECT 1 -- drop", "SELECT 1"), ("SELECT '-- keep'", "SELECT '-- keep'"),
    ("ＳＥＬＥＣＴ 1", "SELECT 1"), ("SELECT é", None), ("SELECT " + "1" * 19993, "SELECT " + "1" * 19993),
    ("SELECT " + "1" * 19994, None), ("", None), ("  ", None), ("-- only", None), (None, None),
]


def test_guard(spark):
    rows = Q.validate_select(spark.createDataFrame([(s,) for s, _ in GUARD], "sql string")).collect()
    assert [(r.sql, r.normalised) for r in rows] == GUARD
    for sql, normalised in GUARD[:-1]:
        if normalised is None:
            with pytest.raises(ValueError):
                Q.read_only_sql(spark, sql)
    with pytest.raises(ValueError):
        Q.read_only_sql(spark, "SELECT reflect('java.lang.System', 'nanoTime')")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a'\"-/* \n", max_size=30))
def test_comments_leave_quoted_text(text):
    bare = without_comments(text)
    assert len(bare) <= len(text)
    if "--" not in text and "/*" not in text:
        assert bare == text


def test_comment_forms():
    assert without_comments("a -- b\nc") == "a  c" and without_comments("a /* b") == "a  "
    assert without_comments("'it''s -- x' /* /* */ */ \"/* y\"") == "'it''s -- x'   \"/* y\""


def test_row_cap(spark):
    assert [Q.row_limit(n) for n in (None, 0, -1, 10, 500)] == [200, 200, 200, 10, 200]
    for n, expected in ((10, (10, False)), (9, (9, True))):
        rows, summary = Q.cap_rows(spark.range(10), n)
        assert (rows.count(), summary.head()["truncated"]) == expected
    rows, summary = Q.guarded_sql(spark, "SELECT id FROM range(100) WHERE id >= :low", {"low": 98}, 1)
    assert rows.columns == ["id"] and tuple(summary.head())[2:] == (1, True, 1) and summary.head()["columns"] == ["id"]


def test_json_safe(spark):
    df = spark.sql("SELECT 1.50BD AS d, TIMESTAMP_NTZ '2024-01-01 00:00:00.5' AS t, DATE '2024-01-02' AS day, NULL AS n, 'x' AS s")
    assert Q.json_safe(df).head()[0] == (
        '{"d":"1.50","t":"2024-01-01 00:00:00.500000","day":"2024-01-02","n":null,"s":"x"}')


def test_tool_payloads(spark):
    cases = [('{"error":"E","detail":"D"}', "E: D"), ('{"error":"E"}', "E"), ('{"error":""}', None), ("[1]", None),
             ("x", None), ('{"error":"E"} x', None), ('{"error":3,"detail":0}', "3"), (None, None)]
    rows = TR.parse_tool_results(spark.createDataFrame([(c,) for c, _ in cases], "result string")).collect()
    assert [(r.result, r.error) for r in rows] == cases and [r.ok for r in rows] == [e is None for _, e in cases]
    args = TR.parse_tool_arguments(spark.createDataFrame([('{"a":1,"b":"x"}',), ("{bad",), ("[1]",)], "arguments string"))
    assert [r.args for r in args.collect()] == [{"a": "1", "b": "x"}, {}, {}]
    blocks = spark.range(1).select(P.blocks_text(F.array(F.lit('{"text":"a"}'), F.lit('{"n":1}'))))
    assert blocks.head()[0] == 'a\n{"n":1}'
    names = spark.createDataFrame([("DataError",), ("Other",)], "c string").select(X.error_label(F.col("c")))
    assert [r[0] for r in names.collect()] == ["Invalid data format", "Database operation failed"]


def test_client_identity(spark):
    rows = spark.createDataFrame([(" 1.2.3.4 ", "p"), ("", "p"), (None, "p"), (None, None)], "h string, p string")
    assert [r[0] for r in rows.select(X.client_identity(F.col("h"), F.col("p"))).collect()] == [
        "1.2.3.4", "p", "p", "unknown"]


def test_history(spark):
    df = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(6)],
                               "conv_id long, turn long, role string, text string")
    last = H.recent_context(df).filter("turn = 5").head()["context"]
    assert last == "user: m2\nassistant: m3\nuser: m4\nassistant: m5"
    asked = H.contextual_questions(df).orderBy("turn").head()["question"]
    assert asked == "Context: user: m0\n\nQuestion: m0"
    assert H.contextual_questions(df, remember=False).orderBy("turn").head()["question"] == "m0"
    assert H.unpack_history(H.pack_history(df, 4)).count() == 6


def test_service_rule_with_one_key_of_a_million_requests(spark):
    """One key over all partitions: its chains are numbered across them without a window over its blocks."""
    rng = np.random.default_rng(11)
    steps = rng.integers(0, 3, 1_000_000)
    steps[::40_000] += 100
    df = spark.range(0, 1_000_000, 1, 16).select(F.lit("all").alias("client"), F.col("id"))
    times = spark.createDataFrame(pd.DataFrame({"id": np.arange(1_000_000), "at": np.cumsum(steps)}))
    df = df.join(times, "id").withColumn("ts", F.timestamp_micros(F.col("at") * 1_000_000).cast("timestamp_ntz"))
    found = sliding_admission(df, "client", "ts", "id", 10, 20, inclusive=True)
    plan = found._jdf.queryExecution().toString()
    assert "windowspecdefinition(client" not in plan
    rows = found.select("event_id" if "event_id" in found.columns else "id", "admitted").toPandas().sort_values("id")
    rule = Rule(10, 20, True)
    expected = [o is None for o in plain(np.cumsum(steps).tolist(), rule)]
    assert rows["admitted"].tolist() == expected and 0 < sum(expected) < 1_000_000


def batches(spark, folder, frames):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)


def test_state_of_a_client_goes_after_its_window(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    schema = "client string, id long, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    rows = lambda client, seconds, first: spark.createDataFrame(
        [(client, first + i, start + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], schema)
    batches(spark, f"{tmp_path}/in", [rows("a", [0, 1, 2, 30], 0), rows("b", [10, 500], 10), rows("c", [900], 20), rows("c", [1500], 21)])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = jobs.admission_stream(source, "client", "ts", "id", 2, 60, lateness="5 seconds")
    jobs.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    decided = {r.id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert decided == {0: True, 1: True, 2: False, 3: False, 10: True, 11: True, 20: True, 21: True}
    held = spark.read.format("statestore").option("stateVarName", "admitted").load(f"{tmp_path}/checkpoint")
    assert [r.key.client for r in held.select("key").collect()] == ["c"]


@pytest.mark.parametrize("stretch", [1, 2, 4, 1024])
def test_messages_without_text_have_a_place(spark, stretch):
    texts = ["t0", None, "t2", "t3", "t4", None, None, "t7"]
    df = spark.createDataFrame([(1, n, "u", t) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    found = {r.turn: r.context for r in H.recent_context(df, stretch=stretch).collect()}
    assert found[7] == "u: t4\nu: t7" and found[3] == "u: t0\nu: t2\nu: t3" and found[1] == "u: t0"


def test_history_stream_equals_batch_form(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, n, "u", None if (c + n) % 3 == 0 else f"{c}.{n}") for n in range(9) for c in (1, 2)]
    batches(spark, f"{tmp_path}/in", [spark.createDataFrame(rows[at:at + 6], schema) for at in range(0, 18, 6)])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_to_table(jobs.history_stream(source), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    batch = H.recent_context(spark.createDataFrame(rows, schema)).select("conv_id", "turn", "context")
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(batch.collect())
