"""Registered queries over events, conversations and tool traces."""

from pyspark.sql import functions as F

from fathomdoc.functions import fixed, payload as P, scoring, text as X
from fathomdoc.operators import answer as A, history as H, limits as L, trace as TR
from fathomdoc.operators.admission import sliding_admission
from fathomdoc.operators.skew import top_per_group
from fathomdoc.plans import sql_parts as S
from fathomdoc.plans.registry import query, table
from fathomdoc.session import spread, work_folder
from fathomdoc.streaming import jobs

DAY, HOUR = 86_400, 3_600


def events(spark, folder):
    return table(spark, folder, "events")


def conversations(spark, folder):
    return table(spark, folder, "conversations")


def admission_sql(key: str, limit: int, window: int, inclusive: bool) -> str:
    keep = ">=" if inclusive else ">"
    us = window * 1_000_000
    kept = f"list_filter(w.kept, lambda x: x {keep} o.t - {us})"
    return f"""WITH RECURSIVE o AS (
  SELECT {key} AS client, event_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT client, n, event_id, t, [t] AS kept, true AS admitted, NULL::BIGINT AS oldest FROM o WHERE n = 1
  UNION ALL
  SELECT o.client, o.n, o.event_id, o.t,
    CASE WHEN len({kept}) < {limit} THEN list_append({kept}, o.t) ELSE {kept} END,
    len({kept}) < {limit}, CASE WHEN len({kept}) >= {limit} THEN ({kept})[1] END
  FROM walk w JOIN o ON o.client = w.client AND o.n = w.n + 1)
SELECT client, event_id, admitted,
  greatest(0, CAST(trunc((oldest + {us} - t) / 1000000.0) AS BIGINT) + {0 if inclusive else 1}) AS retry_after
FROM walk"""


# greatest() skips nulls in both engines, so admitted requests need the null back.
def refused_only(sql: str) -> str:
    return f"SELECT client, event_id, admitted, CASE WHEN NOT admitted THEN retry_after END AS retry_after FROM ({sql})"


CLIENT_RULE = refused_only(admission_sql("user_id", 2, DAY, False))
SERVICE_RULE = refused_only(admission_sql("'all'", 10, HOUR, True))


@query("j2_f6_i22_client_admission", CLIENT_RULE)
def client_admission(spark, folder):
    return sliding_admission(events(spark, folder), "user_id", "ts", "event_id", 2, DAY).drop("at_us")


@query("j1_f6_i22_service_admission", SERVICE_RULE)
def service_admission(spark, folder):
    one = events(spark, folder).withColumn("service", F.lit("all"))
    return sliding_admission(one, "service", "ts", "event_id", 10, HOUR, inclusive=True).drop("at_us")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def streamed(spark, stream, name):
    """Runs a stream to its end into a table of the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    target = work_folder(spark, name)
    jobs.run_to_table(stream, target, f"{target}-checkpoint").awaitTermination()
    return spark.read.parquet(target)


@query("j2_client_admission_stream", CLIENT_RULE)
def client_admission_stream(spark, folder):
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", 1).parquet(folder)
    decided = streamed(spark, jobs.admission_stream(source, "user_id", "ts", "event_id", 2, DAY), "admission")
    return decided.select("client", "event_id", "admitted", F.when(
        ~F.col("admitted"), scoring.retry_after(F.col("oldest"), F.col("t"), DAY, True)).alias("retry_after"))


def in_files(rows, order, files):
    """The rows written as so many files of rising order, one after the other, as they would arrive; the folder."""
    target = work_folder(rows.sparkSession, "arrivals")
    at = F.unix_micros(F.col(order).cast("timestamp")) if "timestamp" in dict(rows.dtypes)[order] else F.col(order)
    shares = [n / files for n in range(1, files)]
    edges = rows.agg(F.percentile_approx(at, F.array(*map(F.lit, shares)), F.lit(10_000))).first()[0]
    part = sum((F.when(at > edge, 1).otherwise(0) for edge in edges), F.lit(0))
    for n in range(files):
        rows.filter(part == n).coalesce(1).write.mode("append").parquet(target)
    return target


@query("j1_service_admission_stream", SERVICE_RULE)
def service_admission_stream(spark, folder):
    """The whole-service rule over four files, one batch each; with event time, so its state goes after a window."""
    arrivals = in_files(events(spark, folder).select("event_id", "ts"), "ts", 4)
    source = spark.readStream.schema("event_id bigint, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(arrivals)
    decided = streamed(spark, jobs.admission_stream(source.withColumn("service", F.lit("all")), "service", "ts", "event_id", 10, HOUR,
                                                    inclusive=True, lateness="1 hour"), "service-admission")
    return decided.select("client", "event_id", "admitted", F.when(
        ~F.col("admitted"), scoring.retry_after(F.col("oldest"), F.col("t"), HOUR, False)).alias("retry_after"))


@query("f5_demand_inclusive", f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN {DAY * 1_000_000} PRECEDING AND CURRENT ROW) AS demand FROM events""")
def demand_inclusive(spark, folder):
    return L.request_rate(events(spark, folder), "user_id", "ts", DAY, inclusive=True).select("event_id", "demand")


@query("f5_demand_exclusive", f"""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
  RANGE BETWEEN {HOUR * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS demand FROM events""")
def demand_exclusive(spark, folder):
    return L.request_rate(events(spark, folder), "event_type", "ts", HOUR, inclusive=False).select("event_id", "demand")


@query("j3_client_identity", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id
  WHEN user_id % 3 = 1 THEN 'peer-' || user_id ELSE 'unknown' END AS client FROM events""")
def client_identity(spark, folder):
    user = F.col("user_id")
    real_ip = F.when(user % 3 == 0, F.concat(F.lit("  10.0.0."), user, F.lit(" "))).when(user % 3 == 1, "")
    peer = F.when(user % 3 != 2, F.concat(F.lit("peer-"), user))
    return events(spark, folder).select("event_id", X.client_identity(real_ip, peer).alias("client"))


@query("g9_recent_rows_per_service", """SELECT event_type, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 200""")
def recent_rows_per_service(spark, folder):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    newest = top_per_group(events(spark, folder), ["event_type"], order, 200, "age", F.col("event_id"))
    return newest.select("event_type", "event_id", F.col("age").cast("bigint").alias("age"))


CONTEXT = """string_agg(role || ': ' || text, chr(10)) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""


@query("f3_i25_recent_context", f"SELECT conv_id, turn, {CONTEXT} AS context FROM conversations")
def recent_context(spark, folder):
    return H.recent_context(conversations(spark, folder)).select("conv_id", "turn", "context")


@query("f3_recent_context_in_stretches", f"SELECT conv_id, turn, {CONTEXT} AS context FROM conversations")
def recent_context_in_stretches(spark, folder):
    """Two turns per stretch, as if every conversation were far longer than a stretch."""
    return H.recent_context(conversations(spark, folder), stretch=2).select("conv_id", "turn", "context")


# Every fifth message has no text: it counts as one of the last four, but has no line.
GAPS = "(SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 <> 0 THEN text END AS text FROM conversations)"
GAPPED = f"SELECT conv_id, turn, coalesce({CONTEXT}, '') AS context FROM {GAPS}"


def gapped(spark, folder):
    text = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.col("text"))
    return conversations(spark, folder).select("conv_id", "turn", "role", text.alias("text"))


@query("f3_recent_context_without_texts", GAPPED)
def recent_context_without_texts(spark, folder):
    return H.recent_context(gapped(spark, folder), stretch=3).select("conv_id", "turn", "context")


@query("j5_history_stream", GAPPED)
def history_stream(spark, folder):
    """Over three files of rising turns, one batch each."""
    arrivals = in_files(gapped(spark, folder), "turn", 3)
    source = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").option(
        "maxFilesPerTrigger", 1).parquet(arrivals)
    return streamed(spark, jobs.history_stream(source), "history")


@query("c13_i17_contextual_questions", f"""SELECT conv_id, turn, 'Context: ' || context || chr(10) || chr(10) || 'Question: ' || text
  AS question FROM (SELECT *, {CONTEXT} AS context FROM conversations) WHERE role = 'user'""")
def contextual_questions(spark, folder):
    return H.contextual_questions(conversations(spark, folder)).select("conv_id", "turn", "question")


@query("g8_last_messages", """SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""")
def last_messages(spark, folder):
    return top_per_group(conversations(spark, folder), ["conv_id"], [F.col("turn").desc()], 4, "age",
                         F.col("turn")).select("conv_id", "turn", "role")


@query("e4_conversation_summary", """SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS questions
FROM conversations GROUP BY conv_id""")
def conversation_summary(spark, folder):
    return H.conversation_summary(conversations(spark, folder))


@query("b6_packed_history", """SELECT conv_id, CAST(turn // 256 AS INTEGER) AS segment, '[' || string_agg('{"turn":' || turn || ',"role":"' || role ||
  '","text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn) || ']' AS history FROM conversations
GROUP BY conv_id, turn // 256""")
def packed_history(spark, folder):
    return H.pack_history(conversations(spark, folder)).withColumn("segment", F.col("segment").cast("int"))


@query("b6_history_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def history_round_trip(spark, folder):
    return H.unpack_history(H.pack_history(conversations(spark, folder), segment=3))


def templates_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else S.quoted(v) for v in t) + ")" for t in fixed.TASK_TEMPLATES)
    return f"t(task, head, middle, tail) AS (VALUES {rows})"


@query("i18_i19_task_requests", f"""WITH {templates_sql()}, prompts AS (
  SELECT conv_id, turn, head || trim(text, E' \\n') || coalesce(middle || role, '') || tail AS prompt
  FROM conversations JOIN t ON task = CASE turn % 4 WHEN 0 THEN 'translate_ja_en' WHEN 1 THEN 'translate_en_ja'
    WHEN 2 THEN 'proofread' ELSE 'reply' END)
SELECT conv_id, turn, prompt, '{{"model":"default","messages":[{{"role":"user","content":' || CAST(to_json(prompt) AS VARCHAR) ||
  '}}],"max_tokens":2000,"stream":false}}' AS request FROM prompts""")
def task_requests(spark, folder):
    turn = F.col("turn") % 4
    task = (F.when(turn == 0, "translate_ja_en").when(turn == 1, "translate_en_ja").when(turn == 2, "proofread")
            .otherwise("reply"))
    inputs = conversations(spark, folder).select(
        "conv_id", "turn", task.alias("task"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("first_input"),
        F.concat(F.col("role"), F.lit("  ")).alias("second_input"))
    prompts = A.task_prompts(inputs, A.template_table(spark))
    return A.chat_requests(prompts).select("conv_id", "turn", "prompt", "request")


# One tool call per event; its result is made from the event.
K = "CAST(json_extract(props, '$.k') AS BIGINT)"
CALLS = f"""calls AS (SELECT event_id, user_id, event_type AS name, {K} AS k,
  CASE WHEN {K} % 5 = 0 THEN 'E' || {K} || ': D' WHEN {K} % 5 = 1 THEN 'E' || {K} END AS error FROM events)"""


def calls(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    arguments = (
        F.when(k % 4 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(k % 4 == 1, F.substring("props", 1, 5))
        .otherwise(F.col("props")))
    return spread(events(spark, folder)).select(
        F.concat(F.lit("call-"), "event_id").alias("tool_call_id"), "event_id", "user_id",
        F.col("event_type").alias("name"), arguments.alias("arguments"))


def results(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    error = F.concat(F.lit('{"error": "E'), k, F.lit('"'))
    result = (
        F.when(k % 5 == 0, F.concat(error, F.lit(', "detail": "D"}')))
        .when(k % 5 == 1, F.concat(error, F.lit(', "detail": ""}')))
        .when(k % 5 == 2, F.lit('{"error": "", "detail": "D"}'))
        .when(k % 5 == 3, F.concat(F.lit("["), error, F.lit("}]")))
        .otherwise(F.concat(error, F.lit("} and more"))))
    return spread(events(spark, folder)).select(
        F.concat(F.lit("call-"), "event_id").alias("tool_call_id"), k.alias("k"), result.alias("result"))


@query("d8_i12_i13_tool_trace", f"WITH {CALLS} SELECT event_id, name, k, error, error IS NULL AS ok FROM calls")
def tool_trace(spark, folder):
    trace = TR.match_calls(calls(spark, folder), TR.parse_tool_results(results(spark, folder)))
    return trace.select("event_id", "name", "k", "error", "ok")


@query("e5_failed_calls", f"WITH {CALLS} SELECT user_id, count(*) AS calls, bool_or(error IS NOT NULL) AS any_failed FROM calls GROUP BY user_id")
def failed_calls(spark, folder):
    trace = TR.match_calls(calls(spark, folder), TR.parse_tool_results(results(spark, folder)))
    return TR.trace_status(trace, "user_id")


@query("i14_tool_arguments", f"""SELECT event_id, CASE WHEN {K} % 4 < 2 THEN 0 ELSE 1 END AS n,
  CASE WHEN {K} % 4 >= 2 THEN CAST({K} AS VARCHAR) END AS k FROM events""")
def tool_arguments(spark, folder):
    return TR.parse_tool_arguments(calls(spark, folder)).select(
        "event_id", F.size("args").alias("n"), F.element_at("args", "k").alias("k"))


@query("i15_content_blocks", """SELECT event_id, 'first ' || event_type || chr(10) || props AS text FROM events""")
def content_blocks(spark, folder):
    first = F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit("first "), "event_type").alias("text")))
    return events(spark, folder).select("event_id", P.blocks_text(F.array(first, "props")).alias("text"))


@query("e6_readiness", """SELECT user_id, CASE WHEN bool_and(value < 90) THEN 'ready' ELSE 'partial' END AS readiness
FROM events GROUP BY user_id""")
def readiness(spark, folder):
    return TR.readiness(events(spark, folder).withColumn("up", F.col("value") < 90), "user_id", "up")


LABELS = " ".join(f"WHEN {S.quoted(k)} THEN {S.quoted(v)}" for k, v in fixed.ERROR_LABELS.items())
CLASSES = [*fixed.ERROR_LABELS, "SomethingElse"]


@query("i23_error_labels", f"""SELECT event_id, CASE [{', '.join(S.quoted(c) for c in CLASSES)}][event_id % {len(CLASSES)} + 1]
  {LABELS} ELSE {S.quoted(fixed.DEFAULT_ERROR_LABEL)} END AS label FROM events""")
def error_labels(spark, folder):
    name = F.get(F.array(*map(F.lit, CLASSES)), (F.col("event_id") % len(CLASSES)).cast("int"))
    return events(spark, folder).select("event_id", X.error_label(name).alias("label"))
