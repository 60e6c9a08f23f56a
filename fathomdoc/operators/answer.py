"""From ranked hits to prompts, answers and source lists."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.config import DEFAULTS
from fathomdoc.functions import fixed, text as X
from fathomdoc.operators.admission import sliding_admission

GenerateFn = Callable[[Sequence[str]], Sequence[str]]


def limit_questions(df: DataFrame, query_id: str = "query_id", asked_at: str = "asked_at") -> DataFrame:
    """Adds ``retry_after``: null for questions that the limit of the whole service lets through, in order of their
    times, else seconds to wait. Every question counts, also one that is refused later. Ids are unique; questions
    without a time are not limited."""
    timed = df.filter(F.col(asked_at).isNotNull()).select(F.lit("all").alias("_service"), query_id, asked_at)
    decided = sliding_admission(timed, "_service", asked_at, query_id, DEFAULTS.question_rate_limit, DEFAULTS.rate_window_seconds, inclusive=True)
    return df.join(decided.filter("NOT admitted").select(query_id, "retry_after"), query_id, "left")


def classify_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds status and, where it is ok, the cleaned question; control characters go after the length checks.

    A question with a ``retry_after`` (see ``limit_questions``) is rate_limited, whatever else is wrong with it.
    """
    status = X.question_status(F.col(question))
    if "retry_after" in df.columns:
        status = F.when(F.col("retry_after").isNotNull(), "rate_limited").otherwise(status)
    return df.withColumn("status", status).withColumn(
        "clean_question", F.when(F.col("status") == "ok", X.sanitize(X.strip(F.col(question)))))


def refusal(status: Column, retry_after: Column | None = None) -> Column:
    """The answer to a question with a status other than ok."""
    answers = F.coalesce(*[F.when(status == name, text) for name, text in fixed.REFUSALS.items()])
    wait = F.lit("a few") if retry_after is None else F.coalesce(retry_after.cast("string"), F.lit("a few"))
    return F.replace(answers, F.lit("%s"), wait)


def context_of(content: str = "content", rank: str = "retrieval_rank") -> Column:
    """Aggregate: hit texts in rank order, joined by a blank line. Hits per query are at most top k."""
    ranked = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("t"))))
    return F.array_join(F.transform(ranked, lambda h: h["t"]), "\n\n")


def sources_of(size: int = DEFAULTS.source_snippet_chars, metadata: bool = False) -> Column:
    """Aggregate: array of a query's sources, best first; with the passages' ``metadata`` if asked for."""
    source = F.struct(
        F.col("retrieval_rank"),
        X.snippet(F.col("content"), size).alias("content"),
        X.source_or_unknown(F.col("source")).alias("source"),
        F.col("rerank_score"),
        *([F.col("metadata")] if metadata else []))
    # Sorted by the rank alone: metadata may be a map, which has no order.
    return F.transform(F.array_sort(F.collect_list(source), lambda a, b: a["retrieval_rank"] - b["retrieval_rank"]), lambda s: s)


def build_context(hits: DataFrame, content: str = "content", rank: str = "retrieval_rank") -> DataFrame:
    return hits.groupBy("query_id").agg(context_of(content, rank).alias("context"))


def rag_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(fixed.PROMPT_HEAD), context, F.lit(fixed.PROMPT_QUESTION), question,
                    F.lit(fixed.PROMPT_TAIL))


def build_prompts(questions: DataFrame, contexts: DataFrame, question: str = "question") -> DataFrame:
    """Questions with context and prompt; both null where nothing was retrieved."""
    return questions.join(contexts, "query_id", "left").withColumn(
        "prompt", rag_prompt(F.col("context"), F.col(question)))


def ranked_sources(hits: DataFrame, size: int = DEFAULTS.source_snippet_chars) -> DataFrame:
    return hits.groupBy("query_id").agg(sources_of(size).alias("sources"))


def extractive_answers(prompts: Sequence[str]) -> list[str]:
    """Stand-in for a model: the first passage of the context."""
    bodies = (p.removeprefix(fixed.PROMPT_HEAD).split(fixed.PROMPT_QUESTION)[0] for p in prompts)
    return [b.split("\n\n")[0] for b in bodies]


def _answers(fn: GenerateFn, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, failure) of a batch; where the function fails, each prompt is tried alone. The failure is for the job
    that runs this and is not shown to who asked."""
    try:
        return [(answer, None) for answer in fn(prompts)]
    except Exception as error:  # any model, any prompt
        if len(prompts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        return [a for p in prompts for a in _answers(fn, [p])]


def generate(prompts: DataFrame, fn: GenerateFn = extractive_answers, batch_size: int = 32) -> DataFrame:
    """Adds answer, trimmed, error and failure; rows without a prompt get the fixed message and are not sent to ``fn``.

    Where ``fn`` fails, the answer is a fixed message, ``error`` is internal_error and ``failure`` says what happened.

    Not deterministic for the optimizer, so that no filter on the answer makes it twice.
    """

    @F.pandas_udf("answer string, failure string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            present = batch[batch.notna()]
            answers: list = []
            for start in range(0, len(present), batch_size):
                answers += _answers(fn, present.iloc[start:start + batch_size].tolist())
            made = pd.DataFrame([(a and a.strip(), f) for a, f in answers], columns=["answer", "failure"], index=present.index, dtype=object)
            yield made.reindex(batch.index).astype(object).where(lambda x: x.notna(), None)

    made = prompts.withColumn("_made", run.asNondeterministic()("prompt"))
    failed = F.col("_made.failure").isNotNull()
    return made.withColumns({
        "answer": F.when(failed, fixed.REFUSALS["internal_error"]).otherwise(F.coalesce("_made.answer", F.lit(fixed.NO_DOCUMENTS))),
        "error": F.when(failed, "internal_error"), "failure": F.col("_made.failure")}).drop("_made")


def template_table(spark, templates=fixed.TASK_TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "task string, head string, middle string, tail string")


def task_prompts(inputs: DataFrame, templates: DataFrame) -> DataFrame:
    """Prompt per input row (task, first_input, second_input) from templates, one per task; null for other tasks.

    Spark broadcasts the templates while they are below its own size threshold.
    """
    second = F.when(F.col("middle").isNotNull(), F.concat("middle", X.strip(F.coalesce("second_input", F.lit("")))))
    return (
        inputs.join(templates, "task", "left")
        .withColumn("prompt", F.concat("head", X.strip(F.col("first_input")), F.coalesce(second, F.lit("")), "tail"))
        .drop("head", "middle", "tail")
    )


def chat_requests(prompts: DataFrame, model: str = "default", max_tokens: int = 2000) -> DataFrame:
    """Adds the JSON body of a chat completion request."""
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    return prompts.withColumn("request", F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(max_tokens).alias("max_tokens"),
        F.lit(False).alias("stream"))))
