"""A self-correcting answer loop as a table of states, one row for each question.

A round retrieves for the open rows, gates them by their best score, answers
what passed, and validates.  Rows that fail are rewritten and go round again, up
to ``MAX_REWRITES`` times; what counts is the current round's outcome.

Models have three places in it.  A generation error stays with its question, and
the answer counts as empty.  A judge's score below ``VALID_SCORE`` fails an answer
with its feedback; where it fails itself, it judges nothing.  A rewriting model's
text is asked next; where it gives none, the prefix is.

With ``rounds_path`` each round's states are written there under a fingerprint of
the questions, and a loop that broke off goes on after the last whole round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import split_words, strip
from ..sources.tables import path_exists
from ..tracing import stage
from .ids import settle

MAX_REWRITES = 3
RERANKED_LIMIT, DENSE_LIMIT = 0.65, 0.05
VALID_SCORE = 0.5
#: What a rewriting model is asked.
REWRITE_PROMPT = "Сформулируй вопрос другими словами, чтобы ответ на него было легче найти. Вопрос: "
KEEP = 5
SORRY = "Извините, не удалось найти ответ."

CHUNK = "struct<chunk_id: string, text: string, dense_score: double, sparse_score: double, rerank_score: double>"


def rerank_chunks(chunks: Column, keep: int = KEEP) -> Column:
    """The best chunks by dense score; equal ones stay in their order."""
    placed = F.transform(chunks, lambda c, i: F.struct((-c["dense_score"]).alias("s"), i.alias("i"), c.alias("c")))
    ordered = F.array_sort(placed, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(a["i"] - b["i"]))
    return F.slice(F.transform(ordered, lambda x: x["c"]), 1, keep)


def _score(c: Column) -> Column:
    own = c["rerank_score"]
    return F.when(own.isNotNull() & (own != 0), own).otherwise(c["dense_score"])


def quality_gate(states: DataFrame) -> DataFrame:
    """(rewrite_count, reranked_chunks) with context, passed, and the count moved on.

    The limit is the rerankers' if the first chunk has such a score.  After the
    last rewrite everything with chunks passes.
    """
    chunks = F.col("reranked_chunks")
    best = F.array_max(F.transform(chunks, _score))
    limit = F.when(F.get(chunks, F.lit(0))["rerank_score"].isNotNull(), RERANKED_LIMIT).otherwise(DENSE_LIMIT)
    some = F.size(chunks) > 0
    low = ~some | ((best < limit) & (F.col("rewrite_count") < MAX_REWRITES))
    context = F.array_join(F.transform(chunks, lambda c: c["text"]), "\n\n")
    return states.withColumns(
        {
            "passed": ~low,
            "context": F.when(low, "").otherwise(context),
            "rewrite_count": F.col("rewrite_count") + low.cast("int"),
        }
    )


def rewritten(query: Column) -> Column:
    return F.concat(F.lit(P.REWRITE_PREFIX), query)


def answer_error(answer: Column) -> Column:
    """Why an answer isn't valid, or null."""
    n = F.size(split_words(answer))
    return F.when(n == 0, "empty answer").when(n < 3, "answer too short")


def finalize_state(answer: Column, chunks: Column) -> Column:
    """The answer, or else the best chunk up to its first full stop, or else an apology."""
    first = F.concat(F.split_part(F.get(chunks, F.lit(0))["text"], F.lit("."), F.lit(1)), F.lit("."))
    said = F.coalesce(answer, F.lit("")) != ""
    return strip(F.when(said, answer).when(F.size(chunks) > 0, first).otherwise(SORRY))


def rewritten_by(model: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """(q_id, query) with ``asked`` by a generator; by the prefix where it gives nothing."""

    def rewrite(rows: DataFrame) -> DataFrame:
        prompts = rows.select("q_id", F.concat(F.lit(REWRITE_PROMPT), "query").alias("query"), F.lit("").alias("context"))
        made = model(prompts).select("q_id", strip(F.col("answer")).alias("__made"))
        own = F.when(F.coalesce("__made", F.lit("")) != "", F.col("__made"))
        return rows.join(made, "q_id", "left").withColumn("asked", F.coalesce(own, rewritten(F.col("query")))).drop("__made")

    return rewrite


def _by_prefix(rows: DataFrame) -> DataFrame:
    return rows.withColumn("asked", rewritten(F.col("query")))


def _round(df: DataFrame, path: str | None, turn: int) -> DataFrame:
    """The states after a round: written to ``path``, or taken from there if they were before."""
    if path is None:
        return settle(df, "agent-answered")
    folder = f"{path}/round={turn}"
    if not path_exists(df.sparkSession, f"{folder}/_SUCCESS"):
        df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def run_agent(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    generate: Callable[[DataFrame], DataFrame],
    rewrite: Callable[[DataFrame], DataFrame] = _by_prefix,
    validate: Callable[[DataFrame], DataFrame] | None = None,
    rounds_path: str | None = None,
    tracer=None,
) -> DataFrame:
    """q_id, query, final_answer, rewrite_count, errors for every (q_id, query).

    ``retrieve`` maps (q_id, query) to (q_id, chunks); ``generate`` adds ``answer``
    to (q_id, query, context), and ``error`` if it likes; ``validate`` adds
    ``verdict`` (score, feedback) to (q_id, query, context, answer); ``rewrite``
    adds ``asked`` to (q_id, query).
    """
    none = F.array().cast("array<string>")
    open_rows = questions.select(
        F.col("q_id").cast("string"), "query", F.col("query").alias("asked"), F.lit(0).alias("rewrite_count"), none.alias("errors")
    )
    path = None
    if rounds_path:
        # one row
        mark = open_rows.agg(*[F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "q_id", "query")), F.lit(0)).alias(f"h{k}") for k in (1, 2)]).first()
        path = f"{rounds_path}/{mark['h1'] % 2**64:016x}{mark['h2'] % 2**64:016x}"
    closed: list[DataFrame] = []
    for turn in range(MAX_REWRITES + 1):
        done = path is not None and path_exists(questions.sparkSession, f"{path}/round={turn}/_SUCCESS")
        if done:
            state = questions.sparkSession.read.parquet(f"{path}/round={turn}")
        else:
            with stage(tracer, f"round {turn}") as run:
                state = run(_turn(open_rows, retrieve, generate, validate, turn), lambda df: _round(df, path, turn))  # noqa: B023
        closed.append(
            state.where("not again").select(
                "q_id",
                "query",
                finalize_state(F.col("answer"), F.col("reranked_chunks")).alias("final_answer"),
                F.least("rewrite_count", F.lit(MAX_REWRITES)).alias("rewrite_count"),
                "errors",
            )
        )
        left = state.where("again")
        if left.isEmpty():
            break
        asked = rewrite(left.select("q_id", "query")).select("q_id", "asked")
        open_rows = settle(left.select("q_id", "query", "rewrite_count", "errors").join(asked, "q_id"), "agent-asked")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def _turn(open_rows: DataFrame, retrieve, generate, validate, turn: int) -> DataFrame:
    """One round: (q_id, query, asked, rewrite_count, errors) with chunks, answer, and whether it goes round again."""
    found = retrieve(open_rows.select("q_id", F.col("asked").alias("query"))).select("q_id", "chunks")
    empty = F.array().cast(f"array<{CHUNK}>")
    state = open_rows.join(found, "q_id", "left").withColumn(
        "reranked_chunks", rerank_chunks(F.coalesce(F.col("chunks").cast(f"array<{CHUNK}>"), empty))
    )
    state = settle(quality_gate(state.drop("chunks")), "agent-gated")
    answered = generate(state.where("passed").select("q_id", F.col("asked").alias("query"), "context"))
    broken = F.col("error") if "error" in answered.columns else F.lit(None).cast("string")
    answered = settle(answered.select("q_id", "answer", broken.alias("broken")), "agent-generated")
    state = state.join(answered, "q_id", "left").withColumn("answer", F.when(F.col("broken").isNull(), F.col("answer")))
    judged = F.lit(None).cast("string")
    if validate is not None:
        plain = state.where(F.col("passed") & answer_error(F.coalesce("answer", F.lit(""))).isNull())
        verdicts = settle(validate(plain.select("q_id", "query", "context", "answer")).select("q_id", "verdict"), "agent-judged")
        state = state.join(verdicts, "q_id", "left")
        judged = F.when(
            F.col("verdict.score") < VALID_SCORE, F.concat(F.lit("validation failed: "), F.coalesce("verdict.feedback", F.lit("")))
        )
    failed = F.when(F.col("passed"), F.coalesce(answer_error(F.coalesce("answer", F.lit(""))), judged))
    broke = F.when(F.col("broken").isNotNull(), F.concat(F.lit("generation failed: "), "broken"))
    state = state.withColumn("error", failed).withColumns(
        {
            "errors": F.concat("errors", F.array_compact(F.array(broke, F.col("error")))),
            "rewrite_count": F.col("rewrite_count") + F.col("error").isNotNull().cast("int"),
        }
    )
    again = (~F.col("passed") | F.col("error").isNotNull()) & F.lit(turn < MAX_REWRITES)
    columns = ["q_id", "query", "asked", "rewrite_count", "errors", "reranked_chunks", "answer"]
    return state.select(*columns, again.alias("again"))
