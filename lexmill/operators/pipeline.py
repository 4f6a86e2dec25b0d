"""Query to answer: preprocess, retrieve, select, prompt, generate, log; encoder and generator are given by the caller."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..streaming.runlog import StageLog
from . import context as ctx
from . import hybrid, lexical, prompt


class AnswerPipeline:
    """chunks: pos, source, text, embedding. encode: queries (query_id, query) -> (query_id, vector). generate: a DataFrame with
    `messages` -> the same with `response`. preprocess: whether stop words are left out before retrieval. All queries of a call go through together."""

    def __init__(self, chunks: DataFrame, encode: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], k: int = 5, alpha: float = hybrid.ALPHA, strategy: str = "ranking", template: str = "T3_Hallucination_Guard", router: bool = False, preprocess: bool = True):
        self.chunks, self.encode, self.generate = chunks, encode, generate
        self.k, self.alpha, self.strategy, self.template, self.router, self.preprocess = k, alpha, strategy, template, router, preprocess
        self.rows = lexical.counted(chunks, "pos", "text", "embedding")
        self.index = lexical.index_of(self.rows)

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, pos, source, text, vector_score, bm25_score, hybrid_score."""
        clean = queries.withColumn("query", tx.preprocess(F.col("query"))) if self.preprocess else queries
        asked = hybrid.asked_side(self.encode(clean), self.index, {"terms": clean})
        top = hybrid.ranked(self.rows, asked, self.index, {"hybrid": ("terms", self.alpha)}, self.k * 2 if self.router else self.k).withColumnRenamed("score", "hybrid_score").drop("ranking")
        found = hybrid.looked_up(top, self.chunks, "source", "text")
        if self.router:
            found = hybrid.route(found.join(queries.select("query_id", hybrid.intent(F.col("query")).alias("intent")), "query_id"), self.k)
        return found

    def run(self, queries: DataFrame) -> DataFrame:
        """query_id, query, context, messages, response."""
        context = ctx.build_context(self.retrieve(queries), self.strategy).select("query_id", "context", "chunks_used")
        asked = prompt.build_prompts(queries.join(context, "query_id", "left").fillna("", ["context"]), [self.template])
        return self.generate(asked)

    def run_logged(self, queries: DataFrame, log: StageLog) -> DataFrame:
        """As run(), stage by stage: each of the six stages is written, counted and timed in the log. The last one puts a fixed message in place of refusals."""
        clean = log.stage("preprocess", queries.withColumn("clean", tx.preprocess(F.col("query"))), changed=F.count_if(F.col("clean") != F.lower("query")))
        found = log.stage("retrieve", self.retrieve(queries), best=F.max("hybrid_score"))
        context = log.stage("select", ctx.build_context(found, self.strategy), chunks=F.sum("chunks_used"), chars=F.sum("chars_after"), truncated=F.count_if("truncated"))
        asked = prompt.build_prompts(clean.drop("clean").join(context.select("query_id", "context", "chunks_used"), "query_id", "left").fillna("", ["context"]), [self.template])
        asked = log.stage("prompt", asked, chars=F.sum(F.length("prompt")))
        answered = self.generate(asked)
        failed = {"failed": F.count_if(F.col("error").isNotNull())} if "error" in answered.columns else {}
        answered = log.stage("generate", answered, chars=F.sum(F.length("response")), **failed)
        return log.stage("respond", answered.withColumn("response", prompt.rewrite_refusal(F.col("response"))), refused=F.count_if(F.contains(F.upper("response"), F.lit("INSUFFICIENT"))))

    def log_record(self, answered: DataFrame, run_id: str, started: float) -> DataFrame:
        """Run records for sources.io.append_runs."""
        ms = (time.time() - started) * 1000
        return answered.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("timestamp"), "query", "response", F.lit(ms).alias("total_ms"), F.array(F.struct(F.lit(6).alias("stage"), F.lit("log").alias("name"), F.lit(ms).alias("elapsed_ms"))).alias("stages"))


def compare_templates(contexts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every query (query_id, query, context) under every template."""
    return prompt.build_prompts(contexts, names)


def compare_strategies(results: DataFrame, strategies: list[str] | None = None, **options) -> DataFrame:
    """query_id, strategy, context, chunks_used, chars_after of every query under every context strategy."""
    out = None
    for s in strategies or list(ctx.STRATEGIES):
        part = ctx.build_context(results, s, **options).select("query_id", "strategy", "context", "chunks_used", "chars_after")
        out = part if out is None else out.unionByName(part)
    return out


def repeat_runs(asked: DataFrame, runs: int = 3) -> DataFrame:
    """Each row once for each run, numbered from 1."""
    return asked.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def evaluate_systems(suite: DataFrame, answer: Callable[[DataFrame], DataFrame], plain: Callable[[DataFrame], DataFrame], runs: int = 3) -> DataFrame:
    """Evaluations of both systems over a suite (query_id, query, ground_truth, false_premise).

    answer gives a query's response and context; plain gives a response without one.
    """
    from . import evaluate

    asked = repeat_runs(suite, runs)
    rag = answer(asked).withColumn("system", F.lit("RAG"))
    llm = plain(asked).withColumn("context", F.lit("")).withColumn("system", F.lit("LLM"))
    return evaluate.evaluate_response(rag.unionByName(llm, allowMissingColumns=True))


def feedback_counts(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Yes and no per group of (…, helpful boolean) rows."""
    return feedback.groupBy(*(by or [])).agg(F.count_if("helpful").alias("n_yes"), F.count_if(~F.col("helpful")).alias("n_no"))
