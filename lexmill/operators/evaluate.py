"""Measures of responses: form, refusals, unsupported numbers, accuracy signals, consistency between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Phrases and patterns that the measures look for.
METRIC_REFUSALS = ("insufficient context", "i don't know", "i cannot answer", "not in the context", "not provided", "i don't have", "cannot determine", "not mentioned")
SPECULATION = ("probably", "likely", "i think", "i believe", "perhaps", "may be", "might be", "approximately", "around", "estimated")
CITES = {"election": ("election", "votes", "constituency"), "budget": ("budget", "revenue", "fiscal", "gh")}
REFUSALS = ("insufficient context", "i cannot answer", "i don't have", "not in the context", "not provided", "cannot determine", "not mentioned", "not available in", "unable to answer")
CORRECTIONS = ("actually", "however", "incorrect", "false", "not accurate", "this is not correct", "the premise", "contrary to", "in fact", "the correct", "rather", "mistaken")
SIGNALS = (r"\d{1,3}[\.,]\d{3}", r"\b(approximately|around|estimated|reportedly|likely|probably)\b", r"\b(i believe|i think|it is known that|it is widely|generally speaking)\b", r"\b(according to my knowledge|based on my training)\b")
LABELS = {0: "WRONG / ACCEPTS_FALSE_PREMISE", 1: "PARTIAL", 2: "CORRECT"}
CONSISTENT = 0.60


def measure_response(df: DataFrame, response: str = "response") -> DataFrame:
    t, low = F.col(response), F.lower(response)
    return df.withColumns({
        "word_count": F.size(F.filter(F.split(t, tx.NOT_WORD), lambda x: x != "")),
        "sentence_count": F.size(F.filter(F.split(t, "[.!?]+"), lambda x: tx.strip(x) != "")),
        "has_refusal": tx.contains_any(low, METRIC_REFUSALS),
        **{f"cites_{k}": tx.contains_any(low, v) for k, v in CITES.items()},
        "has_numbers": t.rlike(r"\d[\d,\.]+"),
        "speculation_count": tx.count_present(low, SPECULATION),
    })


def _digits(c):
    return F.regexp_replace(c, r"[,\.]", "")


def evaluate_response(df: DataFrame, response: str = "response", context: str = "context", ground_truth: str = "ground_truth", false_premise: str = "false_premise") -> DataFrame:
    """Adds accuracy_score (0 to 2), accuracy_label, hallucination_signals, numbers_not_in_context (5 at most), did_refuse, did_correct_premise, word_count.

    Numbers are sought as digit strings anywhere in the context. ground_truth and did_correct_premise may be null.
    """
    t, low, ctx = F.col(response), F.lower(response), F.lower(F.coalesce(F.col(context), F.lit("")))
    refused, corrected = tx.contains_any(low, REFUSALS), tx.contains_any(low, CORRECTIONS)
    numbers = F.regexp_extract_all(t, F.lit(r"\b\d[\d,\.]+\b"), 0)
    bare = _digits(ctx)
    missing = F.slice(F.filter(numbers, lambda n: ~F.contains(bare, _digits(n))), 1, 5)
    signals = sum((F.rlike(low, F.lit(p)).cast("int") for p in SIGNALS[1:]), F.rlike(low, F.lit(SIGNALS[0])).cast("int"))
    count = F.size(tx.words(t))
    keys = tx.word_tokens(F.col(ground_truth), 4)
    matched = F.size(F.filter(keys, lambda k: F.contains(low, k)))
    accuracy = (
        F.when(F.col(false_premise), F.when(corrected, 2).when(refused, 1).otherwise(0))
        .when(F.col(ground_truth).isNull(), F.when(refused, 2).when(count > 20, 1).otherwise(0))
        .otherwise(F.when(matched >= F.size(keys) * 0.6, 2).when(matched > 0, 1).otherwise(0))
    )
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("accuracy_score"))
    return df.withColumn("accuracy_score", accuracy).withColumns({
        "accuracy_label": label, "hallucination_signals": signals, "numbers_not_in_context": missing, "did_refuse": refused,
        "did_correct_premise": F.when(F.col(false_premise), corrected), "word_count": count,
    })


def consistency(runs: DataFrame, by: list[str], run: str = "run", response: str = "response") -> DataFrame:
    """n_runs, avg_jaccard, min_jaccard, consistent: pairwise word Jaccard of the runs of a group; under two runs all is 1.

    Runs of equal words are one set with a count, and only different sets meet, each pair once and weighted: runs that agree cost nothing, however many
    they are. Two equal runs have a similarity of 1 (also two without words; a null response has none). Rows that share a run are runs of their own.
    """
    words = F.array_sort(F.array_distinct(tx.word_tokens(F.coalesce(F.col(response), F.lit("")), 3)))
    sets = runs.select(*by, words.alias("_s")).groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.struct(F.size("_s"), F.col("_s")))
    other = sets.select(*(F.col(c).alias(f"_{c}_other") for c in by), F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), F.col("_k").alias("_k2"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_other")) for c in by]
    pairs = sets.join(other, [*same, F.col("_k") < F.col("_k2")]).select(*by, tx.jaccard(F.col("_s"), F.col("_s2"), 1.0).alias("_j"), (F.col("_n") * F.col("_n2")).alias("_w"))
    score = pairs.groupBy(*by).agg(F.sum(F.col("_j") * F.col("_w")).alias("_sum"), F.min("_j").alias("_min")).withColumnsRenamed({c: f"_{c}_pairs" for c in by})
    every = sets.groupBy(*by).agg(F.sum("_n").alias("n_runs"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_equal"))
    met = every.join(score, [F.col(c).eqNullSafe(F.col(f"_{c}_pairs")) for c in by], "left")
    n_pairs = F.col("n_runs") * (F.col("n_runs") - 1) / 2
    mean = F.when(F.col("n_runs") < 2, F.lit(1.0)).otherwise((F.coalesce("_sum", F.lit(0.0)) + F.col("_equal")) / n_pairs)
    return met.select(*by, "n_runs", mean.alias("avg_jaccard"), F.coalesce("_min", F.lit(1.0)).alias("min_jaccard")).withColumn("consistent", F.col("avg_jaccard") >= CONSISTENT)


def _figures() -> dict:
    """Means and counts of evaluations; refusals as 'r/n', premise corrections likewise or 'N/A'."""
    ratio = lambda n, of: F.concat_ws("/", n.cast("string"), of.cast("string"))
    n, premise = F.count(F.lit(1)), F.count("did_correct_premise")
    return {
        "avg_accuracy": F.avg("accuracy_score"), "avg_hallucination": F.avg("hallucination_signals"), "refusals": ratio(F.count_if("did_refuse"), n),
        "premise_corrections": F.when(premise > 0, ratio(F.count_if("did_correct_premise"), premise)).otherwise("N/A"),
    }


def summary(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """The figures of each group."""
    return evaluated.groupBy(*by).agg(*(c.alias(n) for n, c in _figures().items()))


def report(evaluated: DataFrame, query: str = "query_id", system: str = "system", first: str = "RAG", second: str = "LLM") -> DataFrame:
    """level (query, system, all), query, system, n_runs, the figures of summary(), and at level all the winners of winners(): all levels in one pass over
    the evaluations, as grouping sets of (query, system), (system) and ()."""
    of = lambda c, s: F.avg(F.when(F.col("_s") == s, F.col(c)))
    level = F.when(F.grouping("_q") == 0, "query").when(F.grouping("_s") == 0, "system").otherwise("all")
    sides = {f"_{c}{i}": of(c, s) for c in ("accuracy_score", "hallucination_signals") for i, s in enumerate((first, second))}
    rows = evaluated.withColumns({"_q": F.col(query), "_s": F.col(system)})
    sets = rows.groupingSets([["_q", "_s"], ["_s"], []], "_q", "_s").agg(level.alias("level"), F.count(F.lit(1)).alias("n_runs"), *(c.alias(n) for n, c in _figures().items()), *(c.alias(n) for n, c in sides.items()))
    won = lambda best: F.when(F.col("level") == "all", F.when(best, first).otherwise(second))
    return sets.select(
        "level", F.col("_q").alias(query), F.col("_s").alias(system), "n_runs", *_figures(),
        won(F.col("_accuracy_score0") >= F.col("_accuracy_score1")).alias("accuracy_winner"), won(F.col("_hallucination_signals0") <= F.col("_hallucination_signals1")).alias("hallucination_winner"),
    )


def winners(evaluated: DataFrame, system: str = "system", first: str = "RAG", second: str = "LLM") -> DataFrame:
    """One row: mean accuracy and hallucination of both systems and the winner of each; ties go to the first."""
    of = lambda c, s: F.avg(F.when(F.col(system) == s, F.col(c)))
    one = evaluated.agg(of("accuracy_score", first).alias("accuracy_first"), of("accuracy_score", second).alias("accuracy_second"), of("hallucination_signals", first).alias("hallucination_first"), of("hallucination_signals", second).alias("hallucination_second"))
    return one.withColumns({"accuracy_winner": F.when(F.col("accuracy_first") >= F.col("accuracy_second"), first).otherwise(second), "hallucination_winner": F.when(F.col("hallucination_first") <= F.col("hallucination_second"), first).otherwise(second)})


def hit_rate(results: DataFrame, by: list[str], relevant: str = "relevant") -> DataFrame:
    return results.groupBy(*by).agg(F.avg(F.col(relevant).cast("double")).alias("hit_rate"))


def method_hit_rate(judged: DataFrame) -> DataFrame:
    """method, n_queries, hit_rate: the mean over queries of each query's share of relevant results."""
    return hit_rate(judged, ["method", "query_id"]).groupBy("method").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit_rate").alias("hit_rate"))


def failure_report(judged: DataFrame, suite: DataFrame) -> DataFrame:
    """kind, method, n_queries, hit_rate, best: how each method does on each kind of hard query. suite: query_id, kind; judged: results of methods with
    relevant and score (of rank 1: best is their mean)."""
    mine = judged.join(suite.select("query_id", "kind"), "query_id")
    per = mine.groupBy("kind", "method", "query_id").agg(F.avg(F.col("relevant").cast("double")).alias("hit"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    return per.groupBy("kind", "method").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit").alias("hit_rate"), F.avg("top").alias("best"))
