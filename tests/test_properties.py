"""Properties that hold on any input, on random data and on the tables."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import chunk, context, hybrid, lexical
from lexmill.plans import catalog


def test_fixed_windows_cover_and_overlap(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("abc", k=n)) for n in (1, 511, 512, 513, 960, 961, 5000, 5001)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    by: dict = {}
    for row in chunk.fixed_size(df).orderBy("doc_id", "chunk_index").collect():
        by.setdefault(row.doc_id, []).append(row.text)
    for i, t in enumerate(texts):
        parts = by[i]
        assert parts[0] + "".join(p[64:] for p in parts[1:]) == t
        assert all(a[-64:] == b[:64] for a, b in zip(parts, parts[1:])) and all(len(p) == 512 for p in parts[:-1])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=40), min_size=1, max_size=6), st.integers(5, 30))
def test_truncation_by_hand(spark, texts, limit):
    def by_hand(t):
        if len(t) <= limit:
            return t
        head = t[:limit]
        at = head.rfind(" ")
        return (head[:at] if at > 0 else head) + tx.TRUNCATED

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", tx.cut_at_blank(F.col("t"), limit, tx.TRUNCATED).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [by_hand(t) for t in texts]


def test_blend_on_tables(spark, sf):
    vec, lex = catalog._both(spark, sf)
    vec, lex = vec.cache(), lex.cache()
    hyb = hybrid.hybrid_scores(vec, lex)
    low, high = hyb.agg(F.min("hybrid_score"), F.max("hybrid_score")).first()
    assert 0 <= low and high <= 1 + 1e-9
    order = lambda df: [(r.query_id, r.rank, r.pos) for r in df.orderBy("query_id", "rank").collect()]
    sweep = hybrid.alpha_sweep(vec, lex, 3)
    assert order(sweep.filter("alpha = 1")) == order(lexical.top_k(vec, 3))
    assert order(sweep.filter("alpha = 0")) == order(lexical.top_k(lex, 3))


def test_mmr_keeps_unlike_chunks(spark):
    r = random.Random(4)
    base = [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for q in range(30):
        for rank in range(1, 6):
            rows.append((q, rank, "s", " ".join(sorted(r.sample(base, r.choice([17, 18, 20])))), 1.0 - rank / 10, None))
    df = spark.createDataFrame(rows, "query_id long, rank int, source string, text string, hybrid_score double, vector_score double")
    for row in context.mmr(df, max_chars=10**6).collect():
        sets = [set(p.split("\n")[1].split()) for p in row.context.split("\n\n")]
        assert all(len(a & b) / len(a | b) < 0.85 for i, a in enumerate(sets) for b in sets[:i])
        assert row.chunks_used + row.duplicates_skipped == 5
