"""Operators on small frames: published facts of the design, and edge cases that the tables lack."""
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import chunk, clean, context, evaluate, hybrid, lexical, pipeline, prompt, stats
from lexmill.plans import catalog
from lexmill.sources import io


def one(spark, expr, **values):
    return spark.createDataFrame([values], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x


def test_tokens_and_preprocess(spark):
    cases = {
        "fiscal shortfall reduction plan Ghana": "fiscal shortfall reduction plan ghana", "region": "region",
        "total allocation by region 2025": "total allocation region", "Nana Akufo-Addo presidential votes": "nana akufo addo presidential votes", "Is it the?": "is it the?",
    }
    df = spark.createDataFrame(list(cases.items()), "q string, want string")
    for r in df.select("want", tx.preprocess(F.col("q")).alias("got")).collect():
        assert r.got == r.want
    assert one(spark, tx.tokens(F.col("t")), t="élan abc a_b x1y The naïve of 42") == ["abc", "the", "of"]


def test_normalise(spark):
    assert one(spark, tx.normalise(F.col("t")), t="\u00a0\ufb01ne\x07\x85 \t\n") == "fine"
    df = spark.createDataFrame([("nan", 1), (" None ", 2), ("\x00", 3), ("ok", 4), (None, 5)], "a string, b int")
    assert [r.a for r in clean.normalise_strings(df).orderBy("b").collect()] == [None, None, None, "ok", None]
    assert clean.missing_report(clean.normalise_strings(df)).collect()[0].n_missing == 4
    assert clean.normalise_names(df.toDF(" Old  Region ", "Votes-%")).columns == ["old_region", "votes_%"]


def test_records(spark):
    df = spark.createDataFrame([(2020, None, "0.05%"), (None, None, None)], "year int, old_region string, `votes(%)` string")
    got = clean.rows_to_records(df, "s").collect()
    assert len(got) == 1 and got[0].text == "Year: 2020. Votes(%): 0.05%." and got[0].metadata["old_region"] is None


def test_page(spark):
    raw = "Hd\n12\nA line that is long enough.\nbro-\nken words\n\n\n\n 123 \nNon-\nBreaking  twice\t\tspaced\nmiddle\nabc\nlast lines stay here\nFt\n7"
    got = one(spark, clean.clean_page(F.col("t")), t=raw)
    assert got == "A line that is long enough.\nbroken words\n\nNon-\nBreaking twice spaced\nmiddle\nabc\nlast lines stay here"


def test_fixed_size_facts(spark):
    df = spark.createDataFrame([("x" * 97817,)], "text string").select("text")
    got = chunk.fixed_size(df).select("chunk_index", F.length("text").alias("n")).orderBy("chunk_index").collect()
    assert len(got) == 219 and got[-1].n == 153 and all(r.n == 512 for r in got[:-1])


def by_hand_corpus(texts, size=512, overlap=64):
    s, out, at = "\n\n".join(t for t in texts if t), [], 0
    while True:
        w = s[at : at + size]
        if w.strip():
            out.append(w)
        if at + size >= len(s):
            return out
        at += size - overlap


def test_corpus_windows_cross_records(spark):
    texts = ["a" * 500, "", "b" * 3, "c d " * 400, "e" * 448, "f"]
    df = spark.createDataFrame([(i * 5000, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = [r.text for r in chunk.fixed_size_corpus(df).orderBy("chunk_index").collect()]
    assert got == by_hand_corpus(texts)


def by_hand_paragraphs(text, least=100, most=1500):
    def sents(t):
        return [x for x in (s.strip() for s in re.sub(r"([.!?])\s+", "\\1\x01", t).split("\x01")) if x]

    out, buf = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(buf) + len(p) < least:
            buf = f"{buf} {p}" if buf else p
            continue
        both, buf = (f"{buf} {p}" if buf else p), ""
        if len(both) <= most:
            out.append(both)
            continue
        cur = ""
        for s in sents(both):
            if cur and len(cur) + len(s) + 1 > most:
                out.append(cur)
                cur = s
            else:
                cur = f"{cur} {s}" if cur else s
        if cur:
            out.append(cur)
    return out + [buf] if buf else out


def test_paragraphs(spark):
    text = "Short.\n\nTiny.\n \n" + "Long one. " * 12 + "\n\n" + "A sentence of words here. " * 90 + "\n\n" + "x" * 1700 + ". End.\n\nrest"
    df = spark.createDataFrame([(text,)], "text string")
    got = [r.text for r in chunk.paragraph_based(df).orderBy("chunk_index").collect()]
    assert got == by_hand_paragraphs(text)
    docs = ["a.\n\nb", "c" * 120, "d\n\n\n\ne", "f" * 99 + "\n\ng", "h " * 900]
    df = spark.createDataFrame([(i * 3000, "s", t) for i, t in enumerate(docs)], "doc_id long, source string, text string")
    got = [r.text for r in chunk.paragraph_based_corpus(df).orderBy("chunk_index").collect()]
    assert got == by_hand_paragraphs("\n\n".join(docs))


@pytest.mark.parametrize("fan_bits", [2, 10])
def test_paragraphs_across_many_short_records(spark, fan_bits):
    """A source of short paragraphs only, sources that mix both, a null source; repeated, null and textual keys."""
    r = random.Random(7)
    para = lambda most: " ".join("".join(r.choices("abc", k=r.randint(1, 9))) + r.choice(("", ".", "!")) for _ in range(r.randint(1, most)))
    by = {"short": 3, "mixed": 30, None: 12, "long": 400}
    rows, texts = [], {}
    for source, most in by.items():
        for i in range(60):
            text = r.choice(("\n\n", "\n \n")).join(para(r.choice((1, most))) for _ in range(r.randint(1, 6)))
            texts.setdefault(source, []).append(text)
            rows.append((f"{i:04d}", source, text))
        rows.append((None, source, ""))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(3)
    got: dict = {}
    for row in chunk.paragraph_based_corpus(df, fan_bits=fan_bits).collect():
        got.setdefault(row.source, {})[row.chunk_index] = row.text
    for source in by:
        want = by_hand_paragraphs("\n\n".join(texts[source]))
        assert [got[source][i] for i in range(len(got[source]))] == want


def test_corpus_order_with_repeated_keys(spark):
    """Each row stands once, whatever its key; a null key comes first."""
    rows = [(1, "s", "b" * 30), (1, "s", "b" * 30), (None, "s", "a" * 30), (2, "s", "c" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [r.text for r in chunk.fixed_size_corpus(df, size=1000).collect()] == ["\n\n".join(c * 30 for c in "abbc")]
    assert [r.text for r in chunk.paragraph_based_corpus(df).collect()] == [" ".join(c * 30 for c in "abb") + " " + "c" * 30]
    assert chunk.paragraph_based_corpus(df.limit(0)).count() == 0 and chunk.fixed_size_corpus(df.limit(0)).count() == 0


def test_chunk_registry(spark):
    df = spark.createDataFrame([("s", "One. Two! Three? Four. Five. Six. ")], "source string, text string")
    assert [r.text for r in chunk.chunk(df, "source", "sentence_based").orderBy("chunk_index").collect()] == ["One. Two! Three? Four. Five.", "Five. Six."]
    with pytest.raises(ValueError):
        chunk.chunk(df, "source", "other")


def test_truncate(spark):
    assert one(spark, tx.cut_at_blank(F.col("t"), 10, tx.TRUNCATED), t="hello big world") == "hello big [... truncated]"
    assert one(spark, tx.cut_at_blank(F.col("t"), 5), t="abcdefgh") == "abcde"
    assert one(spark, tx.cut_at_blank(F.col("t"), 5), t="ab\nde") == "ab\nde"


CORPUS = [(0, "red green blue"), (1, "red red yellow"), (2, ""), (3, "black white")]


def test_bm25(spark):
    df = spark.createDataFrame(CORPUS, "pos long, text string")
    q = spark.createDataFrame([(1, "red red blue"), (2, "zebra"), (3, "")], "query_id long, query string")
    index = lexical.build_index(df)
    got = {(r.query_id, r.pos): r.score for r in lexical.bm25_scores(index, q).collect()}
    import math

    idf = lambda n: math.log((4 - n + 0.5) / (n + 0.5) + 1)
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2.0))
    assert got[1, 0] == pytest.approx(2 * idf(2) * part(1, 3) + idf(1) * part(1, 3))
    assert got[1, 1] == pytest.approx(2 * idf(2) * part(2, 3)) and got[2, 0] == 0 and got[3, 3] == 0 and len(got) == 12
    top = {(r.query_id, r.rank): r.pos for r in lexical.bm25_topk(index, q, 3).collect()}
    assert (top[1, 1], top[1, 2], top[1, 3]) in ((0, 1, 2), (1, 0, 2)) and (top[2, 1], top[2, 2], top[2, 3]) == (0, 1, 2)


def test_min_max_and_hybrid(spark):
    v = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (1, 2, 0.0), (2, 0, 0.3), (2, 1, 0.3)], "query_id long, pos long, score double")
    lex = spark.createDataFrame([(1, 0, 3.050835), (1, 1, 3.065864), (1, 2, 0.0), (2, 0, 1.0), (2, 1, 2.0)], "query_id long, pos long, score double")
    got = {(r.query_id, r.rank): r for r in hybrid.hybrid_topk(v, lex, 2).collect()}
    assert round(got[1, 1].hybrid_score, 6) == 0.998529 and got[1, 1].pos == 0  # a published top score
    assert got[2, 1].pos == 1 and got[2, 1].hybrid_score == pytest.approx(0.3)
    sweep = hybrid.alpha_sweep(v, lex, 1)
    assert sweep.count() == 22 and {r.pos for r in sweep.filter("query_id = 1 AND alpha = 0").collect()} == {1}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>")
    assert [r.u for r in df.select(tx.l2_normalise(F.col("e")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_router(spark):
    assert one(spark, hybrid.intent(F.col("q")), q="Presidential votes and ballot") == "election"
    assert one(spark, hybrid.intent(F.col("q")), q="tax votes") is None
    assert one(spark, hybrid.intent(F.col("q")), q="akufo-addo gh") == "election"  # the parts count, 'gh' is too short
    rows = [(1, 1, "budget", 0.9, "election"), (1, 2, "Election data", 0.7, "election"), (1, 3, "budget", 0.6, "election"), (2, 1, "budget", 0.5, None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, source string, hybrid_score double, intent string")
    got = [(r.query_id, r.source, r.hybrid_score, r.innovation_boost) for r in hybrid.route(df, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "Election data", 1.0, True), (1, "budget", 0.0, False), (2, "budget", 0.5, None)]
    assert hybrid.route(df, 5, strict=True).count() == 2


DEMO = [("budget", "Revenue and grants for 2025 are projected at 224.9 billion.", 0.91), ("budget", "Revenue and grants for 2025 are projected at 224.9 billions.", 0.88), ("budget", "Inflation is aimed at 11.9 percent by the end of 2025.", 0.75), ("election", "Year: 2020. Candidate: A. Votes: 6,730,413.", 0.45), ("election", "Year: 2016. Candidate: A. Votes: 5,716,026.", 0.35)]


def demo(spark, rows=DEMO):
    return spark.createDataFrame([(1, i + 1, s, t, h, None) for i, (s, t, h) in enumerate(rows)], "query_id long, rank int, source string, text string, hybrid_score double, vector_score double")


def test_context(spark):
    opts = {"max_chars": 500, "min_score": 0.40, "top_k": 5}
    t, r = (context.build_context(demo(spark), s, **opts).first() for s in ("truncation", "ranking"))
    assert t.chunks_used == 5 and r.chunks_used == 4 and r.chunks_filtered_out == 1 and r.scores == [0.91, 0.88, 0.75, 0.45]
    assert r.context.startswith("[Document 1 | source: budget | relevance: 0.910]\nRevenue")
    m = context.mmr(demo(spark), limit=0.7, **opts).first()
    assert m.chunks_used == 3 and m.duplicates_skipped == 1
    none = context.ranking(demo(spark), min_score=0.99).first()
    assert none.chunks_used == 1 and none.scores == [0.91]
    cut = context.truncation(demo(spark), max_chars=100).first()
    assert cut.truncated and cut.context.endswith(tx.TRUNCATED) and cut.chars_after <= 116
    with pytest.raises(ValueError):
        context.make_manager("other")


def test_zero_scores_fall_through(spark):
    df = spark.createDataFrame([(0.0, 0.4), (None, 0.3), (0.0, 0.0)], "h double, v double")
    assert [r.x for r in df.select(context.effective_score(F.col("h"), F.col("v")).alias("x")).collect()] == [0.4, 0.3, 0.0]


def test_prompts(spark):
    df = spark.createDataFrame([(" has {query} inside ", "and {context}?")], "context string, query string")
    got = {r.template: r for r in prompt.build_prompts(df).collect()}
    assert got["T1_Baseline"].prompt == "Context:\nhas {query} inside\n\nQuestion: and {context}?\n\nAnswer:"
    assert [m.role for m in got["T3_Hallucination_Guard"].messages] == ["system", "user"]
    assert one(spark, prompt.rewrite_refusal(F.col("r"), "no"), r="insufficient context.") == "no"


def test_measures(spark):
    df = spark.createDataFrame([("High rate is 3.5 percent. I think so!",)], "response string")
    r = evaluate.measure_response(df).first()
    assert (r.word_count, r.sentence_count, r.cites_budget, r.cites_election, r.has_numbers, r.speculation_count, r.has_refusal) == (9, 3, True, False, True, 1, False)


def test_evaluation(spark):
    rows = [
        ("Actually that is false.", "", None, True), ("I cannot answer.", "", None, True), ("Yes.", "", None, True), ("not mentioned", None, None, False), ("word " * 21, "", None, False), ("few", "", None, False),
        ("votes were 1,234 and 99.5 and 77 in total", "the total 1234 votes", "total votes counted here", False),
    ]
    df = spark.createDataFrame(rows, "response string, context string, ground_truth string, false_premise boolean")
    got = evaluate.evaluate_response(df).collect()
    assert [r.accuracy_score for r in got] == [2, 1, 0, 2, 1, 0, 1]
    assert got[6].numbers_not_in_context == ["99.5", "77"] and got[6].hallucination_signals == 1 and got[6].did_correct_premise is None and got[0].did_correct_premise


def test_consistency(spark):
    rows = [("a", 1, "red green blue"), ("a", 2, "red green gray"), ("b", 1, "one"), ("c", 1, ""), ("c", 2, "a b")]
    df = spark.createDataFrame(rows, "g string, run int, response string")
    got = {r.g: r for r in evaluate.consistency(df, ["g"]).collect()}
    assert got["a"].avg_jaccard == 0.5 and not got["a"].consistent and got["b"].avg_jaccard == 1.0 and got["c"].min_jaccard == 1.0


def test_jaccard_stats(spark):
    q = spark.createDataFrame([(1, "red blue"), (2, "zebra"), (3, "")], "i long, q string")
    d = spark.createDataFrame(CORPUS, "pos long, text string")
    best = {r.i: r for r in stats.jaccard_best(q, d, "i", "q", "pos", "text").collect()}
    assert best[1].pos == 0 and best[1].shared == 2 and len(best) == 2
    assert (best[2].pos, best[2].shared, best[2].sim) == (0, 0, 0.0)  # nothing shared: the first chunk, with 0
    rate = stats.jaccard_hit_rate(q, d, "i", "q", "pos", "text").first()
    assert rate.hit_rate == pytest.approx(1 / 3) and rate.avg_top1_sim == pytest.approx((2 / 3) / 2)


def test_sources(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("A,B\ncaf\u00e9,1\n".encode("latin-1"))
    assert io.read_csv(spark, str(p)).first().A == "caf\u00e9"
    p = tmp_path / "y.csv"
    p.write_text("A,B\ncaf\u00e9,1\n", encoding="utf-8")
    assert io.read_csv(spark, str(p)).first().A == "caf\u00e9"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"one\x0ctwo")
    got = io.read_pages(spark, str(tmp_path / "d"), lambda b: b.decode().split("\x0c")).orderBy("page_num").collect()
    assert [(r.page_num, r.text) for r in got] == [(1, "one"), (2, "two")]
    log = str(tmp_path / "log")
    for i in range(2):
        io.append_runs(spark.createDataFrame([(str(i),)], "run_id string"), log)
    assert spark.read.json(log).count() == 2


def test_pipeline(spark):
    rows = [(0, "budget", "tax revenue rises", [1.0, 0.0]), (1, "election", "votes are counted", [0.0, 1.0]), (2, "budget", "debt and tax", [0.7, 0.7])]
    chunks = spark.createDataFrame(rows, "pos long, source string, text string, embedding array<float>")
    encode = lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    generate = lambda df: df.withColumn("response", F.concat(F.lit("seen: "), F.size("messages").cast("string")))
    q = spark.createDataFrame([(1, "What is the tax revenue?"), (2, "ballot votes")], "query_id long, query string")
    for router in (False, True):
        got = pipeline.AnswerPipeline(chunks, encode, generate, k=2, router=router).run(q).collect()
        assert len(got) == 2 and all(r.response == "seen: 2" and r.context for r in got)


def test_stream(spark, tmp_path):
    from lexmill.streaming.runlog import latency_windows

    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src)
    run = latency_windows(stream).writeStream.format("memory").queryName("lat").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("lat").first().avg_value == 2.0


def test_experiments(spark, tmp_path):
    got = pipeline.compare_strategies(demo(spark), min_score=0.4).collect()
    assert {(r.strategy, r.chunks_used) for r in got} == {("truncation", 5), ("ranking", 4), ("mmr", 3)} or len(got) == 3
    suite = spark.createDataFrame([(1, "q", "four words here now", False), (2, "p", None, True)], "query_id long, query string, ground_truth string, false_premise boolean")
    answer = lambda df: df.withColumn("response", F.lit("four words here now")).withColumn("context", F.lit("c"))
    plain = lambda df: df.withColumn("response", F.lit("Actually 12,345 is around."))
    ev = pipeline.evaluate_systems(suite, answer, plain)
    assert ev.count() == 12
    best = evaluate.winners(ev).first()
    assert best.accuracy_first == 1.0 and best.accuracy_second == 1.0 and best.accuracy_winner == "RAG" and best.hallucination_winner == "RAG"
    summary = {(r.query_id, r.system): r for r in evaluate.summary(ev, ["query_id", "system"]).collect()}
    assert summary[2, "LLM"].premise_corrections == "3/3" and summary[1, "LLM"].premise_corrections == "N/A" and summary[1, "RAG"].refusals == "0/3"
    fb = spark.createDataFrame([(True,), (False,), (True,)], "helpful boolean")
    assert tuple(pipeline.feedback_counts(fb).first()) == (2, 1)
    src = tmp_path / "a.txt"
    src.write_text("x" * 20000)
    dest = str(tmp_path / "b.txt")
    assert io.fetch(src.as_uri(), dest) and not io.fetch(src.as_uri(), dest) and open(dest).read() == "x" * 20000


@pytest.mark.parametrize("probe", [1, 3])
def test_jaccard_best_against_brute_force(spark, probe):
    """Rarity prefix and size bound lose no best chunk, at any similarity; ties go to the least pos."""
    r = random.Random(probe)
    vocab = ["".join(r.choices("abcdefgh", k=r.choice((2, 3, 5)))) for _ in range(120)]
    common = vocab[:8]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.6 else vocab) for _ in range(n))
    chunks = [(i, text(r.randrange(0, 40))) for i in range(150)] + [(500, None), (501, "")]
    queries = [(i, text(r.randrange(1, 25))) for i in range(40)] + [(100, "zzz yyy"), (101, "1 2 !"), (102, None), (103, chunks[7][1]), (104, "zzz " + chunks[9][1])]
    counts: dict = {}
    got = stats.jaccard_best(spark.createDataFrame(queries, "q long, t string"), spark.createDataFrame(chunks, "p long, t string"), "q", "t", "p", "t", probe=probe, counts=counts).collect()
    sets = lambda t: set(re.findall(r"\b[a-z]{2,}\b", (t or "").lower()))
    want, all_pairs = {}, 0
    for i, t in queries:
        a = sets(t)
        if a:
            scored = [(len(a & sets(c)) / len(a | sets(c)), len(a & sets(c)), p) for p, c in chunks]
            all_pairs += sum(n > 0 for _, n, _ in scored)
            want[i] = max(scored, key=lambda x: (x[0], -x[2]))
    assert {x.q: (x.sim, x.shared, x.p) for x in got} == want and len(got) == len(want)
    assert want[100] == (0.0, 0, 0) and counts["compared"] < all_pairs


def test_saved_index_round_trip(spark, tmp_path):
    """A saved index gives the scores of the one in memory; its postings aren't shuffled, and top k by blocks is exact."""
    r = random.Random(2)
    docs = [(i * 3, " ".join(r.choice("red green blue black white gray pink teal".split() if r.random() < 0.9 else [f"w{x}" for x in "abcdefghij"]) for _ in range(r.randrange(0, 30)))) for i in range(400)]
    docs = [(p, re.sub(r"w([a-j])", r"rare\1", t)) for p, t in docs]
    df = spark.createDataFrame(docs, "pos long, text string")
    q = spark.createDataFrame([(1, "red rarea"), (2, "rareb rarec pink pink"), (3, "zebra"), (4, ""), (5, "red green blue black white")], "query_id long, query string")
    plain = lexical.build_index(df)
    lexical.save_index(plain, f"file://{tmp_path}/index", block_rows=8, buckets=4)
    lexical.save_index(plain, f"file://{tmp_path}/index", block_rows=8, buckets=4)  # again, in place
    index = lexical.load_index(spark, f"file://{tmp_path}/index")
    rows = lambda d: sorted(map(tuple, d.collect()))
    near = lambda a, b: [x[:-1] for x in a] == [x[:-1] for x in b] and all(abs(x[-1] - y[-1]) < 1e-8 for x, y in zip(a, b))
    terms = lexical.query_terms(q)
    assert near(rows(lexical.bm25_matches(index, terms)), rows(lexical.bm25_matches(plain, terms)))
    assert rows(index.tf.select("pos", "term", "tf", "dl")) == rows(plain.tf.select("pos", "term", "tf", "dl")) and rows(index.docs) == rows(plain.docs)
    for k in (1, 5, 60):
        counts: dict = {}
        got = rows(lexical.bm25_topk_blocks(index, terms, k, probe=1, counts=counts))
        assert near(got, rows(lexical.top_k(lexical.bm25_matches(plain, terms), k).select("query_id", "pos", "score")))
        assert near(rows(lexical.bm25_topk(index, q, k).select("query_id", "rank", "pos", "score")), rows(lexical.bm25_topk(plain, q, k).select("query_id", "rank", "pos", "score")))
        assert k > 1 or counts["scored"] < counts["all"]
    # The postings' side of the join has no exchange, whichever join is taken.
    joined = index.blocks.join(lexical._asked(index, terms).hint("merge"), ["term", "salt"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = joined._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "postings" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)
    lexical.forget_index(spark, index)
    assert not [t for t in spark.catalog.listTables() if t.name in index.names]


def test_vector_ranking_by_matrices(spark, monkeypatch):
    """Top k and all scores equal a plain loop, with ties, zero and missing vectors, for few queries and for many (dealt in groups)."""
    r = random.Random(4)
    vec = lambda: [r.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)]
    rows = [(i, vec()) for i in range(120)] + [(500, None), (501, [0.0] * 4), (502, [1.0, 1.0, 1.0, 1.0]), (503, [2.0, 2.0, 2.0, 2.0])]
    asked = [(i, vec()) for i in range(7)] + [(50, [1.0, 1.0, 1.0, 1.0]), (51, None)]
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1e-10) for x in v]
    score = lambda a, b: None if a is None or b is None else sum(x * y for x, y in zip(unit(a), unit(b)))
    want = {(q, p): score(a, b) for q, a in asked for p, b in rows}
    df = spark.createDataFrame(rows, "pos long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    for size in (hybrid.QUERY_BYTES, 100):
        monkeypatch.setattr(hybrid, "QUERY_BYTES", size)
        got = {(x.query_id, x.pos): x.score for x in hybrid.vector_scores(df, queries).collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)
        top = hybrid.vector_topk(df, queries, 6).collect()
        for q, _ in asked:
            best = sorted((-round(s, 9), p) for (i, p), s in want.items() if i == q and s is not None)[:6]
            assert [x.pos for x in sorted((x for x in top if x.query_id == q), key=lambda x: x.rank)] == [p for _, p in best]
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "pos long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        hybrid.vector_topk(bad, queries).collect()
    assert hybrid.vector_topk(df.limit(0), queries).count() == 0 and hybrid.vector_scores(df, queries.limit(0)).count() == 0


def test_report_levels_equal_summary_and_winners(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.choice(("RAG", "LLM")), r.choice(("Insufficient context here.", "In fact it is 12,345.", "Likely so, I think. " * 6)), "12,345", r.choice((None, "it is")), r.random() < 0.3) for _ in range(60)]
    ev = evaluate.evaluate_response(spark.createDataFrame(rows, "query_id string, system string, response string, context string, ground_truth string, false_premise boolean"))
    got = evaluate.report(ev).collect()
    figures = ["avg_accuracy", "avg_hallucination", "refusals", "premise_corrections"]
    for level, by in (("query", ["query_id", "system"]), ("system", ["system"]), ("all", [])):
        want = {tuple(x[c] for c in by): [x[f] for f in figures] for x in evaluate.summary(ev, by).collect()}
        have = {tuple(x[c] for c in by): [x[f] for f in figures] for x in got if x.level == level}
        assert have.keys() == want.keys() and all(have[k][2:] == want[k][2:] and have[k][:2] == pytest.approx(want[k][:2]) for k in want)
    one, best = next(x for x in got if x.level == "all"), evaluate.winners(ev).first()
    assert (one.accuracy_winner, one.hallucination_winner) == (best.accuracy_winner, best.hallucination_winner) and one.n_runs == 60
    assert all(x.accuracy_winner is None for x in got if x.level != "all")


def test_failure_report(spark):
    rows = [("F", "m", 1, 1, True, 2.0), ("F", "m", 1, 2, False, 1.0), ("F", "m", 2, 1, False, 4.0), ("G", "m", 3, 1, None, 1.0)]
    judged = spark.createDataFrame(rows, "k string, method string, query_id long, rank int, relevant boolean, score double")
    suite = judged.select("query_id", F.col("k").alias("kind")).distinct()
    got = {(x.kind, x.method): (x.n_queries, x.hit_rate, x.best) for x in evaluate.failure_report(judged.drop("k"), suite).collect()}
    assert got == {("F", "m"): (2, 0.25, 3.0), ("G", "m"): (1, None, 1.0)}


def test_consistency_of_many_runs_against_all_pairs(spark):
    r = random.Random(11)
    rows = [("copies", i, r.choice(("the same words again", "the same words again", "other words here"))) for i in range(300)]
    rows += [("mixed", i, " ".join(r.choices("alpha beta gamma delta epsilon".split(), k=r.randrange(0, 6)))) for i in range(40)]
    rows += [("one", 0, "alone"), ("none", 0, None), ("none", 1, ""), (None, 0, "alpha beta"), (None, 1, "beta gamma")]
    got = {x.q: x for x in evaluate.consistency(spark.createDataFrame(rows, "q string, run int, response string"), ["q"]).collect()}
    for q in {x[0] for x in rows}:
        sets = [set(re.findall(r"\w{3,}", t or "")) for k, _, t in rows if k == q]
        pairs = [(len(a & b) / len(a | b) if a | b else 1.0) for i, a in enumerate(sets) for b in sets[i + 1 :]] or [1.0]
        assert got[q].n_runs == len(sets) and got[q].avg_jaccard == pytest.approx(sum(pairs) / len(pairs)) and got[q].min_jaccard == pytest.approx(min(pairs))
        assert got[q].consistent == (got[q].avg_jaccard >= 0.6)


def test_rounding_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(-1e-8,), (1e-8,), (-0.0,), (-1.0000005,), (0.1234565,), (float("nan"),)], "x double")
    assert [str(r.y) for r in df.select(tx.rounded(F.col("x")).alias("y")).collect()] == ["-0.0", "0.0", "-0.0", "-1.000001", "0.123457", "nan"]


def test_unit_vectors_equal_sql_in_small_negative_numbers(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from lexmill.plans import catalog

    spark.createDataFrame([(1, [1.0, -1e-8, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["l2_normalise"]).fetchall()[0][1]
    assert str(catalog.l2_normalise(spark, str(tmp_path)).first().unit) == str(want) == "[1.0, -0.0, 0.0]"


def _small_ranking(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("red green blue black white gray pink teal the the".split()) for _ in range(n))
    docs = [(i, text(r.randrange(0, 25)), None if i % 11 == 0 else [r.random() - 0.5 for _ in range(4)]) for i in range(150)] + [(900, "red pink", [1.0, 0.0, 0.0, 0.0]), (901, "red pink", [1.0, 0.0, 0.0, 0.0])]
    asked = [(1, "red pink the", [1.0, 0.2, 0.0, 0.0]), (2, "zebra", [0.0, 0.0, 0.0, 1.0]), (3, "", [0.5] * 4), (4, "teal teal blue", None)]
    rows = spark.createDataFrame(docs, "pos long, text string, embedding array<double>").repartition(5)
    return rows, spark.createDataFrame(asked, "query_id long, query string, vector array<double>")


@pytest.mark.parametrize("small", [None, 300])
def test_scores_row_by_row_equal_joined_scores(spark, monkeypatch, small):
    """BM25 of all pairs, also scaled, without a shuffle of pairs, for few queries and for many (dealt in groups)."""
    df, q = _small_ranking(spark)
    want = lexical.bm25_scores(lexical.build_index(df), q)
    if small:
        monkeypatch.setattr(hybrid, "QUERY_BYTES", small)
        monkeypatch.setattr(hybrid, "PAIRS", 16)
    rows = lexical.counted(df)
    index = lexical.index_of(rows)
    for scaled, other, name in ((False, want, "score"), (True, hybrid.min_max(want, "score", "b"), "b")):
        got = hybrid.lexical_scores(rows, q, index, scaled)
        if not small:
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan
        got, wanted = ({(x.query_id, x.pos): x[n] for x in d.collect()} for d, n in ((got, "score"), (other, name)))
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-8 for k in got)


@pytest.mark.parametrize("small", [None, 300])
def test_rankings_row_by_row_equal_joined_rankings(spark, monkeypatch, small):
    df, q = _small_ranking(spark)
    plain = lexical.build_index(df)
    lex, vec = lexical.bm25_matches(plain, lexical.query_terms(q)), hybrid.vector_scores(df, q)
    if small:
        monkeypatch.setattr(hybrid, "QUERY_BYTES", small)
        monkeypatch.setattr(hybrid, "PAIRS", 16)
    rows = lexical.counted(df, "pos", "text", "embedding")
    index = lexical.index_of(rows)
    near = lambda a, b: [x[:-1] for x in a] == [x[:-1] for x in b] and all(x[-1] == y[-1] or abs(x[-1] - y[-1]) < 1e-8 for x, y in zip(a, b))
    take = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    for k in (3, 200):
        kept = ("query_id", "rank", "pos", "hybrid_score")
        assert near(take(hybrid.hybrid_ranked(rows, q, index, k), *kept), take(hybrid.hybrid_topk(vec, lex, k), *kept))
    best = hybrid.ranked(rows, hybrid.asked_side(q, index, {"terms": q}), index, {"bm25": ("terms", None)}, 6)
    assert near(take(best, "query_id", "rank", "pos", "score"), take(lexical.bm25_topk(plain, q, 6), "query_id", "rank", "pos", "score"))
    kept = ("query_id", "alpha", "rank", "pos", "hybrid_score")
    assert near(take(hybrid.alphas_ranked(rows, q, index, 2), *kept), take(hybrid.alpha_sweep(vec, lex, 2), *kept))


def test_terms_are_counted_inside_rows(spark):
    df = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None)], "pos long, text string")
    got = {r.pos: r.w for r in df.select("pos", tx.term_counts(tx.tokens(F.col("text"), 1)).alias("w")).collect()}
    assert [tuple(x) for x in got[1]] == [("a", 1), ("b", 3), ("c", 1)] and got[2] == [] and got[3] is None
    plan = lexical.build_index(df).tf._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_composition_sends_few_rows_at_a_time(spark):
    """The worker's memory is bounded by a hundred texts, whatever their size; a batch of Arrow held ten thousand."""
    df = spark.createDataFrame([(1, "ﬁn"), (2, "plain"), (3, None), (4, "é")], "i int, t string").select("i", tx.nfkc(F.col("t")).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {r.i: r.t for r in df.collect()} == {1: "fin", 2: "plain", 3: None, 4: "é"}


def test_texts_are_computed_once_a_row(spark):
    """A filter on a computed text doesn't compute it again below."""
    df = spark.createDataFrame([(1, "s", "One. Two.\n\n\n\nThree.")], "doc_id long, source string, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(clean.clean_pages(df, least=1)).count("{3,}") == 1
    assert plan(chunk.sentence_based(df)).count("([.!?])") == 1


def _bare_texts(df) -> list[str]:
    """Shuffles of rows with texts before ids were met where the rows lie."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = [x for x, _ in itertools.takewhile(lambda y: y[1] > depth[i], zip(lines[i + 1 :], depth[i + 1 :]))]
            if any("text#" in x and "Scan" in x for x in below) and not any("LeftSemi" in x for x in below):
                out.append(line)
    return out


@pytest.fixture
def joins_by_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_without_a_vector_or_result_are_not_shuffled(spark, sf, joins_by_shuffle):
    """On tables too large for Spark's own broadcasts."""
    corpus, asked = catalog._corpus(spark, sf), catalog._queries(spark, sf)
    line = pipeline.AnswerPipeline(corpus, lambda q: asked.select("query_id", "vector"), lambda df: df)
    for df in (corpus, catalog._results(spark, sf), line.retrieve(asked.select("query_id", "query"))):
        assert "text" in df.columns and _bare_texts(df) == []
    vectors = catalog.read(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"))
    assert _bare_texts(catalog._rows(spark, sf).join(vectors, "pos"))  # what is looked for is found in a plain join


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_of_results_with_repeated_and_null_numbers(spark, monkeypatch, limit):
    """As plain joins, whether or not the ids are few enough to be sent."""
    if limit is not None:
        monkeypatch.setattr(hybrid, "fits", lambda df: False)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")], "pos long, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [3.0]), (None, [4.0]), (9, [5.0])], "pos long, embedding array<float>")
    results = spark.createDataFrame([(7, 1), (8, 1), (7, 2), (7, None), (8, 5)], "query_id long, pos long")
    take = lambda d: sorted(d.collect(), key=repr)
    corpus = rows.join(vectors, "pos")
    got = hybrid.with_vectors(rows, vectors)
    assert take(got) == take(corpus) and got.columns == corpus.columns
    found, want = hybrid.looked_up(results, got, "text"), results.join(corpus.select("pos", "text"), "pos")
    assert take(found) == take(want) and found.columns == want.columns
    assert hybrid.looked_up(results.limit(0), got, "text").count() == 0 and hybrid.with_vectors(rows, vectors.limit(0)).count() == 0


def _moved(spark, run) -> int:
    """Rows that run() shuffles and writes to work tables until its result is read."""
    sc = spark.sparkContext._jsc.sc()

    def stages() -> list:
        sc.listenerBus().waitUntilEmpty()
        every, none = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = sc.statusStore().stageList(every, False, False, none, every)
        return [found.apply(i) for i in range(found.size())]

    last = max((s.stageId() for s in stages()), default=-1)  # old stages are forgotten in time
    run().write.format("noop").mode("overwrite").save()
    return sum(s.shuffleWriteRecords() + s.outputRecords() for s in stages() if s.stageId() > last)


@pytest.mark.parametrize("name", ["context_truncation", "pipeline_stages"])
def test_a_further_document_moves_no_row_a_query(spark, sf, tmp_path, joins_by_shuffle, name):
    """What the query shuffles and writes grows with documents and vectors, not with their pairs with queries."""
    for table, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
        copies = catalog.read(spark, sf, table).crossJoin(spark.range(4)).withColumn(key, F.col(key) + 1000 * F.col("id")).drop("id")
        copies.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    catalog.read(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    small, large = (_moved(spark, lambda: catalog.QUERIES[name](spark, d)) for d in (sf, str(tmp_path)))
    further = 3 * catalog.read(spark, sf, "documents").count() * catalog.read(spark, sf, "benchmark").count()
    assert 0 < large - small < further / 2
