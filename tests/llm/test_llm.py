"""Training-data operators: brute force, round trips, held-out rows, and the cases that each docstring defines."""
import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.llm import decontaminate, htmltext, langid, langmodel, minhash, packing, periodic, quality, repeats, sharding, tokencount, toxicity

BPE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, shard string, slot string, low string, keys string, _th string, n_words string, block string"


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def frame(spark, texts, **over):
    rows = [(i, t, over.get("lang", "en"), over.get("source", "s"), len(t or ""), 0.5, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def edge(spark):
    """Null, empty, blank, symbol, very long and repeated texts; null columns; columns of clashing names."""
    base = words(120, 1)
    texts = [None, "", "  \n\t ", "!!! ???", base, base, base.replace("w1 ", "zz ", 1), words(60, 2), words(60_000, 3, 5000), "one two three", "ONE two   three", "x" * 50_000, "日本語 текст ñandú 😀"]
    df = frame(spark, texts)
    holes = df.filter("doc_id IN (4, 7)").selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "CAST(NULL AS STRING) lang", "CAST(NULL AS STRING) source", "n_chars", "score", *SCHEMA_TAIL)
    return df.union(df.filter("doc_id = 4")).union(holes)


SCHEMA_TAIL = [c.strip().split()[0] for c in SCHEMA.split(",")][6:]


def empty(spark):
    return frame(spark, ["x"]).limit(0)


# 1 -------------------------------------------------------------------------------------------------------------------


def shingle_counts(t):
    w = t.lower().split() if t else []
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / ((a | b).total() or 1)


def brute_classes(texts):
    s, root = [shingle_counts(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and jaccard(s[i], s[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_copies(seed=5):
    r, out = random.Random(seed), []
    for g in range(12):
        w = words(150, g).split()
        for _ in range(r.randrange(1, 9)):
            c = list(w)
            for _ in range(r.choice([0, 1, 2, 3, 6])):
                c[r.randrange(len(c))] = f"e{r.randrange(10**6)}"
            out.append(" ".join(c))
    common = words(60, 99)
    out += [f"{common} {words(60, 100 + i, 10**6)}" for i in range(12)]  # a shared passage makes no near-duplicate
    r.shuffle(out)
    return out


def test_signatures_estimate_weighted_jaccard():
    r, got = np.random.default_rng(0), []
    for _ in range(80):
        a = {int(x): int(r.integers(1, 9)) for x in r.integers(0, 1 << 62, 30)}
        b = {k: v if r.random() < 0.6 else int(r.integers(1, 9)) for k, v in a.items()}
        true = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
        d = np.repeat([0, 1], [sum(a.values()), sum(b.values())])
        h = np.concatenate([np.repeat(np.array(list(x), np.uint64), list(x.values())) for x in (a, b)])
        s, _ = minhash.signatures(d, h, 2)
        got.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(got)) < 0.02 and np.std(got) < 0.06


def test_near_duplicates_against_brute_force(spark):
    texts = near_copies()
    got = [r.class_id for r in minhash.near_duplicate_classes(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_classes(texts)


def test_near_duplicates_edges(spark):
    got = collections.defaultdict(set)
    rows = minhash.near_duplicate_classes(edge(spark)).collect()
    for r in rows:
        got[r.doc_id].add(r.class_id)
    assert len(rows) == edge(spark).count() and got[4] == got[5] == got[6] == {4} and got[9] == got[10] == {9} and got[0] == {0} and got[1] == {1}
    assert minhash.near_duplicate_classes(empty(spark)).count() == 0
    kept = minhash.drop_near_duplicates(edge(spark))
    assert kept.columns == edge(spark).columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 11, 12]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in minhash.classes_of(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


# 2 -------------------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    texts = [words(20, i) for i in range(400)] + ["same"] * 100
    rows = sharding.shard_digest(sharding.shuffle_into_shards(frame(spark, texts), 8, bucket_bytes=4000)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    by = collections.defaultdict(list)
    for r in rows:
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id]) + 1 and r.grown_shard in (r.shard, 8)
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(frame(spark, texts).repartition(7), 8, bucket_bytes=4000).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(500))[0, 1]) < 0.3
    grown = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(frame(spark, texts), 9).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)


def test_sharding_against_plain_recomputation(spark):
    """Shard, bucket order and slot of every record, worked out in one loop."""
    rows = [(i, words(8, i), i % 2 == 0, [i]) for i in range(200)] + [(7, words(8, 7), None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, flag boolean, list array<long>")
    seed, shards, size = 17, 3, sum(len(t) + 1 for _, t, _, _ in rows)
    buckets = -(-size // (500 * shards))
    hashes = df.distinct().select("doc_id", "text", *(F.xxhash64(F.lit(seed), "doc_id", F.lit(s)).alias(f"h{s}") for s in range(shards + 1)), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", F.xxhash64("text")), F.lit(buckets)).alias("b"))
    plan = {(r.doc_id, r.text): (max(range(shards), key=lambda s: (r[f"h{s}"], -s)), max(range(shards + 1), key=lambda s: (r[f"h{s}"], -s)), r.b) for r in hashes.collect()}  # noqa: B023
    want, slot = collections.Counter(), 0
    for s in range(shards):
        slot = 0
        for b in range(buckets):
            some = sorted((r for r in rows if plan[r[:2]][::2] == (s, b)), key=lambda r: (r[0], r[1], r[2] is None, r[2] or False, repr(r[3])))
            order = np.arange(len(some))
            np.random.Generator(np.random.PCG64([seed, s, b])).shuffle(order)
            for i in order:
                want[some[i][0], some[i][2], s, plan[some[i][:2]][1], slot] += 1
                slot += 1
    got = sharding.shuffle_into_shards(df.repartition(5), shards, bucket_bytes=500).collect()
    assert collections.Counter((r.doc_id, r.flag, r.shard, r.grown_shard, r.slot) for r in got) == want


def test_sharding_edges(spark, tmp_path):
    rows = sharding.shard_digest(sharding.shuffle_into_shards(edge(spark), 3)).collect()
    assert len(rows) == edge(spark).count() and {r.size for r in rows if r.doc_id == 0} == {1} and {r.text_crc32 for r in rows if r.doc_id == 0} == {0}
    assert sharding.shuffle_into_shards(empty(spark), 3).count() == 0
    sharding.write_shards(frame(spark, [words(9, i) for i in range(300)]), str(tmp_path / "out"), 2, bucket_bytes=2000)
    written = [pq.read_table(f, columns=["slot"])["slot"].to_pylist() for f in (tmp_path / "out").glob("*/*.parquet")]
    assert sum(map(len, written)) == 300 and len(written) > 4 and all(x == list(range(x[0], x[0] + len(x))) for x in written)


# 3 -------------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(WORD), random.Random(4)
    alphabet = "aabbccdeeehhiinoorrsstttxyz'0123 .,!-_\n\tÄéßñΣσİ日本한😀<|>"
    texts = ["".join(r.choices(alphabet, k=r.choice([1, 3, 8, 30, 80]))) for _ in range(1500)]
    texts += ["".join(r.choices("etaoinshrdlu", k=25)) for _ in range(800)] + ["a" * 300, "<|endoftext|>x<|startoftext|> <|endoftext|>", "ab\x1ccd \x1d e", "hello" * 900, "I'LL they've"]
    c = tokencount.counter(WORD)
    for t in texts:
        want = len(tok.encode(t, add_special_tokens=False).ids)
        assert c.count(t) == want and c.count(t, 3) == want and c.count(t, 7) == want, t
    got = tokencount.token_digest(edge(spark), WORD).collect()
    for r, t in zip(sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id), sorted((x for x in edge(spark).collect() if x.doc_id is not None), key=lambda x: x.doc_id)):
        n = len(tok.encode(t.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 2048, len((t.text or "").encode()))
    assert tokencount.token_digest(empty(spark), WORD).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def toxic_texts(n, seed):
    r, bad = random.Random(seed), ["grunkel", "snorvat", "blimpo", "fratzig"]
    out = []
    for i in range(n):
        w = words(40, seed * 10_000 + i, 3000).split()
        y = i % 3 == 0
        if y:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity(spark):
    rows = toxic_texts(600, 1)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scorer = toxicity.learn(docs.filter("doc_id < 400"), labels.filter("doc_id < 400"))
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, scorer).collect()}
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in rows if i >= 400]) > 0.97
    prob = lambda t: scorer.probability(scorer.texts([t], {}))[0]
    assert prob("you grun-kel") >= 0.3 and prob("you g r u n k e l !") >= 0.3 and prob("you grunxkel") > prob("you walk") and prob(None) == prob("") < 0.3
    out = toxicity.score_texts(edge(spark), scorer)
    assert out.count() == edge(spark).count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score_texts(empty(spark), scorer).count() == 0
    assert toxicity.learn(docs, labels.filter("toxic = 0")) == 0.0 and toxicity.score_texts(docs, 0.0).first().score == 0.0


def kernel(u, v):
    """The word kernel by enumerated subsequences of three letters and borders that span at most SPAN letters."""
    import itertools

    def weights(w):
        w, out = f"<{w}>", collections.Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def norm(w):
        return math.sqrt(sum(toxicity.DECAY ** (2 * (d - 2)) * (d - 1) * max(len(w) + 2 - d, 0) for d in range(2, toxicity.SPAN)))

    a, b = weights(u), weights(v)
    return sum(a[x] * b[x] for x in a) / norm(u) / norm(v)


def test_word_kernel_against_enumerated_subsequences():
    ws = ["a", "idiot", "id1iot", "idxiot", "abcabc", "réeux", "worthless", "worthwhile", "x" * 9]
    row, col, val = toxicity.triples(ws)
    dense = np.zeros((len(ws), 1 << toxicity.TABLE), np.float32)
    np.add.at(dense, (row, col), val)
    got = dense @ dense.T
    assert all(got[i, j] == pytest.approx(kernel(u, v), rel=1e-4, abs=1e-5) for i, u in enumerate(ws) for j, v in enumerate(ws))
    assert kernel("idiot", "idxiot") > 0.3 > kernel("idiot", "worthless")


def test_folded_machine_equals_its_landmarks():
    """The table gives what the machine's weights give over K(sentence, landmarks) K(landmarks, landmarks)^-1/2."""
    land, sentence = ["idiot", "scum", "trash"], ["you", "idiots", "of", "trash"]
    k = lambda a, b: np.array([[kernel(x, y) for y in b] for x in a])
    lam, vec = np.linalg.eigh(k(land, land))
    root = vec @ np.diag(lam**-0.5) @ vec.T
    w = np.array([1.0, -0.5, 2.0])
    columns = np.unique(toxicity.triples(land)[1])
    maps = toxicity.dense_rows(land, columns).astype(float).T @ root
    s = toxicity.Scorer(columns, maps @ w, -0.25, 1.0, 0.0)
    assert s.words(sentence) == pytest.approx(k(sentence, land) @ root @ w, abs=1e-4)
    assert toxicity.word_features(sentence, columns, maps.astype(np.float32)) == pytest.approx(k(sentence, land) @ root, abs=1e-4)
    want = [k(s_, land).sum(axis=0) @ root / math.sqrt(len(s_)) for s_ in (sentence, sentence[:2], ["scum"])]
    assert toxicity.sentence_features([sentence, sentence[:2], ["scum"]], columns, maps.astype(np.float32), 2) == pytest.approx(np.array(want), abs=1e-4)
    value = [s.words([w]).item() for w in sentence]
    most = max(sum(value[i : i + toxicity.CLAUSE]) for i in range(len(value) - toxicity.CLAUSE + 1)) / math.sqrt(toxicity.CLAUSE)
    assert s.texts(["You. of!\nyou idiots, of trash", None, ""], {}) == pytest.approx([-0.25 + max(most, value[0], value[2], 0), -0.25, -0.25], abs=1e-5)


def test_machine_of_squared_hinge():
    """Newton's point is the least one of the primal objective."""
    r = np.random.default_rng(2)
    x, y = r.normal(size=(200, 3)), np.where(r.random(200) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    weight = r.random(200) + 0.5
    w, b = toxicity._svm(x, y, weight, 1e-2)

    def loss(w, b):
        return 1e-2 * weight.sum() * (w @ w) + (weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    assert all(loss(w + d[:3], b + d[3]) >= loss(w, b) - 1e-6 for d in r.normal(size=(50, 4)) * 1e-3)


def test_machine_holds_a_row_a_word(spark, monkeypatch):
    """What the driver holds to learn grows with the words of the clauses, not with the clauses; rows made in parts are those of all at once."""
    rows, seen = toxic_texts(600, 1), []
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    whole = toxicity._svm

    def watched(x, y, weight, ridge, *at):
        held = getattr(x, "words", x)
        seen.append((held.nbytes, len(y) * held.shape[1] * 4))
        got = whole(x, y, weight, ridge, *at)
        every = x[at[0]] if at else x  # as a matrix that is held whole
        assert got[1] == pytest.approx(whole(every, y, weight, ridge)[1], abs=1e-9)
        return got

    monkeypatch.setattr(toxicity, "_svm", watched)
    toxicity.learn(docs, labels)
    assert seen and all(held < clauses / 2 for held, clauses in seen)
    columns = np.unique(toxicity.triples(["grunkel", "walk"])[1])
    maps, lists = np.eye(len(columns), dtype=np.float32), [["grunkel"], ["walk", "grunkel"], ["walk", "walk"], ["grunkel"]]
    every = toxicity.sentence_features(lists, columns, maps)
    assert (toxicity.Sentences(lists, columns, maps, 1)[np.array([3, 1])] == every[[3, 1]]).all() and len(toxicity.Sentences(lists, columns, maps)[np.zeros(0, int)]) == 0
    assert every[1] == pytest.approx((every[0] + toxicity.word_features(["walk"], columns, maps)[0]) / math.sqrt(2))


def test_toxicity_of_two_ordinary_words(spark):
    """Words that are toxic only side by side are learned from sentences."""
    r, rows = random.Random(4), []
    for i in range(500):
        w = [f"{a}{b}{c}" for a, b, c in zip(*(r.choices(x, k=30) for x in (["ka", "lo", "mi"], ["ne", "pu", "ri"], ["so", "ta", "vu"])))]
        y, at = i % 10, r.randrange(28)
        w[at : at + 2] = ["brodan", "felgit"] if y < 3 else ["brodan", w[at]] if y == 3 else ["felgit", w[at]] if y == 4 else w[at : at + 2]
        rows.append((i, " ".join(w), int(y < 3)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scorer = toxicity.learn(docs.filter("doc_id < 400"), labels.filter("doc_id < 400"))
    value = scorer.texts(["lonepuso brodan felgit mipuso", "lonepuso brodan mipuso", "lonepuso felgit mipuso"], {})
    assert value[0] > max(value[1:])


def test_toxicity_of_letters_with_marks_in_a_long_text():
    s = toxicity.Scorer(np.unique(toxicity.triples(["abc"])[1]), np.float32(1), -0.5, 1.0, 0.0)
    long = "xxxx zzzzz " * 40
    value = s.texts([long + "a. b. c. " + long, "a. b. c.", "a b c", long, long + "a. b. " + long], {})
    assert value[0] == value[1] == value[2] > value[3] and value[2] > value[4]


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    hit = sum(r.toxic and r.predicted for r in got)
    assert hit / sum(r.predicted for r in got) > 0.7 and hit / sum(r.toxic for r in got) > 0.6
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


# 5 -------------------------------------------------------------------------------------------------------------------


def check_packing(pieces, texts, window=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids = [[*(tok.encode(t, add_special_tokens=False).ids if t else []), 1] for t in texts]
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    assert sorted(docs) == list(range(len(texts)))
    for d, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            part = np.array(ids[d][p.start : p.start + p.length], "<u4")
            assert p.start == at and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids[d])
            at += p.length
        assert at == len(ids[d])
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(map(len, ids)) / (len(seqs) * window)


def test_packing(spark):
    texts = [words(random.Random(i).randrange(1, 900), i, 10**5) for i in range(300)] + [None, "", "a<|endoftext|>b", words(9000, 7)]
    pieces = packing.packing_digest(packing.pack_documents(frame(spark, texts).coalesce(1), BPE)).collect()
    assert check_packing(pieces, texts) > 0.95
    assert packing.pack_documents(empty(spark), BPE).count() == 0
    assert packing.pack_documents(edge(spark), BPE).select("sequence_id").distinct().count() > 0


def test_karmarkar_karp():
    r = random.Random(2)
    for _ in range(100):
        sizes, k = [r.randrange(1, 256) for _ in range(r.randrange(0, 60))], r.randrange(1, 12)
        parts = packing.karmarkar_karp(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert not sizes or max(sums) - min(sums) <= max(sizes)
        w = packing.windows(sizes, 256)
        assert sorted(i for p in w for i in p) == list(range(len(sizes))) and all(sum(sizes[i] for i in p) <= 256 for p in w)
    assert sorted(map(len, packing.karmarkar_karp([8, 7, 6, 5, 4], 2))) == [2, 3]


# 6 -------------------------------------------------------------------------------------------------------------------


def base_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [*zip(w, w[1:], w[2:])]
    c = collections.Counter(tri)
    hit = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark):
    r = random.Random(6)
    texts = ["".join(r.choices(["a", "b", "cc", " ", " ", "\n", "\t", "#", "|", "é", " ", "\x0b"], k=r.choice([0, 2, 10, 60, 200]))) for _ in range(300)] + [None, "a b " * 3000, "x y z\nx y z\n\nx y z"]
    got = quality.judge_quality(frame(spark, texts)).orderBy("doc_id").collect()
    for row, t in zip(got, texts):
        want = base_stats(t)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (row.base_failed and row.kept)


def test_quality_outliers(spark):
    texts = [words(80, i, 3000) for i in range(300)] + [" ".join(w + "%%%" for w in words(80, 1000 + i).split()) for i in range(20)]
    df = frame(spark, texts)
    rows = {r.doc_id: r.kept for r in quality.judge_quality(df).collect()}
    assert not any(rows[i] for i in range(300, 320)) and sum(rows[i] for i in range(300)) >= 298
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in rows.items() if k}
    assert quality.judge_quality(edge(spark)).count() == edge(spark).count() and quality.judge_quality(empty(spark)).count() == 0
    assert quality.filter_quality(edge(spark)).count() > 0 and quality.filter_quality(empty(spark)).count() == 0


def test_quality_judges_small_groups(spark):
    """Sources of five rows and of one row (judged by their language), and a language of few rows (judged by all rows), one of them of long words."""
    junk = lambda seed: " ".join(w + "%%%" for w in words(80, seed).split())
    long_words = lambda seed: " ".join(w * 12 for w in words(80, seed, 3000).split())
    texts = [(words(80, i, 3000), "en", "big") for i in range(100)]
    texts += [(words(80, 200 + i, 3000), "en", "five") for i in range(4)] + [(junk(300), "en", "five"), (junk(301), "en", "one")]
    texts += [(words(80, 400 + i, 3000), "fr", "few") for i in range(4)] + [(junk(500), "fr", "few"), (junk(501), "de", None)]
    texts += [(long_words(600 + i), None, "long") for i in range(12)] + [(junk(700), None, "long")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = quality.judge_quality(df).collect()
    assert len(got) == len(texts) and all(r.base_failed or r.distance2 is not None for r in got)
    assert {r.doc_id for r in got if not r.kept} == {i for i, (t, *_) in enumerate(texts) if "%%%" in t}


@pytest.mark.parametrize("share", [0.35, 0.45])
def test_quality_rejects_much_junk(spark, share):
    junk = round(200 * share)
    texts = [words(80, i, 3000) for i in range(200 - junk)] + [" ".join(w + "%%%" for w in words(80, 1000 + i).split()) for i in range(junk)]
    rows = {r.doc_id: r.kept for r in quality.judge_quality(frame(spark, texts)).collect()}
    assert not any(rows[i] for i in range(200 - junk, 200)) and sum(rows[i] for i in range(200 - junk)) >= 199 - junk


def numpy_mcd(x, starts=300, seed=1):
    """(location, scatter) of the least determinant that concentration reaches from many random rows."""
    n, d = x.shape
    percent = min(100, math.ceil(50 * (n + d + 1) / n))
    factor, floor, best = quality._consistency(percent / 100), np.diag([f * f for _, f in quality._VECTOR]), None
    r = np.random.default_rng(seed)
    for _ in range(starts):
        some, last = x[r.choice(n, d + 1, replace=False)], math.inf
        m, c = some.mean(0), np.cov(some.T, bias=True) + floor
        while True:
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            key = np.round(np.log(d2 + 1e-9), 3)
            half = x[key <= np.quantile(key, percent / 100)]
            m, c = half.mean(0), np.cov(half.T, bias=True) * factor + floor
            det = np.linalg.slogdet(c)[1]
            if det > last - 1e-4:
                break
            last = det
        if best is None or det < best[0]:
            best = det, m, c
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quality_verdict_equals_numpy(spark, seed):
    """Groups with scattered, clustered and correlated junk: the same rows go as by a minimum determinant searched from 300 starts."""
    r, rows = random.Random(seed), []
    for source, share in (("a", 0.1), ("b", 0.3), ("c", 0.4)):
        for i in range(90):
            w = letters(r.randrange(60, 90), 1000 * seed + len(rows), 10 ** r.choice([3, 4])).split()
            kind = r.random()
            if kind < share * 0.6:
                w = [x * 9 for x in w]  # one cluster
            elif kind < share:
                w = [x + "#" * r.randrange(9) for x in w] + w[: r.randrange(20)]  # scattered
            rows.append((len(rows), " ".join(w), "en", source))
    got = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), carry=("doc_id", "source")).collect()
    for source in "abc":
        some = [g for g in got if g.source == source and not g.base_failed]
        x = np.array([[math.log(g.word_chars / g.n_words), *(math.sqrt(v / g.n_words) for v in (g.n_symbols, g.n_repeat_words, g.n_dup_lines))] for g in some])
        _, m, c = numpy_mcd(x)
        d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        clear = np.abs(np.log(d2 / 32)) > 0.1
        assert clear.mean() > 0.9 and all(g.kept == (v <= 32) for g, v, k in zip(some, d2, clear) if k)
        assert len(some) > 80 and 0 < sum(not g.kept for g in some) < 45


def test_quality_is_native(spark, sf):
    plan = entry.queries()["op6_quality_rules"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7 -------------------------------------------------------------------------------------------------------------------


def lm_tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute_lm(texts, held, mu, order=3):
    """A plain backoff loop over dictionaries of n-grams."""
    count, n_train = collections.Counter(), 0
    for t, h in zip(texts, held):
        if not h:
            w = ["<s>", *lm_tokens(t)]
            count.update(tuple(w[i - n + 1 : i + 1]) for i in range(1, len(w)) for n in range(1, order + 1) if i - n + 1 >= 0)
            n_train += 1
    uni = {k[0]: c for k, c in count.items() if len(k) == 1}
    n, v = sum(uni.values()), len(uni)
    one, two = (sum(1 for c in uni.values() if c == k) for k in (1, 2))
    d = one / (one + 2 * two) if one else 0.5
    seen = lambda h: n_train if h == ("<s>",) else count[h]

    def weight(h, x):
        """The arc of state h for x, or its failure arc and what follows."""
        if not h:
            return math.log10((uni[x] - d) / n if x in uni else d * v / n)
        m = mu[len(h) - 1]
        if count[(*h, x)]:
            return math.log10((count[(*h, x)] + m * 10 ** weight(h[1:], x)) / (seen(h) + m))
        return (math.log10(m / (seen(h) + m)) if seen(h) else 0.0) + weight(h[1:], x)

    out = []
    for t in texts:
        w = ["<s>", *lm_tokens(t)]
        base = sum(math.log10((uni.get(x, 0) + 1) / (n + 1 * (v + 1))) for x in w[1:])
        score = sum(weight(tuple(w[max(0, i - order + 1) : i]), w[i]) for i in range(1, len(w))) if n else 0.0
        out.append((len(w) - 1, sum(x in uni for x in w[1:]), n, base, score))
    return out


LM_TEXTS = [words(random.Random(i).randrange(0, 60), i, 50) for i in range(120)] + [None, "", "New words only", "W1 w1 W2", words(1500, 5, 40), "zzz", "w1 zzz w2"]


@pytest.mark.parametrize("order, fan, block, slice_keys", [(3, 13, 2000, 1 << 20), (4, 13, 1 << 20, 50), (3, 2, 600, 200), (2, 3, 300, 100)])
def test_language_model_against_brute_force(spark, monkeypatch, order, fan, block, slice_keys):
    """One level of asking, and several (groups of 3 blocks)."""
    monkeypatch.setattr(langmodel, "FAN", fan)
    monkeypatch.setattr(langmodel, "GROUP", 3)
    mu = (50.0, 5.0, 2.0)
    held = [i % 7 == 2 for i in range(len(LM_TEXTS))]
    got = langmodel.score_corpus(frame(spark, LM_TEXTS), held_out=F.col("doc_id") % 7 == 2, order=order, mu=mu, block_bytes=block, slice_keys=slice_keys).orderBy("doc_id").collect()
    for row, h, want in zip(got, held, brute_lm(LM_TEXTS, held, mu, order)):
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (h, *want[:3])
        assert row.base_score == pytest.approx(want[3], rel=1e-9) and row.score == pytest.approx(want[4], rel=1e-9, abs=1e-12)


def test_language_model_edges(spark):
    got = langmodel.score_corpus(edge(spark)).collect()
    assert len(got) == edge(spark).count() and all(r.score < 0 for r in got) and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert langmodel.score_corpus(empty(spark)).count() == 0
    none = langmodel.score_corpus(frame(spark, ["a b", None]), held_out=F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in none} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}


def test_packed_numbers():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0, 1], np.uint64), r.integers(0, 1 << 63, 1000).astype(np.uint64), np.concatenate((np.ones(5000, np.uint64), [np.uint64(2**64 - 1)]))):
        assert (langmodel._unpack(langmodel._pack(x)) == x).all() and (langmodel._unpack_sorted(langmodel._pack_sorted(np.sort(x))) == np.sort(x)).all()
    assert len(langmodel._pack(np.concatenate((np.ones(5000), [2**40])).astype(np.uint64))) < 5100


def test_automaton_states_sum_to_one():
    """The probabilities that leave a state, over all known words and the unknown class, sum to 1; segments don't change a walk."""
    numbers = langmodel._Numbers()
    texts = [langmodel.numbered(t, numbers) for t in [*LM_TEXTS[:60], "unknown", LM_TEXTS[124]]]
    vocabulary, codes, sizes = langmodel.word_hashes(numbers), np.concatenate(texts), np.array([len(x) for x in texts])
    n = int(sizes[:60].sum())
    counts = [np.bincount(number[at < n], minlength=len(every)).astype(float) for at, every, _, number in langmodel.ngrams(vocabulary, codes, sizes, 3)]
    kinds = int((counts[0] > 0).sum())
    machine = langmodel.Automaton(vocabulary, codes, sizes, 3, counts, 60, n, kinds, 0.5, [50.0, 5.0])
    known = np.flatnonzero(machine.known)
    unknown = np.flatnonzero(~machine.known)[:1]
    some = np.concatenate((known, unknown))
    word = known[known != machine.word[sizes[0] - 1]]  # no state follows the end token
    one, _ = machine.step(np.zeros(len(word), np.int64), word)
    two, _ = machine.step(np.repeat(one, len(word)), np.tile(word, len(word)))
    assert len({0, 1, *one, *two}) > 500
    for state in sorted({0, 1, *one[:20].tolist(), *two[::5].tolist()}):
        _, weight = machine.step(np.full(len(some), state), some)
        assert (10**weight).sum() == pytest.approx(1)
    assert machine.walk(sizes, 7) == pytest.approx(machine.walk(sizes, 10_000))


# 8 -------------------------------------------------------------------------------------------------------------------

RICH = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p><p>no";</script></head><body class="page has-sidebar"><nav><a>Menu</a></nav>
<div class="cookie-notice">N</div><div id=sidebar>S</div><main><header><h1>T &amp; t</h1></header><p>a<b>b</b> c&nbsp;d &lt;x&gt;<br>e<ul><li>x<li>y</ul><!-- no --><table><tr><td>1<td>2</table>
<section class="comments"><article><p>bad</p></article></section><form>f</form><pre> q
 w</pre></main><aside>o</aside><footer>z</footer>"""


def test_page_text():
    text = lambda h: htmltext.Page(h).text()
    assert text(RICH) == "T & t\na b c d <x> e\nx\ny\n1\n2\nq w".replace("a b c", "ab c")
    assert text(None) == text("") == "" and text("plain &amp; simple") == "plain & simple" and text("<p>open <a href='x>y'>link</a>") == "open link"


def test_article_parts_stay():
    text = lambda h: htmltext.Page(h).text()
    body = '<section id="discussion"><p>We find x.</p></section><p class="legal">Law.</p><div class="print">Ink.</div><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><div class="article-header">H</div>'
    parts = "We find x.\nLaw.\nInk.\nso x=2 holds\nH"
    assert text(f"<article><p>First.</p>{body}</article>") == "First.\n" + parts
    junk = '<div class="post-comments">c</div><div id="comments">c</div><div class="ad-container">a</div><ul class="share links"><li>s</ul><svg><text>v</text></svg>'
    assert text(f"<article><p>First.</p>{body}{junk}</article>") == "First.\n" + parts and text(f"<p>First.</p>{body}{junk}") == "First.\n" + parts
    assert text('<div class="post-tags-body"><p>Only.</p></div>') == "Only." 
    # A page of nothing but boilerplate is empty.
    assert text('<div class="menu"><p>Only.</p></div>') == text("<nav>Only.</nav>") == text("<form><nav>m</nav><p>All of the page is a form.</p></form>") == ""
    # What is marked in the middle of a paragraph goes, the paragraph stays one block.
    inline = {"A <button>Share</button> b": "A b", "A<button>Share</button>b": "A b", '<span class="ad">Buy now</span>': "", 'Read <a class="share" href=x>Share this</a>on.': "Read on.", "<label>Name</label>It ends.": "It ends.", "x <dialog>Accept cookies</dialog> y": "x y", "x <menu>m</menu> y": "x y", '<span id="cookie-banner">Accept</span> z': "z"}
    for inner, want in inline.items():
        assert text(f"<article><p>{inner}</p></article>") == text(f"<article><p>{inner}</article>") == want
    assert text("<article><p>a</p><button>Subscribe</button></article><dialog>Accept cookies</dialog>") == "a"
    told = '<p class="promotion">He won promotion.</p><p class="comment">No comment.</p><h2 class="notice">Notice</h2>'
    assert text(f"<article>{told}</article>") == "He won promotion.\nNo comment.\nNotice"
    assert text('<article><p>a</p><p class="ad">Buy.</p><div class="comments"><p>First!</p></div></article>') == "a"
    deep = "<div>" * 3000 + "<p>deep</p>"
    assert text(deep) == "deep" and len(text("<p>long text</p>" * 200_000)) == 200_000 * 10 - 1


def letters(*args):
    return words(*args).translate(str.maketrans("0123456789", "aeioubcdfg"))


def neutral_pages(n, hosts, seed=1):
    """(id, url, html, the article's text): no tag or class tells the article from the menu, the notice and the footer, which come from a pool of 12."""
    r, out = random.Random(seed), []
    for i in range(n):
        host = f"{'w' * (1 + i % hosts)}.example.net"
        blocks = [letters(r.randrange(8, 25), 1000 * seed + 7 * i + j, 5000) for j in range(r.randrange(2, 6))]
        k = i % 12
        menu, notice, foot = "".join(f"<li><a>{w}</a>" for w in letters(5, 900 + k).split()), letters(9, 800 + k), letters(6, 700 + k)
        page = f'<body><div class=a><ul>{menu}</ul></div><div class=b>{notice} {r.randrange(10**6)}</div><div class=c>{"".join(f"<p>{b}" for b in blocks)}</div><div class=d>&copy; {host} {foot}</div>'
        out.append((i, f"http://{host}/{i}", page, "\n".join(blocks)))
    return out


@pytest.mark.parametrize("hosts", [1, 30])
def test_style_tree_alone_finds_the_article(spark, hosts):
    """Many pages of a host, or a few pages of each of many hosts: the tree of the host, or the one over all hosts, decides."""
    rows = neutral_pages(240, hosts)
    df = spark.createDataFrame([(i, u, h, "k") for i, u, h, _ in rows], "page_id long, url string, html string, low string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert all(got[i].text == t and got[i].low == "k" for i, _, _, t in rows)
    # Where an article is marked, the limits are others; the tree still drops the unmarked rest and a repeated part inside.
    inside = df.withColumn("html", F.replace(F.replace("html", F.lit("<div class=c>"), F.lit("<article><b>Read on</b>")), F.lit("</div><div class=d>"), F.lit("</article><div class=d>")))
    got = {r.page_id: r.text for r in htmltext.extract(inside).collect()}
    assert all(got[i] == t for i, _, _, t in rows)


def test_style_tree_entropies_against_brute_force(spark):
    rows = neutral_pages(60, 3, 2)
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in rows], "page_id long, url string, html string")
    summed = htmltext.node_features(df).cache()
    for level in (["host"], []):
        seen, style, held, times, chars = (collections.defaultdict(collections.Counter) for _ in range(5))
        for _, url, h, _ in rows:
            host, page = url.split("/")[2], htmltext.Page(h)
            at = (host if level else None,)
            for node, kids in page.styles.items():
                seen[at][node] += 1
                style[at, node]["\n".join(kids)] += 1
            once = set()
            for b, node, mark, _ in page.blocks:
                f = re.sub("[0-9]+", "#", b.replace(host, "@"))  # letters outnumber digits in every block
                times[at, node][f] += 1
                chars[at][node] += len(b)
                once.add((node, f))
            for node, f in once:
                held[at, node][f] += 1
        want = {}
        for at in seen:
            content = {}
            for node, m in seen[at].items():
                if m >= 4 and times[at, node]:
                    content[node] = sum(n * (1 - math.log(held[at, node][f], m)) for f, n in times[at, node].items()) / times[at, node].total()
            mean = sum(c * chars[at][n] for n, c in content.items()) / sum(chars[at][n] for n in content)
            for node, c in content.items():
                m, l = seen[at][node], len(style[at, node])
                n = sum(-k / m * math.log(k / m, m) for k in style[at, node].values())
                want[at[0], node] = max(c, (1 - 0.9**l) * n + 0.9**l * c) / mean
        features = summed if level else summed.groupBy("node", "kind", "feature").agg(*(F.sum(c).alias(c) for c in ("n", "times", "chars")))
        got = {(r["host"] if level else None, r["node"]): r["value"] for r in htmltext.node_importance(features, level, 4, 0.9).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_style_tree_edges(spark):
    rows = [(i, "http://h.example/x", f"<body><div class=q><div>Welcome to our site</div></div><div class=r><p>{words(20, i, 5000)}</div></body>", "k") for i in range(30)]
    rows += [(100, None, None, "k"), (101, "http://one.example/", "<body><div class=q><div>Welcome to our site</div></div></body>", "k"), (102, "http://one.example/", "", None)]
    rows += [(200 + i, "http://same.example/", "<body><p class=s>Only a copy</p><p class=t>of one page</p></body>", "k") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, low string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert len(got) == len(rows) and all("Welcome" not in got[i].text and got[i].text for i in range(30)) and got[100].text == got[102].text == "" and got[0].low == "k"
    assert got[101].text == "Welcome to our site"  # nothing would be left
    assert got[200].text == "Only a copy\nof one page"  # all of a host repeats: nothing is less important than the rest
    assert htmltext.feature("Page 3 of h.example", "h.example") == "Page # of @" and htmltext.feature("12.5 80", "") == "12.5 80"  # figures of a table are told apart
    assert htmltext.extract(df.limit(0)).count() == 0 and htmltext.extract(df.limit(1)).count() == 1


def test_pages_of_the_tables(spark, sf):
    for r in entry.queries()["op8_html_extraction"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 9 -------------------------------------------------------------------------------------------------------------------


def test_viterbi_against_brute_force():
    import itertools

    r = np.random.default_rng(3)
    sizes = np.array([3, 0, 5, 1])
    s = r.normal(size=(sizes.sum(), 3)) * 3
    got = langid.viterbi(s, sizes, 1.5)
    at = 0
    for n in sizes:
        part = s[at : at + n]
        if n:
            value = lambda p: sum(part[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert value(got[at : at + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))
        at += n


def test_languages(spark, sf):
    got = entry.queries()["op9_language_id"](spark, sf).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == true[r.doc_id] for r in got if r.held_out]) > 0.95


def test_language_spans_and_edges(spark):
    texts = [("the cat and the dog are in the house with their friends", "en"), ("der hund und die katze sind in dem haus mit ihren freunden", "de"), ("кот и собака живут в доме", "ru")] * 5
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    mixed = spark.createDataFrame([("the dog and the cat are in the house der hund und die katze sind in dem haus собака и кот",)], "text string")
    spans = langid.identify(mixed, model, switch=4.0, with_spans=True).first().lang_spans
    assert [s.lang for s in spans] == ["en", "de", "ru"]
    got = {r.doc_id: r for r in langid.identify(edge(spark), model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and got[0].score == 0 and got[12].lang_pred != "und"
    assert langid.identify(empty(spark), model).count() == 0 and langid.learn(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.identify(edge(spark), None).filter("lang_pred <> 'und'").count() == 0
    assert langid.filter_languages(edge(spark), model=model).columns == edge(spark).columns


def test_languages_of_one_script_among_many(spark):
    """Letters that tell two languages of one script apart are kept, however many letters other languages have."""
    r = random.Random(9)
    shared = "абвгдежзиклм"

    def text(own, share):
        return " ".join("".join(own if r.random() < share else r.choice(shared) for _ in range(5)) for _ in range(40))

    rows = [(text(own, 0.01), lang) for lang, own in (("x", "і"), ("y", "ы")) for _ in range(40)]
    for k in range(6):
        rows += [(" ".join("".join(chr(0x4E00 + 60 * k + r.randrange(60)) for _ in range(5)) for _ in range(40)), f"z{k}") for _ in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(text(own, 0.3), lang) for lang, own in (("x", "і"), ("y", "ы")) for _ in range(12)]
    got = langid.identify(spark.createDataFrame(asked, "text string, want string"), model).collect()
    assert all(g.lang_pred == g.want for g in got)


def test_languages_of_few_distinct_texts(spark):
    """A language whose documents are copies of one text is learned, whatever that text's hash; equal rows, too."""
    a, b = "the cat and the dog are in the house with their friends", "der hund und die katze sind in dem haus mit ihren freunden"
    for columns in ("doc_id long, text string, lang string", "text string, lang string"):
        for k in range(4):
            rows = [(f"{words(5, i)} {a}", "en") for i in range(60)] + [(b + " x" * k, "de")] * 400
            rows = [(i, *r) for i, r in enumerate(rows)] if "doc_id" in columns else rows
            model = langid.learn(spark.createDataFrame(rows, columns), per_lang=2)
            assert model.langs == ["de", "en"]
            got = langid.identify(spark.createDataFrame([(b, "de"), (a, "en")], "text string, want string"), model).collect()
            assert all(g.lang_pred == g.want for g in got)
    none = spark.createDataFrame([("1 2 3", "zz"), (a, "en")], "text string, lang string")
    assert langid.learn(none).langs == ["en"] and langid.learn(none.filter("lang = 'zz'")) is None


def test_language_scores_against_a_plain_loop(spark):
    """Trigram scores, script narrowing, Viterbi and the document's score, counted by loops over letters."""
    import itertools

    train = [("den hund og kat", "da"), ("der Hund, und Katze", "de"), ("кот и собака", "ru"), ("ein Haus – zwei Häuser", "de"), ("et hus", "da")]
    model = langid.learn(spark.createDataFrame(train, "text string, lang string"))
    langs, count, scripts = ["da", "de", "ru"], collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)

    def grams(w):
        w = f" {w} "
        return [tuple(x if x.isalpha() else "" for x in w[i - 1 : i + 2]) for i in range(1, len(w) - 1) if w[i].isalpha()]

    def script(c):
        return langid.SCRIPTS[int(langid.scripts_of(np.array([ord(c)]))[0])]

    for t, l in train:
        for w in t.lower().split():
            count[l].update(grams(w))
            scripts[l].update(script(c) for c in w if c.isalpha())
    kinds = {g for l in langs for g in count[l]}
    alphabet = {c for g in kinds for c in g}
    asked = ["der hund og katze", "собака und hus", "zwei кот", "qqq! 12 kat", "12 !!", "katze собака"]
    for row in langid.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model, switch=3.0).collect():
        by_word, letters = [], []
        for w in row.text.lower().split():
            own = {script(c) for c in w if c.isalpha()}
            value = []
            for l in langs:
                bottom = math.log(count[l].total() + 0.5 * (len(kinds) + 1))
                value.append(sum(math.log((count[l][g] if set(g) <= alphabet else 0) + 0.5) - bottom for g in grams(w)))
            fits = [any(s in own for s, n in scripts[l].items() if n >= 0.02 * scripts[l].total()) for l in langs]
            if own and any(fits):
                value = [v if f else min(value) - 20 for v, f in zip(value, fits)]
            by_word.append(value)
            letters.append(sum(c.isalpha() for c in w))
        if not sum(letters):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        value = lambda p: sum(by_word[i][k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        path = max(itertools.product(range(3), repeat=len(letters)), key=value)
        held = [sum(n for n, k in zip(letters, path) if k == j) for j in range(3)]
        best = held.index(max(held))
        total = [sum(v[j] for v, k in zip(by_word, path) if k == best) for j in range(3)]
        belief = 1 / sum(math.exp(min(t - total[best], 50)) for t in total)
        assert row.lang_pred == langs[best] and row.score == pytest.approx(max(held) / sum(held) * belief, rel=1e-4, abs=1e-6)


def test_language_filter_sets_languages(spark):
    a, b = "the cat and the dog are in the house with their friends", "der hund und die katze sind in dem haus mit ihren freunden"
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([(a, "en"), (b, "de")] * 6 + [(a, None), (b, "en"), ("12 !!", "en"), (None, "de")])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in langid.filter_languages(docs).collect()}
    assert got == {**{i: ("en", "de")[i % 2] for i in range(12)}, 12: "en", 13: "de"}


# 10 ------------------------------------------------------------------------------------------------------------------


def test_fm_index_against_brute_force():
    r = random.Random(1)
    for _ in range(150):
        vocab = [f"w{i}" for i in range(r.choice([2, 3, 8]))]
        items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 5, 10, 14])))) for i in range(4)]
        texts = [" ".join(r.choices([*vocab, "zz"], k=r.choice([0, 1, 5, 30, 60]))) for _ in range(8)]
        win = decontaminate.Windows(items, 5)
        words_, n_words = decontaminate._word_hashes(texts)
        doc, at, num = decontaminate.shard_hits(words_, n_words, win)
        items_of = lambda w: win.items[win.at[w] : win.at[w + 1]].tolist()  # noqa: B023, E731
        got = [(int(n_words[i]), len({p for d, a, w in zip(doc, at, num) if d == i for p in range(a, a + win.length[w])}), sorted({x for d, w in zip(doc, num) if d == i for x in items_of(w)})) for i in range(len(texts))]
        assert got == decontaminate.brute_force(texts, items, 5)


def test_blocks_of_the_benchmark(spark):
    """A long item is cut into parts that hold all its windows between them; blocks hold to their size."""
    long = words(500, 3, 10**6)
    parts = list(decontaminate._pieces(1, long, 400, 10))
    whole = lambda texts: {tuple(w[i : i + 10]) for t in texts for w in [t.split()] for i in range(len(w) - 9)}
    assert len(parts) > 5 and whole(t for _, t in parts) == whole([long])
    df = spark.createDataFrame([(i, words(30, i, 10**6)) for i in range(40)] + [(99, long), (100, None)], "item_id long, text string")
    blocks = decontaminate._blocks(df, "item_id", "text", 600, 10)
    assert len(blocks.sent) > 10 and not blocks.keep and sum(len(w.begin) for w in blocks) == 40 * 21 + 491


def test_merged_spans():
    got = decontaminate.merged_spans(np.array([1, 0, 1, 0, 1]), np.array([5, 0, 1, 2, 8]), np.array([8, 1, 4, 9, 9]))
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [0, 2, 1, 5], [1, 9, 4, 9]]


def test_contamination(spark):
    passage = words(40, 77, 10**6)
    items = spark.createDataFrame([(1, passage), (2, "Only, three-words"), (3, None), (4, "..."), (5, passage)], "item_id long, text string")
    texts = [f"{words(30, 1)}\n{passage.upper()}! {words(30, 2)}", words(50, 3), "say only three words now", None, "", passage, " ".join(passage.split()[:9])]
    df = frame(spark, texts)
    for block in (1 << 20, 64):  # in one block, and in many passes
        got = decontaminate.contamination_digest(decontaminate.find_contamination(df, items, block_bytes=block)).orderBy("doc_id").collect()
        want = decontaminate.brute_force(texts, [(r.item_id, r.text) for r in items.collect()])
        assert [(r.n_words, r.n_hit, r.items_sha256) for r in got] == [(n, h, hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest()) for n, h, i in want]
    clean = decontaminate.decontaminate(df, items)
    left = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == df.columns and set(left) == {0, 1, 2, 3, 4, 6} and left[1].text == texts[1] and left[2].text == "say\nnow" and left[0].n_chars == len(left[0].text)
    assert not any(h for _, h, _ in decontaminate.brute_force([r.text for r in left.values()], [(r.item_id, r.text) for r in items.collect()]))
    # An item without an id is hit, but not listed.
    nameless = spark.createDataFrame([(None, passage), (2, "three words now"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(df, nameless, block_bytes=64).collect()}
    assert got[5].hit_items == [] and len(got[5].hit_spans) == 1 and got[2].hit_items == [2]
    assert {r.n_items for r in decontaminate.contamination_digest(decontaminate.find_contamination(df, nameless)).collect()} == {0, 1}
    assert decontaminate.find_contamination(edge(spark), items).count() == edge(spark).count()
    assert decontaminate.find_contamination(empty(spark), items).count() == 0 and decontaminate.find_contamination(df, items.limit(0)).filter("size(hit_spans) > 0").count() == 0


# 11 ------------------------------------------------------------------------------------------------------------------


def plain_runs(x, least=24, times=3):
    """(start, length, period): for each period the islands of words that equal the one a period on."""
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(r):
    out = []
    for _ in range(r.randrange(0, 6)):
        alphabet = r.choice((1, 2, 3, 30))
        unit = [r.randrange(alphabet) for _ in range(r.randrange(1, 25))]
        out += unit if r.random() < 0.4 else (unit * 40)[: r.randrange(1, 150)]
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (3, 3), (7, 4)])
def test_runs_against_brute_force(least, times):
    r = random.Random(least)
    for _ in range(60):
        texts = [repetitive(r) for _ in range(r.randrange(1, 6))]
        got = [[] for _ in texts]
        for i, *run in zip(*(x.tolist() for x in periodic.runs_of(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least, times))):
            got[i].append(tuple(run))
        assert got == [plain_runs(t, least, times) for t in texts]


def test_runs_of_texts(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{x}" for x in repetitive(r)) for _ in range(40)] + ["a b c d e f g h " * 5, None, ""]
    for size in (4 << 20, 200):  # in one batch, and text by text
        got = {x.doc_id: x for x in periodic.find_runs(frame(spark, texts), batch_bytes=size).collect()}
        for i, t in enumerate(texts):
            ws = (t or "").split()
            runs = plain_runs(ws)
            drop = {j for s, n, q in runs for j in range(s + q, s + n)}
            assert [tuple(x) for x in got[i].runs] == runs and got[i].n_words == len(ws)
            assert got[i].collapsed == " ".join(w for j, w in enumerate(ws) if j not in drop)
    assert got[40].collapsed == "a b c d e f g h"
    best = {x.doc_id: x for x in periodic.run_digest(periodic.find_runs(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        runs = plain_runs((t or "").split())
        want = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (best[i].start, best[i].length, best[i].period) == want and best[i].n_runs == len(runs)
        assert best[i].exponent_milli == (1000 * want[1] // want[2] if runs else None)
        assert best[i].runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()


def test_runs_on_edges(spark):
    df = edge(spark)
    got = periodic.run_digest(periodic.find_runs(periodic.with_planted_runs(df)))
    assert got.count() == df.count() and got.filter("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0
    assert sum(r.doc_id is None for r in got.collect()) == 2
    assert periodic.run_digest(periodic.find_runs(empty(spark))).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(df, times=2)


def test_planted_runs_by_hand(spark):
    texts = [words(n, i) for i, n in enumerate([1, 2, 5, 40, 200] * 8)] + ["", None]
    for r in periodic.with_planted_runs(frame(spark, texts)).collect():
        ws, h = (texts[r.doc_id] or "").split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        assert (r.text or "").split() == ws


# 12 ------------------------------------------------------------------------------------------------------------------


def plain_repeats(rows, window):
    """(id, text) -> per row (words, words removed, words kept)."""
    first, out = {}, []
    cut = lambda ws: [tuple(ws[i : i + window]) for i in range(len(ws) - window + 1)]
    for d, t in rows:
        for w in cut((t or "").split()):
            if d is not None:
                first[w] = min(first.get(w, d), d)
    for d, t in rows:
        ws = (t or "").split()
        drop = {j for i, w in enumerate(cut(ws)) if d is not None and first[w] < d for j in range(i, i + window)}
        out.append((d, len(ws), len(drop), " ".join(x for j, x in enumerate(ws) if j not in drop)))
    return out


@pytest.mark.parametrize("window, block, keys, fan", [(50, 6 << 20, 1 << 21, 12), (10, 300, 16, 2), (7, 300, 64, 12), (2, 4000, 200, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, window, block, keys, fan):
    """Shared passages, copies, repeats inside a text, ids out of order, equal, negative and null; in one block and slice, and in many levels."""
    monkeypatch.setattr(repeats, "FAN", fan)
    r = random.Random(window)
    passages = [words(r.randrange(window - 1, 3 * window + 5), 500 + i) for i in range(6)]
    rows = []
    for _ in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else words(r.randrange(1, 60), r.randrange(10**6)) for _ in range(r.randrange(0, 5))]
        rows.append((r.choice((None, *range(-20, 40))), " ".join(parts)))
    rows += [rows[3], rows[4], (99, None), (98, ""), (97, passages[0] + " " + passages[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.find_repeats(df, window=window, block_bytes=block, slice_keys=keys)
    got = [(x.doc_id, x.n_words, sum(s.end - s.start for s in x.removed), x.kept) for x in found.collect()]
    assert sorted(got, key=repr) == sorted(plain_repeats(rows, window), key=repr)


def test_repeats_on_edges(spark):
    df = edge(spark)
    got = repeats.repeat_digest(repeats.find_repeats(df)).collect()
    assert len(got) == df.count() and all(r.kept_sha256 for r in got)
    assert {r.n_removed for r in got if r.doc_id == 5} == {120} and {r.n_removed for r in got if r.doc_id in (4, None)} == {0}
    assert repeats.find_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeats.find_repeats(df, doc_id="source")


def test_rolling_hashes_and_names():
    x = np.random.default_rng(1).integers(0, 4, 200).astype(np.uint64)
    for n, h in zip((1, 7, 25, 50), repeats.rolling(x, [1, 7, 25, 50], 0)):
        by = collections.defaultdict(set)
        for i in range(len(x) - n + 1):
            by[int(h[i])].add(tuple(x[i : i + n]))
        assert len(h) == len(x) - n + 1 and all(len(v) == 1 for v in by.values())
    high, low = np.array([3, 3, 3, 9], np.uint64), np.array([1, 5, 7, 1], np.uint64)
    i, at = repeats.find((high, low, low), np.array([3, 9, 3, 4, 9], np.uint64), np.array([7, 1, 2, 1, 2], np.uint64))
    assert dict(zip(i.tolist(), at.tolist())) == {0: 2, 1: 3}


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = {r.doc_id for r in seen.collect()}, stage(spark, seen, sf).cache()
        assert seen.columns == names and {r.doc_id for r in seen.collect()} <= before
    last = seen.collect()
    texts = [r.text for r in last]
    assert brute_classes(texts) == list(range(len(texts)))
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    assert not any(h for _, h, _ in decontaminate.brute_force(texts[:60], [(i["item_id"], i["text"]) for i in items]))
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in last}


#: Rows of edge() that each stage keeps, by doc_id.
EDGE_KEPT = {
    "quality_rules": [4, 4, 5, 6, 7, 8, None, None],  # 50 words or more; of either kind of null row both
    "language_id": [4, 4, 5, 6, 7, 8, 9, 10, 11, 12, None, None],  # those with a letter
    "near_dedup": [0, 1, 2, 3, 4, 7, 8, 9, 11, 12],  # wordless rows are classes of their own; 10 is 9 in other letters
    "decontamination": [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, None, None],  # nothing is a benchmark passage
}


def test_pipeline_stages_on_edges(spark, sf):
    import corpus_pipeline

    rest = lambda df: {tuple(r) for r in df.drop("lang").collect()}
    before = rest(edge(spark))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf).count() == 0
        out = stage(spark, edge(spark), sf)
        got = out.collect()
        if name == "packing":
            pieces = collections.Counter()
            for p in got:
                pieces[p.doc_id] += p.length
            assert pieces[0] == pieces[1] == 1 and set(pieces) == {*range(13), None} and all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in got)
        else:
            assert out.columns == edge(spark).columns and rest(out) <= before
            assert {r.lang for r in got} <= ({"en"} if name == "language_id" else {"en", None})  # a missing language is set
            assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x)) == EDGE_KEPT[name]


@pytest.mark.parametrize("block, few", [(32 << 20, 200_000), (60, 200_000), (60, 3)])
def test_decontamination_of_nested_passages(spark, block, few, monkeypatch):
    """Passages inside passages, of one item and of items in several blocks; what is clean stays."""
    monkeypatch.setattr(decontaminate, "FEW_WORDS", few)
    items = {i: [f"{x}{k}" for k in range(10)] for i, x in enumerate("abcd")}
    inside = lambda i, middle: [*items[i][:5], *middle, *items[i][5:]]
    deep = []
    for _ in range(12):
        deep = inside(0, deep)
    texts = [["keep", *deep, "this"], *(["keep", *inside(i, inside(j, items[i])), "this"] for i in items for j in items), ["keep", "this"]]
    benchmark = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, [" ".join(t) for t in texts]), benchmark, block_bytes=block, shard_bytes=200).collect()
    assert len(got) == len(texts) and all(r.text.split() == ["keep", "this"] and r.n_chars == len(r.text) for r in got)
