"""Quality rules [native]: word statistics of whole texts and robust multivariate outliers.

Every step is a DataFrame or SQL expression. The text is read once: a single projection yields the
base statistics of a document; what follows works on a table of a few numbers a row, written to the
shared folder. For each (lang, source) group a minimum-covariance-determinant estimate of location
and scatter is found: the share of rows whose scatter has the least determinant. Three starts at the medians (scatter by
MADs alone, with the correlations of tanh-scaled rows, with those of spatial signs) each take two concentration steps: keep the
share of rows that lie nearest and take their means and covariances again. The start of the least determinant goes on
until its determinant falls no more. The share is that of the
highest breakdown, (n + d + 1) / 2n of n rows in d dimensions, or `support` if that is more: junk of up
to about half of a group doesn't enter. Medians and cuts are exact on a grid (statistics to 3 digits, distances to 1/1,000 of their
logarithm), so they don't depend on the order in which tasks are merged. Determinants are those of the scatter with its floors. Each step is
one partial aggregate, so a source with a third of all rows is summed where its rows lie.
A row is rejected if its squared Mahalanobis distance to its group's estimate exceeds `cutoff`
(32: a chance of 2e-6 under the chi-square law with 4 degrees of freedom).
A group with fewer than `min_group` rows that pass the base rule takes the scatter of the next wider
one: its language over all sources, then all rows, which have an estimate at any size. Its location
is the medians of its own rows and of `prior` rows at the wider location: single rows are
judged by the wider group, and a few rows that agree (a rare language of long words) by their own place.

Defined cases: a null or empty text has no words and fails the base rule (n_words < 50). Null lang
or source form groups of their own. Every row that passes the base rule has a distance2; for others it
is null. Repeated rows are kept and counted as rows. An empty table gives an empty result. filter_quality() keeps all columns of its input as they are.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize

#: Position bits in the packed sort key of a window; longer texts use the full-key sort.
_POS_BITS = 24

_WORDS = r"filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _let(name: str, value: str, body: str) -> str:
    """SQL has no let: a one-element transform binds value once, so a lambda never computes it again."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _equal_neighbours(arr: str, key) -> str:
    """Indexes j of the sorted array whose key equals that of a neighbour."""
    here, before, after = key(f"{arr}[j]"), key(f"{arr}[j-1]"), key(f"{arr}[j+1]")
    return f"filter(sequence(0, size({arr}) - 1), j -> (j > 0 AND {here} = {before}) OR (j < size({arr}) - 1 AND {here} = {after}))"


def _repeat_words() -> str:
    """Words inside 3-word windows that occur twice or more. ws: the words.

    A primitive sort of (40 hash bits, position) finds candidate windows; only those are sorted again
    by the whole 64-bit key, so the costly sort of structs sees few rows and the result doesn't depend on
    the short hash.
    """
    exact = _let(
        "e", "{cand}",
        "CASE WHEN size(e) = 0 THEN 0L ELSE "
        + _let(
            "p", f"array_sort(transform({_equal_neighbours('e', lambda x: f'{x}.k')}, j -> e[j].i))",
            "aggregate(sequence(0, size(p) - 1), 0L, (a, j) -> a + CASE WHEN j = size(p) - 1 THEN 3 ELSE least(3, p[j+1] - p[j]) END)",
        )
        + " END",
    )
    short = f"shiftright({{0}}, {_POS_BITS})"
    some = f"sort_array(transform({_equal_neighbours('s', lambda x: short.format(x))}, j -> struct(ks[cast(s[j] & {(1 << _POS_BITS) - 1} as int)] AS k, cast(s[j] & {(1 << _POS_BITS) - 1} as int) AS i)))"
    packed = _let("s", f"sort_array(transform(ks, (k, i) -> shiftleft(k, {_POS_BITS}) | cast(i as bigint)))", some)
    every = "sort_array(transform(ks, (k, i) -> struct(k AS k, i AS i)))"
    cand = f"CASE WHEN size(ks) < {1 << _POS_BITS} THEN {packed} ELSE {every} END"
    return "CASE WHEN size(ws) < 3 THEN 0L ELSE " + _let("ks", "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i+1], ws[i+2]))", exact.replace("{cand}", cand)) + " END"


def text_stats(docs: DataFrame, text: str = "text", out: str = "quality_stats") -> DataFrame:
    """docs with a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    lines = r"filter(split(t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"
    stats = _let(
        "t", f"coalesce(`{text}`, '')",
        _let(
            "ws", _WORDS,
            r"named_struct('n_words', cast(size(ws) as bigint), "
            r"'word_chars', cast(length(translate(t, ' \t\n\u000b\f\r', '')) as bigint), "
            r"'n_symbols', cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint), "
            rf"'n_dup_lines', {_let('ls', lines, 'cast(size(ls) - size(array_distinct(ls)) as bigint)')}, "
            rf"'n_repeat_words', {_repeat_words()})",
        ),
    )
    stats = stats.replace(r"' \t\n\u000b\f\r'", "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))").replace(r"'\n'", "'\\\\n'")
    return docs.withColumn(out, F.expr(stats))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: Transformed statistics of a row that passes the base rule, and the least spread each may have in a
#: group: shares are often exactly 0 in most rows of a source, which would leave a singular scatter.
_VECTOR = (
    ("ln(word_chars / n_words)", 0.10),
    ("sqrt(n_symbols / n_words)", 0.10),
    ("sqrt(n_repeat_words / n_words)", 0.10),
    ("sqrt(n_dup_lines / n_words)", 0.06),
)
_D = len(_VECTOR)
SALTS = 32  # parts of a group in joins
_KEYS = ["g_lang", "g_source"]
WIDE = "*"  # stands for all languages or sources; names of real ones begin with + or -


def _distance(x, mean, chol):
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor's columns."""
    z = []
    for i in range(_D):
        v = x[i] - mean[i]
        for k in range(i):
            v = v - chol(i, k) * z[k]
        z.append(v / chol(i, i))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _with_cholesky(est: DataFrame, cov, keep) -> DataFrame:
    """Adds the columns l_i_k of the factor of a covariance given as expressions; floors keep it regular."""
    est = est.select(*keep, *(cov(i, k).alias(f"c{i}{k}") for i in range(_D) for k in range(i + 1)))
    factor = {}
    for i in range(_D):
        for k in range(i + 1):
            v = F.col(f"c{i}{k}")
            if i == k:
                v = v + F.lit(_VECTOR[i][1] ** 2)
            for m in range(k):
                v = v - factor[i, m] * factor[k, m]
            factor[i, k] = F.sqrt(F.greatest(v, F.lit(1e-12))) if i == k else v / factor[k, k]
    return est.select(*keep, *(v.alias(f"l{i}{k}") for (i, k), v in factor.items()))


def _salted(est: DataFrame) -> DataFrame:
    """Rows of a group are dealt over many tasks by a salt, and its one row of estimates goes to each of them."""
    return est.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _cut_key(d2):
    """Squared distances on a grid of 1/1,000 of their logarithm."""
    return F.round(F.log(d2 + F.lit(1e-9)), 3)


def _log_det():
    return sum((F.log(f"l{i}{i}") for i in range(1, _D)), F.log("l00"))


def mcd_estimates(rows: DataFrame, keys: list[str], support: float, min_group: int, warm: int = 2, least_fall: float = 1e-4) -> DataFrame:
    """rows: keys (not null), x0..x{d-1} and salt (0 to SALTS - 1). Per group of min_group rows or more, and for all rows
    (WIDE), its size n, the means m_i and the factor l_i_k."""
    xs, ms = [f"x{i}" for i in range(_D)], [f"m{i}" for i in range(_D)]
    tri = [(i, k) for i in range(_D) for k in range(i + 1)]
    ls = [f"l{i}{k}" for i, k in tri]
    median = lambda c: F.percentile(F.round(c, 3), F.lit(0.5))
    mid = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(median(F.col(x)).alias(m) for x, m in zip(xs, ms))).filter((F.col("n") >= min_group) | (F.col(keys[0]) == WIDE))
    with_est = lambda e: rows.join(_salted(e), [*keys, "salt"])
    dev = with_est(mid).groupBy(*keys, "n", *ms).agg(*(median(F.abs(F.col(x) - F.col(m))).alias(f"s{i}") for i, (x, m) in enumerate(zip(xs, ms))))
    wide = [F.greatest(1.4826 * F.col(f"s{i}"), F.lit(_VECTOR[i][1])) for i in range(_D)]
    dev = materialize(dev.select(*keys, "n", *ms, *(w.alias(f"s{i}") for i, w in enumerate(wide))), "mcd")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(_D)]
    near = with_est(dev).select(*keys, "n", *ms, *(f"s{i}" for i in range(_D)), *(v.alias(f"z{i}") for i, v in enumerate(z)))
    length = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _D)), F.col("z0") * F.col("z0"))
    near = near.withColumn("length", F.greatest(length, F.lit(1e-12)))
    shape = near.groupBy(*keys, "n", *ms, *(f"s{i}" for i in range(_D))).agg(
        *(F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{k}")).alias(f"t{i}{k}") for i, k in tri),
        *(F.avg(F.col(f"z{i}") * F.col(f"z{k}") / F.col("length")).alias(f"g{i}{k}") for i, k in tri),
    )
    kept = [*keys, "n", *ms]

    def start(number: int, name: str | None) -> DataFrame:
        def cov(i, k):
            scale = F.col(f"s{i}") * F.col(f"s{k}")
            if name is None or i == k:
                return scale if i == k else F.lit(0.0)
            var = F.col(f"{name}{i}{i}") * F.col(f"{name}{k}{k}")
            return F.when(var > 1e-12, scale * F.col(f"{name}{i}{k}") / F.sqrt(var)).otherwise(0.0)

        return _with_cholesky(shape, cov, kept).withColumn("start", F.lit(number))

    # The share in percent, as a place in `percents`: a percentile takes constants only.
    least = math.ceil(100 * support)
    percents = range(least, 101)
    share = F.greatest(F.lit(0), F.least(F.lit(100), F.ceil(50 * (F.col("n") + _D + 1) / F.col("n")).cast("int")) - least)
    factor = F.array(*(F.lit(_consistency(p / 100)) for p in percents))[share]

    def concentrate(est: DataFrame) -> DataFrame:
        at = [*keys, "start"]
        near = with_est(est).withColumn("key", _cut_key(_distance([F.col(x) for x in xs], [F.col(m) for m in ms], lambda i, k: F.col(f"l{i}{k}"))))
        half = near.groupBy(*at, "n").agg(F.percentile("key", F.array(*(F.lit(p / 100) for p in percents))).alias("h")).select(*at, F.col("h")[share].alias("h"))
        sums = (
            near.select(*at, "salt", *xs, "key", "n").join(_salted(half), [*at, "salt"]).filter("key <= h").groupBy(*at, "n")
            .agg(*(F.avg(x).alias(m) for x, m in zip(xs, ms)), *(F.covar_pop(xs[i], xs[k]).alias(f"v{i}{k}") for i, k in tri))
        )
        # The nearest share of a normal sample spreads less than the whole; the factor of consistency mends that.
        out = _with_cholesky(sums, lambda i, k: F.col(f"v{i}{k}") * factor, [*kept, "start"])
        return out.withColumn("det", _log_det())

    steps = [dev, materialize(start(0, None).unionByName(start(1, "t")).unionByName(start(2, "g")), "mcd")]
    for _ in range(warm):
        steps.append(materialize(concentrate(steps[-1]), "mcd"))
    one = F.struct(*kept, "start", *ls, "det")
    est = steps[-1].groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(one, F.struct("det", "start")).alias("e")).select("e.*")
    done = []
    while True:  # a determinant that falls by least_fall at least each time ends
        # One job a turn: it writes each group before and after the step, and counts the groups that still fall.
        both = est.join(concentrate(est).select(*keys, F.struct(*ms, *ls, "det").alias("after")), keys)
        falling = Observation()
        turn = both.withColumn("falls", F.col("after.det") < F.col("det") - least_fall).observe(falling, F.count_if("falls").alias("n"))
        steps.append(materialize(turn, "mcd"))
        done.append(steps[-1].filter("NOT falls").select(*kept, *ls))
        est = steps[-1].filter("falls").select(*keys, "n", "start", "after.*")
        if not falling.get["n"]:
            break
    out = materialize(functools.reduce(DataFrame.unionByName, done), "mcd")
    for t in steps:
        discard(t)
    return out


def group_estimates(rows: DataFrame, support: float, min_group: int, prior: int) -> tuple[DataFrame, DataFrame]:
    """(estimates of groups with min_group rows or more, those of smaller groups): each (g_lang, g_source) of rows is in one of them."""
    xs, ms = [f"x{i}" for i in range(_D)], [f"m{i}" for i in range(_D)]
    ls = [f"l{i}{k}" for i in range(_D) for k in range(i + 1)]
    level = lambda lang, source: F.struct(lang.alias("g_lang"), source.alias("g_source"))
    levels = F.array(level(F.col("g_lang"), F.col("g_source")), level(F.col("g_lang"), F.lit(WIDE)), level(F.lit(WIDE), F.lit(WIDE)))
    rows = rows.select(F.explode(levels).alias("g"), "salt", *xs).select("g.*", "salt", *xs)
    large = mcd_estimates(rows, _KEYS, support, min_group).select(*_KEYS, *ms, *ls)
    rest = materialize(rows.join(_salted(large.select(*_KEYS)), [*_KEYS, "salt"], "left_anti").select(*_KEYS, *xs), "mcd")

    def small(own: DataFrame, wider: DataFrame) -> DataFrame:
        """own: rows of small groups. wider: g_lang, m_i and l_i_k. A language may have many small groups, so these are dealt by a salt, too."""
        groups = own.select(*_KEYS).distinct().withColumn("salt", F.pmod(F.xxhash64("g_source"), F.lit(SALTS)))
        groups = groups.join(_salted(wider), ["g_lang", "salt"]).select(*_KEYS, *ms, *ls)
        at_wider = groups.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(prior)))).select(*_KEYS, *(F.col(m).alias(x) for m, x in zip(ms, xs)))
        mid = own.unionByName(at_wider).groupBy(*_KEYS).agg(*(F.percentile(F.round(x, 3), F.lit(0.5)).alias(m) for x, m in zip(xs, ms)))
        return materialize(groups.select(*_KEYS, *ls).join(mid, _KEYS).select(*_KEYS, *ms, *ls), "mcd")

    langs = rest.filter(F.col("g_source") == WIDE)
    every = large.filter(F.col("g_lang") == WIDE).select(*ms, *ls)
    by_lang = large.filter((F.col("g_source") == WIDE) & (F.col("g_lang") != WIDE)).unionByName(small(langs, langs.select("g_lang").distinct().crossJoin(every)))
    return large.filter(F.col("g_source") != WIDE), small(rest.filter(F.col("g_source") != WIDE), by_lang.select("g_lang", *ms, *ls))


def _consistency(support: float) -> float:
    """support / P(chi2 with d+2 degrees <= the support quantile of chi2 with d degrees), for even d."""
    cdf = lambda x, d: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(d // 2))
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, _D) < support else (lo, mid)
    return support / cdf(lo, _D + 2)


def judge_quality(docs: DataFrame, *, text="text", lang="lang", source="source", support=0.5, cutoff=32.0, min_group=40, prior=5, carry=("doc_id",)) -> DataFrame:
    """One row per row of docs: the carried columns, the base statistics, base_failed, distance2 (null: fails the base rule) and kept."""
    stats = text_stats(docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source")), "_text", "_q")
    rows = stats.select(*(f"_c{i}" for i in range(len(carry))), *(F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c), F.lit(""))).alias(k) for c, k in (("_lang", "g_lang"), ("_source", "g_source"))), "_q.*")
    rows = materialize(rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "quality")
    salt = F.pmod(F.xxhash64("n_words", "word_chars", *(f"_c{i}" for i in range(len(carry)))), F.lit(SALTS))
    full = rows.select("*", salt.alias("salt"), *(F.when(~F.col("base_failed"), F.expr(e)).alias(f"x{i}") for i, (e, _) in enumerate(_VECTOR)))
    good = full.filter(~F.col("base_failed"))
    large, small = group_estimates(good.select(*_KEYS, "salt", *(f"x{i}" for i in range(_D))), support, min_group, prior)
    met = good.join(_salted(large), [*_KEYS, "salt"]).unionByName(good.join(_salted(large.select(*_KEYS)), [*_KEYS, "salt"], "left_anti").join(small, _KEYS))
    judged = met.withColumn("distance2", _distance([F.col(f"x{i}") for i in range(_D)], [F.col(f"m{i}") for i in range(_D)], lambda i, k: F.col(f"l{i}{k}")))
    out = judged.unionByName(full.filter("base_failed"), allowMissingColumns=True)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def filter_quality(docs: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns. row_id identifies a row; rows that share it share a verdict if their texts do."""
    keyed = docs.withColumn("__lexmill_crc", F.xxhash64(F.coalesce(F.col(options.get("text", "text")), F.lit("\0"))))
    verdicts = judge_quality(keyed, carry=(row_id, "__lexmill_crc"), **options).filter("kept").select(F.col(row_id).alias("__lexmill_id"), F.col("__lexmill_crc").alias("__lexmill_h")).distinct()
    return keyed.join(verdicts, (keyed[row_id].eqNullSafe(verdicts["__lexmill_id"])) & (keyed["__lexmill_crc"] == verdicts["__lexmill_h"]), "left_semi").drop("__lexmill_crc")
