"""Chunking: one text to many rows, inside a record or over the joined texts of a source.

Over a source, texts are joined by a blank line in the order of a key. That long text is never built. Rows are numbered once in
that order (a sorted, written table), so a key may repeat, be null or of any ordered type. Offsets come from prefix sums in two levels (blocks of
numbers, then inside a block), so a source with most of the rows is summed in many tasks, and each record yields the parts of
the windows that it overlaps. Paragraphs are merged across records by a prefix scan of fold maps: see paragraph_based_corpus().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.work import written

# Parameters of the three strategies.
FIXED = {"size": 512, "overlap": 64}
SENTENCE = {"sentences": 5, "overlap": 1}
PARAGRAPH = {"least": 100, "most": 1500}
JOINT = 2  # characters between two joined texts
BLOCK = 4096  # rows per block of a prefix sum
FAN_BITS = 10  # maps that one step of a prefix scan puts together, as a power of two


def finish(chunks: DataFrame, source: str, strategy: str, index: str = "chunk_index", text: str = "text") -> DataFrame:
    """chunk_id, source, strategy, chunk_index, text, char_count, word_count; blank chunks go, indexes stay."""
    t = tx.strip(F.col(text))
    return tx.with_once(chunks, text, t).filter(F.length(text) > 0).select(
        F.format_string("%s__%s__%05d", F.col(source), F.lit(strategy), F.col(index)).alias("chunk_id"), F.col(source).alias("source"), F.lit(strategy).alias("strategy"),
        F.col(index).cast("int").alias("chunk_index"), F.col(text).alias("text"), F.length(text).alias("char_count"), F.size(tx.words(F.col(text))).alias("word_count"),
    )


def _last_window(n, size: int, step: int):
    return F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")


def fixed_size(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """df with chunk_index and the window's text in place of text."""
    step = size - overlap
    at = df.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), _last_window(F.length(text), size, step))))
    at = at.withColumn(text, F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size)))
    return at.filter(tx.strip(F.col(text)) != "")


def in_order(df: DataFrame, source: str, key: str, text: str) -> DataFrame:
    """source, _at, _text of the rows that have a text; _at numbers them (with gaps) by source and key, rows of one key by a hash of the text.

    A written table: a number stays what it is. Equal rows are told apart by where they were read, so no range of the sort is beyond splitting.
    """
    rows = df.filter(F.length(text) > 0).select(F.col(source).alias(source), F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_read"))
    placed = rows.orderBy(source, "_key", F.xxhash64("_text"), "_read").select(source, F.monotonically_increasing_id().alias("_at"), "_text")
    return written(placed, "in-order")


def _match(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join by columns of both sides in which nulls are equal."""
    renamed = right.withColumnsRenamed({c: f"{c}_other" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"{c}_other")) for c in by]
    return left.join(renamed, on).drop(*(f"{c}_other" for c in by))


def prefix_sum(df: DataFrame, by: list[str], order: str, value, name: str, extra_order: tuple = ()) -> DataFrame:
    """df with the sum of value over the rows before in each group; the rows of a group are split by blocks of the integer order key."""
    df = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / BLOCK))
    blocks = df.groupBy(*by, "_block").agg(F.sum("_v").alias("_s"))
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = F.coalesce(F.sum("_v").over(W.partitionBy(*by, "_block").orderBy(order, *extra_order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _match(df.withColumn("_in", inner), blocks, [*by, "_block"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_block", "_in", "_start")


def fixed_size_corpus(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """source, chunk_index, text of windows over each source's joined texts; empty texts are skipped."""
    step = size - overlap
    docs = in_order(df, source, key, text).withColumn("_n", F.length("_text"))
    at = prefix_sum(docs.drop("_text"), [source], "_at", F.col("_n") + JOINT, "_from")
    whole = at.groupBy(source).agg((F.max(F.col("_from") + F.col("_n"))).alias("_total"))
    docs = _match(docs.join(at.select("_at", "_from"), "_at"), whole, [source])
    # A record covers its text and the joint behind it (none behind the last).
    end = F.least(F.col("_from") + F.col("_n") + JOINT, F.col("_total"))
    first = F.greatest(F.lit(0), F.floor((F.col("_from") - size) / step) + 1).cast("int")
    last = F.least(F.floor((end - 1) / step), _last_window(F.col("_total"), size, step)).cast("int")
    parts = docs.withColumn("_body", F.when(F.col("_from") + F.col("_n") < F.col("_total"), F.concat("_text", F.lit("\n\n"))).otherwise(F.col("_text")))
    parts = parts.withColumn("_end", end).filter(first <= last).withColumn("chunk_index", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_from"), F.col("chunk_index") * step)
    stop = F.least(F.col("_end"), F.col("chunk_index") * step + size)
    piece = F.substring(F.col("_body"), (begin - F.col("_from") + 1).cast("int"), (stop - begin).cast("int"))
    joined = parts.filter(stop > begin).select(source, "chunk_index", F.struct(begin.alias("a"), piece.alias("t")).alias("p"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "")
    return joined.groupBy(source, "chunk_index").agg(ordered.alias(text)).filter(tx.strip(F.col(text)) != "")


def sentence_based(df: DataFrame, text: str = "text", sentences: int = 5, overlap: int = 1, splitter=tx.sentences) -> DataFrame:
    """df with chunk_index and `sentences` sentences, joined by a blank, in place of text. splitter: Column -> array of sentences."""
    step = max(1, sentences - overlap)
    cut = tx.with_once(df, "_s", splitter(F.col(text))).filter(F.size("_s") > 0)
    at = cut.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), _last_window(F.size("_s"), sentences, step))))
    return at.withColumn(text, F.array_join(F.slice("_s", F.col("chunk_index") * step + 1, F.lit(sentences)), " ")).drop("_s")


def paragraphs(text):
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), tx.strip), lambda p: p != "")


def _subdivide(combined, most: int):
    """A text of at most `most` characters as it is; a longer one packed by sentences (a longer sentence stays whole)."""
    state = "named_struct('b', '', 'o', cast(array() as array<string>))"
    start = F.expr(state)

    def step(s, x):
        full = (s["b"] != "") & (F.length(s["b"]) + F.length(x) + 1 > most)
        grown = F.when(s["b"] == "", x).otherwise(F.concat(s["b"], F.lit(" "), x))
        return F.struct(F.when(full, x).otherwise(grown).alias("b"), F.when(full, F.array_append(s["o"], s["b"])).otherwise(s["o"]).alias("o"))

    packed = F.aggregate(tx.sentences(combined), start, step, lambda s: F.when(s["b"] == "", s["o"]).otherwise(F.array_append(s["o"], s["b"])))
    return F.when(F.length(combined) <= most, F.array(combined)).otherwise(packed)


def _merge(paras, least: int, most: int):
    """Short paragraphs wait in a buffer until they and the next one reach `least`; the rest of the buffer is a chunk of its own."""
    start = F.expr("named_struct('b', '', 'o', cast(array() as array<string>))")

    def step(s, p):
        both = F.when(s["b"] == "", p).otherwise(F.concat(s["b"], F.lit(" "), p))
        wait = F.length(s["b"]) + F.length(p) < least
        return F.struct(F.when(wait, both).otherwise(F.lit("")).alias("b"), F.when(wait, s["o"]).otherwise(F.concat(s["o"], _subdivide(both, most))).alias("o"))

    return F.aggregate(paras, start, step, lambda s: F.when(s["b"] == "", s["o"]).otherwise(F.array_append(s["o"], s["b"])))


def paragraph_based(df: DataFrame, text: str = "text", least: int = 100, most: int = 1500) -> DataFrame:
    """df with chunk_index and merged or subdivided paragraphs in place of text."""
    return df.select("*", F.posexplode(_merge(paragraphs(F.col(text)), least, most)).alias("chunk_index", "_c")).withColumn(text, F.col("_c")).drop("_c")


def _next(length, p, least: int):
    """Characters in the buffer after a paragraph of p: 0 where it empties the buffer."""
    wait = length + p < least
    return F.when(wait, F.when(length == 0, p).otherwise(length + 1 + p)).otherwise(F.lit(0))


def fold_map(lengths, least: int):
    """What paragraphs of these lengths make of each buffer length: array of the lengths after them, for 0 to `least` before them.

    A paragraph of at least `least` characters empties every buffer, so behind the last one of them a single length is followed, which stands as an
    array of one.
    """
    last = F.array_max(F.transform(lengths, lambda p, i: F.when(p >= least, i + 1).otherwise(0)))
    rest = F.slice(lengths, F.coalesce(last, F.lit(0)) + 1, F.size(lengths))
    one = F.array(F.aggregate(rest, F.lit(0), lambda n, p: _next(n, p, least)))
    every = F.aggregate(lengths, F.sequence(F.lit(0), F.lit(least)), lambda m, p: F.transform(m, lambda n: _next(n, p, least)))
    return F.when(F.coalesce(last, F.lit(0)) > 0, one).otherwise(every)


def apply_map(m, length):
    """The buffer length after a map; arrays of one hold for every length."""
    return F.when(F.size(m) == 1, F.get(m, F.lit(0))).otherwise(F.get(m, length))


def compose(first, second):
    """The map of one map after the other."""
    return F.when(F.size(second) == 1, second).otherwise(F.transform(first, lambda n: F.get(second, n)))


def scan(maps: DataFrame, by: str, bits: int, least: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """by, _at, _enter: the buffer length before each row (by, _at, _map), from an empty one, in the order of _at within by.

    A prefix scan: neighbours (numbers equal but for their last fan_bits) are put together to one map, the maps of groups are scanned likewise, and
    each group's length before it is handed down to its rows. No step holds more than 2^fan_bits rows of a group. bits: of the largest number.
    """
    groups = maps.groupBy(by, F.shiftright("_at", fan_bits).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_rows"))
    identity = F.sequence(F.lit(0), F.lit(least))
    if bits <= fan_bits:
        entered = groups.withColumn("_enter", F.lit(0))
    else:
        groups = written(groups, "fold-maps")
        whole = groups.select(by, F.col("_group").alias("_at"), F.aggregate(F.col("_rows"), identity, lambda m, r: compose(m, r["_map"])).alias("_map"))
        above = scan(whole, by, bits - fan_bits, least, fan_bits).withColumnRenamed("_at", "_group")
        entered = _match(groups, above, [by, "_group"])
    start = F.struct(F.col("_enter").alias("n"), F.expr("cast(array() as array<struct<_at: bigint, _enter: int>>)").alias("o"))

    def step(s, r):
        seen = F.array_append(s["o"], F.struct(r["_at"].alias("_at"), s["n"].alias("_enter")))
        return F.struct(apply_map(r["_map"], s["n"]).alias("n"), seen.alias("o"))

    return entered.select(by, F.inline(F.aggregate("_rows", start, step)["o"]))


def _pieces(paras, enter, least: int):
    """A record's paragraphs, cut behind each one that empties the buffer: array of (text, ends); the last piece doesn't end and may be empty."""
    start = F.struct(enter.cast("int").alias("n"), F.lit("").alias("b"), F.expr("cast(array() as array<struct<text: string, ends: boolean>>)").alias("o"))

    def step(s, p):
        both = F.when(s["b"] == "", p).otherwise(F.concat(s["b"], F.lit(" "), p))
        n = _next(s["n"], F.length(p), least)
        done = n == 0
        piece = F.struct(both.alias("text"), F.lit(True).alias("ends"))
        return F.struct(n.cast("int").alias("n"), F.when(done, F.lit("")).otherwise(both).alias("b"), F.when(done, F.array_append(s["o"], piece)).otherwise(s["o"]).alias("o"))

    return F.aggregate(paras, start, step, lambda s: F.array_append(s["o"], F.struct(s["b"].alias("text"), F.lit(False).alias("ends"))))


def paragraph_based_corpus(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", least: int = 100, most: int = 1500, fan_bits: int = FAN_BITS) -> DataFrame:
    """source, chunk_index, text of paragraphs over each source's joined texts.

    Whether a paragraph empties the buffer depends on the buffer's length alone, a number of at most `least`. So each record is a map from the length
    before it to the length behind it, a prefix scan of the maps tells every record the length it starts with, and records are then cut by
    themselves. A chunk inside a record is done there; what the records at its ends share (under `least` characters before the last paragraph) is joined by
    the chunk's number. A source of nothing but short paragraphs is as many tasks as any other.
    """
    docs = tx.with_once(in_order(df, source, key, text), "_ps", paragraphs(F.col("_text"))).filter(F.size("_ps") > 0)
    # Written, as they are read three times.
    docs = written(docs.select(source, "_at", "_ps", fold_map(F.transform("_ps", F.length), least).alias("_map")), "paragraphs")
    bits = max(1, int(docs.agg(F.max("_at")).first()[0] or 0).bit_length())
    enter = scan(docs.select(source, "_at", "_map"), source, bits, least, fan_bits)
    cut = docs.join(enter.select("_at", "_enter"), "_at").select(source, "_at", "_enter", _pieces(F.col("_ps"), F.col("_enter"), least).alias("_cut"))
    cut = written(cut, "paragraph-pieces")
    first = prefix_sum(cut.select(source, "_at", F.size("_cut").alias("_k")), [source], "_at", (F.col("_k") - 1).cast("long"), "_first").select("_at", "_first")
    each = cut.join(first, "_at").select(source, "_at", "_enter", "_first", F.posexplode("_cut").alias("_j", "_c"))
    each = each.select(source, "_at", (F.col("_first") + F.col("_j")).alias("_number"), F.col("_c.text").alias("_t"), F.col("_c.ends").alias("_ends"), (F.col("_c.ends") & ((F.col("_j") > 0) | (F.col("_enter") == 0))).alias("_whole"))
    inside = each.filter("_whole").select(source, "_number", F.col("_t").alias("_all"), "_ends")
    parts = F.array_sort(F.collect_list(F.struct("_at", "_t")))
    across = each.filter("NOT _whole AND _t <> ''").groupBy(source, "_number").agg(F.array_join(F.transform(parts, lambda x: x["_t"]), " ").alias("_all"), F.max("_ends").alias("_ends"))
    out = inside.unionByName(across).select(source, "_number", F.when(F.col("_ends"), _subdivide(F.col("_all"), most)).otherwise(F.array("_all")).alias("_o"))
    out = written(out, "paragraph-chunks")
    at = prefix_sum(out.select(source, "_number", F.size("_o").alias("_n")), [source], "_number", F.col("_n").cast("long"), "_before")
    placed = _match(out, at.select(source, "_number", "_before"), [source, "_number"])
    return placed.select(source, "_before", F.posexplode("_o").alias("_j", text)).select(source, (F.col("_before") + F.col("_j")).cast("int").alias("chunk_index"), text)


#: Strategy by name: a function of a DataFrame with a text column.
STRATEGIES = {"fixed_size": lambda df, **k: fixed_size(df, **(FIXED | k)), "sentence_based": lambda df, **k: sentence_based(df, **(SENTENCE | k)), "paragraph_based": lambda df, **k: paragraph_based(df, **(PARAGRAPH | k))}


def chunk(df: DataFrame, source: str, strategy: str, **options) -> DataFrame:
    """Finished chunks of one strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return finish(STRATEGIES[strategy](df, **options), source, strategy)


def select_chunks(chunks: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """The chunks of the (source, strategy) pairs, in union; both columns prune partitions of a chunk table."""
    out = None
    for source, strategy in wanted:
        part = chunks.filter((F.col("source") == source) & (F.col("strategy") == strategy))
        out = part if out is None else out.unionByName(part)
    return out
