"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A task tokenizes the documents of its partition. Whole windows of a long document stand alone; what remains is
cut into pieces of at most `piece` tokens, and the pieces of a group of documents are partitioned over the least
number of windows that could hold them: every piece starts as a partial partition of one filled
subset, and the two partitions of the widest imbalance are merged again and again, the largest subset of
the one with the smallest of the other. If the fullest window exceeds the capacity the partition is made again with
one more window. Groups are formed inside a task from consecutive documents, so nothing is shuffled, no
group grows with the data, and equal or hot documents matter no more than others.

Defined cases: null and empty texts give the end token alone. Every token lies in exactly one piece; pieces of
one document may share a window. Repeated rows are packed once for each row. An empty table gives no piece.
Extra columns are ignored. A partition of a few documents fills its last window badly; partitions of
tens of megabytes, as scans have, lose under one window in a hundred.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task_batches

END_ID = 1
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """ids(text) of a byte-level BPE tokenizer file, without added tokens.

    The file's vocabulary and special tokens run in a faster engine that gives the same ids; a file of any other
    make is run by its own library.
    """
    if path not in _ENCODERS:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(spec["model"].get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout"))
        if plain:
            import public_tokenizers
            import tiktoken

            back = {c: b for b, c in byte_letters().items()}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            names = list(special)
            _ENCODERS[path] = lambda text: enc.encode(text, allowed_special="all") if any(s in text for s in names) else enc.encode_ordinary(text)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: tok.encode(text, add_special_tokens=False).ids
    return _ENCODERS[path]


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself if it is printable
    Latin-1, else the next one from U+0100."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k subsets of near-equal sums (the empty ones included)."""
    if not sizes or k < 1:
        return [[] for _ in range(max(k, 0))]
    # A partial partition: sums of its filled subsets, descending, and their members; the rest of the k are empty.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        over = len(sa) + len(sb) - k
        if over > 0:  # the smallest filled subsets of one meet the largest of the other, in opposite order
            # a: positions k-len(sb).. pair with b descending from its end
            cut = len(sa) - over
            met = [(sa[cut + j] + sb[len(sb) - 1 - j], ma[cut + j] + mb[len(sb) - 1 - j]) for j in range(over)]
            pairs = [*zip(sa[:cut], ma[:cut]), *zip(sb[: len(sb) - over], mb[: len(sb) - over]), *met]
        else:
            pairs = [*zip(sa, ma), *zip(sb, mb)]
        pairs.sort(key=lambda x: -x[0])
        sums, members = [p[0] for p in pairs], [p[1] for p in pairs]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tie, sums, members))
        tie += 1
    members = heap[0][3]
    return members + [[] for _ in range(k - len(members))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Subsets of near-equal sums within the capacity; one more window whenever it is exceeded."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while k:
        out = karmarkar_karp(sizes, k)
        if max(sum(sizes[i] for i in w) for w in out) <= capacity:
            return [w for w in out if w]
        k += 1
    return []


def _cut(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then what remains in near-equal pieces."""
    out = [(s, window) for s in range(0, n - n % window, window)]
    rest, at = n % window, n - n % window
    for j in range(parts := -(-rest // piece) if rest else 0):
        step = rest * (j + 1) // parts - rest * j // parts
        out.append((at, step))
        at += step
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id="doc_id", text="text", window=2048, piece=192, group=512, end_id=END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, next_id, arrow = encoder(tokenizer), TaskContext.get().partitionId() << 36, None
        held: list[tuple[object, np.ndarray]] = []

        def pack():
            nonlocal next_id
            rows, rest = [], []
            for d, (key, ids) in enumerate(held):
                for start, length in _cut(len(ids), window, piece):
                    if length == window:
                        rows.append((d, start, length, next_id, 0))
                        next_id += 1
                    else:
                        rest.append((d, start, length))
            for members in windows([r[2] for r in rest], window):
                at = 0
                for m in sorted(members):
                    d, start, length = rest[m]
                    rows.append((d, start, length, next_id, at))
                    at += length
                next_id += 1
            cols = [[held[d][0] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], [held[d][1][s : s + n].tobytes() for d, s, n, *_ in rows], [len(held[r[0]][1]) for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=schema.names)

        for table in task_batches(batches, [doc_id, text], group, 64 << 20):
            arrow = table.schema.field(doc_id).type
            # A small rest of a task joins the group before it; groups stay under twice their size.
            if len(held) >= group:
                yield pack()
            for key, t in zip(table[doc_id].to_pylist(), table[text].to_pylist()):
                held.append((key, np.array([*(encode(t) if t else ()), end_id], "<u4")))
        if held:
            yield pack()

    return docs.select(doc_id, text).mapInArrow(run, schema)


def packing_digest(pieces: DataFrame, doc_id="doc_id") -> DataFrame:
    return pieces.select(doc_id, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
