"""Calls of models that the caller gives: text encoders and chat models, made in the workers, many rows at a time.

A model is given by a function without arguments that loads it. It is loaded once for each worker process, not for each task or batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.work import written

BATCH = 64  # texts that an encoder gets at once
ENCODER_CHARS = 2000  # a longer text is cut at a blank before it is encoded

_LOADED: dict[str, object] = {}


def _loaded(name: str, load: Callable):
    """The model of a name, loaded at its first use in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def encode(df: DataFrame, text: str, load: Callable[[], Callable], width: int, out: str = "vector", name: str = "encoder", batch: int = BATCH, limit: int = ENCODER_CHARS) -> DataFrame:
    """df with a vector (array of doubles, of length 1) of each text. load gives a function from a list of texts to a matrix of `width` columns.

    Texts over `limit` characters are cut at a blank. Null and blank texts aren't given to the model; their vector is zero, as is one for which the model gives zeros. Each text
    is encoded by itself, so neither the batch size nor the partitions change a vector. A column that is already called `out` is replaced. The model's name is
    what a worker keeps it by.
    """
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    rows = kept.withColumn("__text", tx.cut_at_blank(F.col(text), limit))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = None
        for part in batches:
            texts = part.column("__text").to_pylist()
            there = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors = np.zeros((len(texts), width))
            for at in range(0, len(there), batch):
                model = model or _loaded(name, load)
                mine = there[at : at + batch]
                got = np.asarray(model([texts[i] for i in mine]), np.float64)
                if got.shape != (len(mine), width):
                    raise ValueError(f"the encoder gave {got.shape} for {len(mine)} texts of width {width}")
                vectors[mine] = got
            norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            vectors /= np.where(norm == 0, 1.0, norm)
            ends = pa.array(np.arange(0, len(texts) * width + 1, width, dtype=np.int32))
            table = pa.Table.from_batches([part]).drop_columns(["__text"])
            yield from table.append_column(out, pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))).to_batches()

    return rows.mapInArrow(run, schema)


def hashing_encoder(width: int) -> Callable[[], Callable]:
    """Loads an encoder without weights: each token adds one, with a sign, to the place that its MD5 gives."""

    def load():
        import hashlib
        import re

        import numpy as np

        token, places = re.compile(r"(?<!\w)[a-z]{2,}(?!\w)"), {}

        def place(w: str) -> tuple[int, int]:
            if w not in places:
                if len(places) > 200_000:
                    places.clear()
                h = hashlib.md5(w.encode()).hexdigest()
                places[w] = int(h[:7], 16) % width, 1 if int(h[7], 16) % 2 else -1
            return places[w]

        def run(texts: list[str]):
            out = np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                for w in token.findall(t.lower()):
                    at, sign = place(w)
                    out[i, at] += sign
            return out

        return run

    return load


ANSWER = T.StructType([T.StructField("response", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])


def messages_key(messages: Column) -> Column:
    """Equal for equal messages."""
    return F.sha2(F.coalesce(F.to_json(messages), F.lit("")), 256)


def call_model(df: DataFrame, load: Callable[[], Callable], messages: str = "messages", name: str = "chat", retries: int = 2, wait: float = 0.5, partitions: int | None = None) -> DataFrame:
    """df with the answer of a chat model to each row's messages (array of role, content): response, prompt_tokens, completion_tokens, latency_ms, error, attempts.

    load gives a function from a list of {role, content} to a dict of text, prompt_tokens and completion_tokens. Equal messages are asked once. An error is data: after
    `retries` more attempts (`wait` seconds after the first, twice as long after each further one) the row has its text in error, an empty response and no tokens. No row is
    lost, and none stops another. Null messages aren't asked; their error says so. partitions: how many callers work at once.

    The answers are written before they are joined, so nothing downstream asks again; a task that is lost while it asks is repeated whole.
    """
    kept = df.drop(*ANSWER.names).withColumn("__key", messages_key(F.col(messages)))
    asked = kept.select("__key", F.col(messages).alias("messages")).dropDuplicates(["__key"])
    if partitions:
        asked = asked.repartition(partitions, "__key")
    schema = T.StructType([T.StructField("__key", T.StringType()), *ANSWER.fields])

    def one(model, said) -> dict:
        began, error = time.perf_counter(), "no messages"
        attempts = 0
        while said is not None and attempts <= retries:
            if attempts:
                time.sleep(wait * 2 ** (attempts - 1))
            attempts += 1
            try:
                got = model(said)
                text, counts = got["text"] or "", [int(got.get(n) or 0) for n in ("prompt_tokens", "completion_tokens")]
                return {"response": text, "prompt_tokens": counts[0], "completion_tokens": counts[1], "latency_ms": _ms(began), "error": None, "attempts": attempts}
            except Exception as e:  # whatever a caller's model raises is the row's answer
                error = f"{type(e).__name__}: {e}"
        return {"response": "", "prompt_tokens": 0, "completion_tokens": 0, "latency_ms": _ms(began), "error": error, "attempts": attempts}

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for part in batches:
            model = _loaded(name, load)
            rows = [{"__key": k, **one(model, m)} for k, m in zip(part.column("__key").to_pylist(), part.column("messages").to_pylist())]
            yield from pa.Table.from_pylist(rows, to_arrow_schema(schema)).to_batches()

    answers = written(asked.mapInArrow(run, schema), "answers")
    return kept.join(answers, "__key").drop("__key")


def _ms(began: float) -> float:
    return round((time.perf_counter() - began) * 1000, 1)


def echo(limit: int = 40, fail_every: int = 0) -> Callable[[], Callable]:
    """Loads a chat model for dry runs: it repeats the first `limit` characters of the last message and counts words as tokens. Messages whose length is divisible
    by fail_every raise an error."""

    def load():
        def run(messages: list[dict]) -> dict:
            said = messages[-1]["content"] or ""
            if fail_every and len(said) % fail_every == 0:
                raise RuntimeError("no answer")
            return {"text": said[:limit], "prompt_tokens": sum(len((m["content"] or "").split()) for m in messages), "completion_tokens": len(said[:limit].split())}

        return run

    return load
