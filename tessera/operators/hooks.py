"""Hooks for models that users bring: encoders, rerankers, chat models, captioners and generators.

A model is an injected callable; it runs in Arrow batches on the executors. The defaults need no model: hashed word
counts stand in for an encoder, token overlap for a reranker.
"""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import text as X
from tessera.operators import vector as V

Encoder = Callable[[list[str]], "np.ndarray | list[list[float]]"]
Scorer = Callable[[list[tuple[str, str]]], "list[float]"]
Chat = Callable[[str], str]


class Operator(Protocol):
    """What a plug-in of the engine is: a table to a table."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Registry:
    """Plug-ins by name; an unknown name is an error that tells the known ones."""

    def __init__(self) -> None:
        self.held: dict[str, Operator] = {}

    def add(self, name: str, operator: Operator) -> None:
        if name in self.held:
            raise ValueError(f"{name} is there already")
        self.held[name] = operator

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.held:
            raise KeyError(f"no operator {name}; there are {sorted(self.held)}")
        return self.held[name](df)

    def described(self, spark) -> DataFrame:
        """(name, about) of all plug-ins."""
        rows = [(n, (getattr(f, "__doc__", None) or "").strip().split("\n")[0]) for n, f in sorted(self.held.items())]
        return spark.createDataFrame(rows, "name string, about string")


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """Vectors of word counts by hash, of length 1: the encoder without a model."""
    out = np.zeros((len(texts), size))
    for k, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", text.lower())
        np.add.at(out[k], [zlib.crc32(w.encode()) % size for w in words], 1)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def encoded(df: DataFrame, text: str, encoder: Encoder | None = None, out: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds dense vectors of a text column. ``batch`` texts go to the encoder at once; null texts are empty."""
    encoder = encoder or hashed_words
    size = batch

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        said = texts.fillna("").tolist()
        found = [np.asarray(v, np.float32).tolist() for k in range(0, len(said), size) for v in encoder(said[k : k + size])]
        return pd.Series(found, index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def encode_batch(batch: int) -> int:
    """Texts that go to an encoder at once: half of an insert batch, between 8 and 64."""
    return max(8, min(64, batch // 2))


def reranked(hits: DataFrame, query: str, text: str, scorer: Scorer | None = None, out: str = "rerank_score", limit: int = 512) -> DataFrame:
    """Adds a second score of (query, the first ``limit`` characters of the text) and ``reranked``. A scorer that fails
    leaves the batch's scores as they were, and reranked is false."""
    if scorer is None:
        return hits.withColumn(out, V.jaccard(X.tokens(F.col(query)), X.tokens(F.substring(text, 1, limit)))).withColumn("reranked", F.lit(True))

    @F.pandas_udf("struct<score:double,done:boolean>")
    def run(queries: pd.Series, texts: pd.Series, scores: pd.Series) -> pd.DataFrame:
        try:
            found, done = [float(s) for s in scorer([(q or "", (t or "")[:limit]) for q, t in zip(queries, texts, strict=True)])], True
        except Exception:  # whatever a model does, the search goes on with what it has
            found, done = scores.astype(float).tolist(), False
        return pd.DataFrame({"score": found, "done": done}, index=queries.index)

    rows = hits.withColumn("_r", run(F.col(query), F.col(text), F.col("score")))
    return rows.withColumn(out, F.col("_r.score")).withColumn("reranked", F.col("_r.done")).drop("_r")


def answered(df: DataFrame, prompt: str, chat: Chat, out: str = "answer") -> DataFrame:
    """Adds a chat model's replies; an error is told in the reply, as ``error: ...``, and doesn't fail the job."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            try:
                return chat(p or "")
            except Exception as e:
                return f"error: {e}"

        return prompts.map(one)

    return df.withColumn(out, run(F.col(prompt)))


def generated(prompts: DataFrame, done: DataFrame, by: list[str], chat: Chat, fallback: Chat | None = None, timeout: float = 60.0, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(by, answer, source, tries) of prompts (by, prompt) that ``done`` (by) doesn't have yet.

    Every prompt gets ``tries`` attempts of ``timeout`` seconds; then the fallback answers, and without one, or where it
    fails too, the answer is null and source tells ``failed``. Types of ``by`` are those of the prompts.
    """
    todo = prompts.join(done.select(*by).distinct(), by, "left_anti").select(*by, "prompt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields if f.name != "prompt") + ", answer string, source string, tries int"

    def ask(model: Chat, prompt: str) -> str:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(model, prompt).result(timeout)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                answer, source, n = None, "failed", 0
                while answer is None and n < tries:
                    n += 1
                    try:
                        answer, source = ask(chat, prompt), "model"
                    except (Exception, Late):
                        time.sleep(wait)
                if answer is None and fallback:
                    try:
                        answer, source = ask(fallback, prompt), "fallback"
                    except (Exception, Late):
                        pass
                rows.append((answer, source, n))
            yield batch[by].assign(**dict(zip(("answer", "source", "tries"), map(list, zip(*rows, strict=True)), strict=True))) if rows else batch[by].assign(answer=None, source=None, tries=0)

    return todo.mapInPandas(run, schema)


#: Types of images that a classifier may name, as groups.
IMAGE_TYPES = ["natural_image", "photo", "chart", "diagram", "flowchart", "table", "equation", "circuit", "map", "screenshot", "logo"]


def classified(df: DataFrame, reply: str, types: list[str] | None = None, default: str = "natural_image") -> DataFrame:
    """Adds type, confidence and reason of a classifier's reply: its JSON, else the first type whose name stands in it
    with confidence 0.3, else the default."""
    names = types or IMAGE_TYPES
    v = F.try_parse_json(F.col(reply))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    low = F.lower(F.coalesce(F.col(reply), F.lit("")))
    named = F.coalesce(*[F.when(F.contains(low, F.lit(t)), t) for t in names], F.lit(default))
    out = df.withColumn("type", F.when(is_object, F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit(default))).otherwise(named))
    out = out.withColumn("confidence", F.when(is_object, F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))).otherwise(0.3))
    return out.withColumn("reason", F.when(is_object, F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(""))).otherwise(F.substring(F.coalesce(F.col(reply), F.lit("")), 1, 200)))


def captioned(images: DataFrame, classify: Chat, caption: Callable[[str, str], str], fits: Callable[[str], bool] | None = None, tries: int = 2) -> DataFrame:
    """(path, type, confidence, caption, tries) of images (path): classified, then captioned by their type; a caption that
    doesn't fit, such as one in another language, is asked for again."""
    rows = classified(answered(images.select("path"), "path", classify, "reply"), "reply")

    @F.pandas_udf("struct<caption:string,tries:int>")
    def run(paths: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for path, kind in zip(paths, kinds, strict=True):
            said, n = None, 0
            while n < tries:
                n += 1
                try:
                    said = caption(path, kind)
                except Exception as e:
                    said = f"error: {e}"
                if fits is None or fits(said):
                    break
            out.append((said, n))
        return pd.DataFrame(out, columns=["caption", "tries"], index=paths.index)

    return rows.withColumn("_c", run(F.col("path"), F.col("type"))).select("path", "type", "confidence", "_c.caption", "_c.tries")


def factory(providers: dict[str, Callable[..., Chat]], name: str, **settings) -> Chat:
    """A chat model by the name of its provider; settings go to the provider's maker. An unknown name is an error."""
    if name not in providers:
        raise KeyError(f"no provider {name}; there are {sorted(providers)}")
    return providers[name](**settings)


def exported(spark, queries: dict[str, Callable], oracles: dict[str, str]) -> DataFrame:
    """(name, about, has_sql, sha1) of a catalogue of queries, for documents and tools."""
    rows = [(n, (getattr(f, "__doc__", None) or "").strip().split("\n")[0], n in oracles, hashlib.sha1(oracles.get(n, "").encode()).hexdigest()) for n, f in sorted(queries.items())]
    return spark.createDataFrame(rows, "name string, about string, has_sql boolean, sha1 string")


def tools(queries: dict[str, Callable]) -> list[dict]:
    """The catalogue as tool descriptions: a name, what it does and the folder that it reads."""
    inputs = {"type": "object", "properties": {"sf_dir": {"type": "string"}}, "required": ["sf_dir"]}
    return [{"name": n, "description": (getattr(f, "__doc__", None) or n).strip().split("\n")[0], "inputSchema": inputs} for n, f in sorted(queries.items())]


def call_tool(spark, queries: dict[str, Callable], name: str, arguments: dict, limit: int = 100) -> list[dict]:
    """The first rows of a query as dictionaries, for a tool server's reply."""
    if name not in queries:
        raise KeyError(f"no tool {name}")
    return [r.asDict(recursive=True) for r in queries[name](spark, arguments["sf_dir"]).limit(limit).collect()]
