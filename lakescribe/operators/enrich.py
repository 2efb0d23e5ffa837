"""Stages that call a model: embeddings, contexts, summaries. Models are given as functions; without one a deterministic stand-in is used and named so."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import section_texts
from ..sources.workspace import written
from .manifest import cached


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in for an encoder: unit vectors of hashed words. It has no meaning beyond shared words."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1.0 if h >> 40 & 1 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """An encoder's token vectors averaged over the mask, of length 1."""
    m = mask[..., None].astype(hidden.dtype)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)


#: The tokens of a text that an encoder sees, and its threads.
ENCODER_TOKENS, ENCODER_THREADS = 2048, 2


def pooled_encoder(session, tokenizer, max_tokens: int = ENCODER_TOKENS) -> Callable[[list[str]], np.ndarray]:
    """An encoder from an inference session (inputs input_ids, attention_mask and, if it has it, token_type_ids; token vectors first among its outputs) and a tokenizer: mean-pooled unit vectors."""
    tokenizer.enable_truncation(max_tokens)
    tokenizer.enable_padding()
    wanted = {i.name for i in session.get_inputs()}

    def encode(texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch(list(texts))
        ids, mask = (np.array([getattr(e, name) for e in found], dtype=np.int64) for name in ("ids", "attention_mask"))
        inputs = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return mean_pooled(session.run(None, {k: v for k, v in inputs.items() if k in wanted})[0], mask)

    return encode


def onnx_encoder(model: str, tokenizer: str) -> Callable[[list[str]], np.ndarray]:
    """An encoder from an ONNX model and a tokenizer's JSON, at the same paths on every machine; each Python process opens them once, on first use."""
    opened: list = []

    def encode(texts: list[str]) -> np.ndarray:
        if not opened:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads, options.inter_op_num_threads = ENCODER_THREADS, 1
            opened.append(pooled_encoder(onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer)))
        return opened[0](texts)

    return encode


def embedded(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None, batch: int = 8, text_col: str = "text", context_col: str = "context") -> DataFrame:
    """``chunks`` with ``vector``: an Arrow function that runs the encoder over batches; the encoder is made once per Python worker by the function it is closed over."""
    encode = encode or hashed_embedding

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            yield pd.Series([v.tolist() for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])], dtype=object)

    context = F.col(context_col) if context_col in chunks.columns else F.lit("")
    return chunks.withColumn("vector", run(tx.passage(F.col(text_col), context)))


def answered(rows: DataFrame, model: Callable[[str], str], prompt: Column, cache: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``value``, the cache with what is new): the model is called for rows whose key is not cached, once per key; a failed call gives an empty value that is not kept.

    The answers are written before they are used, so that rows and cache have the same ones.
    """
    hits, misses = cached(rows, cache, text_col)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for p in pdf["prompt"]:
                try:
                    values.append(model(p))
                except Exception:  # a model that fails leaves the chunk without an answer
                    values.append("")
            yield pd.DataFrame({"key": pdf["key"], "value": values})

    asked = misses.withColumn("prompt", prompt).groupBy("key").agg(F.min("prompt").alias("prompt")).mapInPandas(call, "key string, value string")
    asked = written(asked, "answers")
    done = misses.join(asked, "key", "left").withColumn("value", F.coalesce("value", F.lit("")))
    return hits.unionByName(done), cache.unionByName(asked.filter("value <> ''"))


def with_waits(model: Callable[[str], str], tries: int = 3, first: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``model`` asked again where it is rate-limited (429 in what it raises), after 5 and 10 seconds; anything else, and the last try, raises."""

    def ask(prompt: str) -> str:
        for attempt in range(tries):
            try:
                return model(prompt)
            except Exception as e:
                if "429" not in str(e) or attempt == tries - 1:
                    raise
                sleep(first * 2**attempt)
        raise ValueError("tries must be positive")

    return ask


def context_prompt(title: Column, excerpt: Column, chunk: Column) -> Column:
    return F.concat(F.lit("Document: "), title, F.lit("\n\nDocument text:\n"), F.substring(excerpt, 1, 3000), F.lit("\n\nPassage:\n"), F.substring(chunk, 1, 2000), F.lit("\n\nSay in two or three sentences what the passage is about within the document."))


def with_contexts(chunks: DataFrame, documents: DataFrame, model: Callable[[str], str], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with ``context``; documents are matched by type and file."""
    texts = documents.select("document_type", "source_file", F.col("text").alias("_doc_text"))
    rows = chunks.drop("context").join(texts, ["document_type", "source_file"], "left")
    prompt = context_prompt(tx.title_of_file(F.col("source_file")), F.coalesce("_doc_text", F.lit("")), F.col("text"))
    done, cache = answered(rows, model, prompt, cache)
    return done.withColumnRenamed("value", "context").drop("key", "_doc_text", "prompt"), cache


def summary_chunks(chunks: DataFrame, model: Callable[[str], str], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A summary chunk for each section of more than 200 characters: level 2, content type "summary", index -1, no pages."""
    sections = section_texts(chunks)
    prompt = F.concat(F.lit("Section: "), F.col("section_title"), F.lit("\n\n"), F.substring("text", 1, 3000), F.lit("\n\nSummarise the section."))
    done, cache = answered(sections, model, prompt, cache)
    rows = done.filter("value <> ''").select(
        F.col("value").alias("text"), "section_title", F.lit(2).alias("section_level"), F.lit("summary").alias("content_type"), tx.has_quantity(F.col("value")).alias("has_quantitative_data"),
        F.lit(-1).alias("chunk_index"), "source_file", "document_type", F.lit(-1).alias("page_start"), F.lit(-1).alias("page_end"), F.lit(True).alias("is_summary"),
    )
    return rows, cache
