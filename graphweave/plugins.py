"""Pluggable embedders and answer generators, with deterministic defaults that need no model."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.errors import GenerationError


def hashed_words(text: str, width: int = 64) -> list[float]:
    """A bag of words hashed to a unit vector; the default embedder."""
    import xxhash

    vector = np.zeros(width)
    for word in text.lower().split():
        h = xxhash.xxh64_intdigest(word)
        vector[h % width] += 1 if h >> 63 else -1
    size = np.linalg.norm(vector)
    return (vector / size if size else vector).tolist()


def embed(df: DataFrame, column: str, embedder: Callable[[str], list[float]] = hashed_words) -> DataFrame:
    """``df`` with the ``embedding`` of a text column, by Arrow batches; null for null."""

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else embedder(x))

    return df.withColumn("embedding", vector(F.col(column)))


def with_retries(generate: Callable[[str], str], attempts: int = 5, least: float = 2.0, most: float = 60.0) -> Callable[[str], str]:
    """``generate``, tried again after growing pauses; the last failure is raised."""

    def call(prompt: str) -> str:
        for attempt in range(attempts):
            try:
                return generate(prompt)
            except Exception as e:  # noqa: BLE001 - whatever the generator raises
                if attempt == attempts - 1:
                    raise GenerationError(str(e)) from e
                time.sleep(min(most, least * 2**attempt))
        raise GenerationError("no attempt was allowed")

    return call


def extractive_answer(prompt: str) -> str:
    """The sentence of the prompt's context that shares most words with its question; the default generator."""
    context, _, question = prompt.rpartition("\nQuestion: ")
    asked = set(question.lower().split())
    parts = [p.strip() for p in context.replace("\n", ". ").split(". ") if p.strip()]
    return max(parts, key=lambda p: (len(asked & set(p.lower().split())), -len(p)), default="")


def capitalised_names(chunk_id: str, text: str) -> str:
    """A reply in the extractor's format without a model: runs of two or more capitalised words are concepts, and those of one
    line are related. The default extractor, a stand-in."""
    found: dict[str, dict] = {}
    edges = []
    for line in text.split("\n"):
        names = list(dict.fromkeys(re.findall(r"\b[^\W\d_a-z]\w+(?: [^\W\d_a-z]\w+)+", line)))
        for name in names:
            found.setdefault(name, {"name": name, "type": "CONCEPT", "description": line.strip()[:200], "aliases": []})
        edges += [{"source_entity": a, "target_entity": b, "relation_type": "RELATED_TO", "description": "", "weight": 0.5} for a, b in zip(names, names[1:])]
    return json.dumps({"entities": list(found.values()), "relationships": edges, "summary": text.strip()[:200], "keywords": []})


def answers(contexts: DataFrame, generate: Callable[[str], str] = extractive_answer) -> DataFrame:
    """``question_id, answer, error`` from ``question_id, question, context``; a failure is its row's error."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, question, context in zip(frame["question_id"], frame["question"], frame["context"]):
                try:
                    rows.append((key, generate(f"{context}\nQuestion: {question}"), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=["question_id", "answer", "error"])

    return contexts.select("question_id", "question", "context").mapInPandas(work, "question_id bigint, answer string, error string")
