"""Models behind interfaces, with deterministic defaults: bring your own for production. A model is an object that is called
with pandas series in Arrow batches; it is sent once and lives as long as the worker. The defaults for generating, ranking,
judging and summarising are columns, so that they cost no Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.retrieve import word_share


class Embedder(Protocol):
    def __call__(self, texts: pd.Series) -> list[np.ndarray | None]: ...


class PairScorer(Protocol):
    def __call__(self, questions: pd.Series, texts: pd.Series) -> list[float | None]: ...


class TextModel(Protocol):
    """Of a generator, a summariser, a translator or a judge: a text for each prompt."""

    def __call__(self, prompts: pd.Series) -> list[str | None]: ...


class HashingEmbedder:
    """Words hashed to ``width`` signed places, at unit length in double precision; a text without words has a null vector.
    Of the MD5 digits of a word the first four give the place, the fifth the sign."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, texts: pd.Series) -> list[np.ndarray | None]:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for w in re.findall(r"[^\W_]+", (text or "").lower()):
                if (at := known.get(w)) is None:
                    h = md5(w.encode("utf-8", "replace")).hexdigest()
                    at = known[w] = (int(h[:4], 16) % self.width, 1.0 if h[4] < "8" else -1.0)
                v[at[0]] += at[1]
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else None)
        return out


def embed(rows: DataFrame, text_col: str, out: str = "embedding", model: Embedder | None = None, prefix: str = "passage: ", kind: str = "array<float>") -> DataFrame:
    """``rows`` with vectors; null texts have none."""
    model = model or HashingEmbedder()

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.map(lambda t: None if t is None else prefix + t)))

    return rows.withColumn(out, run(F.col(text_col)))


def pair_scorer(model: PairScorer) -> Callable[[Column, Column], Column]:
    """A ranking model as a column of question and text."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model(questions, texts), dtype="float64")

    return run


def text_model(model: TextModel) -> Callable[[Column], Column]:
    """A model that answers prompts as a column of prompts."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(prompts), dtype="object")

    return run


def judged(reply: Column) -> tuple[Column, Column]:
    """(verdict, reason) of a judge's reply of the form "VERDICT: reason"; ERROR without a reply, UNKNOWN for other words."""
    word = F.upper(F.regexp_extract(reply, "(?i)\\b(grounded|partial|ungrounded|hallucinated|skip)\\b", 1))
    reason = F.trim(F.regexp_replace(reply, "(?is)^.*?(?:[:\\-]|$)", ""))
    return F.when(reply.isNull(), "ERROR").when(word == "", "UNKNOWN").otherwise(word), F.coalesce(reason, F.lit(""))


def extractive_answer(context: Column, most: int = 3) -> Column:
    """The default generator: the first sentences of the best passage, with its number."""
    first = F.regexp_extract(context, "(?s)\\)\\n(.*?)(?:\\n\\n\\[Passage |\\z)", 1)
    return F.concat(F.array_join(F.slice(F.split(first, "(?U)(?<=[.!?؟])\\s+"), 1, most), " "), F.lit(" [1]"))


def summary(last_questions: Column, limit: int = 480) -> Column:
    """The default for a summarising model: the last questions, cut."""
    return F.substring(last_questions, 1, limit)


def template_questions(section_title: Column, language: str = "en") -> Column:
    """The default for a model that makes questions: three about the section, in English or Arabic."""
    heads = {
        "en": ("What is required under ", "Who is responsible for ", "When does one have to comply with "),
        "ar": ("ما المطلوب بموجب ", "من المسؤول عن ", "متى يجب الالتزام بـ "),
    }[language]
    title = F.coalesce(section_title, F.lit({"en": "this section", "ar": "هذا القسم"}[language]))
    return F.array(*[F.concat(F.lit(head), title, F.lit("?" if language == "en" else "؟")) for head in heads])


@dataclass(frozen=True)
class Models:
    """What answers questions. ``generators`` by name; each makes a column from context, question and prompt."""

    embedder: Embedder = field(default_factory=HashingEmbedder)
    scorer: Callable[[Column, Column], Column] = word_share
    generators: dict[str, Callable[[Column, Column, Column], Column]] = field(default_factory=lambda: {"extractive": lambda context, question, prompt: extractive_answer(context)})
    backend: str = "extractive"

    def generate(self, context: Column, question: Column, prompt: Column) -> Column:
        return self.generators[self.backend](context, question, prompt)
