"""The narrow interface to models outside the engine: classify, annotate, and a stub without one."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an error message holds when a call may succeed later.
TRANSIENT = ["rate", "429", "timeout", "overloaded", "503"]


class Classifier(Protocol):
    """Anything that labels a batch of texts: (category, subcategory, rationale) each."""

    def __call__(self, texts: list[str]) -> list[tuple[str, str | None, str]]: ...


class KeywordStub:
    """A deterministic classifier for tests: the first category one of whose words occurs."""

    WORDS = {"E1": ["carbone", "climat", "énergétique"], "E3": ["eau", "hydrique"], "E5": ["déchets", "recyclage"], "S1": ["salarié", "emploi", "formation"], "G1": ["corruption", "conduite"]}

    def __call__(self, texts: list[str]) -> list[tuple[str, str | None, str]]:
        out = []
        for t in texts:
            low = (t or "").lower()
            cat = next((c for c, ws in self.WORDS.items() if any(w in low for w in ws)), "none")
            out.append((cat, None if cat == "none" else f"{cat}-1", f"Classement en {cat} par mots-clés."))
        return out


class Stubborn:
    """A deterministic annotator for tests that is right after so many corrections as the length of
    the text, modulo five, says."""

    def __call__(self, text: str, errors: list[str]) -> str:
        return "score 3" if len(errors) >= len(text) % 5 else "score 9"

    @staticmethod
    def validate(answer: str) -> list[str]:
        return [] if answer == "score 3" else ["score invalide"]


class Labelled:
    """A deterministic judge for tests: it answers what a column of the row says."""

    def __init__(self, column: str):
        self.column = column

    def of(self, df: DataFrame) -> Column:
        return F.col(self.column)


def both(df: DataFrame, judge, policy, text: str = "content", key: str = "row_id", attempts: int = 3, wait: float = 60.0) -> DataFrame:
    """``df`` with ``silver_category`` and ``base_category``, the labels of two models for each row.
    A model is a ``Classifier``, or has ``of(df)``, a column that holds its label. A call that fails
    leaves a null label, and the row is an error for both."""
    out = df
    for name, model in (("silver", judge), ("base", policy)):
        if hasattr(model, "of"):
            out = out.withColumn(f"{name}_category", model.of(out))
        else:
            got = classify(df, model, key, text, attempts, wait).select(key, F.col("pred_label").alias(f"{name}_category"))
            out = out.join(got, key, "left")
    return out


class Encoder(Protocol):
    """Hidden states of a batch of texts: for each an array of layers x tokens x dimensions."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]: ...


class HashedEncoder:
    """A deterministic encoder for tests: the state of a word in layer k is a hash of it and the k
    words before it, as so many signs."""

    def __init__(self, layers: int = 3, width: int = 32):
        self.layers, self.width = layers, width

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.stack([[self._state(tuple(w[max(0, i - k) : i + 1])) for i in range(len(w))] for k in range(self.layers)]) for w in ((t.split() or [""]) for t in texts)]

    def _state(self, words: tuple[str, ...]) -> np.ndarray:
        bits = np.frombuffer(hashlib.sha256(" ".join(words).encode()).digest(), dtype=np.uint8)
        return np.unpackbits(bits)[: self.width] * 2.0 - 1


def hidden_states(df: DataFrame, encoder: Encoder, key: str, text: str, pooling: str = "last") -> DataFrame:
    """``(key, layer, features)``: the states of each layer, of the last token or the mean of all.
    Null texts have none."""
    if pooling not in ("last", "mean"):
        raise ValueError(f"pooling is last or mean, not {pooling}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, states in zip(b[key].tolist(), encoder(b[text].tolist())):
                pooled = states[:, -1] if pooling == "last" else states.mean(axis=1)
                yield pd.DataFrame({key: k, "layer": np.arange(len(pooled)), "features": list(pooled.astype(np.float32))})

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, layer long, features array<float>")


def retrying(call, attempts: int = 3, wait: float = 60.0, sleep=time.sleep):
    """The result of ``call()``, tried again after a transient error with doubled waits."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not any(x in str(e).lower() for x in TRANSIENT):
                raise
            sleep(wait * 2**k)


def classify(df: DataFrame, model: Classifier, key: str, text: str, attempts: int = 3, wait: float = 60.0) -> DataFrame:
    """``(key, pred_label, pred_subcategory, pred_rationale, error)``: one batch call per Arrow
    batch. A batch that fails keeps its rows, with null labels and the error, so they can be tried
    again; a failure is never a label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text].tolist()
            try:
                rows = [(*r, None) for r in retrying(lambda t=texts: model(t), attempts, wait)]
            except Exception as e:
                rows = [(None, None, None, str(e)[:200] or type(e).__name__)] * len(texts)
            out = pd.DataFrame(rows, columns=["pred_label", "pred_subcategory", "pred_rationale", "error"], dtype=object)
            out.insert(0, key, b[key].to_numpy())
            yield out

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, pred_label string, pred_subcategory string, pred_rationale string, error string")


def annotate(df: DataFrame, model, validate, key: str, text: str, corrections: int = 2) -> DataFrame:
    """``(key, answer, errors, tries)``: ``model(text, errors)`` is asked again with all errors that
    ``validate(answer)`` found so far, at most ``corrections`` times; the last answer stays with its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key].tolist(), b[text].tolist()):
                found: list[str] = []
                for tries in range(1, corrections + 2):
                    answer = model(t, found)
                    if not (errors := validate(answer)):
                        break
                    found = found + errors
                rows.append((k, answer, errors, tries))
            yield pd.DataFrame(rows, columns=[key, "answer", "errors", "tries"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, answer string, errors array<string>, tries int")
