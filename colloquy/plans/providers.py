"""What stands outside the engine: embedders, judges and assistants, with stand-ins that need no network.

A provider is a picklable object with a method over a list of texts; operators call it in Arrow
batches, once made per Python worker, and turn its failures into rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Judge(Protocol):
    def judge(self, prompts: list[str]) -> list[str]: ...


class HashedWords:
    """Unit vectors of hashed words: deterministic, and alike for texts that share words."""

    def __init__(self, size: int = 768):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 40 & 1 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm).tolist() if norm else None)
        return out


class RuleJudge:
    """Answers by a rule on the prompt, as a JSON text."""

    def __init__(self, rule: Callable[[str], dict]):
        self.rule = rule

    def judge(self, prompts: list[str]) -> list[str]:
        import json

        return [json.dumps(self.rule(p), ensure_ascii=False) for p in prompts]


class HttpEmbedder:
    """POST {"text": ...} per text; a failure is a missing vector."""

    def __init__(self, url: str, timeout: float = 60):
        self.url, self.timeout = url, timeout

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        import json
        import urllib.request

        out: list[list[float] | None] = []
        for t in texts:
            try:
                req = urllib.request.Request(self.url, json.dumps({"text": t}).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(req, timeout=self.timeout) as got:
                    out.append([float(x) for x in json.load(got)["embedding"]])
            except (OSError, ValueError, KeyError):
                out.append(None)
        return out


def embed(records: DataFrame, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """Adds embedding array<double>; null for a blank text or a failure."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            live = [i for i, t in enumerate(s) if t and t.strip()]
            for i in range(0, len(live), batch):
                part = live[i : i + batch]
                for k, v in zip(part, embedder.embed([s.iloc[k] for k in part])):
                    out[k] = v
            yield pd.Series(out)

    return records.withColumn("embedding", run(text))


def ask(records: DataFrame, prompt: str, judge: Judge, attempts: int = 3) -> DataFrame:
    """Adds answer and error; a judge that keeps failing leaves its last error."""
    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for p in s:
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = judge.judge([p])[0], None
                        break
                    except Exception as e:  # a provider may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                rows.append((answer, error))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return records.withColumn("__r", run(prompt)).select("*", "__r.answer", "__r.error").drop("__r")


def model_names(base: str | None, key: str | None, fallback: str, timeout: float = 15) -> list[str]:
    """``owner/id`` of the models that a gateway lists; the fallback alone without settings or on any failure."""
    import json
    import urllib.request

    if not (base or "").strip() or not (key or "").strip():
        return [fallback]
    try:
        asked = urllib.request.Request(f"{base.rstrip('/')}/models", headers={"Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            listed = json.load(got).get("data") or []
        return [f"{m['owned_by']}/{m['id']}" for m in listed if isinstance(m, dict) and {"owned_by", "id"} <= m.keys()] or [fallback]
    except (OSError, ValueError, AttributeError):
        return [fallback]


def role_options(model: str, key: str | None, base: str | None, params: str, default_model: str, protected: frozenset[str] = frozenset({"messages", "model", "api_key", "api_base"}), timeout: float = 300) -> dict:
    """Options of a role's calls; its own JSON parameters win, but for those that the run sets itself."""
    import json

    options: dict = {"model": (model or "").strip() or default_model, "api_key": (key or "").strip() or None, "api_base": base or None, "timeout": timeout}
    try:
        own = json.loads((params or "").strip() or "{}")
    except ValueError:
        own = {}
    return options | {k: v for k, v in own.items() if k not in protected} if isinstance(own, dict) else options
