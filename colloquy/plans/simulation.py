"""Simulated dialogs: a user and an assistant provider take turns within one Arrow batch row."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "history array<struct<role:string,content:string,reply_duration_sec:double>>, turns int, error string"


class Speaker(Protocol):
    def reply(self, history: list[dict]) -> str: ...


def converse(history: list[dict], user: Speaker, assistant: Speaker, max_turns: int = 5, stop: Callable[[list[dict]], bool] | None = None, assistant_first: bool = False) -> tuple[list[dict], int]:
    """Let the side whose turn it is speak until ``max_turns`` replies or, after an assistant's, ``stop``.

    An empty dialog is opened by one more reply, of the user or with ``assistant_first`` of the assistant.
    ``max_turns`` of 0 asks for one reply of the assistant and no more.
    """
    history, turns, opening = [dict(t) for t in history], 0, not history

    def speak(role: str) -> bool:
        began = time.monotonic()
        said = (assistant if role == "assistant" else user).reply(history)
        history.append({"role": role, "content": said, "reply_duration_sec": time.monotonic() - began})
        return role == "assistant" and stop is not None and stop(history)

    if max_turns == 0:
        speak("assistant")
        return history, 1
    if opening and speak("assistant" if assistant_first else "user"):
        return history, 1
    while turns < max_turns:
        turns += 1
        if speak("assistant" if history[-1]["role"] == "user" else "user"):
            break
    return history, turns


def simulate(cases: DataFrame, user: Speaker, assistant: Speaker, max_turns: int = 5, stop: Callable[[list[dict]], bool] | None = None, assistant_first: bool = False) -> DataFrame:
    """dialog_id, history, turns, error of each case (dialog_id, history); a failure is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for dialog, raw in zip(pdf["dialog_id"], pdf["turns_json"]):
                try:
                    history, turns = converse(json.loads(raw or "[]"), user, assistant, max_turns, stop, assistant_first)
                    rows.append((dialog, [{"role": t["role"], "content": t["content"], "reply_duration_sec": t.get("reply_duration_sec")} for t in history], turns, None))
                except Exception as e:  # a provider may fail in any way; the row says how
                    rows.append((dialog, [], 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["dialog_id", "history", "turns", "error"])

    fed = cases.select(F.col("dialog_id").cast("string").alias("dialog_id"), F.to_json("history").alias("turns_json"))
    return fed.mapInPandas(run, f"dialog_id string, {RESULT}")


def one_reply(cases: DataFrame, assistant: Speaker) -> DataFrame:
    """Exactly one new assistant reply to each history."""
    return simulate(cases, assistant, assistant, 0)
