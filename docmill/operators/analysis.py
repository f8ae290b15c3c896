"""Analyses by a client that answers prompts, many texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.formats import truncated
from docmill.operators.documents import judged_category

# Fixed value: characters of a text that go into a prompt.
MAX_CHARS = 6000


class Client(Protocol):
    """Answers a prompt: text, model name, tokens in and out, milliseconds."""

    provider: str

    def generate(self, prompt: str) -> tuple[str, str, int, int, int]: ...


class FakeClient:
    """Repeats the prompt; for tests."""

    # Fixed values of the fake answer.
    provider, model_name, prefix, tokens_out = "fake", "fake-model", "fake_response_for : ", 10

    def generate(self, prompt: str) -> tuple[str, str, int, int, int]:
        return self.prefix + prompt, self.model_name, len(prompt.split()), self.tokens_out, 0


SCHEMA = "answer string, model_name string, tokens_in int, tokens_out int, latency_ms int, error string"


def analyze(
    docs: DataFrame, id_col: str, text_col: str, client: Callable[[], Client], known: list[str], fallback: str, max_chars: int = MAX_CHARS, timeout: float = 60.0, at_once: int = 8
) -> DataFrame:
    """One answer for each text, with its category and reason; a late or failing answer has an ``error``.

    Each task makes its own client and asks for ``at_once`` answers at a time. Null texts are empty.
    """
    prompts = docs.select(F.col(id_col), truncated(F.coalesce(F.col(text_col), F.lit("")), max_chars).alias("prompt"))
    kind = prompts.schema[id_col].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = []
                for waiting in [pool.submit(own.generate, p) for p in batch["prompt"]]:
                    try:
                        rows.append((*waiting.result(timeout), None))
                    except TimeoutError:
                        rows.append((None, None, None, None, None, "AI_TIMEOUT"))
                    except Exception:  # noqa: BLE001  whatever a provider's client raises
                        rows.append((None, None, None, None, None, "AI_PROVIDER_ERROR"))
                found = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                yield pd.concat([batch[[id_col]].reset_index(drop=True), found], axis=1)

    answers = prompts.mapInPandas(ask, f"`{id_col}` {kind}, {SCHEMA}")
    category, reason = judged_category(F.col("answer"), known, fallback)
    return answers.withColumns({"category": category, "reason": reason})
