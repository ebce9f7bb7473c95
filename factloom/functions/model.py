"""The model behind extraction, curation, synthesis and embeddings.

Any object with these methods serves.  It is made once in each Python worker by
a factory, and sees batches.  The stub is deterministic and needs no weights.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.workspace import ship_package


class Model(Protocol):
    def generate(self, prompt: str, max_tokens: int) -> str: ...

    def chat(self, messages: list[tuple[str, str]], max_tokens: int) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    @property
    def dim(self) -> int: ...


def render_chat(messages: list[tuple[str, str]], turn: str = "<|im_start|>{role}\n{content}<|im_end|>\n", answer: str = "<|im_start|>assistant\n") -> str:
    """Messages as one prompt by a chat template: a turn for each, and the beginning of the answer's."""
    return "".join(turn.format(role=role, content=content) for role, content in messages) + answer


class BaseModel:
    """What a model that only completes prompts and embeds single texts needs besides: ``generate``, ``embed_one`` and ``dim``."""

    #: The turns' template, or None where a model has none.
    turn: str | None = None
    answer = ""

    def chat(self, messages: list[tuple[str, str]], max_tokens: int) -> str:
        """By the template; without one, the system message and the last of the user."""
        if self.turn is not None:
            return self.generate(render_chat(messages, self.turn, self.answer), max_tokens)
        of = lambda role, order: next((c for r, c in order if r == role), "")
        return self.generate(f"{of('system', messages)}\n\n{of('user', messages[::-1])}", max_tokens)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_one(t) for t in texts]


class StubModel:
    """Hashed bags of words as embeddings; "I prefer ..." sentences as extractions.

    ``answers`` has answers by what a prompt holds; with ``in_last``, by what it
    holds inside the conversation.
    """

    def __init__(self, dim: int = 64, answers: dict[str, str] | None = None, in_last: bool = False):
        self._dim, self.answers, self.in_last = dim, answers or {}, in_last

    @property
    def dim(self) -> int:
        return self._dim

    def generate(self, prompt: str, max_tokens: int) -> str:
        where = prompt.rsplit("<conversation>", 1)[-1].removesuffix("</conversation>") if self.in_last else prompt
        for needle, answer in self.answers.items():
            if needle in where:
                return answer
        if "CANDIDATES" in prompt:
            return "[]"
        if "FACTS" in prompt:
            first = prompt.split("FACTS", 1)[1].strip().splitlines()
            return json.dumps({"content": first[-1].lstrip("- ") if first else "", "category": "pattern", "confidence": 0.8})
        found = re.findall(r"\b(?:prefer|use|decided on|like)s? ([\w -]{3,60})", prompt.rsplit("<conversation>", 1)[-1])
        return json.dumps([dict(content=f"Prefers {x.strip()}", entity=x.split()[0].lower(), category="preference", scope="personal", confidence=0.9, scope_confidence=0.9) for x in found])

    def chat(self, messages: list[tuple[str, str]], max_tokens: int) -> str:
        return self.generate(messages[-1][1], max_tokens)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self._dim, np.float32)
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self._dim] += 1 if h >> 63 else -1
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).tolist())
        return out


Factory = Callable[[], Model]


def embed_column(spark, factory: Factory, text) -> Column:
    """Embeddings in batches, one model in each worker; a wrong dimension is an error."""
    ship_package(spark)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            vectors = model.embed([x or "" for x in s])
            if any(len(v) != model.dim for v in vectors):
                raise ValueError("the model's vectors don't have its dimension")
            yield pd.Series(vectors)

    return run(text)


def chat_column(spark, factory: Factory, system: str, user, shots: list[tuple[str, str]] | None = None, max_tokens: int = 2048) -> Column:
    """Answers to a column of user messages behind a system message and worked examples.  Null where the model fails."""
    ship_package(spark)
    before = [("system", system)] + [m for q, a in shots or [] for m in (("user", q), ("assistant", a))]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()

        def one(x):
            try:
                return None if x is None else model.chat([*before, ("user", x)], max_tokens)
            except Exception:  # noqa: BLE001 - whatever a model raises makes a dead letter
                return None

        for s in batches:
            yield s.map(one)

    # a real model may answer differently each time, so its answers aren't computed twice
    return run.asNondeterministic()(user)
