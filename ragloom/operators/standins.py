"""Deterministic models that fail on some inputs, for the error paths of the model stages."""

from __future__ import annotations

import re

from ..functions import text as TX
from .judge import TokenJudge


class ShortPrompts:
    """A generator that fails on long prompts and otherwise repeats the prompt's start and end."""

    limit = 330

    def __call__(self, prompts: list[str]) -> list[str]:
        if any(len(p) > self.limit for p in prompts):
            raise ValueError("prompt too long")
        return [f"{p[:5]}|{p[-9:]}" for p in prompts]


class StrictJudge(TokenJudge):
    """The token judge, which fails on answers of many statements."""

    limit = 10

    def __call__(self, records: list[dict]) -> list[dict[str, list[int]]]:
        for r in records:
            if sum(any(c.isalnum() for c in s) for s in re.split(TX.STATEMENT_BREAK, r["answer"])) > self.limit:
                raise ValueError("too many statements")
        return super().__call__(records)
