"""Models that live elsewhere: an adapter for generation and for the edits that need an instruction-following model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# What the edits ask of a model.
REPHRASE = "Say the following in other words. Keep its meaning and about its length. Answer with the new text alone.\n\n{text}"
INTO = "Translate the following into {language}. Answer with the translation alone.\n\n{text}"


@dataclass
class ProvidedModel:
    """A model given by callables.

    ``logits(texts)`` returns a row of scores for each list of ids; ``answer(instruction, max_tokens, seed)`` follows an
    instruction.  Both must pickle: they run on executors, which reach the provider themselves.  Each may be missing; what needs it raises.
    """

    tokens: list[str]
    logits: Callable[[list[list[int]]], np.ndarray] | None = None
    answer: Callable[[str, int, int], str] | None = None
    eos_id: int | None = None
    home: str = "English"
    _number: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._number = {t: i for i, t in enumerate(self.tokens)}

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    def encode(self, tokens: list[str]) -> list[int]:
        return [self._number.get(t, 0) for t in tokens]

    def distributions(self, texts: list[list[int]]) -> np.ndarray:
        if self.logits is None:
            raise NotImplementedError("this model has no scores for tokens")
        scores = np.asarray(self.logits(texts), float)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def _ask(self, instruction: str, text: str, seed: int) -> str:
        if self.answer is None:
            raise NotImplementedError("this model does not follow instructions")
        return self.answer(instruction, 64 + 3 * len(text.split()), seed).strip()

    def paraphrase(self, text: str, seed: int = 0) -> str:
        return self._ask(REPHRASE.format(text=text), text, seed)

    def translate_roundtrip(self, text: str, pivot: str = "French", seed: int = 0) -> str:
        there = self._ask(INTO.format(language=pivot, text=text), text, seed)
        return self._ask(INTO.format(language=self.home, text=there), there, seed + 1)
