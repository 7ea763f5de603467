"""Parameters of the keyed mark and of its detector."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class MarkConfig:
    n_blocks: int = 32
    n_columns: int = 16
    beta: float = 0.5
    context_window: int = 3
    mask_repeated_contexts: bool = True
    ot_iterations: int = 40
    ot_tolerance: float = 0.02

    def as_dict(self) -> dict:
        return asdict(self)


ALPHA = 0.01
VOCAB_SIZE = 12_000
UNKNOWN = "<unk>"
EXAMPLE_KEY = bytes(range(32))
