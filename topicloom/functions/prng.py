"""The 32-bit generator that seeded clustering draws from."""

from __future__ import annotations

from collections.abc import Callable

_WORD = 0xFFFFFFFF


def mulberry32(seed: int) -> Callable[[], float]:
    """Draws in [0, 1); the sequence is fixed by the seed."""
    state = seed & _WORD

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _WORD  # fixed values of the generator: this step, and 1, 7, 61, 14, 15 below
        mixed = (state ^ state >> 15) * (state | 1) & _WORD
        mixed ^= (mixed + ((mixed ^ mixed >> 7) * (mixed | 61) & _WORD)) & _WORD
        return ((mixed ^ mixed >> 14) & _WORD) / 2**32

    return draw


def shuffled(values: list, draw: Callable[[], float]) -> list:
    """Fisher-Yates from the end."""
    out = list(values)
    for last in range(len(out) - 1, 0, -1):
        other = int(draw() * (last + 1))
        out[last], out[other] = out[other], out[last]
    return out
