"""Checks of parameters before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence


class InvalidParameter(ValueError):
    def __init__(self, param: str, value: object, constraint: str) -> None:
        super().__init__(f"{param} = {value!r}: must be {constraint}")
        self.param, self.value, self.constraint = param, value, constraint


class IncompatibleStates(ValueError):
    """States of different kinds or parameters do not merge."""


def within(param: str, value: float, low: float, high: float) -> None:
    if not (isinstance(value, (int, float)) and low <= value <= high):
        raise InvalidParameter(param, value, f"in [{low}, {high}]")


def precision(value: int, low: int = 4, high: int = 18) -> None:
    within("precision", value, low, high)


def log_size(value: int) -> None:
    within("lg_k", value, 4, 26)


def capacity(value: int, high: int = (1 << 31) - 1) -> None:
    within("capacity", value, 1, high)


def probability(param: str, value: float) -> None:
    if not (isinstance(value, (int, float)) and 0 < value < 1):
        raise InvalidParameter(param, value, "in (0, 1)")


def dimensions(width: int, depth: int) -> None:
    within("width", width, 1, 1 << 20)
    within("depth", depth, 1, 1 << 20)


def positive(param: str, value: float) -> None:
    if not (isinstance(value, (int, float)) and value > 0):
        raise InvalidParameter(param, value, "greater than 0")


def bloom(n: int, m: int, k: int) -> None:
    capacity(n)
    within("m", m, 1, 1 << 40)
    within("k", k, 1, 256)


def size_in_bytes(value: int, limit: int = 256 << 20) -> None:
    within("bytes", value, 0, limit)


def one_of(param: str, value: object, choices: Sequence[object]) -> None:
    if value not in choices:
        raise InvalidParameter(param, value, f"one of {list(choices)}")
