"""Recorded steps that can be replayed on other recordings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    fn: Callable[..., DataFrame]
    args: tuple
    kwargs: tuple[tuple[str, object], ...]

    def __str__(self) -> str:
        given = [repr(a) for a in self.args] + [f"{k}={v!r}" for k, v in self.kwargs]
        return f"{self.fn.__name__}({', '.join(given)})"


@dataclass(frozen=True)
class History:
    """Steps fn(df, *args, **kwargs) in order; replaying them only declares a plan.

    Histories don't change: `then` gives a longer one.
    """

    steps: tuple[Step, ...] = ()

    def then(self, fn: Callable[..., DataFrame], *args, **kwargs) -> History:
        return History((*self.steps, Step(fn, args, tuple(kwargs.items()))))

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = df.transform(s.fn, *s.args, **dict(s.kwargs))
        return df

    def describe(self) -> list[str]:
        return [str(s) for s in self.steps]
