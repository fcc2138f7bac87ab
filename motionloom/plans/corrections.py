"""A registry of corrections: functions of one series that a plan calls by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from motionloom.operators.numeric import per_series, propagate

CORRECTIONS: dict[str, Callable] = {}


def correction(name: str) -> Callable:
    """Register a function (values, **options) -> values."""

    def add(function: Callable) -> Callable:
        CORRECTIONS[name] = function
        return function

    return add


@correction("identity")
def identity(values: np.ndarray) -> np.ndarray:
    return values


@correction("offset")
def offset(values: np.ndarray, amount: float = 0.0) -> np.ndarray:
    return values + amount


@correction("anchor")
def anchor(values: np.ndarray, amount: float = 0.0, method: str = "linear") -> np.ndarray:
    """The middle row moves by `amount`, the ends stay."""
    return values + propagate(len(values), [len(values) // 2], np.array([[amount]]), method)[:, 0]


def applied(df: DataFrame, by: list[str], order: str, value: str, name: str, **options: object) -> DataFrame:
    """A registered correction per series; options that it does not take are left out."""
    if name not in CORRECTIONS:
        raise ValueError(f"no correction {name}")
    function = CORRECTIONS[name]
    known = {k: v for k, v in options.items() if k in inspect.signature(function).parameters}
    return per_series(df, by, order, [value], lambda x: function(x, **known), "corrected", "double")
