"""Parameters of greatest likelihood: each step is one pass over the cached depths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from ..functions import model as M
from ..functions.pedigree import Graph
from ..operators.pedigree_calling import log_likelihood

#: Bounds of what can be fitted.
BOUNDS = {"theta": (1e-6, 0.1), "lib_error": (1e-6, 0.1), "bias_hom": (0.0, 1.0), "bias_het": (0.0, 1.0), "bias_hap": (0.0, 1.0), "over_hom": (1e-8, 0.5), "over_het": (1e-8, 0.5)}


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """A simplex walk over the inverse hyperbolic tangents of places within the bounds, so that none is left."""
    span = upper - lower
    inside = lambda y: lower + span * (np.tanh(y) + 1) / 2
    value = lambda y: f(inside(y))
    first = np.arctanh(2 * np.clip((start - lower) / span, 1e-3, 1 - 1e-3) - 1)
    points = [first] + [first + 0.5 * row for row in np.eye(len(first))]
    found = [(value(p), p) for p in points]
    for _ in range(steps):
        found.sort(key=lambda t: t[0])
        if found[-1][0] - found[0][0] < tolerance:
            break
        centre = np.mean([p for _, p in found[:-1]], 0)
        worst = found[-1][1]
        at = lambda k: centre + k * (centre - worst)  # noqa: B023, E731
        mirrored = (value(at(1.0)), at(1.0))
        if mirrored[0] < found[0][0]:
            far = (value(at(2.0)), at(2.0))
            found[-1] = min(mirrored, far, key=lambda t: t[0])
        elif mirrored[0] < found[-2][0]:
            found[-1] = mirrored
        else:
            near = (value(at(-0.5)), at(-0.5))
            if near[0] < found[-1][0]:
                found[-1] = near
            else:
                best = found[0][1]
                found = [found[0], *((value(best + (p - best) / 2), best + (p - best) / 2) for _, p in found[1:])]
    found.sort(key=lambda t: t[0])
    return inside(found[0][1]), found[0][0]


def fit(sites: DataFrame, graph: Graph, libraries: list[str], names: list[str], start: M.Parameters = M.Parameters(), steps: int = 100) -> tuple[M.Parameters, float]:
    """The parameters (names of BOUNDS) and the log10 likelihood."""
    kept = sites.select("contig", "pos", "alleles", "ad").persist()
    try:
        made = lambda x: replace(start, **dict(zip(names, map(float, x), strict=True)))
        lower, upper = (np.array([BOUNDS[n][k] for n in names]) for k in (0, 1))
        minus = lambda x: -log_likelihood(kept, graph, libraries, made(x)).first()["log_likelihood"]
        x, value = nelder_mead(minus, np.array([getattr(start, n) for n in names], float), lower, upper, steps)
        return made(x), -value
    finally:
        kept.unpersist()
