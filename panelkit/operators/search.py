"""Coarse-to-fine search for weights on the capped simplex.

A round evaluates a whole set of candidates in one go on the cluster. The first set is a coarse lattice; each further one moves
a step between any two assets, around the best candidates of every target at once, and the step is halved when no target gets
any better. All candidates seen stay, so a target's result is the best of everything that was evaluated for any of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np

from panelkit.operators.tails import Candidates

Values = dict[str, np.ndarray]


def lattice(assets: int, steps: int, cap: float = 1.0) -> np.ndarray:
    """All weights in steps of 1 / steps that sum to one, none over the cap."""
    bars = np.array(list(itertools.combinations(range(steps + assets - 1), assets - 1)), np.int64).reshape(-1, assets - 1)
    edges = np.hstack([np.full((len(bars), 1), -1), bars, np.full((len(bars), 1), steps + assets - 1)])
    weights = (np.diff(edges, axis=1) - 1) / steps
    return weights[weights.max(1) <= cap + 1e-12]


def moves(weights: np.ndarray, step: float, cap: float = 1.0) -> np.ndarray:
    """Every weight of every row with a step taken from one asset and given to another."""
    n = weights.shape[1]
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
    shift = np.zeros((len(pairs), n))
    for k, (i, j) in enumerate(pairs):
        shift[k, i], shift[k, j] = -step, step
    new = (weights[:, None] + shift[None]).reshape(-1, n)
    return np.round(new[(new.min(1) >= -1e-12) & (new.max(1) <= cap + 1e-12)], 12) + 0.0


def search(evaluate: Callable[[Candidates], Values], best: Callable[[Candidates, Values], Sequence[np.ndarray]], assets: int, cap: float = 1.0, steps: int = 5, halvings: int = 3, most_rounds: int = 12) -> tuple[Candidates, Values]:
    """All candidates that were evaluated, with their values. best gives for each target the places of its best candidates, an
    empty array if nothing fits."""
    c = Candidates(np.zeros(0, np.int64), np.zeros((0, assets)))
    values: Values = {}
    new, step, last = lattice(assets, steps, cap), 1 / steps, None
    for _ in range(most_rounds):
        part = Candidates(np.arange(len(c.ids), len(c.ids) + len(new)), new)
        found = evaluate(part)
        c = Candidates(np.concatenate([c.ids, part.ids]), np.vstack([c.weights, part.weights]))
        values = {k: np.concatenate([values.get(k, np.zeros(0)), x]) for k, x in found.items()}
        chosen = best(c, values)
        now = [tuple(x.tolist()) for x in chosen]
        if now == last or last is None:
            step, halvings = step / 2, halvings - 1
            if halvings < 0:
                break
        last = now
        around = np.unique(np.concatenate([np.asarray(x, np.int64) for x in chosen]))
        known = {w.tobytes() for w in np.round(c.weights, 12) + 0.0}
        while halvings >= 0:
            new = np.unique(moves(np.round(c.weights[around], 12) + 0.0, step, cap), axis=0)
            new = new[[w.tobytes() not in known for w in new]]
            if len(new):
                break
            step, halvings = step / 2, halvings - 1  # all of them are known
        else:
            break
    return c, values


def least(risk: np.ndarray, allowed: np.ndarray, keep: int = 2) -> np.ndarray:
    """Places of the few allowed candidates of least risk, equal ones by place."""
    places = np.flatnonzero(allowed)
    return places[np.lexsort((places, np.round(risk[places], 12)))[:keep]]
