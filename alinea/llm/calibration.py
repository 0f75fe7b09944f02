"""Inclusion probabilities with given category totals: exponential tilting, found by Newton steps on the dual.

Rows enter by their cell only (the combination of categories that they fall in), so the moments of the dual are sums
over cells weighted by their counted rows. For constraints x and totals t the tilted probabilities are
``p = d * exp(lambda . x)``, and the dual's gradient is ``sum N p x - t``, its Hessian ``sum N p x x'``.
"""

from __future__ import annotations

import numpy as np


def floored_totals(shares: np.ndarray, floors: np.ndarray, total: float) -> np.ndarray:
    """Totals in proportion to ``shares``, none below its floor; what floors take is taken from the others alike.

    Shares that add up to less than 1 leave the rest of ``total`` unassigned. Floors that exceed the total are kept.
    """
    out = np.maximum(shares * total, floors)
    budget = max(shares.sum() * total, min(floors.sum(), total))
    held = np.zeros(len(shares), bool)
    while out.sum() > budget + 1e-9 and not held.all():
        held |= out <= floors + 1e-12
        free = ~held
        if not free.any() or not shares[free].sum():
            break
        out[free] = np.maximum(shares[free] / shares[free].sum() * max(0.0, budget - out[held].sum()), floors[free])
    return out


def tilt(rows: np.ndarray, x: np.ndarray, totals: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, bool]:
    """The probability of each cell: ``rows`` (cells), ``x`` (cells, constraints; 0 or 1), ``totals`` (constraints).

    Probabilities that would exceed 1 are set to 1 and the others tilted for what is left. Constraints without rows are
    ignored; totals above their rows are cut to them. Totals that contradict each other are met as nearly as the last step
    does. Returned with it: whether all totals, cut to their rows, are met to a hundredth of a row.
    """
    cells, n = x.shape
    p = np.zeros(cells)
    reach = np.minimum(totals, rows @ x)

    def met() -> tuple[np.ndarray, bool]:
        return p, not n or bool((np.abs((rows * p) @ x - reach) < 0.01).all())

    fixed = (rows == 0) | ((x[:, reach <= tolerance] > 0).any(axis=1) if n else False)  # a total of 0 leaves its rows out
    while True:
        free = ~fixed
        if not free.any() or not n:
            return met()
        left = reach - (rows * p)[fixed] @ x[fixed]
        use = (rows[free] @ x[free] > 0) & (left > tolerance)
        if not use.any():
            return met()
        a, m = x[free][:, use], rows[free]
        d = min(1.0, max(left[use].max() / m.sum(), 1e-12))
        goal, lam = left[use], np.zeros(use.sum())

        def dual(v):
            return (m * d * np.exp(np.clip(a @ v, -700, 50))).sum() - goal @ v

        for _ in range(steps):
            q = m * d * np.exp(np.clip(a @ lam, -700, 50))
            gradient = q @ a - goal
            if np.abs(gradient).max() <= tolerance * max(1.0, goal.max()):
                break
            hessian = (a * q[:, None]).T @ a
            move = np.linalg.lstsq(hessian + 1e-12 * np.eye(len(lam)), gradient, rcond=None)[0]
            size, now = 1.0, dual(lam)
            while size > 1e-6 and dual(lam - size * move) > now - 1e-4 * size * (gradient @ move):
                size /= 2
            lam = lam - size * move
        q = d * np.exp(np.clip(a @ lam, -700, 50))
        over = q > 1 + 1e-12
        at = np.flatnonzero(free)
        if not over.any():
            p[at] = np.minimum(q, 1)
            return met()
        p[at[over]] = 1.0
        fixed[at[over]] = True
