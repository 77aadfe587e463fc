"""The iterated filter that joins a propagated state with matches against a map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np

from .inertial import DIM, State

#: Equations of one matching: H = sum w j j^T (6 x 6), g = -sum w j r, and the scatter of the matched normals.
Match = Callable[[State], tuple[np.ndarray, np.ndarray, np.ndarray]]


def iterate(prior: State, match: Match, max_iter: int = 4, prior_scale: float = 1.0, least_scatter: float = 14.0) -> tuple[State, bool, int]:
    """The updated state, whether the normals fix the pose, and the iterations used.

    Each iteration matches anew. It has converged under 0.01 degrees and 0.015 cm; one more round follows, and the round
    before the last counts as converged once. A step that isn't finite leaves the prior as it was.
    """
    x, again, scatter = prior, 0, np.zeros((3, 3))
    weight = np.linalg.inv(prior.cov) * prior_scale
    for k in range(max_iter):
        h6, g6, scatter = match(x)
        h = np.zeros((DIM, DIM))
        h[:6, :6] = h6
        gain = np.linalg.inv(h + weight)
        back = prior.minus(x)
        kept = gain[:, :6] @ h6
        move = gain[:, :6] @ g6 + back - kept @ back[:6]
        if not np.isfinite(move).all():
            return prior, False, k + 1
        x = x.plus(move)
        done = np.degrees(np.linalg.norm(move[:3])) < 0.01 and 100 * np.linalg.norm(move[3:6]) < 0.015
        if done or (again == 0 and k == max_iter - 2):
            again += 1
        if again >= 2 or k == max_iter - 1:
            full = np.zeros((DIM, DIM))
            full[:, :6] = kept
            x = replace(x, cov=(np.eye(DIM) - full) @ prior.cov)
            break
    return x, bool(np.linalg.eigvalsh(scatter)[0] >= least_scatter), k + 1
