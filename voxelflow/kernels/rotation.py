"""Rotations in numpy."""

from __future__ import annotations

import numpy as np


def hat(v: np.ndarray) -> np.ndarray:
    x, y, z = v
    return np.array([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])


def exp(w: np.ndarray, cutoff: float = 1e-9) -> np.ndarray:
    """The rotation by w; the identity where its length is under the cutoff."""
    angle = float(np.linalg.norm(w))
    if angle < cutoff:
        return np.eye(3)
    k = hat(np.asarray(w) / angle)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def exp_rate(rate: np.ndarray, dt: float) -> np.ndarray:
    """The turn at a rate for a time; the cut-off is on the rate, not on the angle."""
    return exp(np.asarray(rate) * dt, 0.0 if np.linalg.norm(rate) > 1e-7 and dt else np.inf)


def log(r: np.ndarray) -> np.ndarray:
    """The rotation vector: half the skew part near the identity; undefined at half a turn."""
    angle = 0.0 if np.trace(r) > 3 - 1e-6 else float(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))
    skew = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return 0.5 * skew if angle < 1e-3 else 0.5 * angle / np.sin(angle) * skew


def right_jacobian(w: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(w))
    if angle < 1e-9:
        return np.eye(3)
    a = np.asarray(w) / angle
    s = np.sin(angle) / angle
    return s * np.eye(3) + (1 - s) * np.outer(a, a) - (1 - np.cos(angle)) / angle * hat(a)


def right_jacobian_inverse(r: np.ndarray) -> np.ndarray:
    w = log(r)
    angle = float(np.linalg.norm(w))
    if angle < 1e-9:
        return np.eye(3)
    a, c = w / angle, angle / 2 / np.tan(angle / 2)
    return c * np.eye(3) + (1 - c) * np.outer(a, a) + angle / 2 * hat(a)
