"""Temporal basis functions of the haemodynamic response, as small (time, component, value) arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def component_names(n: int, prefix: str = "") -> list[str]:
    width = len(str(max(n - 1, 1)))
    return [f"{prefix}{i:0{width}d}" for i in range(n)]


@dataclass(frozen=True)
class GaussianKernels:
    t_pre: float
    t_post: float
    t_delta: float
    t_std: float
    tails: bool = False

    def __call__(self, fs: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        t = np.arange(-(math.ceil(round(self.t_pre * fs, 9)) + 1), math.ceil(round(self.t_post * fs, 9)) + 2) / fs
        span = self.t_pre + self.t_post
        n = math.floor(round(((span - 6 * self.t_std) if self.tails else span) / self.t_delta, 9))
        first = -self.t_pre + (3 * self.t_std if self.tails else 0.0)
        out = {}
        for k, name in enumerate(component_names(n, "g")):
            g = np.exp(-0.5 * ((t - first - k * self.t_delta) / self.t_std) ** 2)
            out[name] = g / g.max()
        return t, out


@dataclass(frozen=True)
class Gamma:
    tau: float
    sigma: float
    duration: float = 0.0
    derivative: bool = False

    def __call__(self, fs: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        t = np.arange(0, math.ceil((4.1 * self.sigma + self.tau + self.duration) * fs)) / fs
        x = np.where(t >= self.tau, (t - self.tau) / self.sigma, 0.0)
        out = {"gamma": x**2 * np.exp(-(x**2))}
        if self.derivative:
            out["gamma_deriv"] = 2 * x * (1 - x**2) * np.exp(-(x**2))
        n = int(self.duration * fs)
        if n > 1:
            out = {k: np.convolve(v, np.full(n, 1 / n))[: len(t)] for k, v in out.items()}
        return t, {k: v / np.abs(v).max() for k, v in out.items()}


@dataclass(frozen=True)
class AFNIGamma:
    p: float
    q: float
    duration: float = 0.0

    def __call__(self, fs: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        t = np.arange(0, math.ceil((self.p * self.q + 8 * self.q * math.sqrt(self.p) + self.duration) * fs)) / fs
        v = (t / (self.p * self.q)) ** self.p * np.exp(self.p - t / self.q)
        n = int(self.duration * fs)
        v = np.convolve(v, np.full(n, 1 / n))[: len(t)] if n > 1 else v
        return t, {"gamma": v / v.max()}


@dataclass(frozen=True)
class DiracDelta:
    def __call__(self, fs: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return np.zeros(1), {"dirac": np.ones(1)}


def tapered(n: int, share: float) -> np.ndarray:
    """A window of ones with cosine flanks that take the share of its n points."""
    flank = share * (n - 1) / 2
    if n < 2 or flank <= 0:
        return np.ones(n)
    i = np.arange(n)
    edge = np.minimum(np.minimum(i, n - 1 - i) / flank, 1.0)
    return 0.5 * (1 - np.cos(np.pi * edge))


@dataclass(frozen=True)
class RandomGaussianSum:
    """One response: Gaussians of random weights, spread most in the middle, tapered, with its peak at 1."""

    t_start: float
    t_end: float
    t_delta: float
    t_std: float
    weight_std_max: float = 0.5
    weight_std_min: float = 0.05
    weight_mean: float = 0.7
    seed: int | None = None

    def __call__(self, fs: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        first, last = self.t_start + 2 * self.t_std, self.t_end - 2 * self.t_std
        t = np.arange(math.floor(round((first - 3 * self.t_std) * fs, 9)), math.ceil(round((last + 3 * self.t_std) * fs, 9)) + 1) / fs
        centres = first + self.t_delta * np.arange(max(1, math.floor(round((last - first) / self.t_delta, 9))))
        middle = np.exp(-(((centres - (first + last) / 2) / ((last - first) / 2.5)) ** 2))
        weights = np.random.default_rng(self.seed).normal(self.weight_mean, self.weight_std_min + (self.weight_std_max - self.weight_std_min) * middle)
        hrf = (np.exp(-(((t[:, None] - centres) / self.t_std) ** 2)) @ weights) * tapered(len(t), 0.1)
        return t, {"random_gaussian_sum": hrf / hrf.max()}


def normal_hrf(t: np.ndarray, t_peak: float, t_std: float, vmax: float) -> np.ndarray:
    g = np.exp(-0.5 * ((t - t_peak) / t_std) ** 2)
    return g / g.max() * vmax
