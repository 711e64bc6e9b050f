"""One-dimensional kernels of level transfer and interpolation."""

from __future__ import annotations

from fractions import Fraction


def lagrange(points: list[Fraction], target: Fraction) -> list[Fraction]:
    """Weights of the polynomial through the points, at the target."""
    out = []
    for i, p in enumerate(points):
        w = Fraction(1)
        for j, q in enumerate(points):
            if i != j:
                w *= (target - q) / (p - q)
        out.append(w)
    return out


def vertex(order: int) -> list[tuple[int, float]]:
    """(offset, weight) of coarse points for the odd fine point between coarse 0 and 1; odd orders."""
    n = order + 1
    offsets = list(range(1 - n // 2, n // 2 + 1))
    return list(zip(offsets, map(float, lagrange([Fraction(o) for o in offsets], Fraction(1, 2))), strict=True))


def cell(order: int, parity: int) -> list[tuple[int, float]]:
    """(offset, weight) of coarse cells for the fine cell of that parity inside coarse cell 0."""
    n = order + 1
    first = -(n // 2) + (parity if order % 2 else 0)
    offsets = list(range(first, first + n))
    return list(zip(offsets, map(float, lagrange([Fraction(2 * o + 1, 2) for o in offsets], Fraction(1 + 2 * parity, 4))), strict=True))


def cell_at(offsets: tuple[int, ...], parity: int) -> list[tuple[int, float]]:
    """(offset, weight) of the given coarse cells for the fine cell of that parity inside coarse cell 0."""
    return list(zip(offsets, map(float, lagrange([Fraction(2 * o + 1, 2) for o in offsets], Fraction(1 + 2 * parity, 4))), strict=True))


def time_weights(times: list[float], t: float) -> list[float]:
    """Lagrange weights over time levels; coinciding levels and extrapolation are errors."""
    scale = max(abs(x) for x in times) or 1.0
    for i, a in enumerate(times):
        if any(abs(a - b) <= 1e-12 * scale for b in times[:i]):
            raise ValueError("time levels coincide")
    if not min(times) - 1e-12 * scale <= t <= max(times) + 1e-12 * scale:
        raise ValueError("extrapolation in time")
    return [float(w) for w in lagrange([Fraction(x) for x in times], Fraction(t))]


def derivative_weights(times: list[float], t: float, order: int) -> list[float]:
    """Weights of the first or second time derivative of the polynomial through two or three levels."""
    n = len(times)
    if order == 0:
        return [float(w) for w in lagrange([Fraction(x) for x in times], Fraction(t))]
    if (order, n) not in ((1, 2), (1, 3), (2, 3)):
        raise ValueError("needs two or three levels for the first, three for the second derivative")
    out = []
    for i, a in enumerate(times):
        rest = [b for j, b in enumerate(times) if j != i]
        scale = 1.0
        for b in rest:
            scale *= a - b
        out.append((1.0 if n == 2 else 2 * t - sum(rest)) / scale if order == 1 else 2.0 / scale)
    return out
