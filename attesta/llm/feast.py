"""Eigenpairs of a symmetric matrix inside an interval, by contour integration and Rayleigh-Ritz steps."""

from __future__ import annotations

import numpy as np

#: Quadrature points on the upper half of the contour, and rounds of subspace iteration.
POINTS, ROUNDS = 8, 60
#: Residual at which a pair is taken, and distance of eigenvalues that share a contour, both relative to the largest row sum.
PRECISION, TOGETHER = 2e-15, 1e-6


def below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below `shift`: negative pivots of a symmetric factorisation (Sylvester's law of inertia).

    Pivots of one or two rows, the largest that are left, keep the factors bounded.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio = (1 + np.sqrt(17)) / 8
    negative = 0

    def front(at: int, to: int) -> None:
        if at != to:
            a[[at, to]] = a[[to, at]]
            a[:, [at, to]] = a[:, [to, at]]

    i = 0
    while i < len(a):
        size = np.abs(a[i:, i:])
        d = int(size.diagonal().argmax())
        r, c = divmod(int(size.argmax()), len(size))
        if not size[r, c]:
            break  # what is left is zero
        if size[d, d] >= ratio * size[r, c]:
            front(i + d, i)
            negative += bool(a[i, i] < 0)
            side = a[i + 1 :, i].copy()
            a[i + 1 :, i + 1 :] -= np.outer(side, side / a[i, i])
            i += 1
        else:
            r, c = min(r, c), max(r, c)
            front(i + r, i)
            front(i + c, i + 1)
            negative += 1  # such a block has a pivot of either sign
            side = a[i + 2 :, i : i + 2].copy()
            a[i + 2 :, i + 2 :] -= side @ np.linalg.solve(a[i : i + 2, i : i + 2], side.T)
            i += 2
    return negative


def intervals(matrix: np.ndarray, count: int) -> list[tuple[float, float, int]]:
    """(low, high, number inside) of intervals, falling, that hold the `count` largest eigenvalues and what cannot be told from the last.

    Inertia counts place eigenvalues; those closer than TOGETHER share an interval. Each interval reaches halfway into
    the smaller of the gaps beside it, so that what is outside is far from its contour.
    """
    n = len(matrix)
    edge = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9) + 1e-300  # no eigenvalue is beyond the largest row sum
    near = TOGETHER * edge

    def place(k: int, high: float) -> float:
        """The k-th largest eigenvalue, from below, to a hundredth of `near`."""
        low = -edge
        while high - low > near / 100:
            middle = (low + high) / 2
            low, high = (middle, high) if n - below(matrix, middle) >= k else (low, middle)
        return low

    groups: list[list[float]] = []  # largest, least, number
    known, beneath = 0, -2 * edge
    while known < n:
        top = place(known + 1, groups[-1][1] if groups else edge)
        found = n - below(matrix, top - near)
        least = place(found, top + near / 50) if found > known + 1 else top
        if groups and groups[-1][1] - top <= near:
            groups[-1][1:] = [least, groups[-1][2] + found - known]
        elif known >= count:
            beneath = top
            break
        else:
            groups.append([top, least, found - known])
        known = found
    out = []
    for g, (top, least, inside) in enumerate(groups):
        above = groups[g - 1][1] if g else 2 * edge
        under = groups[g + 1][0] if g + 1 < len(groups) else beneath
        room = min(above - top, least - under) / 2
        out.append((least - room, top + room, int(inside)))
    return out


def projected(matrix: np.ndarray, low: float, high: float, vectors: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The part of `vectors` in the eigenspaces of [low, high]: the resolvent summed around the interval by Gauss quadrature.

    The lower half of the circle is the complex conjugate of the upper one.
    """
    nodes, weights = np.polynomial.legendre.leggauss(points)
    centre, radius = (low + high) / 2, (high - low) / 2
    total = np.zeros_like(vectors)
    for x, w in zip(nodes, weights):
        turn = np.exp(0.5j * np.pi * (1 - x))
        shifted = (centre + radius * turn) * np.eye(len(matrix)) - matrix
        total += w / 2 * radius * (turn * np.linalg.solve(shifted, vectors.astype(complex))).real
    return total


def eigenpairs(matrix: np.ndarray, low: float, high: float, expected: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of all eigenvalues in [low, high], falling. The inertia count says how many there must be.

    A subspace that misses some is widened with new directions and iterated again.
    """
    n = len(matrix)
    if n - below(matrix, low) - (n - below(matrix, high)) != expected:
        raise ArithmeticError(f"the interval [{low}, {high}] does not hold {expected} eigenvalues")
    generator = np.random.default_rng(0)
    size = min(n, expected + 2)
    basis = generator.standard_normal((n, size))
    floor = PRECISION * np.abs(matrix).sum(axis=1).max() * np.sqrt(n)
    for k in range(1, ROUNDS + 1):
        basis, _ = np.linalg.qr(projected(matrix, low, high, basis, points))
        small = basis.T @ matrix @ basis
        values, turned = np.linalg.eigh((small + small.T) / 2)
        basis = basis @ turned
        inside = (values >= low) & (values <= high)
        good = inside & (np.linalg.norm(matrix @ basis - basis * values, axis=0) <= floor)
        if k > 1 and inside.sum() == good.sum() == expected:
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], basis[:, inside][:, order]
        if k % 5 == 0 and size < n:
            size = min(n, size + max(4, expected))
            basis = np.hstack([basis, generator.standard_normal((n, size - basis.shape[1]))])
    raise ArithmeticError(f"{int(good.sum())} eigenvalues converged in [{low}, {high}], {expected} expected")


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors, in which the largest entry is positive."""
    count = min(count, len(matrix))
    scale = np.abs(matrix).max(initial=0)
    if not count or not scale:
        return np.zeros(count), np.eye(len(matrix))[:, :count]
    pairs = [eigenpairs(matrix / scale, *part) for part in intervals(matrix / scale, count)]
    values = np.concatenate([v for v, _ in pairs])[:count] * scale
    vectors, _ = np.linalg.qr(np.hstack([v for _, v in pairs]))
    vectors = vectors[:, :count]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(count)] < 0, -1.0, 1.0)
