"""Cutting stock by column generation: a linear program over patterns of lengths, priced by a knapsack, and whole patterns from it.

Its size is bounded by the capacity alone: at most one row for each length, however many pieces there are.
"""

from __future__ import annotations

import numpy as np

#: What a sequence costs besides its tokens, so that few long sequences are better than many short ones.
FEE = 8.0
#: Patterns taken from one knapsack; the program ends within GAP of its bound or after MOST exchanges of patterns.
LOT, GAP, MOST = 64, 2e-3, 1_500
_TINY = 1e-9

Pattern = tuple[tuple[int, int], ...]


def costs(capacity: int) -> np.ndarray:
    """What a sequence of each length costs: itself at a power of two, else the capacity it is padded to."""
    size = np.arange(capacity + 1)
    return np.where((size > 0) & (size & (size - 1) == 0), size, capacity) + FEE


class Program:
    """min cost of x patterns with as many of each length in them as demanded, or more; a revised simplex that holds the inverse of its basis."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.lengths, self.capacity, self.cost = lengths, capacity, costs(capacity)
        m = len(lengths)
        # Equal steps are told apart, so that no exchange is made twice.
        self.demand = demand.astype(float) * (1 + 1e-7 * np.random.default_rng(1).random(m))
        each = capacity // lengths
        self.basis: list[tuple[np.ndarray, np.ndarray]] = [(np.array([i]), np.array([float(n)])) for i, n in enumerate(each)]
        self.price = self.cost[each * lengths].copy()
        self.inverse = np.diag(1.0 / each)
        self.x = self.demand / each
        self.y = self.price / each
        self.rounds = 0

    def knapsack(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each size the largest worth of lengths that fill it exactly, and the last of them."""
        worth = np.full(self.capacity + 1, -np.inf)
        worth[self.lengths] = y
        best, last = np.full(self.capacity + 1, -np.inf), np.zeros(self.capacity + 1, int)
        best[0], tail = 0.0, worth[1:]
        for size in range(1, self.capacity + 1):
            sums = best[size - 1 :: -1] + tail[:size] if size > 1 else best[:1] + tail[:1]
            i = int(sums.argmax())
            best[size], last[size] = sums[i], i + 1
        return best, last

    def column(self, size: int, last: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        parts, total = [first] if first else [], size + first
        while size:
            parts.append(int(last[size]))
            size -= parts[-1]
        found, n = np.unique(parts, return_counts=True)
        return np.searchsorted(self.lengths, found), n.astype(float), total

    def enter(self, at: np.ndarray, n: np.ndarray, cost: float) -> bool:
        """Puts a pattern into the basis if it still pays."""
        gain = float(self.y[at] @ n) - cost
        if gain < 1e-7 * max(cost, 1.0):
            return False
        step = self.inverse[:, at] @ n
        up = np.flatnonzero(step > _TINY)
        if not len(up):
            return False
        ratio = self.x[up] / step[up]
        r = int(up[ratio.argmin()])
        move = float(ratio.min())
        self.x -= move * step
        self.x[r] = move
        np.maximum(self.x, 0, out=self.x)
        row = self.inverse[r] / step[r]
        cols, rest = np.flatnonzero(row), np.flatnonzero(np.abs(step) > 1e-12)
        rest = rest[rest != r]
        if len(rest) * len(cols) < row.size**2 // 8:
            self.inverse[np.ix_(rest, cols)] -= np.outer(step[rest], row[cols])
        else:
            self.inverse[rest] -= np.outer(step[rest], row)
        self.inverse[r] = row
        self.y -= gain * row
        self.basis[r], self.price[r] = (at, n), cost
        return True

    def solve(self) -> int:
        """Exchanges patterns until the bound is near; the number of exchanges.

        Patterns are priced half way and more towards the best prices known to be sound (at first those of sequences without padding),
        as the simplex's own prices swing widely.
        """
        done, sound, pull = 0, self.lengths * (self.capacity + FEE) / self.capacity, 0.9
        sound = sound / max(1.0, self._ratio(self.knapsack(sound)[0]).max())
        while done < MOST:
            y = pull * sound + (1 - pull) * self.y
            best, last = self.knapsack(y)
            ratio = self._ratio(best)
            fair = y / max(1.0, float(ratio.max()))
            if fair @ self.demand > sound @ self.demand:
                sound = fair
            value = float(self.price @ self.x)
            if value - float(sound @ self.demand) <= GAP * value:
                break
            # The best pattern of each size that pays, and the best full one with each of the lengths.
            tries = {(int(size), 0): best[size] - self.cost[size] for size in np.flatnonzero(ratio > 1)}
            rest = self.capacity - self.lengths
            full = y + best[rest] - self.cost[self.capacity]
            tries |= {(int(rest[i]), int(self.lengths[i])): full[i] for i in np.flatnonzero(np.isfinite(full))}
            before = done
            for i in np.argsort(self.y)[:LOT]:  # more than demanded of a length costs nothing
                done += self.enter(np.array([i]), np.array([-1.0]), 0.0)
            for (size, first), _ in sorted(tries.items(), key=lambda t: -t[1])[:LOT]:
                at, n, total = self.column(size, last, first)
                done += self.enter(at, n, float(self.cost[total]))
            self.rounds += 1
            if done == before:
                if pull < 0.01:
                    break
                pull /= 2
        return done

    def _ratio(self, best: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(best), best, 0) / self.cost

    def patterns(self) -> list[tuple[Pattern, float]]:
        """Patterns of the basis and how often each is used; one count below 0 is what is made beyond the demand."""
        return [(tuple((int(self.lengths[i]), int(k)) for i, k in zip(at, n, strict=True)), float(x)) for (at, n), x in zip(self.basis, self.x, strict=True)]


def _exact(left: dict[int, int], first: int, capacity: int) -> Pattern | None:
    """Lengths among those left, ``first`` being one, that fill the capacity exactly: sums as bits of whole numbers, long lengths before short ones."""
    want, mask = capacity - first, (1 << (capacity + 1)) - 1
    sums, trail = 1, []
    for size in sorted(left, reverse=True):
        for _ in range(min(left[size] - (size == first), want // size)):
            grown = (sums | sums << size) & mask
            if grown == sums:
                break
            trail.append((size, sums))
            sums = grown
            if sums >> want & 1:
                break
        if sums >> want & 1:
            break
    if not sums >> want & 1:
        return None
    found = {first: 1}
    for size, before in reversed(trail):
        if not before >> want & 1:
            found[size] = found.get(size, 0) + 1
            want -= size
    return tuple(sorted(found.items()))


def _greedy(left: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns that fill a sequence exactly, from the longest length on, as often as pieces last; and what is in none. Empties ``left``."""
    found, loose = [], {}
    for size in sorted(left, reverse=True):
        while left[size]:
            pattern = _exact({s: n for s, n in left.items() if n}, size, capacity) or (((size, 1),) if not size & (size - 1) else None)
            n = min(left[s] // k for s, k in pattern) if pattern else left[size]
            if pattern:
                found.append((pattern, n))
            else:
                loose[size] = n
            for s, k in pattern or ((size, 1),):
                left[s] -= n * k
    return found, loose


def cut(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns without padding and how often each is used, and the number of pieces of each length that are in none.

    ``histogram`` has the number of pieces of each length below ``capacity``. The linear program's patterns are used as
    often as it says, rounded down; then once more, those with the largest fractions first, while pieces last; and
    what is left is put together length by length from the longest on, as far as it fills sequences exactly.
    """
    left = {size: n for size, n in histogram.items() if n}
    if not left:
        return [], {}
    lengths = np.array(sorted(left))
    program = Program(lengths, np.array([left[int(s)] for s in lengths]), capacity)
    for pattern, _ in _greedy(dict(left), capacity)[0]:
        at, n = np.array(pattern).T
        program.enter(np.searchsorted(lengths, at), n.astype(float), float(program.cost[capacity if at @ n == capacity else at @ n]))
    program.solve()
    used: dict[Pattern, int] = {}

    def take(pattern: Pattern, n: int) -> None:
        n = min(n, *(left[size] // k for size, k in pattern))
        if n > 0:
            used[pattern] = used.get(pattern, 0) + n
            for size, k in pattern:
                left[size] -= n * k

    tight = [(p, x) for p, x in program.patterns() if p[0][1] > 0 and ((total := sum(s * k for s, k in p)) == capacity or not total & (total - 1))]
    for pattern, x in tight:
        take(pattern, int(x + 1e-6))
    for pattern, _ in sorted(tight, key=lambda t: (-(t[1] % 1), t[0])):
        take(pattern, 1)
    more, loose = _greedy(left, capacity)
    for pattern, n in more:
        used[pattern] = used.get(pattern, 0) + n
    return sorted(used.items()), loose
