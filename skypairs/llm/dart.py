"""DartMinHash signatures of weighted sets.

Each element owns a strip of the plane: weight upwards, rank to the right. Hashing throws darts into the strip, one on
average in each unit square, the same ones wherever the element occurs. A set keeps the darts that lie below the
element's weight and left of a rank at which k ln k + 2 k darts are expected, so the work is that number plus the
weight of the set, whatever k is. A dart belongs to one of k coordinates; the earliest rank of a coordinate is its
value. Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from skypairs.llm.columns import ranges

_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """One row of k 64-bit values for each set. elements (hashes, distinct in a set) and positive weights stand set
    after set; sizes says how many each has, at least one."""
    sets = len(sizes)
    result = np.zeros((sets, k), np.uint64)
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(weights, starts) if sets else np.empty(0)
    reach = (k * math.log(k) + 2 * k) / total
    todo = np.arange(sets)
    while len(todo):
        at = ranges(starts[todo], sizes[todo])
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        columns = np.ceil(reach[todo]).astype(np.int64)[owner]
        squares = np.ceil(weights[at]).astype(np.int64) * columns
        cell = np.repeat(np.arange(len(at)), squares)
        number = ranges(np.zeros(len(at), np.int64), squares)
        up, right = number // columns[cell], number % columns[cell]
        name = mix(elements[at][cell] ^ mix(up.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                                            + right.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        darts = np.searchsorted(_POISSON, _unit(name), "right")
        dart = mix(np.repeat(name, darts) + ranges(np.ones(len(name), np.int64), darts).astype(np.uint64))
        square = np.repeat(np.arange(len(name)), darts)
        height = up[square] + _unit(mix(dart ^ np.uint64(1)))
        rank = right[square] + _unit(mix(dart ^ np.uint64(2)))
        whose = owner[cell[square]]
        inside = (height < weights[at][cell[square]]) & (rank < reach[todo][whose])
        dart, rank, whose = dart[inside], rank[inside], whose[inside]
        slot = whose * k + (mix(dart ^ np.uint64(3)) % np.uint64(k)).astype(np.int64)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, slot, rank)
        best = rank == first[slot]
        values = np.zeros(len(todo) * k, np.uint64)
        values[slot[best]] = dart[best]
        full = np.isfinite(first).reshape(-1, k).all(axis=1)
        result[todo[full]] = values.reshape(-1, k)[full]
        todo = todo[~full]
        reach[todo] *= 2
    return result
