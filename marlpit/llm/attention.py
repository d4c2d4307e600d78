"""A causal self-attention language model in numpy, forwards and backwards.

Every position has two ids. Their learned vectors add up to its input; one head
attends over the window's earlier positions and itself, with a learned bias for
each distance; a hidden layer reads the input and what was attended to, and a
softmax over frequent ids and classes of the others, with a second one inside the
class, gives the next id. Windows are batched and masked; nothing loops over
positions.

All weights are trained by Adam on the negative log-likelihood. The same class
serves sequences of words and the pieces inside a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

#: Ids are buckets in order of frequency: MEMBERS that stand alone, then CLASSES classes of MEMBERS each.
CLASSES, MEMBERS = 31, 32
BUCKETS = MEMBERS + CLASSES * MEMBERS
#: The input that stands before the first id of a sequence.
START = BUCKETS
WIDTH, HEAD, HIDDEN = 24, 12, 24
#: Windows that are looked at together when they are scored.
LOOKED = 128
#: Scores are held within this bound before they are exponentiated.
BOUND = np.float32(30)


def keep_memory() -> None:
    """Let this process keep the memory of freed arrays; else the kernel clears new pages for every batch."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 256 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 512 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # not glibc: slower, else the same
        pass


def initial(window: int, popularity: np.ndarray) -> dict[str, np.ndarray]:
    """Weights before training; popularity: the probability of each bucket, from which the outputs start."""
    rng = np.random.default_rng(7)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    share = np.maximum(popularity, 1e-9)
    inside = share[MEMBERS:].reshape(CLASSES, MEMBERS)
    return {
        "one": normal(BUCKETS + 1, WIDTH, scale=0.3),
        "two": normal(BUCKETS + 1, WIDTH, scale=0.3),
        "query": normal(WIDTH, HEAD, scale=WIDTH**-0.5),
        "key": normal(WIDTH, HEAD, scale=WIDTH**-0.5),
        "distance": np.zeros(window, np.float32),
        "read": normal(2 * WIDTH, HIDDEN, scale=WIDTH**-0.5),
        "hidden": np.zeros(HIDDEN, np.float32),
        "class": normal(HIDDEN, MEMBERS + CLASSES, scale=0.05),
        "class_bias": np.log(np.concatenate([share[:MEMBERS], inside.sum(axis=1)])).astype(np.float32),
        "member": normal(CLASSES, HIDDEN, MEMBERS, scale=0.05),
        "member_bias": np.log(inside / inside.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def exponentials(scores: np.ndarray) -> np.ndarray:
    """Exponentiate scores in place; the reciprocal of each row's sum, with which a row is a softmax."""
    np.clip(scores, -BOUND, BOUND, out=scores)
    np.exp(scores, out=scores)
    return np.float32(1) / (scores @ np.ones(scores.shape[-1], np.float32))


def with_ones(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows in that order, each with a one at its end."""
    out = np.ones((len(rows), rows.shape[1] + 1), rows.dtype)
    out[:, :-1] = rows.take(order, axis=0)
    return out


def summed_by(ids: np.ndarray, columns: np.ndarray, many: int) -> np.ndarray:
    """The sum of the rows of each id; columns: of the rows, each laid out by itself."""
    at = ids.astype(np.intp)
    return np.stack([np.bincount(at, c, many) for c in columns], axis=1).astype(np.float32)


class Attention:
    """reach: how far back a position sees; with a reach of no more than a window's lead it does not matter where windows begin."""

    def __init__(self, window: int, weights: dict[str, np.ndarray], reach: int | None = None):
        self.window, self.weights = window, weights
        back = np.arange(window)[:, None] - np.arange(window)
        self.causal = ((back >= 0) & (back <= (window if reach is None else reach))).astype(np.float32)
        self.back, self.ones = np.maximum(back, 0), np.ones(window, np.float32)

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id's vectors (one and two) times all that `look` multiplies inputs by: query, key, what is read of the position itself and of what it sees."""
        w = self.weights
        by = np.concatenate([w["query"] * np.float32(HEAD**-0.5), w["key"], w["read"][:WIDTH], w["read"][WIDTH:]], axis=1)
        one, two = w["one"] @ by, w["two"] @ by
        one[:, 2 * HEAD : 2 * HEAD + HIDDEN] += w["hidden"]
        return one, two

    def attended(self, query: np.ndarray, key: np.ndarray, group: np.ndarray | None, first: int) -> np.ndarray:
        """How much each position from `first` on sees of each position of its window, adding up to one."""
        share = query @ key.transpose(0, 2, 1)
        share += self.weights["distance"][self.back[first:]]
        np.clip(share, -BOUND, BOUND, out=share)
        np.exp(share, out=share)
        share *= self.causal[first:]
        # Most windows lie in one sequence.
        if group is not None and len(mixed := np.flatnonzero((group != group[:, -1:]).any(axis=1))):
            share[mixed] *= group[mixed, first:, None] == group[mixed, None, :]
        flat = share.reshape(-1, self.window)
        flat *= (np.float32(1) / (flat @ self.ones))[:, None]
        return share

    def look(self, one: np.ndarray, two: np.ndarray, group: np.ndarray | None, first: int = 0, known: tuple[np.ndarray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """What positions from `first` on make of windows (ids one and two; group: the sequence that each position belongs to, beyond which it sees nothing; None: one to a window).

        known: the products of all ids, from which only "hidden" is made.
        """
        w = self.weights
        if known is not None:
            flat = known[0].take(one.ravel(), axis=0)
            flat += known[1].take(two.ravel(), axis=0)
            query, key, own, value = np.split(flat.reshape(*one.shape, -1), [HEAD, 2 * HEAD, 2 * HEAD + HIDDEN], axis=2)
            hidden = self.attended(query[:, first:], key, group, first) @ value
            hidden += own[:, first:]
            return {"hidden": np.maximum(hidden, np.float32(0), out=hidden).reshape(-1, HIDDEN)}
        flat = w["one"].take(one.ravel(), axis=0)
        flat += w["two"].take(two.ravel(), axis=0)
        x = flat.reshape(*one.shape, WIDTH)
        own = x[:, first:].reshape(-1, WIDTH)
        query = (own @ (w["query"] * np.float32(HEAD**-0.5))).reshape(len(one), -1, HEAD)
        key = (flat @ w["key"]).reshape(*one.shape, HEAD)
        share = self.attended(query, key, group, first)
        seen = (share @ x).reshape(-1, WIDTH)
        hidden = own @ w["read"][:WIDTH]
        hidden += seen @ w["read"][WIDTH:]
        hidden += w["hidden"]
        np.maximum(hidden, np.float32(0), out=hidden)
        return {"x": x, "query": query, "key": key, "share": share, "seen": seen, "hidden": hidden}

    def shares(self, hidden: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...], list[tuple[int, slice]]]:
        """(probability of each goal; of the first softmax and of the one inside classes: exponentials, what makes shares of them, which of them each goal has; class and its positions), in ascending order of goals.

        The last column of hidden is one, so that biases are a row of the weights. Positions of classes count from the first that has one.
        """
        w = self.weights
        kind = np.where(goal < MEMBERS, goal, goal // MEMBERS + (MEMBERS - 1))
        top = hidden @ np.concatenate([w["class"], w["class_bias"][None]])
        outer = exponentials(top)
        p = top[np.arange(len(goal)), kind] * outer
        ends = np.searchsorted(goal, np.arange(1, CLASSES + 2) * MEMBERS)
        rest = hidden[ends[0] :]
        ends = (ends - ends[0]).tolist()
        parts = [(c, slice(start, stop)) for c, (start, stop) in enumerate(zip(ends[:-1], ends[1:])) if start < stop]
        members, inside = np.concatenate([w["member"], w["member_bias"][:, None]], axis=1), np.empty((len(rest), MEMBERS), top.dtype)
        for c, here in parts:
            np.matmul(rest[here], members[c], out=inside[here])
        inner, member = exponentials(inside), goal[len(goal) - len(rest) :] % MEMBERS
        p[len(goal) - len(rest) :] *= inside[np.arange(len(rest)), member] * inner
        return p, (top, outer, kind), (inside, inner, member), parts

    def log_probability(self, one: np.ndarray, two: np.ndarray, group: np.ndarray | None, target: np.ndarray, first: int = 0, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The natural logarithm of the probability of each target, shaped as target, which has the positions from `first` on. known: `products()`, made once for many calls."""
        known = known or self.products()
        goal = target.ravel()
        order = np.argsort(goal.astype(np.int16), kind="stable")
        # Fewer windows at a time than goals, so that what is made of them stays in a core's cache.
        cuts = range(0, len(one), LOOKED)
        hidden = np.concatenate([self.look(one[k : k + LOOKED], two[k : k + LOOKED], None if group is None else group[k : k + LOOKED], first, known)["hidden"] for k in cuts])
        out = np.empty(len(goal))
        out[order] = np.log(np.maximum(self.shares(with_ones(hidden, order), goal[order])[0], 1e-30))
        return out.reshape(target.shape)

    def slopes(self, one: np.ndarray, two: np.ndarray, group: np.ndarray | None, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, its gradient) over windows; weight: of each position, adding up to one."""
        w, f, goal = self.weights, self.look(one, two, group), target.ravel()
        x, share = f["x"], f["share"]
        flat = x.reshape(-1, WIDTH)
        order = np.argsort(goal.astype(np.int16), kind="stable")
        goal, hidden, weight = goal[order], with_ones(f["hidden"], order), weight.ravel()[order].astype(np.float32)
        rows = np.arange(len(goal))
        p, (top, outer, kind), (inside, inner, member), parts = self.shares(hidden, goal)
        # Weights, and what makes shares of exponentials, scale the narrow side of each product; sums over positions are products too.
        top[rows, kind] -= np.float32(1) / outer
        outer *= weight
        down = top @ w["class"].T
        down *= outer[:, None]
        slope = (top.T @ (hidden * outer[:, None])).T
        out = {"class": slope[:-1], "class_bias": slope[-1]}
        start = len(goal) - len(inside)
        inside[rows[: len(inside)], member] -= np.float32(1) / inner
        inner *= weight[start:]
        heavy, below, slope = (hidden[start:] * inner[:, None]).T, np.empty((len(inside), HIDDEN), top.dtype), np.zeros((CLASSES, HIDDEN + 1, MEMBERS), top.dtype)
        for c, here in parts:
            np.matmul(heavy[:, here], inside[here], out=slope[c])
            np.matmul(inside[here], w["member"][c].T, out=below[here])
        out |= {"member": slope[:, :-1], "member_bias": slope[:, -1]}
        below *= inner[:, None]
        down[start:] += below
        down *= hidden[:, :-1] > 0
        back = np.empty_like(order)
        back[order] = rows
        down = down.take(back, axis=0)
        dseen = (down @ w["read"][WIDTH:].T).reshape(x.shape)
        dx = (share.transpose(0, 2, 1) @ dseen).reshape(-1, WIDTH)
        slope = dseen @ x.transpose(0, 2, 1)
        slope -= np.einsum("bij,bij->bi", slope, share)[:, :, None]
        slope *= share
        out["distance"] = np.bincount(self.back.ravel(), slope.sum(axis=0).ravel(), self.window).astype(np.float32)
        dquery = (slope @ f["key"]).reshape(-1, HEAD) * np.float32(HEAD**-0.5)
        dkey = (slope.transpose(0, 2, 1) @ f["query"]).reshape(-1, HEAD)
        # All that multiplies inputs goes back in one product.
        every = np.concatenate([down, dquery, dkey], axis=1)
        dx += every @ np.concatenate([w["read"][:WIDTH], w["query"], w["key"]], axis=1).T
        read, out["query"], out["key"] = np.split(flat.T @ every, [HIDDEN, HIDDEN + HEAD], axis=1)
        out |= {"read": np.concatenate([read, f["seen"].T @ down]), "hidden": np.ones(len(down), down.dtype) @ down}
        columns = np.ascontiguousarray(dx.T, dtype=np.float64)
        out |= {"one": summed_by(one.ravel(), columns, BUCKETS + 1), "two": summed_by(two.ravel(), columns, BUCKETS + 1)}
        return float(-(np.log(np.maximum(p, 1e-30)) * weight).sum()), out


class Adam:
    """Steps of size `rate` at most, falling to a tenth over `steps`."""

    def __init__(self, model: Attention, rate: float, steps: int):
        self.model, self.rate, self.steps, self.done = model, rate, max(1, steps), 0
        # The weights, and all that goes with them, lie in one array each, which are worked on at once and in place.
        weights, ends = model.weights, np.cumsum([0, *(v.size for v in model.weights.values())])
        self.weights = np.concatenate([v.ravel() for v in weights.values()])
        self.slope, self.mean, self.square, self.spare = (np.zeros_like(self.weights) for _ in range(4))
        self.slopes = {}
        for (k, v), a, b in zip([*weights.items()], ends[:-1], ends[1:]):
            weights[k], self.slopes[k] = self.weights[a:b].reshape(v.shape), self.slope[a:b].reshape(v.shape)

    def step(self, *windows: np.ndarray) -> float:
        loss, slopes = self.model.slopes(*windows)
        for k, g in slopes.items():
            self.slopes[k][...] = g
        self.done += 1
        rate = self.rate * (1 - 0.9 * min(1.0, self.done / self.steps)) * np.sqrt(1 - 0.99**self.done) / (1 - 0.9**self.done)
        g, mean, square, spare = self.slope, self.mean, self.square, self.spare
        np.subtract(g, mean, out=spare)
        spare *= np.float32(0.1)
        mean += spare
        np.multiply(g, g, out=spare)
        spare -= square
        spare *= np.float32(0.01)
        square += spare
        np.sqrt(square, out=spare)
        spare += np.float32(1e-8)
        np.divide(mean, spare, out=spare)
        spare *= np.float32(rate)
        self.weights -= spare
        return loss


def windows_of(sizes: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, given) of windows over sequences laid end to end, a new one every `step` positions of a sequence.

    A window starts window - step positions early, and its last `step` positions
    are its own: each position is given by one window. With step = window all are.
    An index may lie outside the sequence.
    """
    ends, many = np.cumsum(sizes), -(-sizes // step)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    index = (np.repeat(ends - sizes, many) + nth * step - (window - step))[:, None] + np.arange(window)
    return index, (index < np.repeat(ends, many)[:, None]) & (np.arange(window) >= window - step)
