"""Forward-backward over many sequences at once, in NumPy.

Sequences of up to WHOLE steps run through side by side, a vector each. Longer ones are cut into blocks of WIDTH steps. The
blocks' transfer matrices are multiplied up side by side, then vectors are passed from block to block, then all blocks run inside
by side: a piece with one very long text takes about as many NumPy calls as one of short texts. Nothing is approximated.
"""

from __future__ import annotations

import numpy as np

WIDTH = 32
#: A matrix costs as many times a vector as there are states; a step costs some NumPy calls.
WHOLE = 1024


class Layout:
    """Blocks of sequences with these lengths, the longest blocks first."""

    def __init__(self, lengths: np.ndarray, width: int = WIDTH):
        self.lengths = np.asarray(lengths, np.int64)
        self.off = np.r_[0, np.cumsum(self.lengths)]
        many = -(-self.lengths // width)
        seq = np.repeat(np.arange(len(many)), many)
        number = np.arange(len(seq)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(width, self.lengths[seq] - number * width)
        order = np.argsort(-size, kind="stable")
        self.start = (self.off[seq] + number * width)[order]
        self.seq = seq[order]
        sizes = size[order]
        width = int(sizes.max(initial=0))
        self.active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(width)]  # blocks longer than t
        self.width = width
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.cumsum(many) - many
        self.by_blocks = np.argsort(-many, kind="stable")
        ordered = many[self.by_blocks]
        # at[k]: (sequences with more than k blocks, their k-th blocks)
        self.at = []
        for k in range(int(many.max(initial=0))):
            alive = self.by_blocks[: int(np.searchsorted(-ordered, -k, "left"))]
            self.at.append((alive, place[first[alive] + k]))
        self.n_blocks = len(order)


def products(x: np.ndarray, step: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    s = len(step)
    out = np.repeat(np.eye(s)[None], lay.n_blocks, 0)
    logs = np.zeros(lay.n_blocks)
    for t in range(lay.width):
        a = lay.active[t]
        if not a:
            break
        out[:a] = (out[:a].reshape(-1, s) @ step).reshape(a, s, s) * x[lay.start[:a] + t][:, None, :]
        if t % 4 == 3 or t == lay.width - 1:
            top = out.max((1, 2))
            out /= top[:, None, None]
            logs += np.log(top)
    top = out.max((1, 2))
    return out / top[:, None, None], logs + np.log(top)


def forward(matrix: np.ndarray, logs: np.ndarray, start: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The state before each block, and each sequence's log likelihood."""
    state = np.repeat(start[None], len(lay.lengths), 0)
    total = np.zeros(len(lay.lengths))
    before = np.zeros((lay.n_blocks, len(start)))
    for alive, block in lay.at:
        before[block] = state[alive]
        new = np.matmul(state[alive][:, None, :], matrix[block])[:, 0]
        size = new.sum(1)
        state[alive] = new / size[:, None]
        total[alive] += np.log(size) + logs[block]
    return before, total


def backward(matrix: np.ndarray, s: int, lay: Layout) -> np.ndarray:
    """What each block's end is worth."""
    state = np.ones((len(lay.lengths), s))
    after = np.ones((lay.n_blocks, s))
    for alive, block in reversed(lay.at):
        after[block] = state[alive]
        new = np.matmul(matrix[block], state[alive][:, :, None])[:, :, 0]
        state[alive] = new / new.sum(1, keepdims=True)
    return after


def parts(lengths: np.ndarray):
    """(sequences, their steps, layout, whether they are cut) of the short sequences and of the long ones."""
    lengths = np.asarray(lengths, np.int64)
    long = lengths > WHOLE
    for which, width in ((~long, WHOLE), (long, WIDTH)):
        if which.any():
            yield np.flatnonzero(which), np.flatnonzero(np.repeat(which, lengths)), Layout(lengths[which], width), width == WIDTH


def by_time(lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps of all blocks, all first ones, then all second ones; each one's block; the edges of these runs."""
    many = np.array(lay.active[: lay.width], np.int64)
    edge = np.r_[0, np.cumsum(many)]
    block = np.arange(edge[-1]) - np.repeat(edge[:-1], many)
    return lay.start[block] + np.repeat(np.arange(len(many)), many), block, edge


def onward(x: np.ndarray, step: np.ndarray, before: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state before and after each step, in order of time, and what each step scales it by."""
    left, after, size, one = np.empty_like(x), np.empty_like(x), np.empty(len(x)), np.ones(len(step))
    for u, v in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        left[u:v] = before[: v - u]
        new = left[u:v] @ step
        new *= x[u:v]
        np.matmul(new, one, out=size[u:v])
        before = np.divide(new, size[u:v, None], out=after[u:v])
    return left, after, size


def log_likelihood(x: np.ndarray, step: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each sequence. x: likelihood of each step's symbol in each state."""
    out = np.zeros(len(lengths))
    for which, steps, lay, cut in parts(lengths):
        if cut:
            out[which] = forward(*products(x[steps], step, lay), start, lay)[1]
        else:
            place, block, edge = by_time(lay)
            size = onward(x[steps[place]], step, np.repeat(start[None], lay.n_blocks, 0), edge)[2]
            out[which] = np.bincount(lay.seq[block], np.log(size), len(which))
    return out


def posteriors(x: np.ndarray, step: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities of each step, expected transitions (the first from start), and log likelihoods."""
    s = len(step)
    gamma, moves, total, one = np.zeros_like(x), np.zeros_like(step), np.zeros(len(lengths)), np.ones(s)
    for which, steps, lay, cut in parts(lengths):
        if cut:
            matrix, logs = products(x[steps], step, lay)
            before, after = forward(matrix, logs, start, lay)[0], backward(matrix, s, lay)
        else:
            before, after = np.repeat(start[None], lay.n_blocks, 0), np.ones((lay.n_blocks, s))
        place, block, edge = by_time(lay)
        place = steps[place]
        y = x[place]
        left, alpha, size = onward(y, step, before, edge)
        # states before blocks add up to one, so that the blocks of a sequence add up to its likelihood
        total[which] = np.bincount(lay.seq[block], np.log(size), len(which))
        beta = np.empty_like(y)
        for u, v in zip(edge[-2::-1].tolist(), edge[:0:-1].tolist(), strict=True):
            beta[u:v] = after[: v - u]
            y[u:v] *= beta[u:v]
            new = y[u:v] @ step.T
            np.divide(new, (new @ one)[:, None], out=after[: v - u])
        alpha *= beta
        alpha /= (alpha @ one)[:, None]
        gamma[place] = alpha
        # y is by now the likelihood of each step's symbol and of all that follows
        scale = np.einsum("ij,ij->i", left @ step, y)[:, None]
        moves += left.T @ (y / np.where(scale > 0, scale, 1))
    return gamma, step * moves, total
