"""A bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word enters as its own vector (a hashed bucket) beside the mean of the vectors of its character runs (hashed buckets of
3 to 5 bytes, with marks for its beginning and end). Inputs depend on the word alone, so their share of the gates is
computed once for each distinct word of a block; only the recurrent share is computed at each place.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

from ledgerline.llm.textarrays import LOWER, U, Prefix, words

GRAMS = (3, 4, 5)
_OPEN, _CLOSE = 2, 3
#: Letters and digits stay, A-Z as a-z; all other ASCII characters separate words.
PLAIN = LOWER.copy()
PLAIN[:128][~np.array([chr(c).isalnum() for c in range(128)])] = 32


@dataclass
class Network:
    word: np.ndarray  # buckets x size
    char: np.ndarray
    inputs: np.ndarray  # direction x 2 size x 3 hidden: update, reset, candidate
    state: np.ndarray  # direction x hidden x 3 hidden
    bias: np.ndarray
    attend: np.ndarray  # 2 hidden x attention
    attend_bias: np.ndarray
    attend_to: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, words_: int = 1 << 13, chars: int = 1 << 14, size: int = 12, hidden: int = 12, attention: int = 12, seed: int = 1, kind=np.float32) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: r.normal(0, s, shape).astype(kind)
        return cls(draw(words_, size, s=0.1), draw(chars, size, s=0.3), draw(2, 2 * size, 3 * hidden, s=(2 * size) ** -0.5),
                   draw(2, hidden, 3 * hidden, s=hidden**-0.5), np.zeros((2, 3 * hidden), kind), draw(2 * hidden, attention, s=(2 * hidden) ** -0.5),
                   np.zeros(attention, kind), draw(attention, s=attention**-0.5), draw(2 * hidden, s=(2 * hidden) ** -0.5), np.zeros(1, kind))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


@dataclass
class Vocabulary:
    """Distinct words of a block: bucket of each word, and its character runs from `first[i]` to `first[i + 1]`."""

    bucket: np.ndarray
    first: np.ndarray
    runs: np.ndarray

    def take(self, at: np.ndarray) -> Vocabulary:
        count = self.first[at + 1] - self.first[at]
        first = np.concatenate(([0], np.cumsum(count)))
        inside = np.arange(first[-1]) - np.repeat(first[:-1], count)
        return Vocabulary(self.bucket[at], first, self.runs[np.repeat(self.first[at], count) + inside])


def encode(data: np.ndarray, offsets: np.ndarray, n_words: int, n_chars: int) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in them, and the first word of each text (n + 1 values)."""
    plain = PLAIN[data]
    start, end, first = words(plain, offsets)
    names, at, back = np.unique(Prefix(plain).of(start, end), return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    size = end - start + 2
    edge = np.concatenate(([0], np.cumsum(size)))
    letters = np.empty(int(edge[-1]), np.uint8)
    inside = np.arange(len(letters)) - np.repeat(edge[:-1], size)
    letters[:] = plain[np.minimum(np.repeat(start, size) + np.maximum(inside - 1, 0), max(len(plain) - 1, 0))] if len(plain) else 0
    letters[edge[:-1]], letters[edge[1:] - 1] = _OPEN, _CLOSE
    prefix, left = Prefix(letters), np.repeat(edge[1:], size) - np.arange(len(letters))
    counts = [np.maximum(size - g + 1, 0) for g in GRAMS]
    begin = np.concatenate(([0], np.cumsum(sum(counts))))
    runs, before = np.empty(int(begin[-1]), np.int32), np.zeros(len(size), np.int64)
    for g, count in zip(GRAMS, counts, strict=True):
        ids = (prefix.windows(g) % U(n_chars)).astype(np.int32)
        ids = ids[left[: len(ids)] >= g]
        ahead = np.concatenate(([0], np.cumsum(count)))[:-1]
        runs[np.repeat(begin[:-1] + before - ahead, count) + np.arange(len(ids))] = ids
        before += count
    return Vocabulary((names % U(n_words)).astype(np.int32), begin, runs), back.reshape(-1), first


def window_places(first: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of all windows: every `stride` words, `width` long, until the text is covered."""
    size = np.diff(first)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - width) // stride)), 0)
    text = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return text, first[text] + begin, np.minimum(width, size[text] - begin)


def window_words(back: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Word numbers of windows, one row each; what lies beyond a window's length is never read."""
    return back[np.minimum(start[:, None] + np.arange(width), max(len(back) - 1, 0))]


def _summed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, first[:-1], axis=0) if len(first) > 1 else rows[:0]


def word_inputs(net: Network, vocabulary: Vocabulary, part: int = 1 << 14) -> np.ndarray:
    """Vector of each distinct word; every word has at least one character run."""
    out = []
    for a in range(0, len(vocabulary.bucket), part):
        first = vocabulary.first[a : a + part + 1]
        mean = _summed(net.char[vocabulary.runs[first[0] : first[-1]]], first - first[0]) / np.diff(first)[:, None].astype(net.char.dtype)
        out.append(np.concatenate((net.word[vocabulary.bucket[a : a + part]], mean), axis=1))
    return np.concatenate(out) if out else np.zeros((0, net.inputs.shape[1]), net.word.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, through the exponential, which runs on vector registers."""
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _order(length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows, longest first, and how many of them reach each place."""
    order = np.argsort(-length, kind="stable")
    return order, np.searchsorted(-length[order], -np.arange(width), "left")


def forward(net: Network, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logit of each window, for word vectors `x` and word numbers `at` (window x place), longest window first."""
    width, hidden = at.shape[1], net.state.shape[1]
    active = np.searchsorted(-length, -np.arange(width), "left")
    states = np.zeros((width, len(at), 2 * hidden), net.word.dtype)
    memory: dict = {"steps": ([], [])}
    for side in (0, 1):
        shares = [np.ascontiguousarray(a) for a in np.split(x @ net.inputs[side] + net.bias[side], 3, axis=1)]
        pulls = [np.ascontiguousarray(a) for a in np.split(net.state[side], 3, axis=1)]
        h = np.zeros((len(at), hidden), net.word.dtype)
        for t in range(width) if side == 0 else range(width - 1, -1, -1):
            k = active[t]
            if k == 0:
                continue
            place, old = at[:k, t], h[:k]
            z, r, n = (share.take(place, axis=0) for share in shares)
            z += old @ pulls[0]
            r += old @ pulls[1]
            _sigmoid(z)
            _sigmoid(r)
            pull = old @ pulls[2]
            n += r * pull
            _tanh(n)
            if keep:
                memory["steps"][side].append((t, k, old.copy(), z, r, n, pull))
            new = old - n
            new *= z
            new += n
            h[:k] = new
            states[t, :k, side * hidden : (side + 1) * hidden] = new
    look = _tanh(states @ net.attend + net.attend_bias)
    weight = look @ net.attend_to
    weight[np.arange(width)[:, None] >= length[None, :]] = -np.inf
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    if keep:
        memory |= {"states": states, "look": look, "weight": weight, "pooled": pooled}
    return pooled @ net.out + net.out_bias[0], memory


def backward(net: Network, vocabulary: Vocabulary, x: np.ndarray, at: np.ndarray, length: np.ndarray, memory: dict, slope: np.ndarray,
             shown: np.ndarray | None = None) -> list[np.ndarray]:
    """Gradients in the order of `Network.arrays`, for the slope of the loss at each logit; `shown` marks words whose own vector took part."""
    hidden, size = net.state.shape[1], net.word.shape[1]
    states, look, weight, pooled = (memory[k] for k in ("states", "look", "weight", "pooled"))
    d_pooled = slope[:, None] * net.out
    d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_look = d_score[..., None] * net.attend_to * (1 - look * look)
    d_states = weight[..., None] * d_pooled + d_look @ net.attend.T
    flat = lambda a: a.reshape(-1, a.shape[-1])
    d_attend = flat(states).T @ flat(d_look)
    d_attend_to = flat(look).T @ d_score.reshape(-1)
    d_inputs, d_state, d_bias, d_x = np.zeros_like(net.inputs), np.zeros_like(net.state), np.zeros_like(net.bias), np.zeros_like(x)
    for side in (0, 1):
        d_h = np.zeros((len(at), hidden), x.dtype)
        taken, slopes = [], []
        for t, k, old, z, r, n, pull in reversed(memory["steps"][side]):
            d_new = d_h[:k] + d_states[t, :k, side * hidden : (side + 1) * hidden]
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (old - n) * z * (1 - z)
            d_r = d_n * pull * r * (1 - r)
            to_state = np.concatenate((d_z, d_r, d_n * r), axis=1)
            d_state[side] += old.T @ to_state
            d_h[:k] = d_new * z + to_state @ net.state[side].T
            taken.append(at[:k, t])
            slopes.append(np.concatenate((d_z, d_r, d_n), axis=1))
        d_share = _scattered(np.concatenate(taken), np.concatenate(slopes), len(x)) if taken else np.zeros((len(x), 3 * hidden), x.dtype)
        d_inputs[side] = x.T @ d_share
        d_bias[side] = d_share.sum(axis=0)
        d_x += d_share @ net.inputs[side].T
    if shown is not None:
        d_x[:, :size] *= shown[:, None]
    count = np.diff(vocabulary.first)
    d_runs = np.repeat(d_x[:, size:] / count[:, None].astype(x.dtype), count, axis=0)
    return [_scattered(vocabulary.bucket, d_x[:, :size], len(net.word)), _scattered(vocabulary.runs, d_runs, len(net.char)), d_inputs, d_state, d_bias,
            d_attend, flat(d_look).sum(axis=0), d_attend_to, pooled.T @ slope, slope.sum(keepdims=True)]


def _scattered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows for each number."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[head]] = np.add.reduceat(rows[order], head, axis=0)
    return out


def logits(net: Network, vocabulary: Vocabulary, back: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, batch: int = 2048) -> np.ndarray:
    """Logit of each window."""
    x = word_inputs(net, vocabulary)
    order, _ = _order(length, width)
    out = np.zeros(len(start), np.float64)
    for a in range(0, len(order), batch):
        some = order[a : a + batch]
        out[some] = forward(net, x, window_words(back, start[some], length[some], width), length[some])[0]
    return out


class Adam:
    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))

    def step(self, slopes: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.net.arrays(), slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-8)


def train(net: Network, vocabulary: Vocabulary, back: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray, width: int,
          epochs: int = 30, warm: int = 3, patience: int = 5, rate: float = 0.01, hide: float = 0.5, decay: float = 1e-5, steps: int = 16, seed: int = 1) -> tuple[Network, float, list[float]]:
    """Fit on texts (label 0 or 1 each) that are given by their windows; returns the network, the logit that separates the
    classes, and the loss on the texts held back after each epoch.

    A text is as toxic as its worst window. For the first epochs a random window stands for its text; later the window with
    the highest logit does, for a clean text beside a random one. One text in five is held back to end training in time.
    Half of the words in a step show their characters only, so that unseen words are judged by those.
    """
    r = np.random.default_rng(seed)
    held = np.zeros(len(label), bool)
    for k in (0, 1):
        some = np.flatnonzero(label == k)
        held[some[r.permutation(len(some))[: len(some) // 5]]] = True
    share = np.bincount(label[~held], minlength=2).astype(float)
    scale = np.where(label == 1, max(1.0, (share[0] / max(share[1], 1)) ** 0.5), 1.0)
    best, kept, adam, losses, stale, every = np.inf, [a.copy() for a in net.arrays()], Adam(net, rate), [], 0, None
    for epoch in range(epochs):
        rows = _highest(text, every if epoch >= warm else r.random(len(start)))
        other = _highest(text, r.random(len(start)))
        chosen = np.unique(np.concatenate((rows, other[label[text[other]] == 0])) if epoch >= warm else np.concatenate((rows, other)))
        chosen = r.permutation(chosen[~held[text[chosen]]])
        batch = min(128, max(16, len(chosen) // steps))
        for a in range(0, len(chosen), batch):
            some = chosen[a : a + batch]
            some = some[np.argsort(-length[some], kind="stable")]
            at = window_words(back, start[some], length[some], width)
            used, local = np.unique(at, return_inverse=True)
            small, at = vocabulary.take(used), local.reshape(at.shape)
            x = word_inputs(net, small)
            shown = r.random(len(x)) >= hide
            x[:, : net.word.shape[1]] *= shown[:, None]
            logit, memory = forward(net, x, at, length[some], keep=True)
            y, w = label[text[some]], scale[text[some]]
            slope = (w * (1 / (1 + np.exp(-logit)) - y) / w.sum()).astype(x.dtype)
            adam.step([g + decay * p for g, p in zip(backward(net, small, x, at, length[some], memory, slope, shown), net.arrays(), strict=True)])
        every = logits(net, vocabulary, back, start, length, width)
        top = _highest(text, every)
        judged = top[held[text[top]]] if held.any() else top
        y, w = label[text[judged]], scale[text[judged]]
        losses.append(float((w * np.logaddexp(0, np.where(y == 1, -every[judged], every[judged]))).sum() / w.sum()))
        stale += 1
        if losses[-1] < best - 1e-4:
            best, kept, stale = losses[-1], [a.copy() for a in net.arrays()], 0
        elif stale >= patience and epoch >= warm + patience:
            break
    net = Network(*kept)
    every = logits(net, vocabulary, back, start, length, width)
    top = _highest(text, every)
    few = min(np.bincount(label[held], minlength=2)) < 10
    judged = top if few else top[held[text[top]]]
    return net, separating(every[judged], label[text[judged]]), losses


def _highest(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The window with the highest value of each text; `text` rises."""
    order = np.lexsort((value, text))
    return order[np.concatenate((text[order][1:] != text[order][:-1], [True]))] if len(order) else order


def separating(value: np.ndarray, label: np.ndarray) -> float:
    """The middle of the values at which F1 is highest."""
    order = np.argsort(-value, kind="stable")
    y, v = label[order], value[order]
    hit = np.cumsum(y)
    score = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    best = int(np.flatnonzero(score >= score.max() - 1e-12)[0])
    return float((v[best] + v[best + 1]) / 2) if best + 1 < len(v) else float(v[best] - 1)
