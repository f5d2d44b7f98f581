"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding next to the mean embeddings of its beginnings, of its
endings and of the runs of characters in it, and two numbers that are not trained: how far its
features lean most to one label and to the other. Sequences have a fixed length; ``mask`` is 1
where they have a word.
"""

from __future__ import annotations

import string

import numpy as np

SIGNS = string.punctuation + "«»„“”‘’…–—¿¡"
#: Sizes of the parts of a word's vector that are trained, of all of it, and of the hidden state.
PARTS = {"word": 10, "head": 8, "tail": 6, "inner": 6}
INPUT, HIDDEN = sum(PARTS.values()) + 2, 8
GATES = 3 * HIDDEN
#: Character inputs: the first and the last letters of a word, so many of them, and runs of ``RUN``
#: characters from these places on.
HEADS, TAILS = range(3, 9), range(3, 6)
RUN, RUNS = 4, range(12)

#: Sequences of a training step.
BATCH = 128

Params = dict[str, np.ndarray]
Rows = dict[str, dict[str, int]]


def plain(word: str) -> str:
    """The word in lower case without the signs around it."""
    return word.lower().strip(SIGNS)


def features(word: str) -> dict[str, list[str]]:
    """What can be known of a word: itself, its beginnings and endings, and the runs in it (empty behind its end)."""
    inner = [word[i : i + RUN] if i + RUN <= len(word) else "" for i in RUNS]
    return {"word": [word], "head": [word[:n] for n in HEADS], "tail": [word[-n:] for n in TAILS], "inner": inner}


def lexicon(rows: Rows, words: list[str]) -> dict[str, np.ndarray]:
    """Feature rows of the words, (words, features of the part); 0 where a feature is not known."""
    word, head, tail, inner = (rows.get(part, {}).get for part in PARTS)
    # A run behind the end of a word is shorter than all known ones, so it needs no test.
    found = {
        "word": [word(w, 0) for w in words],
        "head": [head(w[:n], 0) for w in words for n in HEADS],
        "tail": [tail(w[-n:], 0) for w in words for n in TAILS],
        "inner": [inner(w[i : i + RUN], 0) for w in words for i in RUNS],
    }
    return {part: np.array(numbers, np.int64).reshape(len(words), -1) for part, numbers in found.items()}


def known_share(rows: np.ndarray) -> np.ndarray:
    """For each feature of each word 1 / its known features of that part, 0 for unknown ones."""
    known = (rows > 0).astype(np.float32)
    return known / np.maximum(known.sum(axis=1, keepdims=True), 1)


def leanings_of(params: Params, lexical: dict[str, np.ndarray]) -> np.ndarray:
    """For each word the most that one of its features leans to the label, and the most that one leans away from it."""
    each = np.concatenate([params[f"{part} leaning"][r] for part, r in lexical.items()], axis=1)
    return np.stack([each.max(axis=1), each.min(axis=1)], axis=1)


def means_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word the mean of the table's rows that are known, zero without any. Most features of most words are not."""
    flat = rows.ravel()
    at = np.flatnonzero(flat)
    found = np.zeros((len(rows), table.shape[1]), np.float32)
    if len(at):
        owner = at // rows.shape[1]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        number = np.diff(np.r_[starts, len(at)])[:, None]
        found[owner[starts]] = np.add.reduceat(table[flat[at]], starts, axis=0) / number
    return found


def vectors_of(params: Params, lexical: dict[str, np.ndarray]) -> np.ndarray:
    """For each word the mean embeddings of its known features, part by part, and how they lean."""
    means = [means_of(params[part], r) for part, r in lexical.items()]
    return np.concatenate([*means, leanings_of(params, lexical)], axis=1, dtype=np.float32)


def fresh(rows: Rows, seed: int = 7, leaning: dict[str, np.ndarray] | None = None) -> Params:
    """Parameters to begin with; ``leaning`` has a number for each feature, by row."""
    rng = np.random.default_rng(seed)

    def small(*shape: int, scale: float = 0.1) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    tables = {part: small(len(rows.get(part, {})) + 1, size, scale=0.05) for part, size in PARTS.items()}
    for part in PARTS:
        tables[part][0] = 0
        tables[f"{part} leaning"] = np.r_[np.float32(0), leaning[part]] if leaning else np.zeros(len(tables[part]), np.float32)
    return tables | {
        "input": small(2, INPUT, GATES, scale=0.3),
        "bias": np.zeros((2, GATES), np.float32),
        "state": small(2, HIDDEN, GATES, scale=0.3),
        "attend": small(2 * HIDDEN),
        "out": small(2 * HIDDEN, scale=0.3),
        "out_bias": np.zeros(1, np.float32),
    }


def gate_inputs(params: Params, vectors: np.ndarray) -> np.ndarray:
    """What the words give to the gates, for both directions: (2, words, gates)."""
    return np.einsum("nd,kdg->kng", vectors, params["input"]) + params["bias"][:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def run_direction(gates, state: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, sequences, hidden) in the order in which ``gates(step)`` gives the inputs."""
    steps, many = mask.shape
    hidden = np.zeros((many, HIDDEN), np.float32)
    states = np.empty((steps, many, HIDDEN), np.float32)
    for t in range(steps):
        x, h = gates(t), hidden @ state
        zr = sigmoid(x[:, : 2 * HIDDEN] + h[:, : 2 * HIDDEN])
        z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], h[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
        step = (1 - z) * (n - hidden) * mask[t][:, None]
        if keep is not None:
            keep.append((hidden, z, r, n, inner))
        hidden = hidden + step
        states[t] = hidden
    return states


def pool(params: Params, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention weights and pooled states of (steps, sequences, 2 hidden)."""
    energy = np.where(mask > 0, states @ params["attend"], -1e9)
    energy = np.exp(energy - energy.max(axis=0)) * mask
    weights = energy / np.maximum(energy.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weights, states)
    return pooled @ params["out"] + params["out_bias"], weights, pooled


def logits(params: Params, table: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``table``: gate inputs of words; ``ids`` and ``mask``: (steps, sequences)."""
    last = len(ids) - 1
    ahead = run_direction(lambda t: table[0][ids[t]], params["state"][0], mask)
    back = run_direction(lambda t: table[1][ids[last - t]], params["state"][1], mask[::-1])[::-1]
    return pool(params, np.concatenate([ahead, back], axis=2), mask)[0]


def _backward_direction(d_states, kept, state, mask) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs (steps, sequences, gates) and of the recurrent weights."""
    steps, many = mask.shape
    d_gates, d_state, d_hidden = np.empty((steps, many, GATES), np.float32), np.zeros_like(state), np.zeros((many, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        hidden, z, r, n, inner = kept[t]
        d = d_hidden + d_states[t]
        on = mask[t][:, None]
        d_n = d * on * (1 - z) * (1 - n * n)
        d_z = d * on * (hidden - n) * z * (1 - z)
        d_r = d_n * inner * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_h = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_state += hidden.T @ d_h
        d_hidden = d * (1 - on * (1 - z)) + d_h @ state.T
    return d_gates, d_state


def gradients(params: Params, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray):
    """Gradients of the mean log loss: of the parameters behind the embeddings, and of the word vectors."""
    table = gate_inputs(params, vectors)
    kept: tuple[list, list] = ([], [])
    ahead = run_direction(lambda t: table[0][ids[t]], params["state"][0], mask, kept[0])
    back = run_direction(lambda t: table[1][ids[::-1][t]], params["state"][1], mask[::-1], kept[1])[::-1]
    states = np.concatenate([ahead, back], axis=2)
    logit, weights, pooled = pool(params, states, mask)
    d_logit = ((sigmoid(logit) - labels) / len(labels)).astype(np.float32)
    d_pooled = d_logit[:, None] * params["out"]
    d_weights = np.einsum("bh,tbh->tb", d_pooled, states)
    d_energy = weights * (d_weights - (weights * d_weights).sum(axis=0))
    d_states = weights[:, :, None] * d_pooled + d_energy[:, :, None] * params["attend"]
    found = {
        "out": d_logit @ pooled, "out_bias": d_logit.sum(keepdims=True), "attend": np.einsum("tb,tbh->h", d_energy, states),
        "input": np.zeros_like(params["input"]), "bias": np.zeros_like(params["bias"]), "state": np.zeros_like(params["state"]),
    }
    d_vectors = np.zeros_like(vectors)
    flat = ids.ravel()
    for k in (0, 1):
        turn = slice(None, None, -1 if k else 1)
        d_gates, found["state"][k] = _backward_direction(d_states[turn, :, k * HIDDEN : (k + 1) * HIDDEN], kept[k], params["state"][k], mask[turn])
        d_rows = np.stack([np.bincount(flat, d_gates[turn, :, g].ravel(), len(vectors)) for g in range(GATES)], axis=1).astype(np.float32)
        found["input"][k] = vectors.T @ d_rows
        found["bias"][k] = d_rows.sum(axis=0)
        d_vectors += d_rows @ params["input"][k].T
    return found, d_vectors, logit


class Adam:
    def __init__(self, params: Params, rate: float, floor: float = 1e-3):
        self.params, self.rate, self.floor, self.step = params, rate, floor, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, found: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        """``rows``: for embeddings, which rows the gradient is of; the others stay as they are."""
        self.step += 1
        for key, grad in found.items():
            at = rows.get(key, slice(None))
            mean = self.mean[key][at] * 0.9 + 0.1 * grad
            square = self.square[key][at] * 0.99 + 0.01 * grad * grad
            self.mean[key][at], self.square[key][at] = mean, square
            self.params[key][at] -= self.rate * mean / (1 - 0.9**self.step) / (np.sqrt(square / (1 - 0.99**self.step)) + self.floor)


def train_pass(params: Params, adam: Adam, lexical: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, labels: np.ndarray, rng) -> None:
    """One pass over the sequences, columns of ``ids``, in random order."""
    order = rng.permutation(ids.shape[1])
    for chosen in np.array_split(order, max(1, len(order) // BATCH)):
        used, local = np.unique(ids[:, chosen], return_inverse=True)
        own = {part: rows[used] for part, rows in lexical.items()}
        found, d_vectors, _ = gradients(params, vectors_of(params, own), local.reshape(ids.shape[0], -1), mask[:, chosen], labels[chosen])
        touched, low = {}, 0
        for part, size in PARTS.items():
            each = (known_share(own[part])[:, :, None] * d_vectors[:, None, low : low + size]).reshape(-1, size)
            touched[part], at = np.unique(own[part].ravel(), return_inverse=True)
            found[part] = np.stack([np.bincount(at, each[:, k], len(touched[part])) for k in range(size)], axis=1).astype(np.float32)
            low += size
        adam.update(found, touched)
