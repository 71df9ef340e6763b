"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of the word itself (hashed) beside the mean embedding of
its character 3- to 5-grams (hashed, with word edges).  Words end at ASCII white space;
what is longer than LONGEST bytes is split at other spaces and signs, and parts that are
still longer into overlapping pieces, which are words of their own.  Two GRUs read a window of 64
words in either direction, attention pools their states and a linear layer gives the
window's logit.  Every whole text is scored: windows start each 32 words and cover it
to its end.  A document's score is a logistic function of its highest and second
highest window logit, their log-sum-exp and the number of windows, fitted on labelled documents that the
network was not trained on.

Training rows: labelled documents chosen by the caller's filter, at most MAX_TOXIC
toxic and MAX_CLEAN others (smallest hash of the id first), of each kind as many as
MAX_BYTES hold: a document that does not fit into what is left of them is passed over.
These bounds on rows are the only limits, and hold for training alone: a document of the
sample is learned from whole, and what reaches the driver is bounded in bytes.  Given the
same tables the model is the same (fixed seed).  Scoring runs in the partitions of the
documents; the trained weights (some MB, fixed size) are broadcast.

Defined results: a null or empty text is scored as one window without words; very long
texts are scored to their end and, in training, count as any other row; without labels
of both kinds every score is the share of toxic labels (0 without labels); of rows that
share a labelled id the first text in byte order is learned from; ids that are null are
not held out unless their hash says so; repeated rows score alike; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import texts_of
from .common import discard, materialize, prepare, table

#: Bounds of the labelled rows learned from: toxic ones, others, and the bytes of the texts of each kind.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1000, 1600, 6 << 20
WINDOW, STRIDE = 64, 32
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 15, 8, 16, 16, 16
EPOCHS, STEPS, BATCH, RATE, SEED = 5, 500, 256, 5e-3, 7
#: Windows scored together, and distinct words a task keeps before it starts its cache anew.
TOGETHER, CACHE = 2048, 150_000


PUNCTUATION = b".,;:!?\"'()[]|*#%&$-"
#: Bytes of a word beyond which it is split, and characters of a piece and from piece to piece (no piece is split again).
LONGEST, PIECE, AHEAD = 60, 15, 8
#: Spaces and separating signs; not marks of letters, emoji or signs that stand for letters.
_SIGNS = re.compile(r"[\s\u200b_\-/\\|+=&.,;:!?()\[\]{}<>\"\u2010-\u2015\u2026\u3001-\u3003\u3008-\u3011\uff01\uff08\uff09\uff0c\uff0e\uff0f\uff1a\uff1b\uff1f\uff61-\uff65]+")


class Parts:
    """Word and n-gram buckets of distinct lower-cased words, as flat arrays (n-grams with word edges)."""

    def __init__(self, words: list[bytes]):
        cores = [w.strip(PUNCTUATION) or w for w in words]
        self.word = np.fromiter((zlib.crc32(c) for c in cores), np.int64, len(cores)) % BUCKETS
        text = np.frombuffer(b"".join(b"<" + c + b">" for c in cores), np.uint8).astype(np.uint32)
        length = np.fromiter((len(c) + 2 for c in cores), np.int64, len(cores))
        end = np.repeat(np.cumsum(length), length)
        owner, grams, value = [], [], text.copy()
        for n in (2, 3, 4, 5):
            value = value[:-1] * np.uint32(0x01000193) + text[n - 1 :]
            if n > 2:
                at = np.flatnonzero(np.arange(len(value)) + n <= end[: len(value)])
                mixed = value[at] * np.uint32(0x9E3779B1) + np.uint32(n)
                grams.append((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS))
                owner.append(at)
        owner, grams = np.concatenate(owner), np.concatenate(grams).astype(np.int64)
        word = np.repeat(np.arange(len(cores)), length)[owner]
        self.flat = grams[np.argsort(word, kind="stable")].astype(np.uint16)  # BUCKETS fit
        self.count = np.bincount(word, minlength=len(cores))
        self.begin = np.cumsum(self.count) - self.count

    @classmethod
    def of(cls, words: list[bytes], piece: int = 20_000) -> Parts:
        """The same for many words, piece by piece: what is held while a piece is made is many times its size."""
        pieces = [cls(words[i : i + piece]) for i in range(0, len(words), piece)]
        out = object.__new__(cls)
        out.word, out.flat, out.count = (np.concatenate(x) for x in zip(*((p.word, p.flat, p.count) for p in pieces), strict=True))
        out.begin = np.cumsum(out.count) - out.count
        return out

    def take(self, rows: np.ndarray) -> Parts:
        out = object.__new__(Parts)
        out.word, out.count = self.word[rows], self.count[rows]
        out.begin = np.cumsum(out.count) - out.count
        out.flat = self.flat[np.arange(out.count.sum()) + np.repeat(self.begin[rows] - out.begin, out.count)]
        return out


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values' rows by row number, (n, columns)."""
    out = np.empty((n, values.shape[1]), np.float32)
    for c, column in enumerate(np.ascontiguousarray(values.T)):
        out[:, c] = np.bincount(rows, column, n)
    return out


def split_long(word: bytes) -> list[bytes]:
    """The parts of a long word between spaces and signs, or overlapping pieces of what has none; nothing but signs: pieces."""
    core = word.strip(PUNCTUATION) or word
    if len(core) <= LONGEST:
        return [word]
    text, out = core.decode(), []
    for part in [p for p in _SIGNS.split(text) if p] or [text]:
        if len(part.encode()) <= LONGEST:
            out.append(part.encode())
        else:
            out += [part[i : i + PIECE].encode() for i in range(0, max(1, len(part) - PIECE + AHEAD), AHEAD)]
    return out


def tokens(text: bytes) -> list[bytes]:
    words = text.decode("utf-8", "replace").lower().encode().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ((w,) if len(w) <= LONGEST else split_long(w))]


def window_starts(n: int) -> list[int]:
    """Overlapping windows over n words, the last one ending with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Net:
    """Parameters, forward and backward pass.  Windows: (N, T) rows of a matrix of distinct words, -1 for none."""

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        d, h, k = WORD_DIM + CHAR_DIM, HIDDEN, ATTEND

        def matrix(*shape):
            return (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": (0.1 * g.standard_normal((BUCKETS, WORD_DIM))).astype(np.float32),
            "char": (0.3 * g.standard_normal((BUCKETS, CHAR_DIM))).astype(np.float32),
            "x": matrix(d, 6 * h), "b": np.zeros(6 * h, np.float32), "hf": matrix(h, 3 * h), "hb": matrix(h, 3 * h),
            "a": matrix(2 * h, k), "v": matrix(k), "o": matrix(2 * h), "c": np.zeros(1, np.float32),
        }

    def inputs(self, parts: Parts) -> np.ndarray:
        """One row per distinct word."""
        chars = np.add.reduceat(self.p["char"][parts.flat], parts.begin) / np.sqrt(parts.count)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][parts.word], chars], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input side of both directions' gates per distinct word; a last row stands for no word."""
        return np.concatenate([x @ self.p["x"] + self.p["b"], np.zeros((1, 6 * HIDDEN), np.float32)])

    def _read(self, gates, ids, there, back: bool, keep: list | None):
        h, side = HIDDEN, slice(3 * HIDDEN, None) if back else slice(0, 3 * HIDDEN)
        table, w = np.ascontiguousarray(gates[:, side]), self.p["hb" if back else "hf"]
        n, t_max = ids.shape
        state, out = np.zeros((n, h), np.float32), np.empty((t_max, n, h), np.float32)
        full = there.all(axis=0).tolist()
        for t in reversed(range(t_max)) if back else range(t_max):
            u, s = table[ids[:, t]], state @ w
            rz = sigmoid(u[:, : 2 * h] + s[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            c = np.tanh(u[:, 2 * h :] + r * s[:, 2 * h :])
            new = c + z * (state - c)
            if not full[t]:
                new = np.where(there[:, t, None], new, state)
            if keep is not None:
                keep.append((t, state, r, z, c, s[:, 2 * h :]))
            state = out[t] = new
        return out

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        there = ids >= 0
        kf, kb = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._read(gates, ids, there, False, kf), self._read(gates, ids, there, True, kb)], axis=2)
        look = np.tanh(states @ self.p["a"])
        e = np.where(there.T, look @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        if keep is not None:
            keep.update(there=there, kf=kf, kb=kb, states=states, look=look, alpha=alpha, pooled=pooled, ids=ids)
        return pooled @ self.p["o"] + self.p["c"][0]

    def backward(self, d_logit: np.ndarray, k: dict, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the distinct words' gate inputs."""
        p, h, g = self.p, HIDDEN, {}
        g["o"], g["c"] = k["pooled"].T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pool = d_logit[:, None] * p["o"]
        d_alpha = np.einsum("nh,tnh->tn", d_pool, k["states"])
        d_e = k["alpha"] * (d_alpha - (k["alpha"] * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_e, k["look"])
        d_look = d_e[:, :, None] * p["v"] * (1 - k["look"] ** 2)
        g["a"] = np.einsum("tnh,tnk->hk", k["states"], d_look)
        d_states = k["alpha"][:, :, None] * d_pool + d_look @ p["a"].T
        d_gates = np.zeros((n_words + 1, 6 * h), np.float32)
        for name, side, kept, part in (("hf", 0, k["kf"], d_states[:, :, :h]), ("hb", 3 * h, k["kb"], d_states[:, :, h:])):
            w, d_w, d_next = p[name], np.zeros_like(p[name]), 0.0
            us, at = [], []
            for t, state, r, z, c, sn in reversed(kept):
                there = k["there"][:, t, None]
                d = part[t] + d_next
                live = np.where(there, d, 0)
                d_c = live * (1 - z) * (1 - c * c)
                d_z = live * (state - c) * z * (1 - z)
                d_r = d_c * sn * r * (1 - r)
                d_s = np.concatenate([d_r, d_z, d_c * r], axis=1)
                d_w += state.T @ d_s
                us.append(np.concatenate([d_r, d_z, d_c], axis=1))
                at.append(k["ids"][:, t])
                d_next = np.where(there, live * z + d_s @ w.T, d)
            g[name] = d_w
            rows = np.concatenate(at)
            d_gates[:, side : side + 3 * h] = summed(np.where(rows < 0, n_words, rows), np.concatenate(us), n_words + 1)
        return g, d_gates[:-1]


def padded(rows: np.ndarray, starts: list[int]) -> np.ndarray:
    """Windows of one text's word rows."""
    if len(rows) < WINDOW:
        rows = np.append(rows, np.full(WINDOW - len(rows), -1, rows.dtype))
    return rows[np.array(starts)[:, None] + np.arange(WINDOW)]


def train_net(docs: list[list[bytes]], toxic: np.ndarray, least_epochs: int = EPOCHS, least_steps: int = STEPS) -> Net:
    """Windows carry their document's label; after two fifths of the epochs a toxic document's label counts for its best windows.

    Few windows are seen in smaller batches and more epochs, so that the number of steps is least_steps or more.
    """
    net, g = Net(), np.random.default_rng(SEED)
    number: dict[bytes, int] = {}
    windows, owner = [], []
    for i, words in enumerate(docs):
        rows = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        starts = window_starts(len(words))
        windows.append(padded(rows, starts))
        owner += [i] * len(starts)
    windows, owner = np.concatenate(windows), np.array(owner)
    parts = Parts.of(list(number)) if number else None
    label = toxic[owner].astype(np.float32)
    weight = np.ones(len(windows), np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("word", "char")}
    seen = {k: np.full(BUCKETS, 1e-3, np.float32) for k in ("word", "char")}
    batch = min(BATCH, max(BATCH // 2, len(windows) // 40))
    step, epochs = 0, max(least_epochs, -(-least_steps * batch // len(windows)))
    refine = {-(-fifth * epochs // 5) for fifth in (2, 3, 4)}
    for epoch in range(epochs):
        if epoch in refine:  # a long toxic document has windows without anything toxic
            logit = np.concatenate([_logits(net, parts, windows[i : i + TOGETHER]) for i in range(0, len(windows), TOGETHER)])
            best = np.full(len(docs), -np.inf)
            np.maximum.at(best, owner, logit)
            weight = np.where(label > 0, (logit >= np.minimum(best[owner], 0)).astype(np.float32), 1)
        positive, negative = (weight * label).sum(), (weight * (1 - label)).sum()
        scale = np.where(label > 0, np.sqrt(negative / max(positive, 1)), 1).astype(np.float32)
        order = g.permutation(np.flatnonzero(weight > 0))
        for at in range(0, len(order), batch):
            which = order[at : at + batch]
            used, ids = np.unique(windows[which], return_inverse=True)
            ids = ids.reshape(-1, WINDOW)
            if len(used) and used[0] < 0:
                used, ids = used[1:], ids - 1
            if not len(used):
                continue
            own = parts.take(used)
            x = net.inputs(own)
            kept: dict = {}
            p = sigmoid(net.forward(net.gates(x), ids, kept))
            d = (p - label[which]) * scale[which] / len(which)
            grad, d_gates = net.backward(d.astype(np.float32), kept, len(used))
            grad["x"], grad["b"] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x = d_gates @ net.p["x"].T
            step += 1
            for k, v in grad.items():
                m = moment[k]
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.01 * (v * v - m[1])
                net.p[k] -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
            d_char = np.repeat(d_x[:, WORD_DIM:] / np.sqrt(own.count)[:, None].astype(np.float32), own.count, axis=0)
            for k, rows, value in (("word", own.word, d_x[:, :WORD_DIM]), ("char", own.flat, d_char)):
                total = summed(rows, value, BUCKETS)
                seen[k] += (total * total).mean(axis=1)
                net.p[k] -= 0.05 * total / np.sqrt(seen[k])[:, None]
    return net


def _logits(net: Net, parts, windows: np.ndarray) -> np.ndarray:
    used, ids = np.unique(windows, return_inverse=True)
    ids = ids.reshape(windows.shape)
    if len(used) and used[0] < 0:
        used, ids = used[1:], ids - 1
    if not len(used):
        return np.full(len(windows), net.p["c"][0])
    return net.forward(net.gates(net.inputs(parts.take(used))), ids)


class Scorer:
    """Logits of whole texts, without what training keeps; holds the gate inputs of distinct words between texts.

    Gate inputs and weights are stored scaled by -1 (reset, update) and -2 (candidate), so
    that one exponential gives 1 / (1 + e) and 2 / (1 + e) - 1 in place.
    """

    def __init__(self, net: Net):
        h, self.p = HIDDEN, net.p
        self.net, self.scale = net, np.array([-1.0] * (2 * h) + [-2.0] * h, np.float32)
        self.w = [np.ascontiguousarray(net.p[k] * self.scale) for k in ("hf", "hb")]
        self.look = [np.ascontiguousarray(net.p["a"][side] * np.float32(-2)) for side in (slice(0, h), slice(h, None))]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = [np.zeros((1, 3 * HIDDEN), np.float32)] * 2  # the last row stands for no word

    def _add(self, words: list[bytes]) -> None:
        new = [[t[:-1]] for t in self.table]
        for i in range(0, len(words), 20_000):
            gates = self.net.gates(self.net.inputs(Parts(words[i : i + 20_000])))[:-1]
            for k, side in ((0, slice(0, 3 * HIDDEN)), (1, slice(3 * HIDDEN, None))):
                new[k].append(gates[:, side] * self.scale)
        self.table = [np.concatenate([*t, self.table[k][-1:]]) for k, t in enumerate(new)]

    def _read(self, k: int, ids: np.ndarray, there: np.ndarray) -> np.ndarray:
        h, (n, t_max) = HIDDEN, ids.shape
        out = np.empty((t_max, n, h), np.float32)
        state, u, s, full = np.zeros((n, h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32), there.all(axis=0).tolist()
        for t in reversed(range(t_max)) if k else range(t_max):
            np.take(self.table[k], ids[:, t], axis=0, out=u, mode="wrap")
            np.matmul(state, self.w[k], out=s)
            gate = u[:, : 2 * h] + s[:, : 2 * h]
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            c = gate[:, :h] * s[:, 2 * h :]
            c += u[:, 2 * h :]
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            new = np.subtract(state, c, out=out[t])
            new *= gate[:, h:]
            new += c
            if not full[t]:
                np.copyto(new, state, where=~there[:, t, None])
            state = new
        return out

    def _logits(self, windows: np.ndarray) -> np.ndarray:
        there = windows >= 0
        ids = np.where(there, windows, len(self.table[0]) - 1)
        states = [self._read(k, ids, there) for k in (0, 1)]
        look = states[0] @ self.look[0]
        look += states[1] @ self.look[1]
        np.exp(look, out=look)
        look += 1
        np.divide(2, look, out=look)
        look -= 1
        e = np.where(there.T, look @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        o = self.p["o"]
        return ((states[0] @ o[:HIDDEN] + states[1] @ o[HIDDEN:]) * e).sum(axis=0) + self.p["c"][0]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """(documents, 4): highest and second highest window logit, log-sum-exp, log of the number of windows."""
        number, fresh, windows, count = self.number, [], [], []
        for text in texts:
            rows = []
            for w in tokens(text):
                i = number.get(w)
                if i is None:
                    i = number[w] = len(number)
                    fresh.append(w)
                rows.append(i)
            found = padded(np.array(rows, np.int64), window_starts(len(rows)))
            windows.append(found)
            count.append(len(found))
        if fresh:
            self._add(fresh)
        windows, count = np.concatenate(windows), np.array(count)
        with np.errstate(over="ignore"):
            logit = np.concatenate([self._logits(windows[i : i + TOGETHER]) for i in range(0, len(windows), TOGETHER)]).astype(np.float64)
        begin = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(count)), count)
        best = np.maximum.reduceat(logit, begin)
        place = np.full(len(count), len(logit))
        np.minimum.at(place, doc, np.where(logit == best[doc], np.arange(len(logit)), len(logit)))
        rest = logit.copy()
        rest[place] = -10
        second = np.maximum.reduceat(rest, begin)
        spread = best + np.log(np.add.reduceat(np.exp(logit - best[doc]), begin))
        if len(number) > CACHE:
            self._clear()
        return np.stack([best, second, spread, np.log(count)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved while the loss would rise; the last coefficient is the constant."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
    penalty = ridge * np.append(np.ones(x.shape[1]), 0.0)

    def loss(b):
        m = z @ b
        return (weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (penalty * b * b).sum()

    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = sigmoid(z @ b)
        step = np.linalg.solve((z.T * (weight * p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * b)
        size = 1.0
        while size > 1e-4 and loss(b + size * step) > loss(b):
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.append(b[:-1] / spread, b[-1] - (b[:-1] * mean / spread).sum())


class Model:
    def __init__(self, net: Net | None, combine: np.ndarray | None, base: float):
        self.net, self.combine, self.base = net, combine, base

    def scores(self, scorer: Scorer, texts: list[bytes]) -> np.ndarray:
        x = scorer.features(texts)
        return sigmoid(np.clip(x @ self.combine[:-1] + self.combine[-1], -30, 30))


def sample(docs: DataFrame, labels: DataFrame, chosen, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> tuple[list, int, int]:
    """(rows of doc_id, toxic, text in order of id, toxic labels, all labels): the bounded sample of labelled rows."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & chosen).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {bool(r["t"]): r["n"] for r in marks.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return [], total.get(True, 0), sum(total.values())
    order = F.xxhash64("doc_id")
    picked = marks.filter("toxic > 0").orderBy(order).limit(max_toxic).unionByName(marks.filter("toxic <= 0").orderBy(order).limit(max_clean))
    # at most max_toxic + max_clean rows: the bound of what is broadcast, and of the rows written and counted here
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = materialize(rows, "labelled")
    left, fits = {True: max_bytes, False: max_bytes}, []
    for r in rows.select("doc_id", (F.col("toxic") > 0).alias("t"), F.octet_length("text").alias("size")).orderBy(order, "doc_id").collect():
        if r["size"] <= left[r["t"]]:
            left[r["t"]] -= r["size"]
            fits.append(r["doc_id"])
    kept = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fits], "doc_id long")), "doc_id") if fits else rows.limit(0)
    got = sorted(kept.toLocalIterator(), key=lambda r: r["doc_id"])
    discard(rows)
    return got, total[True], sum(total.values())


def fitted(ids: list[int], words: list[list[bytes]], toxic: np.ndarray, odds: float) -> Model:
    """The network, and the logistic function fitted on a fifth of the rows that it did not see; odds: other labels for each toxic one."""
    aside = np.array([zlib.crc32(b"aside%d" % i) % 5 == 0 for i in ids])
    if min(toxic[aside].sum(), (~toxic[aside]).sum(), toxic[~aside].sum()) < 1:
        aside[:] = False
    net = train_net([w for w, a in zip(words, aside, strict=True) if not a], toxic[~aside])
    fit = aside if aside.any() else ~aside
    scorer = Scorer(net)
    x = np.concatenate([scorer.features([b" ".join(words[i])]) for i in np.flatnonzero(fit)])
    y = toxic[fit].astype(float)
    # the sample holds more toxic rows than the labels do; half of that (in log odds) is undone, which favours recall
    odds /= max((1 - y.mean()) / max(y.mean(), 1e-9), 1e-9)
    weight = np.where(y > 0, 1.0, np.sqrt(odds))
    return Model(net, fit_logistic(x, y, weight), 0.0)


def train(docs: DataFrame, labels: DataFrame, chosen, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows for which the Column `chosen` (of doc_id) holds."""
    got, n_toxic, every = sample(docs, labels, chosen, max_toxic, max_clean, max_bytes)
    toxic = np.array([r["toxic"] > 0 for r in got], bool)
    if not toxic.any() or toxic.all():
        return Model(None, None, n_toxic / every if every else 0.0)
    same: dict[bytes, bytes] = {}  # a word is held once
    words = [[same.setdefault(w, w) for w in tokens(r["text"].encode())] for r in got]
    return fitted([r["doc_id"] for r in got], words, toxic, (every - n_toxic) / n_toxic)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores; other columns stay as they are."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.net) if m.net else None
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch[text_col])]
            if scorer is None:
                out = np.full(len(texts), m.base)
            else:
                out, at = [], 0
                while at < len(texts):  # about a megabyte of text at a time
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                        size += len(texts[end])
                        end += 1
                    out.append(m.scores(scorer, texts[at:end]))
                    at = end
                out = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """Rows whose labels are never learned from: CRC-32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
