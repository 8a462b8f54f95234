"""Language-model scoring with a gated recurrent network, in numpy inside Spark tasks.

Corpus counts. Every training token is counted: tasks count their words before the shuffle. Words of the
largest counts (at most ``HEAD``) go to the tasks as a table; all others, the tail, are looked up by a
join, so no table that grows with the corpus is broadcast. Texts are then read once more: each document's
ids are written, and training and scoring read these alone.

Network. The end and the ``OWN`` most frequent words of the table that occur ``LEAST`` times or more are read
and predicted as themselves, so that the vocabulary grows with the corpus counts up to ``OWN``; the classes are
as many as make a token's scores fewest. All other words are dealt by a digest to "rare" symbols, about the square root of their
number, which are read and predicted likewise. A gated recurrent unit reads token after token; the output
is a softmax over frequency classes times a softmax over the words of the class, both starting from the
corpus counts. A rare word has the probability of its symbol times its share among the symbol's words,
(c + 0.5) / (N + 0.5 (V + 1)), with N and V of these; all unknown words of a symbol together are one of
them, so probabilities sum to one.

Training. Back-propagation is truncated to windows of ``WINDOW`` tokens (up to ``LONGEST`` times as many where
documents are so long that few run side by side), with the state carried from window to window
and set to zero where a document begins. Every training document is learnt from once. The
documents are dealt into ``ROUNDS`` by a digest; in a round each task learns from its own documents,
starting from common weights, and steps only the rows of words that it reads and of classes that it
predicts. Steps are adaptive, with one sum of squares for a word's row, and the sums go on from round to
round. Of these rows alone it passes on the changes, which are averaged row by row by how often the row
was learnt from, piece by piece of the weights in as many tasks. What reaches the driver is one set of
weights. As tasks step on their own before weights are averaged, scores depend (a little) on how many tasks
the input has.

Scoring. Lanes of documents run side by side; the state is carried through whole documents.

A null or empty text is its end alone. A null key counts as an empty one when folds are dealt. Repeated
rows count as often as they occur and score alike. An empty table gives no rows; without training
documents every word is rare and unknown. Texts of any length are learnt from and scored whole, the state carried from begin to
end; only the key and the text are read, other columns may have any name.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import settle

HEAD = 200_000
#: Words that the network reads and predicts as themselves, at most: what bounds its size and the time for a token.
OWN = 8_192
#: Words that occur less often are rare: what is learnt of them must hold for words never seen.
LEAST = 3
HIDDEN = 16
WINDOW = 64
ROUNDS = 3
LANES = 512
LONGEST = 4
SCORE_LANES, SCORE_WINDOW, SCORE_LONGEST = 512, 128, 16
RATE = 0.2
#: Tokens a task holds at a time.
HELD = 1 << 22
#: What the squares of gradients of words' rows start from: a token's share of a window's mean loss.
SLOW = 1 / (LANES * WINDOW)
#: Pieces into which weights are cut for averaging.
PIECES = 16
#: Tasks, or groups of them, whose averages are taken together.
FAN = 32
#: Distinct words a task counts before it passes them on.
COUNTED = 1_000_000
#: Bytes of texts whose words are counted or encoded at a time, unless one text is longer.
TOGETHER = 1 << 23
#: Tokens whose classes are predicted at a time, so that their scores stay in a core's cache.
BLOCK = 256
#: Of "class" the last row and of "word" the last column are biases.
NAMES = ["read", "gate", "class", "word"]
#: Weights that are rows of ids; a row has one sum of squares.
BY_ID = ("read", "word")
END = b"\n"  # no word has white space
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of one text, said plainly; tasks cut many texts at once, into the same words."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return data.translate(_LOWER).split() if data else []


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """The batch in slices of about ``TOGETHER`` bytes of its texts, a column of strings. With each: the words of its texts, as ``words_of``
    gives them, and one end after them; the place among these of each token, ends included; and the number of tokens of each text."""
    ends = np.cumsum(pc.binary_length(batch.column(texts)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
    edges = np.flatnonzero(np.diff((ends - 1) // TOGETHER)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        if a == b:
            continue
        own = batch.slice(a, b - a)
        split = pc.ascii_split_whitespace(pc.ascii_lower(own.column(texts).fill_null("")))
        words = split.flatten()
        full = pc.binary_length(words).to_numpy() > 0  # white space at a text's ends leaves empty strings
        sizes = np.diff(np.r_[0, np.cumsum(full)][split.offsets.to_numpy() - split.offsets[0].as_py()])
        words = pa.concat_arrays([words.filter(pa.array(full)).cast(pa.binary()), pa.array([END], pa.binary())])
        yield own, words, np.insert(np.arange(len(words) - 1), np.cumsum(sizes), len(words) - 1), sizes + 1


@dataclass
class Head:
    """What tasks know of the corpus. ``words``: those of the largest counts by falling count; a word's place counts from 1 and has in ``every`` its
    count and in ``ids`` its id; up to ``known`` a word has an id of its own, beyond it a word is rare and has its symbol's. Place 0 is of all
    other words, the tail."""

    words: pa.Array
    ids: np.ndarray
    every: np.ndarray
    known: int
    tokens: int
    distinct: int
    rare_totals: np.ndarray  # of each rare symbol, N + 0.5 (V + 1)
    counts: np.ndarray  # of the ids: rare symbols, then words by frequency
    starts: np.ndarray  # where classes of ids begin, and the end

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """texts: text. Returns word (binary), n: of all words and ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for whole in batches:
            ends += whole.num_rows
            for _, words, _, _ in _slices(whole, 0):
                held.append(pa.table(words[:-1].value_counts().flatten(), names=["word", "n"]))
                size += held[-1].num_rows
                if size > COUNTED:
                    held = [_summed(held)]
                    size = held[0].num_rows
                    if size > COUNTED // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if ends:
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"]))
            yield from _summed(held).to_batches()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def head_of(counts: DataFrame) -> Head:
    """counts is settled. At most HEAD rows reach the driver, and a histogram of the counts' sizes."""
    size = F.floor(F.log2("n") * 16)
    bins = {r["b"]: r for r in counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()}
    taken, least = 0, None
    for b in sorted(bins, reverse=True):
        if taken + bins[b]["v"] > HEAD:
            break
        taken, least = taken + bins[b]["v"], bins[b]["least"]
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    ranked = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))
    distinct, tokens = sum(r["v"] for r in bins.values()), sum(r["n"] for r in bins.values())
    known = min(OWN, sum(n >= LEAST for _, n in ranked))
    end = next((k for k, (w, _) in enumerate(ranked) if w == END), 0)
    if ranked and end >= known:  # the end is always an id
        ranked.insert(known, ranked.pop(end))
        known += 1
    every = np.array([0, *(n for _, n in ranked)], "f8")
    symbols = math.isqrt(max(0, distinct - known)) + 1
    rare_tokens, rare_distinct = np.zeros(symbols), np.zeros(symbols)
    beyond = counts.where(F.col("n") < least) if least is not None else counts
    for r in beyond.groupBy((F.crc32("word") % symbols).alias("s")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect():
        rare_tokens[r["s"]], rare_distinct[r["s"]] = r["n"], r["v"]
    for w, n in ranked[known:]:
        rare_tokens[_symbol(w, symbols)] += n
        rare_distinct[_symbol(w, symbols)] += 1
    sizes = np.r_[np.maximum(1.0, rare_tokens), np.maximum(1.0, every[1 : known + 1])]
    # with s_i the square root of a word's share, classes of equal sum of s give a token about n + (sum of s)^2 / n scores: least where n is that sum
    mass = np.cumsum(np.sqrt(sizes / sizes.sum()))
    classes = math.ceil(mass[-1])
    inner = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    starts = np.unique(np.r_[0, symbols, inner, len(sizes)])
    ids = np.array([0, *range(symbols, symbols + known), *(_symbol(w, symbols) for w, _ in ranked[known:])], "i4")
    return Head(pa.array([w for w, _ in ranked], pa.binary()), ids, every, known, tokens, distinct, rare_tokens + 0.5 * (rare_distinct + 1), sizes, starts[starts <= len(sizes)])


def _symbol(word: bytes, symbols: int) -> int:
    return zlib.crc32(word) % symbols


def _order(numbers: np.ndarray, limit: int) -> np.ndarray:
    """The stable order of numbers from 0 and under the limit; small ones are sorted by digits."""
    return np.argsort(numbers.astype("u2") if limit <= 1 << 16 else numbers, kind="stable")


def _softmax(states: np.ndarray, weights: np.ndarray, at: np.ndarray, to: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the scores, their sums by row, and the log-probabilities of ``to``."""
    p = states @ weights
    picked = p[at, to]
    np.exp(p, out=p)
    total = p @ ones[: p.shape[1]]
    if not (total.min() > 1e-30 and total.max() < 1e30):  # out of range: once more, from the largest score of each row
        p = states @ weights
        p -= p.max(1, keepdims=True)
        picked = p[at, to]
        np.exp(p, out=p)
        total = p.sum(1)
    return p, total, picked - np.log(total)


class Network:
    """``weights`` by name and, under the same names, ``squares``: the sums of squared gradients by which steps are scaled."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, hidden: int = HIDDEN, seed: int = 1, flat: np.ndarray | None = None):
        rng, v = np.random.default_rng(seed), len(counts)
        self.starts, self.hidden = starts, hidden
        self.of = np.searchsorted(starts, np.arange(v), "right") - 1  # class of an id
        per_class = np.add.reduceat(counts, starts[:-1])
        #: How often rows were learnt from: by reading an id, by predicting a class.
        self.reads, self.predicted = np.zeros(v, "i8"), np.zeros(len(starts) - 1, "i8")
        self.weights = {
            "read": rng.normal(0, 0.1, (v, 3 * hidden)) if flat is None else np.zeros((v, 3 * hidden), "f4"),
            "gate": rng.normal(0, 1 / math.sqrt(hidden), (hidden, 3 * hidden)),
            "class": np.r_[np.zeros((hidden, len(starts) - 1)), np.log(per_class / counts.sum())[None]],
            "word": np.c_[np.zeros((v, hidden)), np.log(counts / per_class[self.of])],
        }
        self.weights["read"][:, :hidden] += 1.0  # keep the state at first
        self.weights = {k: w.astype("f4") for k, w in self.weights.items()}
        # a predicted row's first steps follow the size of its gradient
        self.squares = {k: np.full((len(w), 1) if k in BY_ID else w.shape, SLOW**2 if k == "word" else 0, "f4") for k, w in self.weights.items()}
        if flat is not None:
            self.load(flat)

    def arrays(self) -> dict[str, np.ndarray]:
        return self.weights | {f"{k}_squares": x for k, x in self.squares.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays().values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for part in (self.weights, self.squares):
            for k, w in part.items():
                part[k] = flat[at : at + w.size].reshape(w.shape).astype("f4")
                at += w.size

    def step(self, name: str, rows, grad: np.ndarray) -> None:
        """One adaptive step against a gradient."""
        squares = self.squares[name]
        squares[rows] += np.einsum("ij,ij->i", grad, grad)[:, None] / grad.shape[1] if name in BY_ID else grad * grad
        self.weights[name][rows] -= grad * (RATE / (np.sqrt(squares[rows]) + 1e-6))

    def changes(self, start: np.ndarray, learnt: int) -> list[bytes]:
        """From what ``flat`` was, ``start``, of the rows that were learnt from: by name its rows, which they are, how often each was learnt from
        and its change, that of weights in 16 bits; a piece for each range of ids, and one for the weights that are no id's."""
        now = self.arrays()
        before = {k: x.reshape(now[k].shape) for k, x in zip(now, np.split(start, np.cumsum([x.size for x in now.values()])[:-1]), strict=True)}
        times = {"read": self.reads, "word": self.predicted[self.of]}
        times |= {f"{k}_squares": n for k, n in times.items()}
        limit, pieces = np.finfo("f2").max, []
        for k in range(PIECES):
            ids = slice(len(self.of) * k // PIECES, len(self.of) * (k + 1) // PIECES)
            own = {}
            for name, n in times.items():
                rows = np.flatnonzero(n[ids])
                change = (now[name][ids] - before[name][ids])[rows]
                own[name] = len(n[ids]), rows.astype("i4"), n[ids][rows].astype("i4"), np.clip(change, -limit, limit).astype("f2") if name in BY_ID else change
            pieces.append(own)
        common = {k: x - before[k] for k, x in now.items() if k not in times}
        pieces.append({k: (len(x), np.arange(len(x)), np.full(len(x), learnt), x) for k, x in common.items()})
        return [pickle.dumps(x) for x in pieces]

    def run(self, tokens: np.ndarray, begins: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """tokens, begins: step x lane. Returns the states before each token and the last one."""
        n, read = self.hidden, self.weights["read"]
        # a unit of all lanes stands in one piece of memory, and so does each part of a step
        gate = np.ascontiguousarray(self.weights["gate"].T)
        states, ended = np.empty((len(tokens) + 1, n, tokens.shape[1]), gate.dtype), begins.any(1).tolist()
        states[0] = state.T
        for t, h in enumerate(states[:-1]):
            if ended[t]:
                h *= ~begins[t]
            u, x = gate @ h, read[tokens[t]].T
            gates, own, c = u[: 2 * n], u[2 * n :], states[t + 1]
            gates += x[: 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:n], gates[n:]
            if keep is None:
                own *= r
                own += x[2 * n :]
                c = np.tanh(own, out=own)
            else:
                c = r * own
                c += x[2 * n :]
                np.tanh(c, out=c)
                keep.append((z, r, c, own))
            after = np.subtract(h, c, out=states[t + 1])
            after *= z
            after += c
        return states[:-1].transpose(0, 2, 1), states[-1].T

    def log_softmax(self, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None, scale: float = 1.0) -> np.ndarray:
        """Natural log-probability of each target. With ``gradients``, adds the gradients of the loss' sum times ``scale``: of the classes' and
        the words' weights and, as ``states``, of the states."""
        w, n, size = self.weights, len(targets), self.hidden
        order = _order(self.of[targets], len(self.starts))
        s, kind, mine = np.ones((n, size + 1), states.dtype), self.of[targets[order]], np.arange(n)
        s[:, :size] = states[order]  # the last column meets the biases
        found, d = np.empty(n, states.dtype), np.empty((n, size), states.dtype)
        ones = np.ones(max(len(self.starts), int(np.diff(self.starts).max())), states.dtype)
        if gradients is not None:
            gradients |= {"class": np.zeros_like(w["class"]), "word": np.zeros_like(w["word"])}
        back = np.ascontiguousarray(w["class"][:size].T)
        with np.errstate(over="ignore", divide="ignore"):
            for k in range(0, n, BLOCK):
                own, to, at = s[k : k + BLOCK], kind[k : k + BLOCK], mine[: min(BLOCK, n - k)]
                p, total, found[k : k + BLOCK] = _softmax(own, w["class"], at, to, ones)
                if gradients is not None:
                    p *= (scale / total)[:, None]
                    p[at, to] -= scale
                    gradients["class"] += own.T @ p
                    d[k : k + BLOCK] = p @ back
            edges = np.searchsorted(kind, np.arange(len(self.starts)))
            if gradients is not None:
                self.predicted += np.diff(edges)
            places, starts, ends = targets[order] - self.starts[kind], self.starts.tolist(), edges.tolist()
            for k in np.flatnonzero(np.diff(edges) * (np.diff(self.starts) > 1)).tolist():
                a, b, x, y = starts[k], starts[k + 1], ends[k], ends[k + 1]
                own, words, at, to = s[x:y], w["word"][a:b], mine[: y - x], places[x:y]
                p, total, own_found = _softmax(own, words.T, at, to, ones)
                found[x:y] += own_found
                if gradients is not None:
                    p *= (scale / total)[:, None]
                    p[at, to] -= scale
                    d[x:y] += p @ words[:, :size]
                    gradients["word"][a:b] = p.T @ own
        out = np.empty_like(found)
        out[order] = found
        if gradients is not None:
            gradients["states"] = np.empty_like(d)
            gradients["states"][order] = d
        return out

    def learn(self, tokens: np.ndarray, begins: np.ndarray, valid: np.ndarray, state: np.ndarray, whole: int = 0) -> np.ndarray:
        """One window: forward, back through its steps, one adaptive gradient step. Returns the state to carry on. With ``whole``, the
        tokens of a full window, a token weighs as much in a window where few lanes still run."""
        n, keep, g = self.hidden, [], {}
        states, last = self.run(tokens, begins, state, keep)
        flat = np.flatnonzero(valid.ravel())
        scale = 1 / max(1, whole or len(flat))
        self.log_softmax(states.reshape(-1, n)[flat], tokens.ravel()[flat], g, scale)
        d_states = np.zeros((tokens.size, n), "f4")
        d_states[flat] = g.pop("states")
        d_states, states = d_states.reshape(states.shape).transpose(0, 2, 1), states.transpose(0, 2, 1)
        gate = self.weights["gate"]
        d_read, d_gate = np.empty((tokens.size, 3 * n), "f4"), np.empty((3 * n, tokens.shape[1]), "f4")
        d_z, d_r, d_u = d_gate[:n], d_gate[n : 2 * n], d_gate[2 * n :]
        dh, ended, width = np.zeros_like(states[0]), begins.any(1).tolist(), tokens.shape[1]
        g["gate"] = np.zeros_like(gate)
        for t in range(len(tokens) - 1, -1, -1):
            (z, r, c, u), h, own = keep[t], states[t], d_read[t * width : (t + 1) * width].T
            rest = 1 - z
            rest *= dh
            np.subtract(h, c, out=d_z)
            d_z *= z
            d_z *= rest
            rest -= rest * c * c
            np.multiply(rest, u, out=d_r)
            d_r *= r
            own[2 * n :] = rest
            rest *= r
            d_u[...] = rest
            np.subtract(1, r, out=r)
            d_r *= r
            own[: 2 * n] = d_gate[: 2 * n]
            g["gate"] += h @ d_gate.T
            dh *= z
            dh += gate @ d_gate
            dh += d_states[t]
            if ended[t]:
                dh *= ~begins[t]
        ids = tokens.ravel()
        order = _order(ids, len(self.of))
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        at = ids[order][first]
        sums = np.add.reduceat(d_read[order], first, axis=0)
        for name, grad in g.items():
            self.step(name, slice(None), grad)
        self.reads[at] += np.diff(np.r_[first, len(ids)])
        self.step("read", at, sums)
        return last


def lanes(sizes: list[int], width: int) -> list[list[int]]:
    """Documents (by place) for each lane, the longest first and always to the shortest lane; lanes by falling length."""
    import heapq

    heap = [(0, k) for k in range(min(width, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in sorted(range(len(sizes)), key=lambda d: (-sizes[d], d)):
        size, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (size + sizes[d], k))
    return sorted(out, key=lambda own: (-sum(sizes[d] for d in own), own))


def windows(docs: list[np.ndarray], width: int, steps: int, longest: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """tokens, begins, valid and document, each step x lane, of the lanes that still run.

    A long document takes one lane for itself, so that few lanes would be left at last: then lanes are fewer (and longer) from the start,
    and windows have up to ``longest`` times as many steps, so that they hold about as many tokens throughout.
    """
    total, most = sum(map(len, docs)), max(map(len, docs), default=1)
    dealt = lanes([len(d) for d in docs], min(width, max(1, width // longest, total // most)))
    streams = [np.concatenate([docs[d] for d in own]) for own in dealt]
    marks = [np.repeat(np.array(own, "i4"), [len(docs[d]) for d in own]) for own in dealt]
    starts = [np.concatenate([np.r_[True, np.zeros(len(docs[d]) - 1, bool)] for d in own]) for own in dealt]
    sizes, at = np.array([len(s) for s in streams]), 0
    while n := int((sizes > at).sum()):
        size = max(steps, min(steps * longest, steps * width // n))
        tokens, begins = np.zeros((size, n), "i4"), np.zeros((size, n), bool)
        valid, doc = np.zeros((size, n), bool), np.zeros((size, n), "i4")
        for k in range(n):
            own = slice(at, at + size)
            m = len(streams[k][own])
            tokens[:m, k], begins[:m, k], valid[:m, k], doc[:m, k] = streams[k][own], starts[k][own], True, marks[k][own]
        yield tokens, begins, valid, doc
        at += size


def _ranks(words: list[bytes] | pa.Array, head: Head) -> np.ndarray:
    found = pc.index_in(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()), value_set=head.words)
    return found.fill_null(-1).to_numpy() + np.int32(1)


def _ids(words: list[bytes] | pa.Array, ranks: np.ndarray, head: Head) -> np.ndarray:
    ids, symbols = head.ids[ranks], len(head.rare_totals)
    tail = np.flatnonzero(ranks == 0)
    found = words.take(pa.array(tail)).to_numpy(zero_copy_only=False).tolist() if isinstance(words, pa.Array) else [words[i] for i in tail.tolist()]
    ids[tail] = [_symbol(w, symbols) for w in found]
    return ids


def train_round(encoded: DataFrame, layout, flat: np.ndarray) -> np.ndarray:
    """encoded: ids; layout: counts and starts of the head. Each task learns from its documents; returns the average of their weights.

    Averages are taken in a tree: those of ``FAN`` tasks first, then of ``FAN`` such groups, so that no task adds up the changes of all.
    """
    start = encoded.sparkSession.sparkContext.broadcast(flat)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = Network(*layout.value, flat=start.value)
        held, size, learnt = [], 0, 0

        def go() -> None:
            state = np.zeros((LANES, net.hidden), "f4")
            for tokens, begins, valid, _ in windows(held, LANES, WINDOW, LONGEST):
                state = net.learn(tokens, begins, valid, state[: tokens.shape[1]], LANES * WINDOW)

        for batch in batches:
            for ids in batch.column(0).to_pylist():
                held.append(np.frombuffer(ids, "<i4"))
                size += len(held[-1])
                if size >= HELD:
                    go()
                    held, size, learnt = [], 0, learnt + size
        if held:
            go()
            learnt += size
        if learnt and np.isfinite(net.flat()).all():
            changes = net.changes(start.value, learnt)
            part = [TaskContext.get().partitionId()] * (PIECES + 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES + 1), pa.int32()), pa.array(part, pa.int64()), pa.array(changes, pa.binary())], names=["piece", "part", "changes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by piece and part: one row for each, the mean of its rows and how often each was learnt."""
        now, sums = None, {}

        def done() -> pa.RecordBatch:
            merged = {}
            for name, (total, times) in sums.items():
                rows = np.flatnonzero(times)
                n = times[rows]
                merged[name] = (len(times), rows, n, total[rows] / n.reshape(-1, *(1 for _ in total.shape[1:])))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([pickle.dumps(merged)], pa.binary())], names=["piece", "part", "changes"])

        for batch in batches:
            for piece, part, changes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is not None and now != (piece, part):
                    yield done()
                    sums = {}
                now = piece, part
                for name, (size, rows, n, change) in pickle.loads(changes).items():
                    total, times = sums.setdefault(name, (np.zeros((size, *change.shape[1:])), np.zeros(size)))
                    n = np.broadcast_to(n, len(change)).astype("f8")
                    total[rows] += n.reshape(-1, *(1 for _ in change.shape[1:])) * change
                    times[rows] += n
        if now is not None:
            yield done()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        times: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            for piece, changes in zip(*(batch.column(i).to_pylist() for i in (0, 2)), strict=True):
                for name, (size, rows, n, change) in pickle.loads(changes).items():
                    k = piece, name
                    if k not in sums:
                        sums[k], times[k] = np.zeros((size, *change.shape[1:])), np.zeros((size, *(1 for _ in change.shape[1:])))
                    n = n.reshape(-1, *(1 for _ in change.shape[1:])).astype("f8")
                    sums[k][rows] += n * change
                    times[k][rows] += n
        means = {k: (x / np.maximum(1, times[k])).astype("f4") for k, x in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in means], pa.int32()), pa.array([k[1] for k in means], pa.string()), pa.array([x.tobytes() for x in means.values()], pa.binary())], names=["piece", "name", "change"])

    learnt, tasks = encoded.mapInArrow(learn, "piece int, part long, changes binary"), encoded.rdd.getNumPartitions()  # written once, by the shuffle
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        groups = learnt.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).repartition((PIECES + 1) * tasks, "piece", "part")
        learnt = groups.sortWithinPartitions("piece", "part", "changes").mapInArrow(merge, "piece int, part long, changes binary")
    rows = learnt.repartition(PIECES + 1, "piece").sortWithinPartitions("piece", "part", "changes").mapInArrow(average, "piece int, name string, change binary").collect()
    start.destroy()
    found: dict[str, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        found.setdefault(r["name"], []).append(np.frombuffer(bytes(r["change"]), "f4"))
    return flat + np.concatenate([x for name in [*NAMES, *(f"{k}_squares" for k in NAMES)] for x in found[name]]) if found else flat


CARRIED = {"id": "long", "key": "string", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "n_tail": "long"}
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
ENCODED = ", ".join(f"{k} {kind}" for k, kind in CARRIED.items()) + ", turn long, tail array<binary>, ids binary"


def encode(docs: DataFrame, head) -> DataFrame:
    """docs: key, text, held_out, turn. A row per row: sums over the words that the head has (``score``: the rare words' shares of their
    symbols), the tail words, and the ids, little-endian 32-bit."""
    kinds = {k: _KINDS[kind] for k, kind in CARRIED.items()} | {"turn": pa.int64(), "tail": pa.list_(pa.binary()), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = head.value
        number = TaskContext.get().partitionId() << 33
        logs = np.log10(own.every + 0.5)
        unit, rare_units = math.log10(own.total), np.log10(own.rare_totals)
        rare = np.arange(len(logs)) > own.known
        shares = np.where(rare, logs - rare_units[np.minimum(own.ids, len(rare_units) - 1)], 0)
        base = logs - unit
        logs[0] = shares[0] = 0
        base[0] = -unit  # what the counts of tail words add comes later
        for whole in batches:
            for batch, words, places, sizes in _slices(whole, 1):
                found = _ranks(words, own)
                ids, ranks = _ids(words, found, own)[places], found[places]
                starts, tail = np.cumsum(np.r_[0, sizes[:-1]]), np.flatnonzero(ranks == 0)
                share = shares[ranks]
                share[tail] = -rare_units[ids[tail]]
                data, ends = ids.astype("<i4").tobytes(), [*starts[1:].tolist(), len(ids)]
                words = words.take(pa.array(places[tail]))
                n_tail = np.bincount(np.searchsorted(starts, tail, "right") - 1, minlength=len(sizes))
                columns = [
                    pa.array(np.arange(number, number + len(sizes))), batch.column(0), batch.column(2), pa.array(sizes), pa.array(sizes - n_tail), pa.array(np.add.reduceat(base[ranks], starts)),
                    pa.array(np.add.reduceat(share, starts)), pa.array(n_tail.astype("i8")), batch.column(3), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_tail)], pa.int32()), words),
                    pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()),
                ]
                number += len(sizes)
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return docs.mapInArrow(run, ENCODED)


def score(encoded: DataFrame, layout, flat: np.ndarray) -> DataFrame:
    """encoded: what is carried, ids; layout: counts and starts of the head. Adds the model's log10 probability of the ids to ``score``."""
    held_weights = encoded.sparkSession.sparkContext.broadcast(flat)
    names = list(CARRIED)
    place = names.index("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*layout.value, flat=held_weights.value)
        rows, held, size = [], [], 0

        def done() -> pa.RecordBatch:
            columns = [pa.concat_arrays(x) for x in zip(*rows, strict=True)]
            columns[place] = pa.array(columns[place].to_numpy() + log_probability(net, held) / math.log(10))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows.append([batch.column(k) for k in names])
                held += [np.frombuffer(ids, "<i4") for ids in batch.column("ids").to_pylist()]
                size += sum(map(len, held[-batch.num_rows :]))
                if size >= HELD:
                    yield done()
                    rows, held, size = [], [], 0
        if rows:
            yield done()

    return encoded.select(*names, "ids").mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in CARRIED.items()))


def log_probability(net: Network, docs: list[np.ndarray], lanes: int = SCORE_LANES, steps: int = SCORE_WINDOW, longest: int = SCORE_LONGEST) -> np.ndarray:
    """Natural log-probability of each document's ids, the state carried from its begin to its end."""
    out, state = np.zeros(len(docs)), np.zeros((lanes, net.hidden), "f4")
    for tokens, begins, valid, doc in windows(docs, lanes, steps, longest):
        states, state = net.run(tokens, begins, state[: tokens.shape[1]])
        own = valid.ravel()
        got = net.log_softmax(states.reshape(-1, net.hidden)[own], tokens.ravel()[own])
        out += np.bincount(doc.ravel()[own], got.astype("f8"), len(docs))
    return out


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """A row per row: key (as text), held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    name = F.col(key).cast("string")
    held_out = F.crc32(F.coalesce(name, F.lit(""))) % folds == held_fold
    rows = docs.select(name.alias("key"), F.col(text).cast("string").alias("text"), held_out.alias("held_out"))
    counts = settle(word_counts(rows.where(~F.col("held_out")).select("text")), "counts")
    head = head_of(counts)
    shared = spark.sparkContext.broadcast(head)  # at most HEAD words
    turn = F.pmod(F.xxhash64("key", "text"), F.lit(ROUNDS)).alias("turn")
    encoded = settle(encode(rows.select("key", "text", "held_out", turn), shared), "encoded")
    flat, layout = Network(head.counts, head.starts).flat(), spark.sparkContext.broadcast((head.counts, head.starts))
    for k in range(ROUNDS):
        flat = train_round(encoded.where(~F.col("held_out") & (F.col("turn") == k)).select("ids"), layout, flat)
    scored = settle(score(encoded, layout, flat), "scored")
    tail = encoded.select("id", F.explode("tail").alias("word"))
    known = tail.join(counts.withColumnRenamed("n", "c"), "word")  # tail words that were never seen drop out here
    sums = known.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.log10(F.col("c") + 0.5) - math.log10(0.5)).alias("l"))
    more = F.coalesce("l", F.lit(0.0)) + F.col("n_tail") * math.log10(0.5)
    return scored.join(sums, "id", "left").select(
        "key", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs).withColumn("doc_id", F.col("key").cast("long")).drop("key")
