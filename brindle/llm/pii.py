"""Personal data by fixed patterns and a skip-chain conditional random field.

The base patterns give spans of e-mail addresses, IP addresses, card numbers and phone numbers. The
field labels tokens (white-space words) with those kinds, ``secret`` or nothing. Each token has a
potential from its features; neighbours share a transition potential; tokens of one document that
repeat (equal letters and digits, six at least) or else are similar (equal letters, and digits in equal
places) share a skip potential, which is for agreement whatever the label, with the first such token, however far it is: what is known of one reaches all others in two steps.
Labels are read from marginals after loopy message passing over each document's
whole graph, so that an entity found by its context in one place is found in its other places too. Each document's messages are passed
until they settle, whatever other documents are passed with them: after ``SWEEPS`` sweeps more heavily damped, and those that have not
settled after ``MOST_SWEEPS`` are told by ``p_settled``.
Telling tokens are those with a digit or an at sign, named values (as below), tokens of ``LONG`` characters of
keys or more, and all repetitions of these; they and what lies within ``REACH`` tokens of them are always in the
graph, and only telling tokens have skip edges. Every other token is scored too, and clamped to "nothing" if the
weights prove that it is nothing with odds of 1 to ``PROVEN`` or better whatever its neighbours are: a neighbour can add no
more than the largest difference of transition potentials. Tokens without that proof are in the graph. Fitting
looks at the surroundings of telling tokens alone.

Weights maximise the pseudo-likelihood of weakly labelled documents: labels are the base spans and the
values of key = value pairs that name a token, key, secret or password; the surroundings of at most ``LETTERED`` such values are
learnt from a second time, with letters for the value's digits, so that names count for values of letters alone. At most ``TRAIN_ROWS`` rows of at
most ``TRAIN_CHARS`` characters are used, chosen by digest from all that qualify; these are the bounds on rows.

The field only adds spans: base spans stay, and an added span overlaps none of them. A null or empty text
has no spans. Repeated rows give equal results. Extra columns pass through; results are prefixed ``p_``
and replace columns of those names.
An empty table gives no rows; with no labelled rows no span is added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import without

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["", *KINDS, "secret"]
TRAIN_ROWS, TRAIN_CHARS, LETTERED = 3000, 20_000, 500
REACH = 2
LONG = 16
#: Odds of being anything, at most, with which a token is left out of the graph.
PROVEN = 0.01
#: Distinct tokens, and their characters, whose scores a worker remembers; tokens scored at a time.
MET, MET_CHARS, SCORED = 1 << 18, 1 << 24, 1 << 16
#: Bytes of text whose graphs are held together.
TOGETHER = 4 << 20
#: Message-passing sweeps before more damping, and at most; the change of a document's messages that ends them.
SWEEPS, MOST_SWEEPS, SETTLED = 50, 500, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TELLING = re.compile(r"[0-9@]")
_LONG = re.compile(rf"[A-Za-z0-9/+_-]{{{LONG},}}")
_TOKEN = re.compile(r"\S+")
_DIGITS = frozenset("0123456789")
_EDGES = "%#*$&!|\"'.,;:()[]{}<>?"
_NAMED = r"(?i)(?:\b|_)(?:token|secret|password|passwd|api[_-]?key|key)[\x20\x09]*[:=][\x20\x09]*[\"']?"
_NAMED_BEFORE, _NAMED_INSIDE = re.compile(_NAMED + r"\Z"), re.compile(_NAMED + rf"[A-Za-z0-9/+_-]{{{LONG},}}")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)[\x20\x09]*[:=][\x20\x09]*[\"']?([A-Za-z0-9/+_-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs: a local part is the run before one, back to the last match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base patterns, by kind and start."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _TELLING.search(text):
        spans += [("ip", *s) for s in _ips(text)]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return spans


@dataclass
class Graph:
    """Tokens of some documents that are not clamped, and what joins them."""

    doc: list[int] = field(default_factory=list)
    span: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    clamped: list[int] = field(default_factory=list)  # neighbours (or text ends) that are "nothing"
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    own = text[start:end]
    left = len(own) - len(own.lstrip(_EDGES))
    return (start + left, max(start + left, start + len(own.rstrip(_EDGES)))) if left < len(own) else (start, end)


def _own_features(core: str) -> list[str]:
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", core)))
    digits = re.sub(r"[^0-9]", "", core)
    mixed = bool(re.fullmatch(r"[A-Za-z0-9/+_-]{16,}", core)) and bool(digits) and len(digits) < len(core)
    out = ["bias", f"shape={shape if len(shape) <= 10 else 'long'}", f"digits={min(len(digits), 20)}", f"chars={min(len(core), 48) // 4}", f"mixed={mixed}"]
    if "@" in core:
        out.append(f"at={bool(_DOMAIN.search(core.rpartition('@')[2])) and core[0] in _LOCAL}")
    if core.count(".") == 3:
        out.append(f"ip={bool(_ips(core))}")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    out.append(f"plus={core[:1] == '+'}")
    return out


@cache
def _letters(length: int) -> tuple[str, ...]:
    return tuple(_own_features("a" * length))


def _as_neighbour(core: str) -> str:
    """What a token is to those beside it: a short word of letters itself, any other its first character."""
    if len(core) <= 12 and core.isascii() and core.isalpha() or core in ("=", ":"):
        return core.lower()
    first = core[:1].lower()[:1]
    return "9" if first in _DIGITS else first


def _beside(name: str, core: str) -> str:
    """The feature that a token has from its neighbour."""
    return f"{name}={_as_neighbour(core)}"


def _features(cores: list[str], k: int) -> list[str]:
    at = lambda j: cores[j] if 0 <= j < len(cores) else ""
    own = _letters(min(len(cores[k]), 48)) if cores[k].isalpha() else _own_features(cores[k])
    return [*own, _beside("before", at(k - 1)), _beside("after", at(k + 1))]


def _key(token: str) -> str:
    return re.sub(r"[\W_]", "", token).lower()


def _spans(text: str, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends: at once if single characters part them."""
    if int(lengths.sum()) + len(words) - 1 == len(text):
        starts = np.cumsum(lengths + 1) - lengths - 1
    else:
        starts = np.fromiter((m.start() for m in _TOKEN.finditer(text)), "i8", len(words))
    return starts, starts + lengths


def add_document(graph: Graph, doc: int, text: str, model: Model | None = None) -> None:
    """Adds a text's graph; with a model, tokens that it does not prove to be nothing are in it too."""
    words = text.split()
    if not words:
        return
    if model:
        ids = model.places(words)
        doubtful, marked, plain, lengths = model.doubtful_at(ids), model.telling[ids], model.plain[ids], model.lengths[ids]
    else:
        doubtful, lengths = np.zeros(0, "i8"), np.fromiter(map(len, words), "i8", len(words))
        marked = np.fromiter((_TELLING.search(w) is not None for w in words), bool, len(words))
        plain = ~marked & np.fromiter((_is_long(w) for w in words), bool, len(words))
    if not len(doubtful) and not marked.any() and not plain.any():
        return
    if plain.any():  # what repeats a token with digits has digits
        if model:
            again = np.zeros(len(words), bool)
            some = np.flatnonzero(lengths >= 6)
            again[some] = np.isin(model.keys_of(ids[some]), model.keys_of(ids[plain]))
        else:
            keys = {_key(words[k]) for k in np.flatnonzero(plain).tolist()}
            again = np.fromiter((len(w) >= 6 and _key(w) in keys for w in words), bool, len(words))
        marked = marked | plain | again & (lengths >= 6)
    held = np.zeros(len(words), bool)
    for by in range(-REACH, REACH + 1):
        held[max(0, by) : len(words) + min(0, by)] |= marked[max(0, -by) : len(words) - max(0, by)]
    held[doubtful] = True
    kept = np.flatnonzero(held)
    starts, ends = _spans(text, words, lengths)
    clamped = (np.r_[False, held[:-1]][kept] ^ True).astype(int) + (np.r_[held[1:], False][kept] ^ True)
    node: dict[int, int] = {}
    first: dict[str, int] = {}
    alike: dict[str, int] = {}
    core: dict[int, tuple[int, int]] = {}

    def core_of(j: int) -> tuple[int, int]:
        if j not in core:
            core[j] = _core(text, int(starts[j]), int(ends[j]))
        return core[j]

    for k, around in zip(kept.tolist(), clamped.tolist(), strict=True):
        i = node[k] = len(graph.doc)
        near = [text[slice(*core_of(j))] if 0 <= j < len(words) else "" for j in (k - 1, k, k + 1)]
        graph.doc.append(doc)
        graph.span.append(core_of(k))
        graph.features.append(_features(near, 1) + (["named"] if _is_long(near[1]) and _named(text, *core_of(k)) else []))
        graph.clamped.append(around)
        if k - 1 in node:
            graph.chain.append((node[k - 1], i))
        if marked[k] and len(key := _key(near[1])) >= 6:
            like = re.sub(r"[0-9]", "0", key)
            if key in first:
                graph.skip.append((first[key], i))
            elif like in alike and not like.isdigit():
                graph.skip.append((alike[like], i))
            first.setdefault(key, i)
            alike.setdefault(like, i)


def _named(text: str, start: int, end: int) -> bool:
    """Whether a name of secrets stands before a token, or begins it. Only long tokens, which are always in the graph, are asked."""
    return _NAMED_BEFORE.search(text[max(0, start - 40) : start]) is not None or _NAMED_INSIDE.match(text, start, end) is not None


def _is_long(word: str) -> bool:
    return len(word) >= LONG and _LONG.search(word) is not None


class _Met(dict):
    """Places of tokens in a worker's memory; a new one is entered when it is asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> int:
        return self.model._meet(token)


@dataclass
class Model:
    index: dict[str, int]
    unary: np.ndarray  # feature x label
    chain: np.ndarray  # label x label
    skip: np.ndarray  # label x label, symmetric

    def __post_init__(self):
        self.forget()
        size = len(LABELS)
        #: The most that two neighbours' labels can add to a label over nothing.
        self.most = 2 * np.maximum((self.chain - self.chain[:, :1]).max(0), (self.chain.T - self.chain.T[:, :1]).max(0))[1:]
        #: The most that the words before and after can add.
        gain = lambda name: np.max([np.zeros(size), *(self.unary[j] - self.unary[j, 0] for n, j in self.index.items() if n.startswith(name))], 0)[1:]
        self.beside = gain("before=") + gain("after=")

    def forget(self) -> None:
        """Empties what a worker remembers: places of tokens it has met; of each its rows (own, as the token before, as the token after), the most its odds can
        be, and what it is; scores of rows."""
        self.met, self.met_chars, self.known, self.key_ids, self.tokens = _Met(self), 0, {}, {}, []
        self.letter_rows: dict[int, int] = {}
        self.rows, self.bounds, self.sums = np.zeros((1024, 3), "i8"), np.zeros(1024), np.zeros((1024, len(LABELS)))
        self.telling, self.plain, self.lengths, self.keys = np.zeros(1024, bool), np.zeros(1024, bool), np.zeros(1024, "i8"), np.zeros(1024, "i8")

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("index", "unary", "chain", "skip")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _row(self, names: tuple[str, ...]) -> int:
        """The row that holds the summed scores of features; row 0 is zero."""
        row = self.known.get(names)
        if row is None:
            row = self.known[names] = len(self.known) + 1
            if row == len(self.sums):
                self.sums, self.bounds = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.bounds))
            own = self.sums[row] = sum((self.unary[self.index[n]] for n in names if n in self.index), np.zeros(len(LABELS)))
            self.bounds[row] = np.exp(np.minimum(50.0, own[1:] - own[0] + self.beside + self.most)).sum()
        return row

    def _meet(self, token: str) -> int:
        core = token.strip(_EDGES) or token
        if core.isalpha():  # to the features, words of letters differ in length alone
            size = min(len(core), 48)
            own = self.letter_rows.get(size)
            if own is None:
                own = self.letter_rows[size] = self._row(_letters(size))
        else:
            own = self._row(tuple(_own_features(core)))
        place = self.met[token] = len(self.tokens)
        self.tokens.append(token)
        self.met_chars += len(token)
        if place == len(self.rows):
            for name in ("rows", "telling", "plain", "lengths", "keys"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        near = _as_neighbour(core)
        before, after = f"before={near}", f"after={near}"
        self.rows[place] = own, self._row((before,)) if before in self.index else 0, self._row((after,)) if after in self.index else 0
        self.lengths[place], self.keys[place] = len(token), -1
        self.telling[place] = not token.isalpha() and _TELLING.search(token) is not None
        self.plain[place] = len(token) >= LONG and not self.telling[place] and _is_long(token)
        return place

    def keys_of(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the letters and digits of tokens by their places; found when they are asked for."""
        for place in np.unique(ids[self.keys[ids] < 0]).tolist():
            self.keys[place] = self.key_ids.setdefault(_key(self.tokens[place]), len(self.key_ids))
        return self.keys[ids]

    def places(self, tokens: list[str]) -> np.ndarray:
        if len(self.met) > MET or self.met_chars > MET_CHARS:
            self.forget()
        return np.fromiter(map(self.met.__getitem__, tokens), "i8", len(tokens))

    def doubtful(self, tokens: list[str]) -> list[int]:
        """Places of tokens in a row that may be something, by their scores and the most that two neighbours can add."""
        return self.doubtful_at(self.places(tokens)).tolist()

    def doubtful_at(self, ids: np.ndarray) -> np.ndarray:
        """The same of tokens by their places in memory. Most tokens are nothing whatever stands beside them; the words beside the others are looked at."""
        some = np.flatnonzero(self.bounds[self.rows[ids, 0]] >= PROVEN)
        if not len(some):
            return some
        end = self.met[""]
        before, after = np.where(some > 0, ids[some - 1], end), np.where(some + 1 < len(ids), ids[np.minimum(some + 1, len(ids) - 1)], end)
        out = []
        for k in range(0, len(some), SCORED):
            at = slice(k, k + SCORED)
            score = self.sums[self.rows[ids[some[at]], 0]] + self.sums[self.rows[before[at], 1]] + self.sums[self.rows[after[at], 2]]
            odds = np.exp(np.minimum(50.0, score[:, 1:] - score[:, :1] + self.most)).sum(1)
            out.append(some[at][odds >= PROVEN])
        return np.concatenate(out)


def _sums(model_index: dict[str, int], graph: Graph) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(i, j) for i, names in enumerate(graph.features) for n in names if (j := model_index.get(n)) is not None]
    found = np.array(pairs, "i8").reshape(-1, 2)
    return found[:, 0], found[:, 1]


def weak_labels(graph: Graph, texts: dict[int, str]) -> np.ndarray:
    """Label of each token by base spans and named values; a token inside a span has its kind."""
    spans = {d: [(LABELS.index(k), a, b) for k, a, b in base_spans(t)] + [(LABELS.index("secret"), *m.span(1)) for m in _SECRET.finditer(t)] for d, t in texts.items()}
    out = np.zeros(len(graph.doc), "i8")
    for i, (d, (a, b)) in enumerate(zip(graph.doc, graph.span, strict=True)):
        out[i] = next((k for k, x, y in spans[d] if a < y and x < b), 0)
    return out


#: Ways to name a value that are learnt beside those of the texts.
_FORMS = ("password = ", "api_key: ", "secret=", 'token="')
_IN_LETTERS = str.maketrans("0123456789", "oizeasgtbq")


def _lettered(texts: list[str]) -> list[str]:
    """The surroundings of named values with digits, at most ``LETTERED``, with letters in place of the digits."""
    found = []
    for text in texts:
        for m in _SECRET.finditer(text):
            if len(found) == LETTERED:
                return found
            if _TELLING.search(m[1]):
                (a, b), value = m.span(1), m[1].translate(_IN_LETTERS)
                before = text[max(0, m.start() - 80) : m.start()]
                found += [f"{before}{name}{value}{text[b : b + 80]}" for name in (text[m.start() : a], *_FORMS)][: LETTERED - len(found)]
    return found


def fit(texts: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Maximum pseudo-likelihood by gradient steps with momentum: each token's label given its neighbours' labels."""
    graph, size = Graph(), len(LABELS)
    texts = [*texts, *_lettered(texts)]
    for d, t in enumerate(texts):
        add_document(graph, d, t)
    counts = Counter(n for names in graph.features for n in names)
    index = {n: j for j, n in enumerate(sorted(n for n, c in counts.items() if c >= 3))}
    model = Model(index, np.zeros((len(index), size)), np.zeros((size, size)), np.zeros((size, size)))
    if not graph.doc:
        return model
    label = weak_labels(graph, dict(enumerate(texts)))
    n = len(label)
    rows, columns = _sums(index, graph)
    chain, skip = np.array(graph.chain, "i8").reshape(-1, 2), np.array(graph.skip, "i8").reshape(-1, 2)
    clamped = np.array(graph.clamped)
    one = np.eye(size)[label]
    # labels around each token, summed: to its left, to its right (clamped ones count half each side), by skips
    left, right, far = np.zeros((n, size)), np.zeros((n, size)), np.zeros((n, size))
    np.add.at(left, chain[:, 1], one[chain[:, 0]])
    np.add.at(right, chain[:, 0], one[chain[:, 1]])
    left[:, 0] += clamped / 2
    right[:, 0] += clamped / 2
    np.add.at(far, skip[:, 0], one[skip[:, 1]])
    np.add.at(far, skip[:, 1], one[skip[:, 0]])
    weights = [model.unary, model.chain, model.skip]
    speed = [np.zeros_like(w) for w in weights]
    per_feature = np.maximum(1.0, np.bincount(columns, minlength=len(index)))[:, None] if len(index) else np.ones((0, 1))
    for _ in range(rounds):
        score = left @ model.chain + right @ model.chain.T + far @ model.skip
        np.add.at(score, rows, model.unary[columns])
        p = np.exp(score - score.max(1, keepdims=True))
        gap = one - p / p.sum(1, keepdims=True)
        unary = np.zeros_like(model.unary)
        np.add.at(unary, columns, gap[rows])
        to_skip = np.eye(size) * np.trace(far.T @ gap) / size  # to agree is worth the same whatever the label
        steps = [unary / np.sqrt(per_feature * n), (left.T @ gap + (right.T @ gap).T) / n, (to_skip + to_skip.T) / max(1, len(skip))]
        for w, v, g in zip(weights, speed, steps, strict=True):
            v *= 0.9
            v += rate * (g - decay * w)
            w += v
    return Model(index, *weights)  # anew: what it keeps is made from its weights


def beliefs(graph: Graph, model: Model) -> tuple[np.ndarray, set[int]]:
    """Beliefs of each token after loopy sum-product message passing over chains and skips, and the documents whose messages did not settle.

    A document's messages are passed until they settle, and stay then: its beliefs are those it has alone.
    """
    n, size = len(graph.doc), len(LABELS)
    score = np.zeros((n, size))
    rows, columns = _sums(model.index, graph)
    np.add.at(score, rows, model.unary[columns])
    score += np.array(graph.clamped)[:, None] / 2 * (model.chain[0] + model.chain[:, 0])
    chain, skip = np.array(graph.chain, "i8").reshape(-1, 2), np.array(graph.skip, "i8").reshape(-1, 2)
    a, b = np.concatenate([chain[:, 0], skip[:, 0]]), np.concatenate([chain[:, 1], skip[:, 1]])
    edges = len(a)
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    back = np.concatenate([np.arange(edges, 2 * edges), np.arange(edges)])
    # potential[e, y of the source, y of the target]
    kind = np.concatenate([np.zeros(len(chain), "i8"), np.ones(len(skip), "i8"), np.full(len(chain), 2), np.ones(len(skip), "i8")])
    factor = np.exp(np.stack([model.chain, model.skip, model.chain.T]))
    message = np.zeros((2 * edges, size))
    _, doc = np.unique(np.array(graph.doc, "i8")[target], return_inverse=True)
    active, size_of_nodes = np.arange(2 * edges), 0
    for sweep in range(MOST_SWEEPS):
        if not len(active):
            break
        if 2 * len(active) <= size_of_nodes or not sweep:  # only the nodes of documents that have not settled are gone through
            nodes, place = np.unique(np.r_[source[active], target[active]], return_inverse=True)
            (begin, end), own, size_of_nodes = np.split(place, 2), score[nodes], len(active)
        belief = own.copy()
        np.add.at(belief, end, message[active])
        out = belief[begin] - message[back[active]]
        out -= out.max(1, keepdims=True)
        new = np.log(np.maximum(1e-300, np.einsum("ey,eyz->ez", np.exp(out), factor[kind[active]])))
        new -= new.max(1, keepdims=True)
        keep = 0.5 if sweep < SWEEPS else 0.9  # damped, so that loops settle
        new = (1 - keep) * new + keep * message[active]
        change = np.zeros(doc.max() + 1)
        np.maximum.at(change, doc[active], np.abs(new - message[active]).max(1) / (1 - keep))
        message[active] = new
        going = change[doc[active]] >= 2 * SETTLED
        active, begin, end = active[going], begin[going], end[going]
    belief = score
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), {graph.doc[i] for i in target[active].tolist()}


def marginals(graph: Graph, model: Model) -> np.ndarray:
    return beliefs(graph, model)[0]


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Model) -> list[list[tuple[str, int, int]]]:
    """Spans of the field for each text: runs of tokens of one label, more likely than not, that no base span overlaps."""
    return _field_spans(texts, base, model)[0]


def _field_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Model) -> tuple[list[list[tuple[str, int, int]]], set[int]]:
    """The spans, and the texts whose messages did not settle."""
    graph = Graph()
    for d, t in enumerate(texts):
        add_document(graph, d, t, model)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not graph.doc:
        return out, set()
    p, unsettled = beliefs(graph, model)
    best = p.argmax(1)
    sure = (p.max(1) > 0.5) & (best > 0)
    joined = {b: a for a, b in graph.chain}
    run: dict[int, int] = {}
    for i in np.flatnonzero(sure).tolist():
        d, kind, (a, b) = graph.doc[i], LABELS[best[i]], graph.span[i]
        before = joined.get(i)
        if before in run and best[before] == best[i] and kind == "phone":
            k = run[before]
            out[d][k] = (kind, out[d][k][1], b)
        else:
            out[d].append((kind, a, b))
            k = len(out[d]) - 1
        run[i] = k
    return [[s for s in own if not any(s[1] < y and x < s[2] for _, x, y in taken)] for own, taken in zip(out, base, strict=True)], unsettled


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes its (first) kind in angle brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fits the field to at most TRAIN_ROWS rows; a first pass counts those that qualify, so that the second passes on few more."""
    rows = docs.select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike(f"[0-9@]|{_LONG.pattern}") & (F.length("t") <= TRAIN_CHARS))
    share = max(1, rows.count() // (2 * TRAIN_ROWS))
    some = rows.where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0).distinct()
    return fit([r.t for r in some.orderBy(F.xxhash64("t"), "t").limit(TRAIN_ROWS).collect()])


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts are labelled together: up to ``TOGETHER`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if held + size > TOGETHER and k > start:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def find_pii(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, p_spans (kind, start, end in code points, base: a base pattern's) by kind and start, p_redacted, p_settled."""
    docs = without(docs, ["p_spans", "p_redacted", "p_settled"])
    column = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _portions(whole, column):
                texts = [t or "" for t in batch.column(column).to_pylist()]
                base = [base_spans(t) for t in texts]
                more, unsettled = _field_spans(texts, base, held.value)
                spans, redacted = [], []
                for t, b, m in zip(texts, base, more, strict=True):
                    own = sorted([(*s, True) for s in b] + [(*s, False) for s in m], key=lambda s: (LABELS.index(s[0]), s[1]))
                    spans.append([{"kind": kind, "start": x, "end": y, "base": is_base} for kind, x, y, is_base in own])
                    redacted.append(redact(t, [s[:3] for s in own]) if own else t)
                table = pa.Table.from_batches([batch]).append_column(pa.field("p_spans", spans_type), pa.array(spans, spans_type)).append_column("p_redacted", pa.array(redacted, pa.string()))
                table = table.append_column("p_settled", pa.array([d not in unsettled for d in range(len(texts))]))
                yield from table.to_batches()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, p_spans array<struct<kind: string, start: long, end: long, base: boolean>>, p_redacted string, p_settled boolean")


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, train(docs)).select("doc_id", "p_spans", "p_settled")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("p_spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS]
    more = [F.size(F.filter("p_spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"), F.size("p_spans").cast("long").alias("n_spans"), F.col("p_settled").alias("settled")]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("p_spans")).alias("spans"), *more)
