"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult (a word or a stem that labelled texts teach, with a weight), threat (a verb of harm), target
(whom a clause is about), negator, reporter (a verb of speech) and quotation mark; every other word is one symbol. Five small
transducers read the symbols of a clause: the insult transducer emits each insult; the threat transducer emits a verb of harm
only after a word of intent; the target transducer remembers a target for ``REACH`` words; the negation transducer a negator for
``SCOPE`` words; the reported-speech transducer a verb of speech to the clause's end, and a quotation to its closing mark. They are
composed once, on the driver, into one automaton whose states are the reachable tuples of theirs; an arc's output says
what is matched and in which context. The target may also follow: the clause is read once from each end.

A clause scores what it matches: insult weights by context (plain, targeted, negated, reported) and threats. A text's features
are sums over its clauses in each context, the strongest clause, how many clauses match, and these per word; a logistic
regression makes them a probability. A word outside a match scores nothing.

What is learnt: insult words and stems with their weights (log odds of labels among documents that hold them), from the labelled
rows of about ``TRAIN_ROWS`` documents at most, chosen by digest of their ids, counted by Spark, at most ``PATTERNS`` of them; and the regression, on
the same rows, each half scored with the patterns of the other half. These two are the bounds. Scores never see labels,
language, source or id.

Null and empty texts have no match and the lowest score; repeated rows get equal scores; without labelled rows of both
labels no pattern is known and all scores are the share of label 1 (0.5 without any). An empty table gives no rows. Texts are read whole, clause by
clause. Extra columns pass through; results are prefixed ``t_`` and replace columns of those names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import settle, table, without

#: Labelled documents that are learnt from, and patterns kept, at most.
TRAIN_ROWS, PATTERNS = 24_000, 4096
#: Least documents of label 1 with a pattern, and least z-score of its log odds.
LEAST_DOCS, LEAST_Z = 4, 4.0
#: Code points of stems. A stem is the beginning of a longer word.
STEMS = range(3, 13)
#: Words for which a target and a negator are remembered.
REACH, SCOPE = 4, 3
#: Distinct words whose symbols a worker remembers; words whose patterns are counted together.
MET, COUNTED = 1 << 20, 1 << 21

# The closed classes of the grammar, in the languages of the texts.
TARGETS = "you your yours yourself he him his she her they them their we us du dich dir dein deine er ihn sie ihr ihre wir uns tu toi te ton ta tes il elle ils elles nous vous lui leur tú ti usted ustedes él ella ellos ellas nosotros su sus"
NEGATORS = "not no never none nobody nothing neither nor isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune ni nunca ningún ninguna jamás tampoco"
REPORTERS = "said says say told called calls wrote writes claimed claims according sagte sagt schrieb nannte behauptet dit disait appelle écrit déclare dijo dice llamó escribió declara"
THREATS = "kill hurt beat punch destroy burn shoot stab töten schlagen verletzen zerstören tuer frapper blesser détruire matar golpear herir destruir"
INTENTS = "will shall gonna should must going werde werden sollte vais va vas allons debe voy vamos"
MARKS = "\"“”„«»"

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER, QUOTE, INTENT = range(8)
_CLASSES = {w: k for k, names in ((TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORTER, REPORTERS), (THREAT, THREATS), (INTENT, INTENTS)) for w in names.split()}

_CLAUSE = re.compile(r"[.;!?\n\r]+")
_WORD = re.compile(rf"[^\W\d_]+(?:['’][^\W\d_]+)*|[{MARKS}]")
FEATURES = ["plain", "targeted", "negated", "reported", "threats", "strongest", "clauses", "hits", "per_word"]


# The transducers: step(state, symbol) -> (state, output). State 0 is the start, and output 0 is nothing.


def _insults(state: int, symbol: int) -> tuple[int, int]:
    return 0, int(symbol == INSULT)


def _threats(state: int, symbol: int) -> tuple[int, int]:
    if symbol == INTENT:
        return SCOPE, 0
    return max(0, state - 1), int(symbol == THREAT and state > 0)


def _targets(state: int, symbol: int) -> tuple[int, int]:
    return (REACH, 1) if symbol == TARGET else (max(0, state - 1), int(state > 0))


def _negation(state: int, symbol: int) -> tuple[int, int]:
    return (SCOPE, 1) if symbol == NEGATOR else (max(0, state - 1), int(state > 0))


def _reported(state: int, symbol: int) -> tuple[int, int]:
    """0 own speech, 1 in a quotation, 2 after a verb of speech."""
    if symbol == QUOTE:
        return (0 if state == 1 else 1), 0
    return (2, 1) if symbol == REPORTER and state == 0 else (state, int(state > 0))


TRANSDUCERS = (_insults, _threats, _targets, _negation, _reported)


def compose(transducers=TRANSDUCERS) -> tuple[list[list[int]], list[list[int]]]:
    """Next states and outputs, by state and symbol, of all transducers run at once; an output has a bit for each of them. State 0 is the start."""
    number = {(0,) * len(transducers): 0}
    todo, following, outputs = list(number), [], []
    for states in todo:  # grows as tuples are reached
        next_row, out_row = [], []
        for symbol in range(8):
            moves = [step(s, symbol) for step, s in zip(transducers, states, strict=True)]
            reached = tuple(s for s, _ in moves)
            if reached not in number:
                number[reached] = len(number)
                todo.append(reached)
            next_row.append(number[reached])
            out_row.append(sum(out << k for k, (_, out) in enumerate(moves)))
        following.append(next_row)
        outputs.append(out_row)
    return following, outputs


_INSULT, _THREAT, _TARGET, _NEGATED, _REPORTED = (1 << k for k in range(5))


@dataclass
class Grammar:
    """Learnt patterns with their weights, and the composed automaton."""

    words: dict[str, float]
    stems: dict[str, float]
    met: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.following, self.outputs = compose()

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol of a lower-cased word, and its weight: the whole word's, or else that of its longest stem."""
        found = self.met.get(word)
        if found is None:
            if len(self.met) >= MET:
                self.met.clear()
            weight = self.words.get(word)
            if weight is None:
                weight = next((self.stems[word[:k]] for k in reversed(STEMS) if k < len(word) and word[:k] in self.stems), None)
            kind = QUOTE if word in MARKS else _CLASSES.get(word, OTHER) if weight is None else INSULT
            found = self.met[word] = (kind, weight or 0.0)
        return found

    def clause(self, read: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """Matches of a clause: the output's bits and the weight. A target that follows counts like one before."""
        after, state = [], 0
        for kind, _ in reversed(read):
            after.append(self.outputs[state][kind] & _TARGET)
            state = self.following[state][kind]
        found, state = [], 0
        for (kind, weight), seen in zip(read, reversed(after), strict=True):
            out = self.outputs[state][kind] | seen
            if out & (_INSULT | _THREAT):
                found.append((out, weight))
            state = self.following[state][kind]
        return found

    def features(self, text: str) -> list[float]:
        """Those of ``FEATURES``, of a whole text."""
        sums = dict.fromkeys(("plain", "targeted", "negated", "reported", "threats"), 0.0)
        strongest, clauses, hits, n_words = 0.0, 0, 0, 0
        symbol = self.symbol
        for clause in _CLAUSE.split(text.lower()):
            words = _WORD.findall(clause)
            n_words += len(words)
            read = [symbol(w) for w in words]
            if not any(kind in (INSULT, THREAT) for kind, _ in read):
                continue
            score = 0.0
            found = self.clause(read)
            for out, weight in found:
                if out & _THREAT:
                    sums["threats"] += 1.0
                    score += 1.0
                    continue
                kind = "reported" if out & _REPORTED else "negated" if out & _NEGATED else "targeted" if out & _TARGET else "plain"
                sums[kind] += weight
                score += weight * (0.5 if kind in ("reported", "negated") else 1.0)
                hits += 1
            strongest, clauses = max(strongest, score), clauses + bool(found)
        return [*sums.values(), strongest, float(clauses), float(hits), 100.0 * hits / max(n_words, 20)]


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray  # one for each of FEATURES, and the constant

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_scaled(features) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _scaled(features: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(features, 0.0))


def _patterns(text: str) -> set[str]:
    """Words of a text, marked by a bar in front, and the stems of words."""
    words = set(_WORD.findall(text.lower()))
    return {f"|{w}" for w in words} | {w[:k] for w in words for k in STEMS if k < len(w)}


def count_patterns(rows: DataFrame) -> DataFrame:
    """rows: text, toxic, half. pattern, toxic, half, n: documents with a pattern; tasks add theirs up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (toxic, half), held in counts.items():
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([toxic] * n, pa.int32()), pa.array([half] * n, pa.int32()), pa.array(list(held.values()), pa.int64())], ["pattern", "toxic", "half", "n"])
            counts.clear()

        for batch in batches:
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                counts.setdefault((toxic, half), Counter()).update(_patterns(text))
                if sum(map(len, counts.values())) > COUNTED:
                    yield from flush()
        yield from flush()

    found = rows.select("text", "toxic", "half").mapInArrow(run, "pattern string, toxic int, half int, n long")
    return found.groupBy("pattern", "toxic", "half").agg(F.sum("n").alias("n"))


def _grammar(counts: dict[str, tuple[int, int]], positive: int, negative: int) -> Grammar:
    """Patterns whose log odds stand out; of a stem and a longer one with nothing more to say only the shorter is kept."""
    weights: dict[str, tuple[float, float]] = {}
    for pattern, (a, b) in counts.items():
        if a < LEAST_DOCS or positive == 0 or negative == 0:
            continue
        odds = np.log((a + 0.5) / (positive - a + 0.5)) - np.log((b + 0.5) / (negative - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (positive - a + 0.5) + 1 / (b + 0.5) + 1 / (negative - b + 0.5))
        if z >= LEAST_Z and odds >= 1.5:
            weights[pattern] = (float(odds), float(z))
    words, stems = {}, {}
    for pattern in sorted(weights, key=lambda p: (p[:1] == "|", len(p), p)):
        odds, _ = weights[pattern]
        core = pattern.removeprefix("|")
        shorter = [stems[core[:k]] for k in STEMS if k < len(core) and core[:k] in stems]
        if shorter and odds <= max(shorter) + 0.3:
            continue  # its stem says as much
        (words if pattern[0] == "|" else stems)[core] = odds
    top = sorted([*((o, w, 0) for w, o in words.items()), *((o, s, 1) for s, o in stems.items())], reverse=True)[:PATTERNS]
    return Grammar({w: o for o, w, k in top if k == 0}, {s: o for o, s, k in top if k == 1})


def fit(features: np.ndarray, label: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    x = np.c_[_scaled(features), np.ones(len(features))]
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (label - p) - penalty @ w)
        w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(rows: DataFrame, grammars: tuple[Grammar, ...], columns: list[str]) -> DataFrame:
    """The columns, and the features of the text by the grammar that ``which`` names."""
    held = rows.sparkSession.sparkContext.broadcast(grammars)  # at most PATTERNS patterns each
    kept = rows.select(*columns, "text", "which")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, which = batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()
            found = [held.value[g].features(t) if t else [0.0] * len(FEATURES) for t, g in zip(texts, which, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found, pa.list_(pa.float64()))], [*columns, "features"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in columns)
    return kept.mapInArrow(run, f"{types}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from at most about ``TRAIN_ROWS`` labelled documents, chosen by digest of the key on both sides of the join; of several labels of a key the largest counts."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    share = max(1, -(-known.count() // TRAIN_ROWS))
    taken = F.pmod(F.xxhash64(F.lit("rows"), "_key"), F.lit(share)) == 0
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).where(taken & (F.col("text") != ""))
    rows = texts.join(known.where(taken), "_key")
    some = settle(rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int").alias("half")), "labelled")
    sizes = {(r.half, r.toxic): r.n for r in some.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = count_patterns(some).groupBy("pattern").agg(*(F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1)))
    # only patterns in enough documents of label 1 that stand out by a factor come to the driver
    positive, negative = (sum(n for (_, y), n in sizes.items() if y == label_) for label_ in (1, 0))
    told = counted.where((F.col("c01") + F.col("c11") >= LEAST_DOCS) & ((F.col("c01") + F.col("c11")) * F.lit(max(1, negative)) > 3 * (F.col("c00") + F.col("c10")) * F.lit(max(1, positive))))
    found = [(r.pattern, r.c00, r.c01, r.c10, r.c11) for r in told.orderBy(F.desc(F.col("c01") + F.col("c11")), "pattern").limit(16 * PATTERNS).collect()]
    halves = [{p: ((c01, c00), (c11, c10))[h] for p, c00, c01, c10, c11 in found} for h in (0, 1)]
    whole = _grammar({p: (c01 + c11, c00 + c10) for p, c00, c01, c10, c11 in found}, positive, negative)
    # a document is scored by the patterns of the other half
    others = tuple(_grammar(halves[1 - h], sizes.get((1 - h, 1), 0), sizes.get((1 - h, 0), 0)) for h in (0, 1))
    sampled = _featured(some.withColumn("which", F.col("half")), others, ["toxic"]).collect()  # at most about TRAIN_ROWS short rows
    if positive == 0 or negative == 0:
        constant = 0.0 if positive == negative else 5.0 if positive else -5.0
        return Model(whole, np.r_[np.zeros(len(FEATURES)), constant])
    return Model(whole, fit(np.array([r.features for r in sampled]), np.array([r.toxic for r in sampled], float)))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, t_score (0 to 1), t_hits (matched insults), t_clauses (matched clauses)."""
    docs = without(docs, ["t_score", "t_hits", "t_clauses"])
    column, names = docs.columns.index(text), [*docs.columns, "t_score", "t_hits", "t_clauses"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most PATTERNS patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = pc.fill_null(batch.column(column).cast(pa.string()), "").to_pylist()
            features = np.array([held.value.grammar.features(t) for t in texts])
            more = [held.value.scores(features), features[:, FEATURES.index("hits")].astype("i8"), features[:, FEATURES.index("clauses")].astype("i8")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, t_score double, t_hits long, t_clauses long")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0  # a null id counts as an empty one
    learnt = table(spark, sf_dir, "labels").where(~held_out)
    scored = score_toxicity(docs, train(docs, learnt))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("t_score").alias("score"), F.when(F.col("t_score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("t_hits").alias("n_hits"), F.col("t_clauses").alias("n_clauses"))
