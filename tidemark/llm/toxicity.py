"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target (a person addressed or spoken of), negation,
report (speech or quotation of others), other. Five small transducers, each with a finite scope,
are composed into one machine that reads a clause and weighs what matches in it: an insult weighs
more near a target, a threat counts only with a target, and both weigh little under a negation or
in reported speech. A document's matched clauses give its features; a logistic function of them,
fitted to labels, gives its score.

Insults are of two kinds: listed words, and beginnings of words learned from labels: an acceptor
over the letters of a word, whose longest known beginning gives the weight (a whole word counts
as longer than its beginnings, so a form of neutral use stands apart from its inflections).

Clauses end at . ! ? ; : and line ends. Words are runs of ASCII letters, digits, apostrophes and
bytes beyond ASCII, A-Z lower-cased, so signs stuck to a word don't hide it.

Rows: null and empty texts have no clause and get the score of such texts; every input row gives
one output row; a null or unknown label teaches nothing; without labels of both kinds the fixed
prior weights score. Added columns replace input columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, without, written
from .grams import LOWER, prefix_sums, spans, text_bytes, word_spans

#: Labelled rows learned from: those with the lowest hashes of their ids, if there are more.
FIT_ROWS = 20_000
#: Learned beginnings: letters, least documents, least share of toxic documents, least log odds, log odds of weight 1.
LETTERS = (3, 9)
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, UNIT_ODDS = 5, 0.01, 2.0, 3.0

# The lexicon of each symbol.
LEXICON = {
    "insult": """idiot idiots moron morons stupid clown clowns pathetic worthless disgusting scum loser losers trash dumb
        imbecile fool jerk creep vermin filthy ugly degenerate garbage scumbag lowlife coward retard retarded bastard
        asshole bitch subhuman parasite parasites dummkopf schwachkopf abschaum versager wertlos connard imbécile
        crétin ordure minable basura estúpido estúpida imbécil inútil despreciable""",
    "threat": """kill killed murder hurt stab shoot beat strangle destroy burn hang lynch exterminate attack töten umbringen
        tuer frapper matar golpear""",
    "target": """you your you're youre yourself u she her him they them their everyone people women men immigrants
        du dich dein ihr sie tu toi vous ton eux tú usted ustedes ellos""",
    "negation": """not no never isn't aren't wasn't don't doesn't didn't ain't without hardly nicht kein keine nie pas jamais
        aucun nunca jamás""",
    "report": """said says quoted quote wrote claimed claims reported allegedly according called accused
        sagte schrieb zitierte dit écrit déclaré dijo escribió según""",
}
SYMBOLS = ["other", *LEXICON]
#: Words a symbol reaches forward (report: to the end of the clause).
SCOPE = {"target": 6, "negation": 3, "report": 10**6, "threat": 5, "insult": 4}
#: Weights of the grammar.
WEIGHT = {"insult": 1.0, "targeted": 0.5, "threat": 1.5, "negated": 0.25, "reported": 0.4}
FEATURES = ["weight", "matched", "dense"]
#: Used without labels: a document is toxic from about two matched clauses on.
PRIOR = [-4.0, 2.5, 1.0, 0.5]
CLASS_STEP = 1 << 20


def scope(symbol: str, width: int):
    """A transducer: its state is how many more words `symbol` reaches; other words run it down."""
    def step(state: int, read: str) -> int:
        return width if read == symbol else max(0, state - 1) if width < 10**6 else state

    return step


class Grammar:
    """The composition of the scope transducers; arcs are made when first taken and kept."""

    def __init__(self):
        self.parts = list(SCOPE)
        self.steps = [scope(p, SCOPE[p]) for p in self.parts]
        self.start = (0,) * len(self.parts)
        self.arcs: dict[tuple, tuple] = {}

    def arc(self, state: tuple, read: str) -> tuple[tuple, float]:
        if (state, read) not in self.arcs:
            on = dict(zip(self.parts, state, strict=True))
            damp = (WEIGHT["negated"] if on["negation"] else 1.0) * (WEIGHT["reported"] if on["report"] else 1.0)
            out = 0.0
            if read == "insult":
                out = WEIGHT["insult"] + (WEIGHT["targeted"] if on["target"] else 0.0)
            elif read == "target":
                out = (WEIGHT["targeted"] if on["insult"] else 0.0) + (WEIGHT["threat"] if on["threat"] else 0.0)
            elif read == "threat" and on["target"]:
                out = WEIGHT["threat"]
            self.arcs[state, read] = tuple(f(s, read) for f, s in zip(self.steps, state, strict=True)), out * damp
        return self.arcs[state, read]

    def clause(self, symbols: list[str], at: list[int], weights: list[float]) -> float:
        """Weight of a clause from its symbols other than `other`, their word numbers and the words' own weights."""
        state, total, last = self.start, 0.0, None
        for read, i, own in zip(symbols, at, weights, strict=True):
            for _ in range(0 if last is None else min(i - last - 1, 8)):     # every finite scope ends within eight words
                state, _w = self.arc(state, "other")
            state, w = self.arc(state, read)
            total, last = total + w * own, i
        return total


SEPARATES = np.ones(256, dtype=bool)
SEPARATES[[*range(48, 58), *range(97, 123), 39, *range(128, 256)]] = False
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?;:\n"]] = True


class Table:
    """Values by hash, with a bitmap that turns most hashes away."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.maybe = np.zeros(CLASS_STEP, dtype=bool)
        self.maybe[(hashes & np.uint64(CLASS_STEP - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `h` that are known, and their values."""
        hit = np.flatnonzero(self.maybe[(h & np.uint64(CLASS_STEP - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[hit]), max(len(self.hashes) - 1, 0))
        if not len(self.hashes):
            return hit[:0], self.values[:0]
        found = self.hashes[at] == h[hit]
        return hit[found], self.values[at[found]]


def _strings(words: list[str]) -> np.ndarray:
    raw, off = text_bytes(pa.array(words, pa.string()))
    return spans(prefix_sums(raw, 0), off[:-1], off[1:], 0) if words else np.empty(0, np.uint64)


class Words:
    """Symbol and weight of words: the fixed lexicon, and the learned beginnings."""

    def __init__(self, learned: list[tuple[str, float]]):
        fixed = [(w, SYMBOLS.index(s)) for s, text in LEXICON.items() for w in text.split()]
        self.fixed = Table(_strings([w for w, _ in fixed]), np.array([k for _, k in fixed], dtype=np.int64))
        whole = [(w[:-1], v) for w, v in learned if w.endswith("$")]
        self.whole = Table(_strings([w for w, _ in whole]), np.array([v for _, v in whole], dtype=float))
        self.begin = {}
        for n in sorted({len(w.encode()) for w, _ in learned if not w.endswith("$")}):
            some = [(w, v) for w, v in learned if not w.endswith("$") and len(w.encode()) == n]
            self.begin[n] = Table(_strings([w for w, _ in some]), np.array([v for _, v in some], dtype=float))
        self.grammar = Grammar()

    def read(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of words that are no `other`, their symbols, and the weights of insults."""
        p = prefix_sums(raw, 0)
        h = spans(p, start, end, 0)
        kind = np.zeros(len(h), dtype=np.int64)
        weight = np.ones(len(h))
        at, k = self.fixed.find(h)
        kind[at] = k
        for n, known in self.begin.items():                       # a longer beginning overrides a shorter one
            long = np.flatnonzero(end - start >= n)
            at, v = known.find(spans(p, start[long], start[long] + n, 0))
            kind[long[at]], weight[long[at]] = SYMBOLS.index("insult"), v
        at, v = self.whole.find(h)
        kind[at], weight[at] = SYMBOLS.index("insult"), v
        hit = np.flatnonzero((kind > 0) & (weight > 0))
        return hit, kind[hit], weight[hit]


def _features(batch: pa.RecordBatch, words: Words) -> dict[str, np.ndarray]:
    raw, off = text_bytes(batch["text"])
    raw = LOWER[raw]
    n = batch.num_rows
    out = {"weight": np.zeros(n), "matched": np.zeros(n), "dense": np.zeros(n)}
    start, end, row = word_spans(raw, off, SEPARATES)
    if not len(start):
        return out
    hit, kind, weight = words.read(raw, start, end)
    return _match(raw, start, row, hit, kind, weight, words.grammar, out) if len(hit) else out


def _match(raw, start, row, hit, kind, weight, grammar, out):
    ends = np.cumsum(ENDS[raw])
    clause = ends[start[hit]] + row[hit].astype(np.int64) * (int(ends[-1]) + 1)
    trigger = np.unique(clause[(kind == SYMBOLS.index("insult")) | (kind == SYMBOLS.index("threat"))])
    keep = np.isin(clause, trigger)
    hit, kind, weight, clause = hit[keep], kind[keep], weight[keep], clause[keep]
    if not len(hit):
        return out
    cut = np.flatnonzero(np.diff(clause)) + 1
    for at, kinds, weights in zip(np.split(hit, cut), np.split(kind, cut), np.split(weight, cut), strict=True):
        w = grammar.clause([SYMBOLS[k] for k in kinds], at.tolist(), weights.tolist())
        if w > 0:
            out["weight"][row[at[0]]] += w
            out["matched"][row[at[0]]] += 1
    words = np.maximum(np.bincount(row, minlength=len(out["weight"])), 1)
    out["dense"] = np.log1p(100 * out["weight"] / words)
    out["weight"] = np.log1p(out["weight"])
    out["matched"] = np.log1p(out["matched"])
    return out


def features(docs: DataFrame, keep: list[str], learned: list[tuple[str, float]]) -> DataFrame:
    """The columns in `keep` and the features of each row's text."""
    held: list[Words] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Words(learned))
        f = _features(b, held[0])
        return pa.RecordBatch.from_pydict({**{f"c{i}": b[f"c{i}"] for i in range(len(keep))}, **{k: pa.array(f[k]) for k in FEATURES}})

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], "text")
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"{k} double" for k in FEATURES])
    made = map_arrow(rows, run, schema)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *FEATURES)


def lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Beginnings of words, and whole words (ending in $), with weights, from (text, toxic).

    Chosen are beginnings that toxic documents hold far more often; of what goes on from a chosen
    one, all that `LEAST_DOCS` documents hold, with its own weight, down to 0. Documents count,
    not occurrences. The result is bounded by the sample.
    """
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+")), lambda w: F.length(w) >= LETTERS[0])
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(
        F.transform(F.sequence(F.lit(LETTERS[0]), F.least(F.length(w), F.lit(LETTERS[1]))), lambda k: w.substr(F.lit(1), k)),
        F.array(F.concat(w, F.lit("$")))))))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    held = sample.select("toxic", F.explode(starts).alias("part")).groupBy("part").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).filter(F.col("bad") + F.col("good") >= LEAST_DOCS)
    odds = F.log((F.col("bad") + 0.5) / (n[1] - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n[0] - F.col("good") + 0.5))
    held = written(held.withColumn("odds", odds), "toxic-beginnings")
    least = max(LEAST_DOCS, LEAST_SHARE * n[1])
    chosen = {r["part"] for r in held.filter((F.col("odds") >= LEAST_ODDS) & (F.col("bad") >= least)).collect()}
    roots = sorted(p for p in chosen if not any(p[:k] in chosen for k in range(LETTERS[0], len(p))))
    if not roots:
        return []
    under = F.lit(False)
    for k in sorted({len(p) for p in roots}):
        under = under | F.col("part").substr(1, k).isin([p for p in roots if len(p) == k])
    return [(r["part"], float(min(2.0, max(0.0, r["odds"] / UNIT_ODDS)))) for r in held.filter(under).orderBy("part").collect()]


def fit(labelled: DataFrame) -> list[float]:
    """Intercept and weights of the features, from rows of toxic and features; ridge-penalised Newton steps."""
    got = labelled.select("toxic", *FEATURES).collect()
    y = np.array([r[0] for r in got], dtype=float)
    if not len(y) or y.min() == y.max():
        return list(PRIOR)
    x = np.column_stack([np.ones(len(y)), *[[r[1 + i] for r in got] for i in range(len(FEATURES))]])
    b, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * len(FEATURES))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(b)), x.T @ (y - p) - ridge @ b)
    return [float(v) for v in b]


@dataclass
class Model:
    learned: list[tuple[str, float]]
    weights: list[float]

    def probability(self) -> Column:
        z = F.lit(self.weights[0])
        for w, k in zip(self.weights[1:], FEATURES, strict=True):
            z = z + F.lit(w) * F.col(k)
        return 1 / (1 + F.exp(-z))


def trained(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from `rows` labelled rows of `docs` at most; labels has doc_id and toxic. Equal texts count once."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")     # `rows` ids at most
    sample = written(sample.groupBy(F.xxhash64("text"), F.md5("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-sample")
    learned = lexicon(sample)
    return Model(learned, fit(features(sample, ["toxic"], learned)))


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or only the columns in `keep`) with `score` (double, 0 to 1) and `predicted` (int, 1 from 0.5 on)."""
    docs = without(docs, "score", "predicted")
    keep = docs.columns if keep is None else keep
    return features(docs, keep, model.learned).withColumn("score", model.probability()).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")).select(*[F.col(f"`{c}`") for c in keep], "score", "predicted")
