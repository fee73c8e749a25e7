"""Toxicity by a linear-chain conditional random field.

Fitting. Labels are per document, so tokens are labelled first: a token feature
(the word, or one of its prefixes) that occurs in toxic documents more often
than chance allows, at a level of one expected false feature over all, marks
the tokens of toxic documents that carry it. A two-label chain is then fitted to
these tokens by proximal gradient steps with an L1 penalty, so that most words
weigh exactly nothing; its gradient comes from forward-backward marginals. A
logistic regression of the documents' labels on two aggregates of the marginals
gives document scores.

Scoring. A chain with two labels needs one number a position and direction: the
log odds of the prefix and of the suffix. Both recursions are contractions, so
they are solved by sweeps over all positions at once until nothing changes by
1e-10; where the weights of label pairs are so strong that SWEEPS don't settle
them, a plain loop over the tokens does. Documents without any weighed token need
no chain of their own: their marginals depend on their length alone.

The fit uses at most about ``most_labelled`` labelled documents, chosen by a hash
of the id, one text an id (the least of its rows'), and of these, in the order of
the hash, as many as ``most_bytes`` hold (two documented bounds; all where there
are fewer). Inputs of a score are the text's tokens only: never labels, lang,
source or doc_id.

Defined results: null or empty texts score as a document without weighed tokens;
texts of any length are read whole; repeated rows score alike, and rows that
repeat an id each by their own text; a document with several labels is toxic if
one says so; null labels are no labels; without both classes among the labels the
score is the share of toxic ones (0 without any); rows with a null id are scored
and never learned from; extra columns aren't read, may have any name, and stay
where documents are filtered; an empty table gives none.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Memo, cached, held, in_fold, map_texts, quoted

FOLDS, HELD_OUT = 5, 0
PREFIXES = (3, 4, 5, 6)
EDGE = ".,;:!?\"'()[]{}*#$%&|<>"


def features(word: str) -> list[str]:
    """Of one token: the bare word and its prefixes."""
    bare = word.lower().strip(EDGE)
    return [f"w={bare}", *(f"{n}={bare[:n]}" for n in PREFIXES if len(bare) > n)] if bare else []


@dataclass
class Chain:
    """bias and weights give a position's log odds on its own; join holds the log weights of label pairs."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    join: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    #: Document score: sigmoid(a + b * largest log odds + c * log(1 + sum of marginals from FLOOR on)).
    score: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def passed(odds: np.ndarray, join, back: bool = False) -> np.ndarray:
    """What one position's log odds tell the next one's."""
    j00, j01, j10, j11 = join
    if back:
        j01, j10 = j10, j01
    grown = np.exp(np.clip(odds, -600.0, 600.0))
    return np.log((np.exp(j01) + np.exp(j11) * grown) / (np.exp(j00) + np.exp(j10) * grown))


#: Marginals below this aren't added up: a clean text's would grow with its length.
FLOOR = 0.05
#: Sweeps after which a chain that hasn't settled is walked token by token.
SWEEPS = 64


def log_odds(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, join, close: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal log odds of the label, of the prefix and of the suffix, for chains laid end to end."""
    forth, back, settled = own.copy(), np.zeros_like(own), False
    for _ in range(SWEEPS):
        new = own.copy()
        new[1:] += passed(forth[:-1], join)
        new[starts] = own[starts]
        settled = np.abs(new - forth).max(initial=0.0) < close
        forth = new
        if settled:
            break
    if not settled:
        forth = _walked(own, starts, ends, join)
    settled = False
    for _ in range(SWEEPS):
        new = np.zeros_like(own)
        new[:-1] = passed((own + back)[1:], join, True)
        new[ends] = 0.0
        settled = np.abs(new - back).max(initial=0.0) < close
        back = new
        if settled:
            break
    if not settled:
        back = (_walked(own[::-1], len(own) - 1 - ends[::-1], len(own) - 1 - starts[::-1], (join[0], join[2], join[1], join[3])) - own[::-1])[::-1]
    return forth + back, forth, back


def _walked(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, join) -> np.ndarray:
    """Log odds of the prefixes, from each position to the next."""
    j00, j01, j10, j11 = map(exp, join)
    values, out = own.tolist(), []
    for a, b in zip(starts.tolist(), ends.tolist()):
        now = values[a]
        out.append(now)
        for x in values[a + 1 : b + 1]:
            grown = exp(min(600.0, max(-600.0, now)))
            now = x + log((j01 + j11 * grown) / (j00 + j10 * grown))
            out.append(now)
    return np.array(out)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def marked_features(docs: list[tuple[str, int]]) -> set[str]:
    """Features that toxic documents hold beyond chance."""

    def of(text: str) -> set[str]:
        return {f for w in set(WORD.findall(text or "")) for f in features(w)}

    toxic: Counter = Counter()
    for text, label in docs:
        if label:
            toxic.update(of(text))
    base = max(sum(label for _, label in docs), 1) / max(len(docs), 1)
    need = np.log(max(len(toxic), 2))
    # What occurs too seldom to pass even if no clean document has it needs no count there.
    toxic = {f: a for f, a in toxic.items() if -a * np.log(base) > need}
    clean = dict.fromkeys(toxic, 0)
    for text, label in docs:
        if not label:
            for f in of(text):
                if f in clean:
                    clean[f] += 1
    found = set()
    for f, a in toxic.items():
        b = clean[f]
        share = a / (a + b)
        if share < 0.9:
            continue
        # Log likelihood ratio of the share against the base rate.
        gain = a * np.log(share / base) + (b * np.log((1 - share) / (1 - base)) if b else 0.0)
        if gain > need:
            found.add(f)
    return found


def training_chains(docs: list[tuple[str, int]], marked: set[str], window: int, stretch: int) -> list[tuple[list[str], np.ndarray]]:
    """Stretches of words with token labels: around marked tokens, and one of each document without any."""
    hits = Memo(lambda w: any(f in marked for f in features(w)))
    rng = np.random.default_rng(7)
    chains: list[tuple[list[str], np.ndarray]] = []
    for text, label in docs:
        words = WORD.findall(text or "")
        at, end = [i for i, w in enumerate(words) if hits[w]], 0
        for i in at:  # joined where they meet; in clean documents they are what the chain must learn to pass
            a, b = max(end, i - window), min(len(words), i + window + 1)
            if b > end:
                chains.append((words[a:b], np.array([float(label and hits[w]) for w in words[a:b]])))
                end = b
        if not at and words:
            a = int(rng.integers(0, max(1, len(words) - stretch)))
            chains.append((words[a : a + stretch], np.zeros(len(words[a : a + stretch]))))
    return chains


def fit(docs: list[tuple[str, int]], rounds: int = 80, penalty: float = 2e-6, window: int = 6, stretch: int = 60) -> Chain:
    """The chain from labelled texts."""
    labels = np.array([label for _, label in docs], dtype=float)
    if len(docs) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(docs) else 0.0
        return Chain(score=(float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0))
    chains = training_chains(docs, marked_features(docs), window, stretch)
    counts = Counter(f for words, _ in chains for w in words for f in features(w))
    known = {f: k for k, f in enumerate(f for f, c in counts.items() if c >= 3)}
    del counts
    ids = Memo(lambda w: [known[f] for f in features(w) if f in known], 100_000)
    m = len(known)

    def one(word: str) -> list[int]:
        fs = features(word)[:1]
        return [known[fs[0]]] if fs and fs[0] in known else []

    cols, rows, t = array("i"), array("i"), 0
    for words, _ in chains:
        for i, w in enumerate(words):
            own = ids[w] + ([m + k for k in one(words[i - 1])] if i else []) + ([2 * m + k for k in one(words[i + 1])] if i + 1 < len(words) else [])
            cols.extend(own)
            rows.extend([t] * len(own))
            t += 1
    row, col = np.frombuffer(rows, dtype=np.int32), np.frombuffer(cols, dtype=np.int32)
    y = np.concatenate([v for _, v in chains])
    sizes = np.array([len(v) for _, v in chains])
    ends = sizes.cumsum() - 1
    starts = ends + 1 - sizes
    inner = np.ones(t, dtype=bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    w, bias, join = np.zeros(3 * m), -4.0, np.zeros(4)
    scale, bias_scale, join_scale = np.full(3 * m, 1e-8), 1e-8, np.full(4, 1e-8)
    pairs = np.array([((y[inner - 1] == a) & (y[inner] == b)).sum() for a in (0, 1) for b in (0, 1)], dtype=float)
    for _ in range(rounds):
        own = bias + np.bincount(row, w[col], minlength=t)
        odds, forth, back = log_odds(own, starts, ends, tuple(join), 1e-5)
        delta = (sigmoid(odds) - y) / t
        joint = np.stack([join[0] + 0 * inner, join[1] + own[inner] + back[inner], join[2] + forth[inner - 1], join[3] + forth[inner - 1] + own[inner] + back[inner]])
        joint = np.exp(joint - joint.max(axis=0))
        join_grad = ((joint / joint.sum(axis=0)).sum(axis=1) - pairs) / t + 1e-4 * join
        grad = np.bincount(col, delta[row], minlength=3 * m)
        scale += grad * grad
        rate = 0.5 / np.sqrt(scale)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0.0)
        bias_scale += delta.sum() ** 2
        bias -= 0.5 / np.sqrt(bias_scale) * delta.sum()
        join_scale += join_grad**2
        join = join - 0.2 / np.sqrt(join_scale) * join_grad
    names = list(known)
    parts = [{names[k]: float(v) for k, v in enumerate(w[i * m : (i + 1) * m]) if abs(v) > 1e-3} for i in range(3)]
    chain = Chain(float(bias), *parts, tuple(map(float, join)))
    tagger = Tagger(chain)
    x = np.concatenate([tagger.tagged([text for text, _ in docs[at : at + 256]])[0] for at in range(0, len(docs), 256)])
    chain.score = logistic(x, labels)
    return chain


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge; never a falling score in either aggregate."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b = np.zeros(3)
    for _ in range(50):
        p = sigmoid(z @ b)
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        b = b + np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ b)
    slope = np.maximum(b[1:] / sd, 0.0)
    return float(b[0] - (b[1:] / sd * mean).sum()), float(slope[0]), float(slope[1])


class Tagger:
    """Applies a chain to texts, many at a time."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.table: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)]
        self.index = {self.table[0]: 0}
        self.code = Memo(self._code, 150_000)
        #: The first characters of all weighed features: other words weigh nothing.
        self.heads = {f[2:5] for part in (chain.weights, chain.before, chain.after) for f in part}
        self.plain = Memo(self._plain, 20_000)
        self.array = np.zeros((1, 3))

    def _code(self, word: bytes) -> int:
        text, chain = word.decode("utf-8", "surrogatepass"), self.chain
        if text.lower().strip(EDGE)[:3] not in self.heads:
            return 0
        fs = features(text)
        values = (sum(chain.weights.get(f, 0.0) for f in fs), chain.before.get(fs[0], 0.0) if fs else 0.0, chain.after.get(fs[0], 0.0) if fs else 0.0)
        if values not in self.index:  # as many as there are sums of weights, not words
            self.index[values] = len(self.table)
            self.table.append(values)
        return self.index[values]

    def _plain(self, n: int) -> tuple[float, float]:
        """The aggregates of n tokens without weight."""
        if not n:
            return self.chain.bias, 0.0
        odds = log_odds(np.full(n, self.chain.bias), np.array([0]), np.array([n - 1]), self.chain.join)[0]
        p = sigmoid(odds)
        return float(odds.max()), float(np.log1p(p[p >= FLOOR].sum()))

    def tagged(self, texts: list[str | None], least: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """Aggregates of each text, and its tokens (number, marginal) that are toxic.

        The texts' chains are laid end to end, so their sweeps are one array operation.
        """
        codes, sizes = [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            codes.append(np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words)))
            sizes.append(len(words))
        if len(self.array) != len(self.table):
            self.array = np.array(self.table)
        sums, marked = np.zeros((len(texts), 2)), [[] for _ in texts]
        some = [i for i, c in enumerate(codes) if c.any()]
        for i in range(len(texts)):
            if not codes[i].any():
                sums[i] = self.plain[sizes[i]]
        if some:
            ends = np.cumsum([sizes[i] for i in some]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            values = self.array[np.concatenate([codes[i] for i in some])]
            own = self.chain.bias + values[:, 0]
            inner = np.ones(len(own), dtype=bool)
            inner[starts] = False
            own[1:] += values[:-1, 1] * inner[1:]
            own[:-1] += values[1:, 2] * inner[1:]
            odds = log_odds(own, starts, ends, self.chain.join)[0]
            p = sigmoid(odds)
            sums[some, 0] = np.maximum.reduceat(odds, starts)
            sums[some, 1] = np.log1p(np.add.reduceat(np.where(p >= FLOOR, p, 0.0), starts))
            at = np.flatnonzero(p >= least)
            for k, which in zip(at, np.searchsorted(ends, at), strict=True):
                marked[some[which]].append((int(k - starts[which]), float(p[k])))
        return sums, marked

    def scores_of(self, sums: np.ndarray) -> np.ndarray:
        a, b, c = self.chain.score
        return sigmoid(a + b * sums[:, 0] + c * sums[:, 1])

    def score(self, text: str | None) -> float:
        return float(self.scores_of(self.tagged([text])[0])[0])

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Code point offsets and marginals of the tokens tagged toxic."""
        return placed(text, self.tagged([text], least)[1][0])


def placed(text: str | None, tokens: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """Tokens by number as code point offsets."""
    if not tokens:
        return []
    marginal = dict(tokens)
    return [(m.start(), m.end(), marginal[i]) for i, m in enumerate(WORD.finditer(text)) if i in marginal]


def labelled(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int, id_col: str, text_col: str, label_col: str, folds: int, fold: int) -> list[tuple[str, int]]:
    """Texts and labels to learn from: not the held-out fold, about ``most`` by a hash of the id, as many of them as most_bytes hold.

    Only the ids that are sampled are broadcast, a number that ``most`` bounds;
    their texts' sizes come first, then the texts that the bound admits.
    """
    known = labels.select(F.col(quoted(id_col)).cast("string").alias("__id"), F.col(quoted(label_col)).cast("int").alias("__label")).dropna().filter(~in_fold(F.col("__id"), folds, fold))
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    n = known.count()
    if not n:
        return []
    place = F.pmod(F.xxhash64(F.lit("labelled"), "__id"), F.lit(1 << 30))
    sample = known.withColumn("__place", place).filter(F.col("__place") < int(min(1.0, most / n) * (1 << 30)))
    texts = docs.select(F.col(quoted(id_col)).cast("string").alias("__id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("__text"))
    rows = cached(texts.join(F.broadcast(sample), "__id").groupBy("__id", "__place", "__label").agg(F.min("__text").alias("__text")))
    sizes = rows.select("__place", "__id", F.octet_length("__text").alias("size")).collect()
    taken, total = set(), 0
    for r in sorted(sizes):
        total += r["size"]
        if total <= most_bytes:
            taken.add(r["__id"])
    some = rows if len(taken) == len(sizes) else rows.filter(F.col("__id").isin(sorted(taken)))
    found = some.select("__id", "__text", "__label").collect()
    rows.unpersist()
    return [(r["__text"], int(r["__label"] > 0)) for r in sorted(found)]


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, most_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    return fit(labelled(docs, labels, most_labelled, most_bytes, id_col, text_col, "toxic", FOLDS, HELD_OUT))


def _tagger(key: int, chain: Chain) -> Tagger:
    return held(("toxicity", key), lambda: Tagger(chain))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and spans of every row; one pass, no shuffle."""
    key = hash((chain.bias, chain.join, chain.score, len(chain.weights)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(key, chain)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            sums, marked = tagger.tagged(texts)
            scores = tagger.scores_of(sums)
            spans = [[{"start": a, "end": b, "marginal": p} for a, b, p in placed(x, m)] for x, m in zip(texts, marked, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, SPAN)], names=[id_col, "score", "predicted", "spans"])

    rows = docs.select(quoted(id_col), F.col(quoted(text_col)).alias("__text"))
    return map_texts(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>")


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    key = hash((chain.bias, chain.join, chain.score, len(chain.weights)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(key, chain)
        for batch in batches:
            sums, _ = tagger.tagged([x.as_py() for x in batch.column(at)])
            yield batch.filter(pa.array(tagger.scores_of(sums) < 0.5))

    # mapInArrow looks columns up by name: plain ones on the way.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return map_texts(plain, run, plain.schema, at).toDF(*docs.columns)
