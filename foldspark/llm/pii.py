"""Personal data by weak supervision.

Candidates are the base matches (email, ip, card, phone) and looser ones that
the base patterns leave out: written-out addresses, phone numbers without a
plus, national ids, and base matches that failed their kind's check, whatever
their length. Where loose candidates overlap, the more specific kind is taken.
Five labelers vote on each candidate, for, against or not at all: the base
pattern, the checksum or shape, a gazetteer, the words before it, and its edges.
Expectation-maximisation (Dawid and Skene, 1979) estimates for each kind how
reliable each labeler is and how likely each pattern of votes is personal data;
it needs only the number of candidates with each pattern, which Spark counts and
whose number is bounded (3 to the power of 5 for each kind). A logistic
classifier of the span's shape and context is then trained on those
probabilities and has the last word on the looser candidates; base matches
always stay.

The classifier's rows are the distinct candidates (kind, votes, features) with
their counts, which Spark adds up over all rows, so a template that stands in a
third of all texts is one weighted row. Of each kind about ``most_sampled``
distinct ones are taken at most (a documented bound on what the fit holds), each
with a probability in proportion to its count and weighted by its inverse: the
frequent ones are always in.

Base matches are leftmost and non-overlapping for each kind; those that fail the
kind's check are dropped without a retry. Offsets are code points, ends are
exclusive.

Defined results: null or empty text has no spans; very long texts and matches
(runs of thousands of digits among them) are read whole, in linear time; repeated
rows and repeated ids stay, each row with its own text's spans; a null id stays;
other columns aren't read and may have any name; without candidates nothing is
trained and nothing added; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, map_texts

KINDS = ("email", "ip", "card", "phone", "national_id")
BASE = 4
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")
DIMENSIONS = 1 << 12

# The base patterns. Possessive forms match the same, in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Looser candidates.
_AT = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?", re.I)
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)+", re.I)
_PLAIN_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Gazetteers: fixed values.
_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app co me de fr es it uk us nl eu ch at be pl pt se no fi dk cz ca au br in jp cn ru example test".split())
_CARD_PREFIXES = ("34", "37", "36", "38", "4", "51", "52", "53", "54", "55", "2", "6011", "65", "35", "62")
_HINTS = {
    0: frozenset("mail email e-mail contact write address reach from to correo courriel".split()),
    1: frozenset("ip host server address from client node addr".split()),
    2: frozenset("card visa mastercard amex credit debit payment pay karte carte tarjeta".split()),
    3: frozenset("phone tel call mobile fax cell contact whatsapp telefon téléphone teléfono".split()),
    4: frozenset("ssn social security id insurance".split()),
}
_AGAINST = frozenset("version v release isbn page pages section chapter figure fig no number order price total sum $ € eur usd rfc iso".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    """At most 255; a run of any number of digits."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, passes the kind's check) of every base match."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end, True))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            out.append((1, m.start(), m.end(), all(map(_octet, m[0].split(".")))))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 9:
                digits = m[0].replace(" ", "").replace("-", "")
                out.append((2, m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                out.append((3, m.start(), m.end(), 9 <= len(_DIGIT.findall(m[0])) <= 15))
    return out


def spelled(text: str) -> list[tuple[int, int]]:
    """Addresses with a written-out at sign: name (at) domain [dot] com."""
    out, end = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            end = domain.end()
            out.append((start, end))
    return out


#: Of overlapping loose candidates the more specific kind is taken: national id, phone, email, ip, card.
_ORDER = {4: 0, 3: 1, 0: 2, 1: 3, 2: 4}


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """Base matches, failed ones among them, and the looser candidates beside them: (kind, start, end, base)."""
    found = base_matches(text)
    sure = sorted((a, b) for _, a, b, ok in found if ok)
    loose = [(k, a, b) for k, a, b, ok in found if not ok]
    if "(" in text or "[" in text:
        loose += [(0, a, b) for a, b in spelled(text)]
    if _DIGIT.search(text):
        loose += [(3, m.start(), m.end()) for m in _PLAIN_PHONE.finditer(text)]
        loose += [(4, m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    starts = [a for a, _ in sure]
    highest = np.maximum.accumulate([b for _, b in sure]) if sure else []
    taken: list[tuple[int, int]] = []  # apart from each other, in order

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1
        if i >= 0 and highest[i] > a:
            return False
        j = bisect_left(taken, (b, b)) - 1
        return j < 0 or taken[j][1] <= a

    out = [(k, a, b, True) for k, a, b, ok in found if ok]
    for k, a, b in sorted(set(loose), key=lambda x: (_ORDER[x[0]], x[1], x[2])):
        if free(a, b):
            out.append((k, a, b, False))
            insort(taken, (a, b))
    return sorted(out)


def _failed(kind: int, span: str) -> bool:
    """Whether a span that isn't a base match is a match of its kind's base pattern that failed the check."""
    return kind in (1, 2) or (kind == 3 and span.startswith("+"))


_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)?|[$€]")


class Context:
    """The tokens of a text, found once, for the words around its candidates."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def _words(self, a: int, b: int) -> list[str]:
        return [self.text[self.starts[i] : self.ends[i]].lower() for i in range(max(a, 0), min(b, len(self.starts)))]

    def before(self, start: int, n: int) -> list[str]:
        """The last n tokens that end before start."""
        i = bisect_right(self.ends, start)
        return self._words(i - n, i)

    def after(self, end: int, n: int) -> list[str]:
        i = bisect_left(self.starts, end)
        return self._words(i, i + n)


def votes(text: str, context: Context, kind: int, start: int, end: int, base: bool) -> list[int]:
    """One vote (1, -1 or 0: none) of each labeler."""
    span = text[start:end]
    digits = "".join(_DIGIT.findall(span))
    before = context.before(start, 4)
    # A candidate of a looser pattern is none of the base pattern's concern; a failed match speaks against.
    pattern = 1 if base else -1 if _failed(kind, span) else 0
    if kind == 0:
        last = re.split(r"[.\s)\]]+", span)[-1].lower()
        check, gazetteer = (1 if last.isalpha() and len(last) > 1 else -1), (1 if last in _DOMAINS else 0)
    elif kind == 1:
        parts = span.split(".")
        check = 1 if all(map(_octet, parts)) else -1
        gazetteer = -1 if not parts[0].strip("0") or all(len(p) == 1 for p in parts) else 0
    elif kind == 2:
        check, gazetteer = (1 if 13 <= len(digits) <= 19 and luhn(digits) else -1), (1 if digits.startswith(_CARD_PREFIXES) else -1)
    elif kind == 3:
        check, gazetteer = (1 if 9 <= len(digits) <= 15 else -1), (1 if span.startswith(("+1", "+3", "+4", "(")) else 0)
    else:
        check, gazetteer = (-1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1), 0
    hint = 1 if _HINTS[kind].intersection(before) else -1 if _AGAINST.intersection(before) else 0
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return [pattern, check, gazetteer, hint, -1 if glued else 1]


def shape_features(text: str, context: Context, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span and its context, for the classifier. Lengths from 40 on share one bin."""
    span = text[start:end]
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", span)))
    names = [f"k{kind}", f"k{kind}s{shape}", f"k{kind}n{min(end - start, 40) // 4}", f"k{kind}l{text[start - 1 : start]}", f"k{kind}r{text[end : end + 1]}", *(f"k{kind}b{w}" for w in context.before(start, 2)), *(f"k{kind}a{w}" for w in context.after(end, 1))]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


def described(text: str) -> list[dict]:
    """The candidates of a text with their votes and features."""
    found = candidates(text)
    context = Context(text) if found else None
    return [dict(kind=k, start=a, end=b, base=base, votes=",".join(map(str, votes(text, context, k, a, b, base))), features=shape_features(text, context, k, a, b)) for k, a, b, base in found]


CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,features:array<int>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and __found, the candidates of each row with their votes and features; texts end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], names=[id_col, "__found"])

    rows = docs.select(id_col, docs[text_col].alias("__text"))
    return map_texts(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, __found {CANDIDATE}")


def dawid_skene(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern of votes, the vote rates [class, labeler, vote + 1], and the prior.

    A labeler that doesn't vote says nothing: rates are among its votes.
    """
    p = np.clip(0.5 + patterns.mean(axis=1) / 2, 0.05, 0.95)
    rates, prior = np.ones((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        for c, w in ((0, counts * (1 - p)), (1, counts * p)):
            for j in range(patterns.shape[1]):
                n = np.array([w[patterns[:, j] == v].sum() for v in (-1, 1)]) + 0.5 + np.array([0.5, 0] if c == 0 else [0, 0.5])
                rates[c, j, ::2] = n / n.sum()
        prior = (counts @ p + 1) / (counts.sum() + 2)
        log = np.array([np.log((1 - prior, prior)[c]) + sum(np.log(rates[c, j, patterns[:, j] + 1]) for j in range(patterns.shape[1])) for c in (0, 1)])
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return p, rates, float(prior)


@dataclass
class Model:
    #: Probability of each (kind, votes) that occurs.
    posterior: dict[tuple[int, str], float] = field(default_factory=dict)
    reliability: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))
    bias: float = -10.0

    def probability(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features].sum(), -500, 500))))


def sample_of(each: DataFrame, totals: dict[int, int], most: int) -> DataFrame:
    """About ``most`` distinct candidates of each kind at most, with their weights: no more depends on partitions or order than in a count."""
    counts = each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    total = F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("kind"))
    share = F.least(F.lit(1.0), F.col("n") * F.lit(float(most)) / total)
    u = F.pmod(F.xxhash64(F.lit("pii"), "kind", "votes", "features"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return counts.withColumn("share", share).filter(u < F.col("share")).select("kind", "votes", "features", (F.col("n") / F.col("share")).alias("weight"))


def train(found: DataFrame, most_sampled: int = 10_000, rounds: int = 300) -> Model:
    """From the rows of extract(): reliabilities by kind, then the span classifier."""
    model = Model()
    each = found.select(F.explode("__found").alias("c")).select("c.*")
    table = each.groupBy("kind", "votes").count().collect()
    totals: dict[int, int] = {}
    for kind in sorted({r["kind"] for r in table}):
        rows = sorted((r["votes"], r["count"]) for r in table if r["kind"] == kind)
        patterns = np.array([[int(v) for v in votes_.split(",")] for votes_, _ in rows])
        p, rates, _ = dawid_skene(patterns, np.array([float(n) for _, n in rows]))
        model.reliability[kind] = rates
        model.posterior |= {(kind, v): float(x) for (v, _), x in zip(rows, p, strict=True)}
        totals[kind] = sum(n for _, n in rows)
    if not totals:
        return model
    sample = sorted(sample_of(each, totals, most_sampled).collect(), key=lambda r: (r["kind"], r["votes"], r["features"]))
    if not sample:
        return model
    row = np.repeat(np.arange(len(sample)), [len(r["features"]) for r in sample])
    col = np.concatenate([r["features"] for r in sample]).astype(int)
    y = np.array([model.posterior[r["kind"], r["votes"]] for r in sample])
    weight = np.array([r["weight"] for r in sample])
    weight = weight / weight.sum()
    w, bias, scale, bias_scale = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(row, w[col], minlength=len(y))
        delta = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        grad = np.bincount(col, delta[row], minlength=DIMENSIONS) + 1e-6 * w
        scale += grad * grad
        w -= 0.3 * grad / np.sqrt(scale)
        bias_scale += delta.sum() ** 2
        bias -= 0.3 * delta.sum() / np.sqrt(bias_scale)
    model.weights, model.bias = w, float(bias)
    return model


def judge(found: DataFrame, model: Model, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """id and spans (kind, start, end, probability, base): the base matches and the looser ones that the classifier takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                spans = []
                for c in x.as_py() or []:
                    p = model.probability(c["features"])
                    if c["base"] or p >= least:
                        spans.append(dict(kind=KINDS[c["kind"]], start=c["start"], end=c["end"], probability=p, base=c["base"]))
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=[id_col, "spans"])

    kind = found.schema[id_col].dataType.simpleString()
    return found.select(id_col, "__found").mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,probability:double,base:boolean>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Extract, train and judge; texts are read once."""
    found = cached(extract(docs, id_col, text_col))
    return judge(found, train(found), id_col)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of find(); spans stand by kind, then start."""
    of_base = F.filter("spans", lambda s: s["base"])

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(of_base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(id_col, *[count(k) for k in KINDS[:BASE]], F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
