"""Byte-level BPE by prefix dynamic programming, and its inverse.

A byte-pair encoding of a string is right exactly if its first token encodes
itself and each two neighbours encode themselves side by side. So each prefix of
a string has one valid last token: the one token that ends there and fits the
last token of the prefix before it. Storing that token for each prefix gives

* the encoding of every prefix, by walking back;
* appends: the new prefixes only need the old ones;
* edits: prefixes before the edit stay, and behind it the stored tokens hold
  again as soon as they have agreed over the longest token's length.

Both need a vocabulary in which the parts of a token rank before it, as training
makes them; another one is an error.

Text is first cut by the vocabulary's pattern and each match is encoded on its
own, as in the tiktoken library; a match that is itself in the vocabulary is
that token. Special tokens are ordinary text.

Defined results: null text is empty text: 0 tokens and the digests of nothing;
repeated rows stay; a null id stays null; an empty table gives none; other columns
are not read and may have any name. Very long matches take time in proportion to
their length, and aren't held in a worker's memo.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, held, map_texts

#: Unicode White_Space, which tiktoken's \s means; Python's own \s also takes U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0  -     　"


#: Bytes by which shared prefixes are kept.
HEAD = 3


def compiled(pattern: str):
    """pattern with its \\s and \\S as the Unicode property."""
    inner = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"[\s", f"[{SPACE}")
    return regex.compile(inner.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixCoder:
    """Encodes byte strings over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        tails: dict[bytes, set[int]] = {}
        for token in ranks:
            tails.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens of which the last three bytes, or the whole, are given, longest first.
        self.lengths = {tail: tuple(sorted(found | {n for n in (1, 2) if tail[-n:] in ranks}, reverse=True)) for tail, found in tails.items()}
        self.parts = Memo(lambda token: self.merged(token, 2), 1 << 20)
        #: Whether a token encodes itself: its merges then come down to two parts, which it joins.
        self.whole = Memo(lambda rank: len(self.token[rank]) == 1 or len(self.parts[self.token[rank]]) == 2, 1 << 20)
        self.left = Memo(lambda rank: self._edge(rank, 0), 1 << 20)
        self.right = Memo(lambda rank: self._edge(rank, -1), 1 << 20)
        self.fits = Memo(self._fit, 1 << 18)
        #: Last tokens of the prefixes of a few first bytes, which many strings share.
        self.heads = Memo(self._head, 1 << 17)

    def merged(self, data: bytes, upto: int = 1) -> list[bytes]:
        """Byte-pair merges in the order of rank, for the few bytes of a token, until ``upto`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > upto:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, rank: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one edge of a token while it is merged, from a byte up to the token.

        With each the rank of the merge that ends it.
        """
        out, token, ends = [], self.token[rank], float("inf")
        while True:
            out.append((token, ends))
            if len(token) == 1:
                return out[::-1]
            ends = self.ranks[token]
            token = self.parts[token][side]
            if self.ranks[token] >= ends and len(token) > 1:
                raise ValueError("a token ranks before one of its parts")

    def _fit(self, pair: int) -> bool:
        """Whether two tokens side by side encode themselves; pair is left << 32 | right.

        Merges happen in the order of rank, so the parts at the common edge change
        in a known order; the two fit if none of the pairs of parts that meet there
        would have been merged first. Of equal ranks the left one comes first.
        """
        if not (self.whole[pair >> 32] and self.whole[pair & 0xFFFFFFFF]):
            return False
        left, right, i, j = self.right[pair >> 32], self.left[pair & 0xFFFFFFFF], 0, 0
        rank = self.ranks.get
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            across = rank(a + b)
            if across is not None and across < a_ends and across <= b_ends:
                return False
            if a_ends <= b_ends:
                if i + 1 == len(left):
                    return True
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Append to ``last`` the valid last tokens of the prefixes of ``data`` that it lacks.

        last[i] belongs to the prefix of length i + 1.
        """
        ranks, lengths, fits, whole = self.ranks, self.lengths, self.fits, self.whole
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            tail = data[end - 3 : end] if end > 3 else data[:end]
            for n in lengths.get(tail) or ((2, 1) if tail[-2:] in ranks else (1,)):
                if n >= end:
                    if n > end or (token := ranks.get(data[:end])) is None or not whole[token]:
                        continue
                elif (token := ranks.get(data[end - n : end])) is None or not fits[last[end - n - 1] << 32 | token]:
                    continue
                last.append(token)
                break
            else:
                raise ValueError("no valid last token: the vocabulary lacks a byte")

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of length ``end``, from the stored last tokens."""
        at, out = len(last) if end is None else end, []
        while at:
            out.append(last[at - 1])
            at -= len(self.token[last[at - 1]])
        return out[::-1]

    def _head(self, data: bytes) -> list[int]:
        last = self.heads[data[:-HEAD]].copy() if len(data) > HEAD else []
        self.extend(data, last)
        return last

    def encode(self, data: bytes) -> list[int]:
        size = (len(data) - 1) // HEAD * HEAD if len(data) <= 4 * HEAD else HEAD
        last = self.heads[data[:size]].copy() if size > 0 else []
        self.extend(data, last)
        return self.walk(last)

    def encode_match(self, data: bytes) -> list[int]:
        """What tiktoken makes of one match of the pattern."""
        own = self.ranks.get(data)
        return self.encode(data) if own is None or self.whole[own] else [own]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Encoded:
    """One byte string with the last tokens of its prefixes; grows and changes in place."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of data[start:end]; how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = last = old[:start]
        agreed, edge = 0, start + len(new)
        while len(last) < len(self.data):
            self.coder.extend(self.data, last, len(last) + 1)
            at = len(last) - 1
            agreed = agreed + 1 if at >= edge and last[at] == old[at - shift] else 0
            if agreed >= self.coder.longest:
                done = len(last) - start
                last.extend(old[len(last) - shift :])
                return done
        return len(last) - start

    def ids(self, end: int | None = None) -> list[int]:
        return self.coder.walk(self.last, end)


class TextCoder:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str):
        self.coder = PrefixCoder(read_ranks(path))
        self.matches = compiled(pattern).findall
        self.packed = Memo(lambda match: array("I", self.coder.encode_match(match.encode("utf-8", "surrogatepass"))).tobytes(), 300_000)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.matches(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return self.coder.decode(ids)


def text_coder(path: str, pattern: str) -> TextCoder:
    """One for each worker and vocabulary."""
    return held(("bpe", path, pattern), lambda: TextCoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens and token_ids (binary: little-endian unsigned 32-bit integers) of each row."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, pattern)
        for batch in batches:
            ids = [coder.encode(text.as_py() or "") for text in batch.column(len(keep))]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), n, pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "token_ids"])

    rows = docs.select(*keep, docs[text_col].alias("__text"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return map_texts(rows, run, ", ".join([*kinds, "n_tokens long", "token_ids binary"]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and the digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                packed = coder.encode(text.as_py() or "")
                n.append(len(packed) // 4)
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, docs[text_col].alias("__text"))
    return map_texts(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

