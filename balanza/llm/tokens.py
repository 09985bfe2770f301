"""Token counts by byte-pair merging over a heap and a linked list.

The tokenizer file is read where it is installed; it is never copied or trained.
A text is cut by the byte-level pattern, each piece becomes a list of byte
symbols, and the adjacent pair of lowest rank (leftmost first) is merged until
no pair has a rank.  The count is the number of initial symbols minus the number
of merges; identifiers are never formed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import Remembered, kept, ship

#: Fixed value: the pre-tokenization pattern of the byte-level scheme.  White space is the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same pattern with the letters, numbers and spaces below U+0250 spelt out, for the faster standard matcher.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(free))
        free += b not in printable
    return out


def pair_ranks(merges: list[tuple[str, str]]) -> dict[int, int]:
    """Rank of each mergeable pair, keyed by both symbol numbers; bytes are 0-255, the product of rank r is 256 + r."""
    number = {s: i for i, s in enumerate(byte_symbols())}
    ranks: dict[int, int] = {}
    for r, (a, b) in enumerate(merges):
        ranks[number[a] << 24 | number[b]] = r
        number.setdefault(a + b, 256 + r)
    return ranks


def merged_length(symbols: list[int], ranks: dict[int, int]) -> int:
    """Number of symbols left after all merges; ``symbols`` is used up."""
    n = len(symbols)
    get = ranks.get
    # at[i]: rank of the pair that starts at i now; a heap entry with another rank is stale.
    at = [get(a << 24 | b, -1) for a, b in zip(symbols, symbols[1:])]
    heap = [r << 32 | i for i, r in enumerate(at) if r >= 0]
    if not heap:
        return n
    heapify(heap)
    at.append(-1)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        e = heappop(heap)
        i = e & 0xFFFFFFFF
        r = e >> 32
        if at[i] != r:
            continue
        symbols[i] = merged = 256 + r
        j = nxt[i]
        at[j] = -1
        left -= 1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            at[i] = r = get(merged << 24 | symbols[k], -1)
            if r >= 0:
                heappush(heap, r << 32 | i)
        else:
            at[i] = -1
        p = prv[i]
        if p >= 0:
            at[p] = r = get(symbols[p] << 24 | merged, -1)
            if r >= 0:
                heappush(heap, r << 32 | p)
    return left


class Memo(Remembered):
    """Results of ``work`` met so far."""

    def __init__(self, work: Callable[[str], int], most: int):
        super().__init__(most)
        self.work = work

    def __missing__(self, key: str) -> int:
        return self.keep(key, self.work(key))


class TokenCounter:
    """Token counts of texts by one tokenizer file; ``most`` bounds the bytes that a worker remembers."""

    def __init__(self, path: str, most: int = 96 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = pair_ranks([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]])
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.split = regex.compile("|".join(map(regex.escape, self.specials))).split if self.specials else None
        self.findall = regex.compile(PATTERN).findall
        self.latin_findall = re.compile(LATIN_PATTERN).findall
        self.beyond_latin = re.compile("[^\\x00-\u024f]").search
        self.pieces = Memo(lambda piece: merged_length(list(piece.encode("utf-8", "surrogatepass")), self.ranks), most // 2)
        self.after_space = Memo(lambda word: self.plain(" " + word), most // 2)
        self.odd_space = re.compile(r" (?:\s|$)").search

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        findall = self.findall if self.beyond_latin(text) else self.latin_findall
        return sum(map(self.pieces.__getitem__, findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token, as by the library's default."""
        if any(s in text for s in self.specials):
            parts = self.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if not text or self.odd_space(text):
            return self.plain(text)
        # A piece always begins at a space before something that is no white space, so the parts between spaces add up.
        first, *rest = text.split(" ")
        return self.plain(first) + sum(map(self.after_space.__getitem__, rest))


def counter(path: str) -> TokenCounter:
    """The counter of a file, kept by the Python worker."""
    return kept(f"tokens {path}", lambda: TokenCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row of ``docs`` (doc_id, text).

    ``path`` is the tokenizer file as seen by the executors.  Null and empty texts
    have 0 bytes and 0 tokens; repeated rows and null ids stay as they are; other
    columns are ignored; an empty table gives an empty table.  Map-only: nothing is
    shuffled, and a very long text costs its own task only time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = [c.count(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
