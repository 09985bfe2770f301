"""Toxicity scores of texts after noisy-channel deobfuscation.

Suspicious spans (letters mixed with look-alike signs, letters spaced out, letters
drawn out) become character lattices: each sign may stand for one of several
letters or be junk, a drawn-out letter may stand for one or two, a separator may be
a border between words.  A Viterbi search under a character language model, counted
over the whole corpus, restores the likeliest word of a span and the likeliest words
where it is split at separators.  A logistic model over words and word beginnings of
the restored text gives the score.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import Remembered, Renewed, Scratch, let_go, pieces_of, ship

# What a sign may stand for; accented letters of the language model beside a-z.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
ACCENTED = "äöüßàâæçéèêëîïôœùûÿñáíóúãõåø"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + ACCENTED
#: Code 0 is a border: anything but a letter.
CODES = len(LETTERS) + 1
BORDER = " "
CODE = {BORDER: 0} | {c: i + 1 for i, c in enumerate(LETTERS)}
#: Spans up to so many characters are remembered, tokens too; in longer ones, settled letters leave the search every so many columns.
SHORT = 64
#: Costs in nats: a look-alike sign, a junk sign, a letter less in a drawn-out run.
SIGN, JUNK, SHORTER = 1.5, 6.0, 0.7

_SIGNS = "".join(map(re.escape, LEET))
_L = "a-z" + ACCENTED
#: Spans inside a token: letters with single separators, signs between letters, letters drawn out.
SPANS = re.compile(
    rf"(?<![{_L}{_SIGNS}])[{_L}{_SIGNS}](?:[.\-_*\u200b][{_L}{_SIGNS}]){{2,}}(?![{_L}{_SIGNS}])"
    rf"|[{_L}]+(?:[{_SIGNS}\-_.*\u200b]+[{_L}]+)+|[{_SIGNS}]+[{_L}]+(?:[{_SIGNS}]*[{_L}]+)*"
    rf"|[{_L}]*([{_L}])\1\1[{_L}]*"
)
#: Three or more single characters with a space between each.
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
#: What may be a border inside a span: anything but letters and signs, and the star.
SEPARATOR = re.compile(rf"[^{_L}{_SIGNS}]|\*")
CHAR_MAP = np.zeros(0x250, np.uint8)
CHAR_MAP[[ord(c) for c in LETTERS if ord(c) < 0x250]] = [i + 1 for i, c in enumerate(LETTERS) if ord(c) < 0x250]


def codes(text: str) -> np.ndarray:
    """Letter codes of a lower-case text, 0 for all else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CHAR_MAP[np.where(points < len(CHAR_MAP), points, 0)]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(trigram, n) over all texts: letters by code, words ending at borders.  At most CODES ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(CODES**3, np.int64)
        for b in pieces_of(batches, "text"):
            x = codes("  ".join(t for t in b.column("text").to_pylist() if t).lower()).astype(np.int32)
            if len(x) > 2:
                total += np.bincount((x[:-2] * CODES + x[1:-1]) * CODES + x[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["trigram", "n"])

    counts = docs.select("text").mapInArrow(count, "trigram int, n long")
    return counts.groupBy("trigram").agg(F.sum("n").alias("n"))


class Channel:
    """Restores obfuscated spans under a trigram model of letters; ``most`` bounds the bytes that a worker remembers."""

    def __init__(self, counts: np.ndarray, most: int = 24 << 20):
        n = counts.reshape(CODES, CODES, CODES).astype(np.float64)
        n2, n1 = n.sum(2, keepdims=True), n.sum((0, 1))
        uni = (n1 + 1) / (n1.sum() + CODES)
        bi = (n.sum(0) + 2 * uni) / (n.sum(0).sum(1, keepdims=True) + 2)
        self.cost = -np.log((n + 2 * bi[None]) / (n2 + 2))
        self.memo = Remembered(most, SHORT)

    def lattice(self, span: str, borders: bool = False) -> list[list[tuple[str, float]]]:
        """One column for each run of equal characters: (letters, channel cost); no letters where the run is junk.

        With ``borders``, a separator may also end a word.
        """
        spaced = not re.search(rf"[{_L}]{{2}}", span)
        columns = []
        for m in re.finditer(r"(.)\1*", span, re.S):
            c, k = m[1], len(m[0])
            if c in LETTERS:
                columns.append([(c * j, SHORTER * (k - j)) for j in range(max(1, min(k, 2) - 1), min(k, 2) + 1)])
                continue
            if c in LEET:
                ways = [(x * j, SIGN * k) for x in LEET[c] for j in range(1, min(k, 2) + 1)]
                columns.append([*ways, ("", JUNK if c not in "*|" else SIGN)])
            else:
                columns.append([("", 0.0 if spaced else SIGN)])
            if borders and (c == "*" or c not in LEET):
                columns[-1].append((BORDER, SIGN if c == "*" else 0.0))
        return columns

    def search(self, columns: list[list[tuple[str, float]]]) -> str:
        """The likeliest letters and borders, by Viterbi over states of the last two.

        All of the columns are searched in one go.  What every state's path begins with is
        settled and set aside from time to time, so that paths stay short.
        """
        cost = self.cost
        settled: list[str] = []
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for k, column in enumerate(columns, 1):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (paid, word) in states.items():
                for letters, price in column:
                    x, y, total = a, b, paid + price
                    for c in letters:
                        z = CODE[c]
                        total += cost[x, y, z]
                        x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = total, word + letters
            states = after
            if k % SHORT == 0:
                same = os.path.commonprefix([word for _, word in states.values()])
                settled.append(same)
                states = {s: (paid, word[len(same) :]) for s, (paid, word) in states.items()}
        # The last word ends at a border.
        settled.append(min(states.items(), key=lambda s: (s[1][0] + cost[s[0][0], s[0][1], 0], s[1][1]))[1][1])
        return "".join(settled)

    def remembered(self, span: str, borders: bool) -> str:
        key = (BORDER if borders else "") + span
        if key in self.memo:
            return self.memo[key]
        best = self.search(self.lattice(span, borders))
        return self.memo.keep(key, best, 56 + len(best))

    def restore(self, span: str) -> str:
        """The likeliest word."""
        return self.remembered(span, False)

    def words(self, span: str) -> set[str]:
        """The likeliest word, and the likeliest words where the span has separators to split it at."""
        found = {self.restore(span)}
        if SEPARATOR.search(span):
            found.update(self.remembered(span, True).split(BORDER))
        return found - {""}


def squeezed(word: str) -> str:
    """Runs of a letter as one letter, so that a doubled letter makes no other feature."""
    return _RUN.sub(r"\1", word)


_RUN = re.compile(r"(.)\1+", re.S)
WORD = re.compile(rf"[{_L}]+")
#: Lengths of word beginnings that are features beside whole words, for stems with many endings, and how many
#: distinct words of one beginning are told apart.
STEMS, SEVERAL = (3, 4, 5, 6, 7, 8), 3


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n]


def named(words: set[str]) -> set[str]:
    """Features of a text: its words, and word beginnings marked by "~" once for each word that has them, up to SEVERAL."""
    counts = Counter(s for w in words for s in stems(w))
    return words | {s + "~" * k for s, c in counts.items() for k in range(1, min(c, SEVERAL) + 1)}


class Reader:
    """Features of texts: which words and beginnings of interest occur in the restored text."""

    def __init__(self, counts: np.ndarray, features: dict[str, int] | None = None, most: int = 40 << 20):
        self.channel = Channel(counts)
        self.features = features or {}
        self.stems = {f.rstrip("~") for f in self.features}
        #: The words of interest of each token met.
        self.seen = Renewed(most, SHORT)

    def of_token(self, token: str) -> set[str]:
        """Words of a lower-case token, obfuscated spans restored, runs of a letter as one."""
        words = set(WORD.findall(token))
        for m in SPANS.finditer(token):
            words.update(self.channel.words(m[0]))
        return set(map(squeezed, words))

    def spaced(self, text: str) -> set[str]:
        """Words restored from letters that are spaced out."""
        return {squeezed(w) for m in SPACED.finditer(text) for w in self.channel.words(m[0])}

    def names(self, text: str) -> set[str]:
        text = text.lower()
        return named(set().union(*map(self.of_token, set(text.split())), self.spaced(text)))

    def numbers(self, text: str) -> list[int]:
        """Numbers of the chosen features that occur."""
        text = text.lower()
        tokens = set(text.split())
        words = self.spaced(text)
        seen = self.seen
        for t in tokens:
            found = seen.get(t)
            if found is None:
                found = seen.find(t)
                if found is None:
                    found = tuple(w for w in self.of_token(t) if w in self.stems or any(s in self.stems for s in stems(w)))
                seen.keep(t, found, 120 * len(found))
            if found:
                words.update(found)
        return sorted(self.features[n] for n in named(words) if n in self.features)


@dataclass(frozen=True)
class Training:
    """Bounds of the fit: labelled rows in the sample, features chosen, pull towards 0, steps."""

    rows: int = 12_000
    features: int = 2_000
    ridge: float = 1e-4
    steps: int = 600
    seed: int = 11


def logistic(rows: list[list[int]], y: np.ndarray, width: int, t: Training) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps on the mean loss.

    Weights are not negative: toxic words are evidence, other words are none for the contrary.
    """
    lengths = np.array([len(r) for r in rows])
    at = np.array([f for r in rows for f in r], np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    w, b, n = np.zeros(width), 0.0, len(rows)
    v, u = w.copy(), b
    rate = 1 / (0.25 * (1 + lengths.mean() * 2) + t.ridge)
    for k in range(t.steps):
        z = np.bincount(of, v[at], minlength=n) + u
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        w2, b2 = np.maximum(v - rate * (np.bincount(at, d[of], minlength=width) + t.ridge * v), 0), u - rate * d.sum()
        m = k / (k + 3)
        v, u, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


@dataclass
class Model:
    counts: np.ndarray
    features: dict[str, int]
    weights: np.ndarray
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Model:
    """Language model over all of ``docs``; classifier on a bounded sample of the rows with a label.

    Rows whose crc32 of the id as text is divisible by 5 are held out.  The sample is
    the labelled ids of smallest hash, as many of each kind, with each text once.  Features are those whose presence is the surest sign of toxicity.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "toxicity")
    counts = np.zeros(CODES**3)
    # At most CODES ** 3 rows, whatever the corpus.
    for r in trigram_counts(docs).collect():
        counts[r["trigram"]] = r["n"]
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out("doc_id")).select(F.col("doc_id").alias("of"), (F.col("toxic") == 1).alias("toxic"))
    seeded = F.xxhash64(F.lit(t.seed), "of")
    halves = [known.filter(kind).orderBy(seeded, "of").limit(t.rows // 2) for kind in (F.col("toxic"), ~F.col("toxic"))]
    # At most t.rows ids: the documents are not shuffled to find their texts.
    ids = F.broadcast(halves[0].unionByName(halves[1]))
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("of")).select("text", "toxic", F.xxhash64("text").alias("h"))
    shared = spark.sparkContext.broadcast(counts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        reader = Reader(shared.value)
        for b in pieces_of(batches, "text"):
            names = [sorted(reader.names(x or "")) for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("h"), b.column("toxic"), pa.array(names, pa.list_(pa.string()))], ["h", "toxic", "names"])

    once = chosen.groupBy("h", "toxic").agg(F.first("text").alias("text"))
    sample = scratch.keep(once.mapInArrow(read, "h long, toxic boolean, names array<string>"), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        return Model(counts, {}, np.zeros(0), math.log((pos + 0.5) / (neg + 0.5)))
    per_name = sample.select(F.explode("names").alias("name"), "toxic").groupBy("name").agg(
        F.count(F.when(F.col("toxic"), 1)).alias("p"), F.count(F.when(~F.col("toxic"), 1)).alias("n")
    )
    gap = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    # Two standard errors below the log-odds: rare names need to be clearer than common ones.
    sure = gap - 2 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = per_name.filter(sure > 0).orderBy(sure.desc(), "name").limit(t.features).collect()
    features = {r["name"]: i for i, r in enumerate(best)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [[features[x] for x in names if x in features] for names in b.column("names").to_pylist()]
            yield pa.record_batch([b.column("toxic"), pa.array(at, pa.list_(pa.int32()))], ["toxic", "at"])

    data = sample.select("toxic", "names").mapInArrow(pick, "toxic boolean, at array<int>").collect()
    w, b = logistic([r["at"] for r in data], np.array([float(r["toxic"]) for r in data]), len(features), t)
    # The kinds are sampled by themselves; the intercept is set to their shares among all labels.
    known_pos, known_neg = (known.filter(kind).count() for kind in (F.col("toxic"), ~F.col("toxic")))
    b += math.log(known_pos / known_neg) - math.log(pos / neg)
    scratch.drop("sample")
    return Model(counts, features, w, b)


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        reader = Reader(m.counts, m.features)
        for b in pieces_of(batches, "text"):
            z = [m.intercept + float(m.weights[reader.numbers(t)].sum()) if t else m.intercept for t in b.column("text").to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -500, 500)))
            yield pa.record_batch([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic; a doc_id with several labels counts as toxic if
    one says so, null ids and labels are ignored.  Only the text is an input of the
    score.  Null and empty texts get the score of a text without features; a null id
    is not held out; repeated rows are scored alike; other columns are ignored.
    Without labels of both kinds every text gets the share of the kind there is; an
    empty table gives none.
    """
    out = scored(docs, fit(docs, labels, training))
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, columns unchanged."""
    model = fit(docs, labels)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        reader = Reader(m.counts, m.features)
        for b in pieces_of(batches, "text"):
            keep = [not t or m.intercept + float(m.weights[reader.numbers(t)].sum()) < 0 for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
