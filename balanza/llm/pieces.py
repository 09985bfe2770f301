"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The white space of a text is marked and the text is cut into marked words.  The
distinct words of a batch are sorted, which is the depth-first order of their
trie: forward states of a common prefix are kept and reused by the next word.

The public model is of the merging kind: its library does not return the path of
the best sum of scores.  The search therefore runs over pairs: a piece may follow
another only if merging both together leaves the border where it is.  Such a path
is unique for each prefix and is the one that the merges give, so the forward
state is the last piece; its score is 0, that of any other path minus infinity.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balanza.llm.common import kept, pieces_of, ship

SPACE = "▁"
#: Words of more characters than this are worked out each time.
LONGEST = 64


class State(dict):
    """What the end of the characters read so far may still become: ``read`` is the longest end that some piece begins with.

    ``ends`` are the pieces that end here, longest first, as (length, number, packed
    identifiers).  Items are the states after one more character, found when first
    asked for.
    """

    __slots__ = ("ends", "pieces", "read")

    def __init__(self, pieces: Pieces, read: str):
        self.pieces, self.read = pieces, read
        found = (read[k:] for k in range(len(read) - 1))
        self.ends = tuple((len(p), i, struct.pack("<i", i)) for p in found if (i := pieces.whole.get(p)) is not None)

    def __missing__(self, character: str) -> State:
        return self.pieces.step(self, character)


class Pieces:
    """Vocabulary of one model file, with encoder and decoder; ``most`` bounds the bytes that a worker remembers of words and of pairs."""

    def __init__(self, path: str, most: int = 40 << 20):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # No piece has a mark behind another character, and none of several characters has a line break: words are independent.
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a piece spans two marked words")
        self.words = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        #: Text of each piece by number; numbers beyond are single characters without a piece.
        self.text = [""] * self.size
        for p, i in self.ids.items():
            self.text[i] = p
        #: Whether a piece may follow another, by both numbers; an entry takes some 100 bytes, and they get half of ``most``.
        self.pair: dict[int, bool] = {}
        self.most_pairs = most // 200
        #: Packed identifiers of words met, and about how many bytes they take.
        self.known: dict[str, bytes] = {}
        self.most, self.held = most, 0
        # Pieces that their own merges give, with their numbers; no other piece can occur.
        self.whole = {p: i for p, i in self.ids.items() if len(p) > 1 and len(self.merged(p)) == 1}
        self.beginnings = {p[:k] for p in self.whole for k in range(1, len(p) + 1)}
        #: No more states than beginnings of pieces; steps between them take some 40 bytes each and get a quarter of ``most``.
        self.states: dict[str, State] = {"": State(self, "")}
        self.steps, self.most_steps = 0, most // 160
        self.single = {c: (1, i, struct.pack("<i", i)) for c, i in self.ids.items() if len(c) == 1}

    def merged(self, text: str) -> list[str]:
        """Symbols of a short string after all merges, best score first, leftmost among equals."""
        symbols = list(text)
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def step(self, state: State, character: str) -> State:
        """The state after one more character, kept with the state before."""
        read = state.read + character
        while read and read not in self.beginnings:
            read = read[1:]
        if self.steps >= self.most_steps:
            for s in self.states.values():
                s.clear()
            self.steps = 0
        self.steps += 1
        if read not in self.states:
            self.states[read] = State(self, read)
        state[character] = after = self.states[read]
        return after

    def alone(self, character: str) -> tuple[int, int, bytes]:
        """A character without a piece: a number beyond all pieces, the identifiers of its bytes."""
        data = character.encode()
        return 1, self.size + ord(character), struct.pack(f"<{len(data)}i", *(self.byte_ids[b] for b in data))

    def follows(self, a: int, b: int, key: int) -> bool:
        """Whether piece b may follow piece a: the merges of both together keep the border."""
        if len(self.pair) > self.most_pairs:
            self.pair.clear()
        first = self.text[a] if a < self.size else chr(a - self.size)
        ok = self.pair[key] = self.merged(first + self.text[b]) == [first, self.text[b]]
        return ok

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, identifiers as packed 32-bit integers) of distinct words, in the order of their trie."""
        # best[i]: the last piece of the best path over the first i characters; states[i]: what they may still become.
        best: list[tuple[int, int, bytes]] = [(0, 0, b"")]
        states: list[State] = [self.states[""]]
        before, single, pair = "", self.single.get, self.pair.get
        for word in sorted(words):
            i = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                i += 1
            del best[i + 1 :], states[i + 1 :]
            state, end = states[i], i
            for character in word[i:]:
                end += 1
                state = state[character]
                for piece in state.ends:
                    start = end - piece[0]
                    if not start:
                        break
                    last = best[start][1]
                    key = last << 32 | piece[1]
                    ok = pair(key)
                    if ok or ok is None and self.follows(last, piece[1], key):
                        break
                else:
                    piece = single(character) or self.alone(character)
                best.append(piece)
                states.append(state)
            before = word
            out: list[bytes] = []
            while end:
                piece = best[end]
                out.append(piece[2])
                end -= piece[0]
            out.reverse()
            yield word, b"".join(out)

    def marked(self, text: str) -> list[str]:
        """Marked words of a text; where no mark stands beside another, the parts between spaces are those words."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return self.words((" " + text).replace(" ", SPACE))
        if "\n" not in text:
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of each text."""
        cut = [self.marked(t) for t in texts]
        distinct = set().union(*cut)
        known = self.known
        new = dict(self.encode_words(distinct.difference(known)))
        # Words of this call stay at hand until its end.
        known.update(new)
        out = [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<i4") for ws in cut]
        self.forget(distinct, new)
        return out

    def forget(self, distinct: set[str], new: dict[str, bytes]) -> None:
        """Hold what is remembered within its bound; where that is passed, words met before and again now stay."""
        known = self.known
        for word in [w for w in new if len(w) > LONGEST]:
            del known[word], new[word]
        self.held += weight(new)
        if self.held > self.most:
            again = {w: known[w] for w in distinct if w in known and w not in new}
            known.clear()
            self.held = weight(again)
            if self.held > self.most // 2:
                self.held = 0
            else:
                known.update(again)

    def decode(self, ids: np.ndarray) -> str:
        """The text: bytes of all pieces, without the mark put before the first word; broken bytes become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def weight(known: dict[str, bytes]) -> int:
    """At least the bytes that words and their identifiers take, with their places in the table."""
    return 220 * len(known) + 4 * sum(map(len, known)) + sum(map(len, known.values()))


def model(path: str) -> Pieces:
    """The model of a file, kept by the Python worker."""
    return kept(f"pieces {path}", lambda: Pieces(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless for each row of ``docs`` (doc_id, text).

    ids are the library's for the model file ``path``, without begin or end; lossless
    tells whether decoding them gives the text again (the mark character itself comes
    back as a space, as in the library).  Null and empty texts have no identifiers and
    are lossless; repeated rows and null ids stay as they are; other columns are
    ignored; an empty table gives none.  Map-only.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in pieces_of(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = m.encode(texts)
            lengths = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
            same = [m.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.record_batch([b.column("doc_id"), pa.array(lengths.astype(np.int32)), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "lossless"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens int, ids array<int>, lossless boolean")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text from identifiers: ``rows`` has doc_id and ids; null ids give a null text."""
    ship(rows.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int32)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, f"doc_id {kind}, text string")
