"""SentencePiece-style encoding by Viterbi over the matches of an Aho-Corasick automaton, and exact decoding.

The automaton is built over the pieces. It reads a text once; at every position
it reports all pieces that end there (its output links), and each of them
relaxes the best score of the position by the best score before the piece.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trivane.llm.wordhash import lists_of

#: A public BPE-type model with byte fallback; any other path can be given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose pieces a task remembers at most.
REMEMBERED = 200_000
#: Rows of an Arrow batch that the tasks give back.
ROWS = 256


@dataclass(frozen=True)
class Vocabulary:
    """(piece, score, id) of the ordinary pieces, ids of the 256 byte pieces, score of a character that no piece holds."""

    pieces: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]
    unknown: float
    size: int

    @staticmethod
    def load(path: str = DEFAULT_MODEL, scores: str = "auto") -> Vocabulary:
        """Read a model on the driver; its few hundred kB go to the tasks with the functions.

        scores "model" takes the file's scores as log probabilities (a unigram
        model). A BPE model has merge ranks instead, of which a sum says nothing:
        "zipf" scores the piece of rank r with -log(r + 1). "auto" takes "zipf" if the scores
        are whole numbers in falling order.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ordinary = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        given = [sp.get_score(i) for i in ordinary]
        ranks = all(s == int(s) for s in given)
        if scores == "zipf" or (scores == "auto" and ranks):
            given = [-math.log(r + 1) for r in range(1, len(ordinary) + 1)]
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces: texts could not be restored")
        return Vocabulary(tuple((sp.id_to_piece(i), s, i) for i, s in zip(ordinary, given, strict=True)), tuple(byte_ids[b] for b in range(256)), min(given) - 10, n)


#: A word splitter cuts only where no piece can lie across; the finest one that no piece contradicts is used.
_LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SPLITTERS = (
    f" *[{_LATIN}]+| *[^{_LATIN} \n]+| +|\n+",
    " *[^ \n]+| +|\n+",
    " *[^ ]+| +",
    r"(?s).+",
)


class _Known(dict):
    """Word -> its ids as bytes, worked out at the first use. A full memory takes no new words: the frequent ones came first."""

    def __init__(self, best_path):
        super().__init__()
        self.best_path = best_path

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.best_path(word)).tobytes()
        if len(word) <= 64 and len(self) < REMEMBERED:
            self[word] = ids
        return ids


#: The encoder and decoder of the last vocabulary, kept from task to task in a worker.
_kept: dict[str, tuple] = {}


def _shared(kind: str, vocabulary: Vocabulary):
    """One Encoder or Decoder in a process, so that neither is built, or left over, once a task."""
    if kind not in _kept or _kept[kind][0] != vocabulary:
        _kept[kind] = (vocabulary, Encoder(vocabulary) if kind == "encode" else Decoder(vocabulary))
    return _kept[kind][1]


class Encoder:
    """Encodes in one process, word by word. Inside, a space stands for the mark SPACE."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        pieces = [(p.replace(SPACE, " "), s, i) for p, s, i in vocabulary.pieces]
        for piece, score, i in pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        fits = lambda x: all(m is not None and m.end() == len(p) for p, _, _ in pieces for m in [x.match(p)])
        self.words = next(x for x in map(re.compile, SPLITTERS) if fits(x))
        self.known = _Known(self.best_path)
        self.mark = array("i", [vocabulary.byte_ids[b] for b in SPACE.encode()]).tobytes()

    def best_path(self, word: str) -> list[int]:
        """Ids of the best-scoring split of ``word``; of equal scores the one with the longer last piece.

        The automaton reports all pieces that end at a position, the longest first, before those that end
        later, so the best score of every earlier position is final when it is read. A character
        that is no piece itself may also go by its bytes, at the score of an unknown one.
        """
        if not self.single.issuperset(word):
            return self._best_path_unknown(word)
        n = len(word)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for end, entry in self.automaton.iter(word):
            total = best[end + 1 - entry[0]] + entry[1]
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, entry
        out = []
        while n:
            k, _, i = back[n]
            out.append(i)
            n -= k
        out.reverse()
        return out

    def _best_path_unknown(self, word: str) -> list[int]:
        n, unknown = len(word), self.v.unknown
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        done = 0
        for end, entry in chain(self.automaton.iter(word), [(n, None)]):
            while done < min(end + 1, n):
                best[done + 1], back[done + 1] = best[done] + unknown, (1, unknown, -1)
                done += 1
            if entry is not None:
                total = best[end + 1 - entry[0]] + entry[1]
                if total > best[end + 1] or (total == best[end + 1] and entry[0] > back[end + 1][0]):
                    best[end + 1], back[end + 1] = total, entry
        out: list[int] = []
        while n:
            k, _, i = back[n]
            out += [i] if i >= 0 else [self.v.byte_ids[b] for b in reversed(word[n - 1].encode("utf-8", "surrogatepass"))]
            n -= k
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, with a space put before it. A null or empty text has none."""
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def encode_bytes(self, text: str | None) -> bytes:
        """The same as 32-bit integers in memory order."""
        if not text:
            return b""
        known, parts = self.known, []
        for k, literal in enumerate((" " + text).split(SPACE)):
            if k:  # the mark itself stands for a space, so a text's own one goes by its bytes
                parts.append(self.mark)
            parts += [known[w] for w in self.words.findall(literal)]
        return b"".join(parts)

    def encode_column(self, texts: pa.Array) -> pa.Array:
        raw = [self.encode_bytes(t) for t in texts.to_pylist()]
        offsets = np.cumsum([0, *map(len, raw)]) // 4
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int32)))


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.table = [b""] * vocabulary.size
        for piece, _, i in vocabulary.pieces:
            self.table[i] = piece.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(vocabulary.byte_ids):
            self.table[i] = bytes([b])

    def decode(self, ids) -> str:
        text = b"".join([self.table[i] for i in (() if ids is None else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


    def decode_column(self, rows: pa.Array) -> pa.Array:
        flat, offsets = lists_of(rows)
        parts = [self.table[i] for i in flat.tolist()]
        texts = [b"".join(parts[a:b]).decode("utf-8", "replace") for a, b in pairwise(offsets.tolist())]
        return pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())


def _added(docs: DataFrame, source: str, out: str, kind: str, build, carry: list[str] | None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) and ``out``: what ``build()`` makes of each value of ``source``, in small Arrow batches."""
    rest = [c for c in (docs.columns if carry is None else carry) if c != out]
    schema = T.StructType([*[docs.schema[c] for c in rest], *T.StructType.fromDDL(f"`{out}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = build()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            for lo in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, ROWS) for c in columns], convert(values.slice(lo, ROWS))], names=[*rest, out])

    return docs.select(*rest, *([source] if source not in rest else [])).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``, which spares the tasks the others) with ``out`` array<int>. Null and empty texts have no ids; a column named ``out`` is replaced.

    Rows are independent and not shuffled, so repeated rows, ties and null ids need nothing; an empty table gives no rows. A very long text is encoded
    whole, word by word; of splits with equal scores the one with the longer last piece counts.
    """
    return _added(docs, text_col, out, "array<int>", lambda: _shared("encode", vocabulary).encode_column, carry)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``out`` string, the text of the ids; null ids give an empty one. encode then decode restores every text."""
    return _added(docs, ids_col, out, "string", lambda: _shared("decode", vocabulary).decode_column, carry)
