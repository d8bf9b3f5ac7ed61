"""Operator 9, SentencePiece encoding and decoding by an Aho-Corasick automaton.

The pieces of a SentencePiece model are the words of an automaton.  It runs
once over the text; at each position its output links give all pieces that end
there, and each relaxes the best score of its end (Viterbi).  The piece scores
of the model file are taken as log scores, so the result is the segmentation
of the highest sum.  Of equal sums the one with the longer last piece wins.

A character that is no piece by itself may be skipped at ``unknown`` below the
worst piece and is written as its UTF-8 byte pieces; so is the space mark where
it stands in the text itself.  Decoding therefore gives back every text.

No piece has a space mark behind another character, so all segmentations cut
before each word; words are segmented one by one and a bounded cache remembers
them.  Tokenizers are not trained: the model is a parameter.

Defined results: a null text is empty and has no pieces.  Very long texts are
encoded whole.  Repeated rows each get a row, null ids too.  Further columns
are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, text_or_empty

MARK = "▁"
#: Stands for a space mark in the text itself; no text that Spark holds has it.
LITERAL_MARK = "\ud800"
UNKNOWN = 10.0
#: Words in each of the two generations that a worker remembers, of at most CACHE_LENGTH characters.
CACHE_WORDS = 120_000
CACHE_LENGTH = 48


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str) -> list[str]:
    """The text's words; a word begins with one space less than stand before it, the text's begin counting as one."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for p in parts:
        if p:
            out.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    return [*out, " " * (spaces - 1)] if spaces else out


class PieceModel:
    """Automaton, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.singles, self.bytes, self.text, self.scores = set(), {}, [b""] * n, {}
        worst = 0.0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = float(model.get_score(i))
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses words")
                self.automaton.add_word(piece, (i, len(piece), score))
                self.scores[piece] = score
                self.text[i] = piece.replace(MARK, " ").encode()
                if len(piece) == 1:
                    self.singles.add(piece)
                if score > -1e8:
                    worst = min(worst, score)
        self.automaton.make_automaton()
        self.skip = worst - UNKNOWN
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def segment(self, word: str) -> list[int]:
        """Ids of the best segmentation of normalised text."""
        n, skip, singles = len(word), self.skip, self.singles
        best, back = [0.0] + [float("-inf")] * n, [(-1, 1, skip)] * (n + 1)
        if singles.issuperset(word):  # every position is reached by a piece
            for end, match in self.automaton.iter(word):
                total = best[end + 1 - match[1]] + match[2]
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, match
        else:
            done = 0
            for end, match in [*self.automaton.iter(word), (n - 1, None)]:
                while done <= end:  # positions up to here may also be reached by skipping a character
                    done += 1
                    if word[done - 1] not in singles:
                        best[done] = best[done - 1] + skip
                if match and best[end + 1 - match[1]] + match[2] > best[end + 1]:
                    best[end + 1], back[end + 1] = best[end + 1 - match[1]] + match[2], match
        out, at = [], n
        while at:
            i, size, _ = back[at]
            if i >= 0:
                out.append(i)
            else:
                char = MARK if word[at - 1] == LITERAL_MARK else word[at - 1]
                out += [self.bytes[b] for b in reversed(char.encode("utf-8", "surrogatepass"))]
            at -= size
        return out[::-1]

    def _learn(self, wanted: set[str]) -> list[str]:
        """Adds all that is wanted to the young generation of remembered words, and tells which of it are too long to stay.

        When the generation is full it becomes the old one, so frequent words
        stay and memory is bounded.
        """
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old, long = self.young, self.old, []
        for w in wanted.difference(young):
            known = old.get(w)
            if known is None:
                bare = w.lstrip(" ")
                known = array("i", self.segment(MARK * (1 + len(w) - len(bare)) + bare.replace(MARK, LITERAL_MARK))).tobytes()
            young[w] = known
            if len(w) > CACHE_LENGTH:
                long.append(w)
        return long

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes."""
        cut = [words(t) for t in texts]
        long = self._learn(set().union(*cut))
        made = [b"".join(map(self.young.__getitem__, part)) for part in cut]
        for w in long:
            del self.young[w]
        return made

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = self.text
        return b"".join([text[i] for i in ids]).decode("utf-8", "replace")[1:]


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """This worker's model, which later tasks use again with the words it remembers."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids, ids_crc32, round_trip) of whole texts."""
    path = model or model_path()
    schema = "doc_id long, n_chars long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = some.column("text").to_pylist()
                made = pieces.encode_all(texts)
                ids = [np.frombuffer(m, "<i4") for m in made]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                same = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), pa.array([zlib.crc32(m) for m in made], pa.int64()), pa.array(same),
                    ],
                    names=["doc_id", "n_chars", "n_pieces", "ids", "ids_crc32", "round_trip"],
                )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
