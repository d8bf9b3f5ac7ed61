"""Operator 7, token ids in ORC files.

Documents are put in ascending order of id by a range partitioning, encoded,
and written as ORC: one row per document with its ids and the end id as a list
of integers, which ORC stores with integer run-length encoding, with row
indexes, and with a Bloom filter on the document id, so that readers take
stripes in parallel and skip those that cannot hold an id.  Each row also
holds its file part and the number of ids before it in that part; readers add
the parts' totals (one row per write task) to know where each document starts.

Encoding cuts a text before each space or line end that no white space
follows.  The tokenizer's pattern always has a boundary there, and between a
letter and signs behind it, so the pieces' ids, which the tokenizers library
gives and a bounded cache remembers, put together are those of the whole text.

Defined results: a null text is empty and gives the end id alone.  Rows with
the same id follow in order of a hash of their text and may lie in several
tasks; a null id comes first.  Very long texts are encoded whole.  Other
columns are not read, whatever their names.  An empty table gives files
without rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound_batches, fresh_path, slices, text_or_empty

END_ID = 2
CACHE_PIECES = 400_000
#: Longer pieces are not remembered.
CACHE_LENGTH = 48
#: Texts of about so many bytes are encoded at once: what Spark hands over in a batch, with some room.
SLICE_BYTES = 9 << 20
ROW_STRIDE = 1000
ROWS = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space as the tokenizer's pattern has it, but for line ends.
_WHITE = r" \t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Pieces that a plain cut gives where white space follows white space, or stands at either end of a text.
_ODD = rf"^([{_WHITE}]|\n[{_WHITE}\n]|\n?$)"


def pieces(text: str) -> list[str]:
    """The pieces of a text, led by a piece for its beginning.

    Cuts are before each space or line end that no white space follows.  A
    piece loses the space that it begins with, but keeps a line end; the text
    itself begins as if behind a line end.  Where a text begins with white
    space (or is empty), what stands before the first cut is behind two line
    ends, of which neither belongs to it; so is a text that is not cut.
    """
    parts = [m.group() for m in _CUT.finditer(text)]
    first = ["\n\n" + parts[0] if parts[0][0].isspace() else "\n" + parts[0]] if parts else ["\n\n"]
    return first + [p[1:] if p[0] == " " else p for p in parts[1:]]


#: From one cut to the next.
_CUT = re.compile(r"[\s\S](?:(?![ \n]\S)[\s\S])*")
#: Words of letters alone, which the tokenizer's pattern never cuts, and signs that it always cuts from a letter before them.
_LETTERS = re.compile(r"\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_SIGNS = ".,;:!?\"()[]{}<>*#$%&|-_/\\"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian 32-bit integers, with the end id appended.

    Two generations of pieces are remembered: when the young one is full it
    becomes the old one, so frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.end_id = end_id
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._whole(["\n"])[0]
        if len(self.line_end) != 4:
            raise ValueError("the tokenizer has no id of its own for a line end")
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level: one character of a token is one byte
            self.sizes[i] = len(token)
        self.bytes = {i: c for i, c in enumerate(byte_letters())}
        self.space, self.model = self.bytes[32], self.tokenizer.model
        probes = ["Tition", "\nTition", "çouier", "\nÉéê"]
        self.direct = [self._letters(p) for p in probes] == self._whole([p if p[0] == "\n" else " " + p for p in probes])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, piece: str) -> bytes:
        """Ids of a word of letters, straight from the tokenizer's model."""
        before, text = (self.line_end, piece[1:]) if piece[0] == "\n" else (b"", self.space + piece)
        if not piece.isascii():
            text = text.replace(self.space, " ").encode().decode("latin-1").translate(self.bytes)
        return before + array("i", [x.id for x in self.model.tokenize(text)]).tobytes()

    def _learn(self, wanted: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        made = list(map(young.get, wanted))
        slow: dict[str, list[tuple[int, bytes]]] = {}
        for i in [i for i, known in enumerate(made) if known is None]:
            p = wanted[i]
            known = old.get(p)
            if known is None:
                base, tail = p.rstrip(_SIGNS), b""
                if len(base) < len(p) and base[-1:].isalpha() and p[:2] != "\n\n":
                    tail = self._tail(p[len(base) :])
                else:
                    base = p
                known = young.get(base) or old.get(base)
                if known is None and self.direct and _LETTERS.fullmatch(base):
                    known = young[base] = self._letters(base)
                if known is None:
                    slow.setdefault(base, []).append((i, tail))
                    continue
                known += tail
            made[i] = known
            if len(p) <= CACHE_LENGTH:
                young[p] = known
        plain = list(slow)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            for base, known in zip(some, self._encode(some), strict=True):
                for i, tail in slow[base]:
                    made[i] = known + tail
                    if len(wanted[i]) <= CACHE_LENGTH:
                        young[wanted[i]] = made[i]
        return made

    def _tail(self, signs: str) -> bytes:
        """Ids of signs behind a letter."""
        known = self.tails.get(signs)
        if known is None:
            if len(self.tails) > CACHE_PIECES:
                self.tails.clear()
            known = self._whole([signs])[0]
            if len(signs) <= CACHE_LENGTH:
                self.tails[signs] = known
        return known

    def _encode(self, some: list[str]) -> list[bytes]:
        """Ids of pieces, encoded as one text; the bytes that each id stands for tell where a piece ends."""
        if starts := {p for p in some if p.startswith("\n\n")}:
            known = {p: self.line_end + ids for p, ids in zip(starts, self._whole([p[2:] for p in starts]), strict=True)}
            rest = [p for p in some if p not in known]
            known.update(zip(rest, self._encode(rest), strict=True))
            return [known[p] for p in some]
        whole = [p if p[:1] == "\n" else " " + p for p in some]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(whole)], add_special_tokens=False)[0].ids, "<i4")
        due = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in whole])
        ends = np.cumsum(self.sizes[ids])
        cut = np.searchsorted(ends, due) + 1
        if len(due) and (not len(ends) or ends[-1] != due[-1] or (ends[np.minimum(cut, len(ends)) - 1] != due).any()):
            return self._whole(whole)  # an id reaches over the end of a piece
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(4 * cut[:-1]).tolist()], (4 * cut).tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has, with the end id.

        Arrow cuts the texts and numbers the distinct pieces; only these are
        looked up, and their ids are taken for all places at once.
        """
        if not len(texts):
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        begun = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
        cut = pc.split_pattern(pc.replace_substring(begun, "\n", " \n"), " ")
        counts = cut.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts  # each text's first piece is empty
        numbers = cut.flatten().dictionary_encode()
        strange = pc.match_substring_regex(numbers.dictionary, _ODD).to_numpy(zero_copy_only=False)[numbers.indices.to_numpy()]
        strange[first] = False
        odd, whole = np.logical_or.reduceat(strange, first), np.zeros(len(texts), bool)
        for token in self.added:  # found in a text before all else, so such texts are not cut
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any() or whole.any():
            own = [["", "\n\n" + texts[i].as_py()] if w else ["", *pieces(texts[i].as_py())] if o else None for i, (o, w) in enumerate(zip(odd.tolist(), whole.tolist(), strict=True))]
            cut = pc.if_else(pa.array(odd | whole), pa.array(own, cut.type), cut)
            counts = cut.value_lengths().to_numpy().astype(np.int64)
            first = np.cumsum(counts) - counts
            numbers = cut.flatten().dictionary_encode()
        distinct = numbers.dictionary.to_pylist()
        empty = distinct.index("")
        distinct[empty] = "\n"
        known = self._learn(distinct)
        known[empty] = b""
        ends = np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4)
        each = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(np.frombuffer(b"".join(known), "<i4")))
        taken = each.take(numbers.indices)
        ids = np.append(taken.flatten().to_numpy(), np.int32(self.end_id))
        offsets = taken.offsets.to_numpy()
        starts = offsets[first] - offsets[0]
        ids[starts] = self.end_id  # the line end that a text begins with stands where the text before it ends
        return ids[1:], np.diff(np.append(starts, len(ids) - 1))

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """This worker's encoder, which later tasks use again."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write them in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer, end_id).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                ids, n = encode(some.column("text"))
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), pa.array(n), lists], names=["doc_id", "part", "before", "n_tokens", "ids"]
                )
                before += int(ends[-1])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    writer = ordered.mapInArrow(run, ROWS).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", str(ROW_STRIDE)).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``, the number of ids of all documents before: doc_id, start, n_tokens, ids."""
    stored = spark.read.schema(ROWS).orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    # one row per write task: as small as the number of files
    return stored.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def with_checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4").tobytes()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * 4
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; ORC row indexes and Bloom filters skip the other stripes."""
    return spark.read.schema(ROWS).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def store_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files to shared storage and give one row per document, read from them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens-orc")
    write_tokens(docs, path, tokenizer or tokenizer_path(), end_id)
    return with_checksums(read_tokens(spark, path))
