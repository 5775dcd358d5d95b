"""SentencePiece encoding and decoding: Viterbi over an Aho-Corasick automaton of pieces.

The automaton reads a text once; at each position its output links name every piece that ends there,
and each relaxes the best score of the position. Characters without a piece become their UTF-8 bytes,
so decoding gives back every text exactly. Ids are packed (two bytes each, least first), which keeps
a text's ids smaller than the text.

The model's file is read by the driver; its pieces (a few MB) are broadcast, so executors need no file. The default
file's scores are those of a byte-pair model (minus a merge's rank), whose own encoder merges greedily; here its
scores are summed, so the split of the greatest sum is found, which is that of a unigram model with these scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL_MARK = "▁", "\ud800"  # the space of pieces, and what stands for that character in a text: no text holds half a pair
#: Words whose ids a Python worker remembers; a full memory is emptied, which costs time only.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64
_ID = np.dtype("<u2")


@dataclass
class Model:
    """pieces: (text, score) by id, None for control pieces; byte_ids: the id of each byte's piece."""

    pieces: Sequence[tuple[str, float] | None]
    byte_ids: Sequence[int]

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if len(ids) > 1 << 16:
            raise ValueError("packed ids hold 65,536 pieces at most")
        plain = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else (sp.id_to_piece(i), sp.get_score(i)) for i in ids]
        return cls(plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if piece and piece[0]:
                out.add_word(piece[0], (len(piece[0]), piece[1], i))
        out.make_automaton()
        return out

    @cached_property
    def unknown_score(self) -> float:
        return min((p[1] for p in self.pieces if p), default=0.0) - 10.0

    @cached_property
    def units(self) -> re.Pattern | None:
        """What can be encoded by itself: if no piece has a mark behind another character, words with the marks before them."""
        crossing = any(p and MARK in p[0].lstrip(MARK) for p in self.pieces)
        return None if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @cached_property
    def memory(self) -> dict[str, bytes]:
        return {}

    @cached_property
    def surfaces(self) -> list[bytes]:
        """The bytes of each id; control pieces have none."""
        out = [p[0].replace(MARK, " ").encode() if p else b"" for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out

    @cached_property
    def single(self) -> frozenset[str]:
        return frozenset(p[0] for p in self.pieces if p and len(p[0]) == 1)

    def best(self, unit: str) -> list[int]:
        """The ids of the split of unit with the greatest sum of scores; of equal ones, that whose last piece is longest.

        Outputs of a position come longest first. A character that is no piece counts as one of unknown_score.
        """
        n = len(unit)
        score, back = [0.0] + [-1e300] * n, [None] * (n + 1)
        found = self.automaton.iter(unit)
        if not self.single.issuperset(unit):
            found = self._with_unknown(unit, found)
        for end, piece in found:
            length, own, _ = piece
            end += 1
            new = score[end - length] + own
            if new > score[end]:
                score[end], back[end] = new, piece
        ids: list[int] = []
        while n:
            length, _, i = back[n]
            if i >= 0:
                ids.append(i)
            else:
                c = unit[n - 1]
                ids.extend(self.byte_ids[b] for b in reversed((MARK if c == LITERAL_MARK else c).encode()))
            n -= length
        return ids[::-1]

    def _with_unknown(self, unit: str, found: Iterator) -> Iterator:
        """found, and at each character that is no piece an output of its own."""
        at, unknown = 0, (1, self.unknown_score, -1)
        for end, piece in found:
            while at < end:
                if unit[at] not in self.single:
                    yield at, unknown
                at += 1
            yield end, piece
        for at in range(at, len(unit)):
            if unit[at] not in self.single:
                yield at, unknown

    def _unit(self, unit: str) -> bytes:
        found = np.array(self.best(unit), dtype=_ID).tobytes()
        if len(unit) <= LONGEST_REMEMBERED:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """The packed ids of text, behind one added space; an empty text has none."""
        if not text:
            return b""
        marked = MARK + text.replace(MARK, LITERAL_MARK).replace(" ", MARK)
        get = self.memory.get
        units = self.units.findall(marked) if self.units else [marked]
        return b"".join([get(u) or self._unit(u) for u in units])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, without the added space; bytes that are no UTF-8 become U+FFFD."""
        surfaces = self.surfaces
        out = b"".join([surfaces[i] for i in np.frombuffer(packed, _ID).tolist()]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


class Codec:
    """The column functions of one model, broadcast once."""

    def __init__(self, spark: SparkSession, path: str = MODEL):
        model = spark.sparkContext.broadcast(Model.load(path))

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = model.value
            for texts in batches:
                yield pa.array([own.encode(t.as_py()) if t.is_valid else None for t in texts], pa.binary())

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = model.value
            for packed in batches:
                yield pa.array([own.decode(p.as_py()) if p.is_valid else None for p in packed], pa.string())

        @F.arrow_udf("pieces binary, round_trip boolean")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = model.value
            for texts in batches:
                packed, same = [], []
                for t in texts:
                    text = t.as_py()
                    packed.append(None if text is None else own.encode(text))
                    same.append(None if text is None else own.decode(packed[-1]) == text)
                yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(same, pa.bool_())], ["pieces", "round_trip"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """Packed ids (binary); null stays null, an empty text has no ids, a text is encoded whole however long."""
        return self._encode(text)

    def decode(self, packed: Column) -> Column:
        """The text of packed ids; null stays null."""
        return self._decode(packed)

    def encode_and_compare(self, text: Column) -> Column:
        """A struct of the packed ids and whether decoding them gives the text back, in one pass; null gives nulls."""
        return self._both(text)


def encode_documents(docs: DataFrame, path: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs with pieces (packed ids) and n_pieces; columns of these names are replaced, repeated rows stay.

    Null text has null pieces, an empty text none; an empty table stays empty; texts are encoded whole, however long.
    """
    codec = Codec(docs.sparkSession, path)
    return docs.withColumn("pieces", codec.encode(F.col(text_col))).withColumn("n_pieces", (F.octet_length("pieces") / 2).cast("long"))


def encoded_digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_chars, pieces_sha256 and round_trip (decoding gave the text back) for every row of docs.

    Null text counts as empty; repeated rows stay; an empty table has no row; other columns are not looked at.
    """
    codec = Codec(docs.sparkSession, path)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), codec.encode_and_compare(F.col("text")).alias("r"))
    return rows.select("doc_id", (F.octet_length("r.pieces") / 2).cast("long").alias("n_pieces"), "n_chars", F.sha2("r.pieces", 256).alias("pieces_sha256"), "r.round_trip")
