"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two, the
largest first: floor(n / longest) pieces of the longest length, then one piece
for each set bit of the rest. Every piece is a sequence of its own, so no
sequence crosses documents, none needs padding, and batches are formed within
buckets of equal length. Each document is handled alone: nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import chunks, release

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of whole texts, each distinct stretch between ASCII spaces encoded once.

    Splitting there is exact for this kind of tokenizer, which drops white space
    and never joins across it. Stretches of printable Latin-1 are cut into the
    tokenizer's own pieces (its pattern, letters lower-cased) and each distinct
    piece goes through its BPE model once; any other stretch, and texts that
    hold an added token, go through the tokenizer as a whole. What is known is
    kept up to ``limit`` stretches and pieces, then forgotten.
    """

    def __init__(self, path: str, limit: int = 700_000):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        # Added tokens are matched in the raw text first.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        cutters = given["pre_tokenizer"]["pretokenizers"]
        plain = [n["type"] for n in given["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cutters] == ["Split", "ByteLevel"] and cutters[0]["behavior"] == "Removed" and cutters[0]["invert"] and not cutters[1]["use_regex"] and not cutters[1]["add_prefix_space"]
        cut = regex.compile(cutters[0]["pattern"]["Regex"]).findall
        latin = re.compile("[!-~\u00a1-\u00ff]+").fullmatch
        self.cut, self.plain = cut, latin if plain else lambda text: None
        self.spell, letters = self.tokenizer.model.tokenize, _byte_letters()
        self.letters = [letters[b] for b in range(256)]
        # Plain dicts of bytes and text: Python's garbage collector passes them over, whatever their size.
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the tokenizer's pattern cuts, by its BPE model."""
        ids = self.pieces.get(piece)
        if ids is None:
            spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = self.pieces[piece] = array("I", [t.id for t in self.spell(spelt)]).tobytes()
        return ids

    def _word(self, word: bytes) -> bytes:
        """Ids of a stretch without ASCII spaces, A-Z lower-cased."""
        text = word.decode()
        if not self.plain(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if text.isalpha():
            return self._piece(text.lower())
        if text[:-1].isalpha() and text[-1] in ".,":
            return self._piece(text[:-1].lower()) + self._piece(text[-1])
        return b"".join([self._piece(p) for p in self.cut(text.lower())])

    def encode(self, text: bytes) -> np.ndarray:
        if any([a in text for a in self.added]):
            return np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        for kept in (self.known, self.pieces):
            if len(kept) > self.limit:
                kept.clear()
        known, parts = self.known, text.lower().split()
        for new in set(parts).difference(known):
            known[new] = self._word(new)
        return np.frombuffer(b"".join([known[p] for p in parts]), np.uint32)

    def forget(self) -> None:
        self.known.clear()
        self.pieces.clear()


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process, whatever number of tasks it runs."""
    return WordEncoder(path)


@contextmanager
def lent_encoder(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for one task: at its end the tokenizer stays and what was kept goes, also what earlier tasks had left free before."""
    release()
    encoder = encoder_of(path)
    try:
        yield encoder
    finally:
        encoder.forget()
        release()


def cut(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens: powers of two that add up to n, none above longest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of length).

    Null and empty texts hold ``end_id`` alone: one piece of length 1. Rows
    with a null or repeated doc_id are packed like any other, each with
    sequences of its own. Very long texts are cut into many pieces. Columns
    other than the two named are ignored. ``sequence_id`` counts within the
    input partition, above the partition's number. ``with_ids`` adds the ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or tokenizer_file()
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("bucket", pa.int32())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        following = TaskContext.get().partitionId() << 40
        last = np.array([end_id], np.uint32)
        with lent_encoder(path) as encoder:
            for batch, texts in chunks(batches, "text"):
                out: list[list] = [[] for _ in schema]
                for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                    ids = np.concatenate((encoder.encode(text), last))
                    raw, n, start = memoryview(ids.tobytes()), len(ids), 0
                    for length in cut(n, longest):
                        row = [doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, following, 0, length.bit_length() - 1]
                        for column, value in zip(out, row + [ids[start : start + length].astype(np.int32)] * with_ids):
                            column.append(value)
                        start, following = start + length, following + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, SCHEMA + ", ids array<int>" * with_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces under one folder for each length (bucket=0 holds length 1, bucket=12 length 4096), so that batches of one length are read without padding.

    Nothing is shuffled: each task writes its own pieces of each of the few lengths.
    """
    pieces.write.partitionBy("bucket").parquet(path)
