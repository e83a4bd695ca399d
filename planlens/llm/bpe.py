"""Byte-level BPE: encoding by a queue of merge ranks, decoding by the vocabulary.

A chunk's symbols form a doubly linked list. A heap holds (rank, position) of
each adjacent pair that can merge; the lowest rank, leftmost first, merges; a
popped entry whose pair is no longer there is skipped as stale.

The file is that of the tokenizers library (byte-level BPE, no normalizer).
Added special strings inside a text become their ids and decode to themselves.
Null text counts as empty: no ids, and the hashes of nothing. Repeated rows and
ids give a row each, other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from planlens.llm.bpe_chunks import ChunkEncoder, Encoded
from planlens.llm.frames import texts_of
from planlens.llm.worker_memory import worker_cache
from planlens.workspace import ship_package

#: Fixed value: the pattern that splits a text before merging.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[int, str]:
    """Printable stand-in of each byte: itself where printable in Latin-1, else the next code from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BpeModel:
    """Vocabulary and merges of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.byte_ids = [self.vocab[symbols[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {s: b for b, s in symbols.items()}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimals = [str(i) for i in range(size)]
        self.pieces = regex.compile(PIECE_PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge_piece(self, piece: str) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
        n, merge = len(ids), self.merge
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has merged with another
            ids[k], ids[j] = merge[left, right][1], -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if found := merge.get((ids[k], ids[j])):
                    heapq.heappush(queue, (found[0], k, ids[k], ids[j]))
            if (i := before[k]) >= 0 and (found := merge.get((ids[i], ids[k]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[k]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in self.pieces.findall(part):
                    out += self.merge_piece(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def encode_many(self, chunks: list[str]) -> Encoded:
        found = [self.encode(x) for x in chunks]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter((i for ids in found for i in ids), "<u4", int(lengths.sum()))


@cache
def model_of(path: str) -> BpeModel:
    """Once for each worker."""
    return BpeModel(path)


def encoder_of(path: str) -> ChunkEncoder:
    """Kept by the worker; what a task learns, later tasks find."""
    return worker_cache(f"own {path}", lambda: ChunkEncoder(model_of(path).encode_many, "<u4"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each text."""
    ship_package(docs.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder_of(tokenizer_path)
        for batch in batches:
            ids = list(known.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))], schema=fields)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of each row's ids."""
    ship_package(encoded.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(tokenizer_path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=fields)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the hashes of a text's ids and of what they decode to.

    Encodes and decodes within a task, so that ids never leave it.
    """
    ship_package(docs.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(tokenizer_path)
        known, decimals = encoder_of(tokenizer_path), model.decimals.__getitem__
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for found in known.encode(batch.column("text").to_pylist()):
                ids = found.tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimals, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], schema=fields)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
