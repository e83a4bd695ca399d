"""Encode texts chunk by chunk, remembering the ids of chunks that recur.

A byte-level BPE of the GPT-2 family splits a text by a pattern and merges only
inside a piece. No piece holds a non-space character followed by white space,
so a single blank or newline between two non-space characters always starts a
new piece. Cutting there gives chunks that are encoded independently; words
recur across a corpus, so a worker encodes most of them once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import repeat

import numpy as np

from planlens.llm.worker_memory import worker_cache

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Marks the key of a chunk that has no blank or newline before it.
_BARE = "\x00"


def word_keys(text: str) -> list[str]:
    """Keys of the chunks of ``text`` in order; see ``chunk_of_key``."""
    words = text.replace("\n", " \n").split(" ")
    if "" in words or "\n" in words or _BARE in text or len(words) != len(text.split()):
        return [_BARE + x for x in _SAFE_CUT.split(text) if x]
    words[0] = _BARE + words[0]
    return words


def chunk_of_key(key: str) -> str:
    return key[1:] if key[0] == _BARE else key if key[0] == "\n" else " " + key


def white_space_keys(text: str) -> list[str]:
    """For tokenizers that drop white space and case: the words in lower case.

    The whole text where Python and Unicode differ on white space; case is kept
    where it depends on what follows or may tell special strings apart.
    """
    if re.search("[\x00\x1c-\x1f]", text):
        return [_BARE + text]
    return (text if "<|" in text or "Σ" in text else text.lower()).split()


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of several runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


#: What ``encode_many`` gives: ids of each chunk, and all ids in order.
Encoded = tuple[np.ndarray, np.ndarray]


class ChunkEncoder:
    """Ids of texts from a table of known chunks and ``encode_many`` for the rest.

    At ``bound`` chunks the table is full and what is unknown is encoded without
    being kept, so a worker's memory is bounded; if over three tenths of the
    chunks are then unknown (the texts have changed), the table starts anew.
    """

    def __init__(self, encode_many: Callable[[list[str]], Encoded], dtype: str, keys: Callable[[str], list[str]] = word_keys, bound: int = 1_000_000, words: int = 400_000, chunk: Callable[[str], str] = chunk_of_key, mark: str = _BARE):
        self.mark = mark  # what the key of a mark that follows a word starts with
        self.encode_many, self.dtype, self.keys, self.bound, self.words, self.chunk = encode_many, dtype, keys, bound, words, chunk
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.tokens, self.used = np.zeros(1 << 14, self.dtype), 0
        self.passing = 0

    def _learn(self, lost: list[str]) -> None:
        """Add ``lost`` to the table. Letters and one mark after them are two pieces, each likely known."""
        pairs = [(k, k[:-1], self.mark + k[-1]) for k in lost if k[-1] in ",." and k[:-1].isalpha() and k[:-1].lower().isalpha()]
        two = {k for k, _, _ in pairs}
        single = dict.fromkeys(k for k in lost if k not in two)
        single.update(dict.fromkeys(x for _, *parts in pairs for x in parts if x not in self.slot))
        if single:
            keys = list(single)
            self._append(keys, *self.encode_many([self.chunk(k) for k in keys]))
        if pairs:
            parts = np.fromiter((self.slot[x] for _, *xs in pairs for x in xs), np.int64, 2 * len(pairs))
            lengths = self.lengths[parts]
            self._append([k for k, _, _ in pairs], lengths.reshape(-1, 2).sum(axis=1), self.tokens[spans(self.starts[parts], lengths)])

    def _append(self, keys: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, m = len(self.slot), len(keys)
        while n + m > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.tokens):
            self.tokens = np.resize(self.tokens, 2 * len(self.tokens))
        self.lengths[n : n + m] = lengths
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.tokens[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(keys, range(n, n + m)))

    def slots(self, flat: list[str]) -> np.ndarray:
        for _ in range(self.passing):  # the last that were added
            self.slot.popitem()
        self.used -= self.passing_ids if self.passing else 0
        self.passing = 0
        at = np.fromiter(map(self.slot.get, flat, repeat(-1)), np.int64, len(flat))
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            full, used, kept = len(self.slot) >= self.bound, self.used, len(self.slot)
            if full and len(gaps) > 0.3 * len(flat):
                self._clear()
                return self.slots(flat)
            missed = [flat[k] for k in gaps.tolist()]
            lost = list(dict.fromkeys(missed))
            self._learn(lost)
            at[gaps] = np.fromiter(map(self.slot.__getitem__, missed), np.int64, len(missed))
            if full:
                self.passing, self.passing_ids = len(self.slot) - kept, self.used - used
        return at

    def groups(self, texts: Sequence[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For runs of consecutive texts, the number of chunks of each and the slots of all."""
        flat: list[str] = []
        counts: list[int] = []
        for text in texts:
            keys = self.keys(text) if text else ()
            flat += keys
            counts.append(len(keys))
            if len(flat) >= self.words:
                yield counts, self.slots(flat)
                flat, counts = [], []
        if counts:
            yield counts, self.slots(flat)

    def key_lengths(self, keys: list[str]) -> np.ndarray:
        """The number of ids of each chunk."""
        at = self.slots(keys)
        return self.lengths[at]

    def token_counts(self, texts: Sequence[str | None]) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        out = []
        for counts, at in self.groups(texts):
            ends = np.concatenate([[0], np.cumsum(self.lengths[at])])
            bounds = np.cumsum([0, *counts])
            out.append(ends[bounds[1:]] - ends[bounds[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        for counts, at in self.groups(texts):
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            ids = self.tokens[spans(self.starts[at], lengths)]
            cuts = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield ids[a:b]


@cache
def load_tokenizer(path: str):
    """The tokenizers library's object for a file, once for each worker; without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def narrow_dtype(path: str) -> str:
    """Two bytes for an id where the vocabulary allows it, else four."""
    return "<u2" if load_tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def one_by_one(path: str, dtype: str, chunks: list[str]) -> Encoded:
    found = [e.ids for e in load_tokenizer(path).encode_batch_fast(chunks, add_special_tokens=False)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return lengths, np.fromiter((i for ids in found for i in ids), dtype, int(lengths.sum()))


def joined(path: str, dtype: str, marks: np.ndarray, simple: Callable[[str], bool], glue: str, chunks: list[str]) -> Encoded:
    """Encode the simple chunks as one text, cut where ``marks`` says that an id starts (or ends) a chunk."""
    plain = [k for k, x in enumerate(chunks) if simple(x)]
    rest = [k for k, x in enumerate(chunks) if not simple(x)]
    text = glue.join(chunks[k] for k in plain)
    ids = np.array(load_tokenizer(path).encode(text, add_special_tokens=False).ids if plain else [], dtype)
    edges = np.flatnonzero(marks[ids])
    if len(edges) != len(plain):  # not what the marks promise: ask for each alone
        return one_by_one(path, dtype, chunks)
    bounds = np.append(edges, len(ids)) if not glue else np.insert(edges + 1, 0, 0)
    lengths = np.zeros(len(chunks), np.int64)
    lengths[plain] = np.diff(bounds)
    other, more = one_by_one(path, dtype, [chunks[k] for k in rest]) if rest else (np.zeros(0, np.int64), ids[:0])
    lengths[rest] = other
    starts = np.zeros(len(chunks), np.int64)
    starts[plain] = bounds[:-1]
    starts[rest] = len(ids) + np.cumsum(other) - other
    return lengths, np.concatenate([ids, more])[spans(starts, lengths)]


def byte_level_encoder(path: str) -> ChunkEncoder:
    """For byte-level vocabularies; kept by the worker, so that later tasks find what earlier ones learned."""
    return worker_cache(f"byte-level {path}", lambda: _byte_level_encoder(path))


def _byte_level_encoder(path: str) -> ChunkEncoder:
    """A chunk of a blank and letters starts with the blank's token."""
    vocab, dtype = load_tokenizer(path).get_vocab(with_added_tokens=True), narrow_dtype(path)
    marks = np.zeros(max(vocab.values()) + 1, bool)
    marks[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
    simple = lambda x: x[0] == " " and (x[1:].isalpha() or x[1:-1].isalpha())
    return ChunkEncoder(lambda xs: joined(path, dtype, marks, simple, "", xs), dtype, bound=500_000, words=40_000)


def word_end_encoder(path: str) -> ChunkEncoder:
    """For vocabularies with word ends; kept by the worker."""
    return worker_cache(f"word-end {path}", lambda: _word_end_encoder(path))


def _word_end_encoder(path: str) -> ChunkEncoder:
    """A word of letters is one piece, which its last token ends."""
    vocab, dtype = load_tokenizer(path).get_vocab(with_added_tokens=True), narrow_dtype(path)
    marks = np.zeros(max(vocab.values()) + 1, bool)
    marks[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    simple = lambda x: x.isalpha() and x.lower().isalpha()
    return ChunkEncoder(lambda xs: joined(path, dtype, marks, simple, " ", xs), dtype, white_space_keys, chunk=lambda k: k.removeprefix(_BARE), mark="")
