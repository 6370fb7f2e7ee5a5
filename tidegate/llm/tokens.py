"""Token ids of whole texts, with the work of a public tokenizer done once for each distinct chunk.

For tokenizers that drop white space (each pre-token ends in a token that closes a word), a text's ids are the ids of its
white-space chunks one after the other. Chunks are told apart by hash, new ones are tokenised together, and ids are
gathered with array operations. Whatever is not plainly safe to split is given to the tokenizer as it is.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tidegate.llm.words import scan

#: The pre-token pattern that the tokenizer file states.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Chunks remembered per worker process, about 40 bytes each.
REMEMBERED = 400_000


class ChunkTokenizer:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of chunks
        self.at = np.zeros(0, np.int32)  # where a chunk's ids begin in self.flat
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, chunk: str) -> list[str] | None:
        """The chunk's pre-tokens, or None where they cannot be told without the tokenizer."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if not chunk.isprintable() or any(s in chunk for s in self.special):
                return None
            return _PRETOKEN.findall(chunk.lower())
        low = chunk.lower()
        if len(low) != len(chunk) or "Σ" in chunk or not unicodedata.is_normalized("NFC", chunk) or not unicodedata.is_normalized("NFC", low):
            return None
        if low.isalpha() and chunk.isalpha():
            return [chunk]
        if not chunk.isprintable() or any(s in chunk for s in self.special):
            return None
        return _PRETOKEN.findall(low)

    def _tokenised(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and each chunk's number of ids."""
        counts = np.zeros(len(chunks), np.int64)
        words: list[str] = []
        odd: list[int] = []
        for i, chunk in enumerate(chunks):
            found = self._pretokens(chunk)
            if found is None:
                odd.append(i)
            else:
                counts[i] = len(found)
                words += found
        flat = np.zeros(0, np.int32)
        if words:
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words) or (len(flat) and ends[-1:] != len(flat)):
            each = self._whole(chunks)
            return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], dtype=np.int64)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(edges)
        if odd:
            parts = [flat[edges[i] : edges[i + 1]] for i in range(len(chunks))]
            for i, ids in zip(odd, self._whole([chunks[i] for i in odd]), strict=True):
                parts[i] = ids
            return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return flat, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column one row after the other, and where each row's begin (one entry more than rows)."""
        words = scan(texts, lower=False)
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), dtype=bool)
        if new.any():
            raw = words.data.tobytes()
            pick = first[new]
            chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[pick].tolist(), words.end[pick].tolist(), strict=True)]
            ids, sizes = self._tokenised(chunks)
            where = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.known, unique[new])
            self.known = np.insert(self.known, place, unique[new])
            self.at, self.size = np.insert(self.at, place, where), np.insert(self.size, place, sizes)
            at = np.searchsorted(self.known, unique)
        if not len(unique):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin, size = self.at[at][inverse].astype(np.int64), self.size[at][inverse].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[words.first]


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)
