"""Byte-level BPE through a cache of chunks.

The pattern of byte-level BPE never lets a token span a visible character followed by a space. So a text can be cut
there, each distinct chunk is encoded once by the tokenizers library, and a document is the concatenation.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import regex

from .words import Block, Store, blocks, mix

#: White space beyond ASCII (and separators that Python takes for it): texts with one are encoded by CAREFUL cuts.
ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
CAREFUL = re.compile(r"(?<=\S)(?= )")
PARTS = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
#: How a chunk begins: at a text's start, after one space, or after one line feed.
BARE, SPACED, FED, ODDLY = 0, 1, 2, 3
#: Entries that the small cache of parts holds before it is emptied: the bound on its memory.
CACHE_ENTRIES = 100_000
#: Bytes of text in a block, and bits of the slots for distinct chunks: an executor's workers each hold their own.
BLOCK, STORE_BITS = 250_000, 22


def byte_letters() -> list[str]:
    """The letters by which byte-level BPE writes the 256 bytes: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Encodes whole texts to ids.

    ``path`` is a tokenizer.json of the tokenizers library. Ids are of ``self.dtype``: 16 bits where the vocabulary
    allows it. White space of any kind, special tokens' strings in the text and invalid pairs are as the library has them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(True) <= 65536 else "<u4")
        self.letters = dict(enumerate(byte_letters()))
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.parts: dict[str, list[int]] = {}
        self.store = Store([self.dtype], STORE_BITS)
        self.feed = self._library("\n")

    def _library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> list[int]:
        """One word, number or run of signs, with its space."""
        if (ids := self.parts.get(part)) is None:
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
            if len(part) < 5 or part[0] != " ":
                if len(self.parts) >= CACHE_ENTRIES:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def chunk(self, chunk: str, how: int) -> list[int]:
        """The ids of a chunk without ASCII white space in it, that begins as ``how`` says."""
        space = " " * (how == SPACED)
        if chunk.isalpha():
            ids = self._part(space + chunk)
        elif "'" in chunk or self.special and self.special.search(chunk):
            ids = self._library(space + chunk)
        else:
            first, *rest = PARTS.findall(chunk)
            ids = [*self._part(space + first), *(i for p in rest for i in self._part(p))]
        return self.feed + ids if how == FED else ids

    def whole(self, text: str) -> list[int]:
        """Any text, white space of any kind included."""
        return [i for c in CAREFUL.split(text) if c for i in self._library(c)]

    def block(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts one after the other, and how many each has."""
        b.words()
        data, starts = b.data, b.starts
        texts, sizes = len(b.offsets) - 1, np.diff(b.offsets)
        gap = starts.copy()  # bytes of white space before each word
        gap[1:] -= b.ends[:-1]
        heads = b.first[:-1][np.diff(b.first) > 0]
        text_of_head = np.flatnonzero(np.diff(b.first) > 0)
        gap[heads] = starts[heads] - b.offsets[text_of_head]
        how = np.full(len(starts), ODDLY, np.int64)
        one = gap == 1
        sign = data[np.maximum(starts - 1, 0)]
        how[one & (sign == 32)], how[one & (sign == 10)] = SPACED, FED
        how[heads] = np.where(gap[heads] == 0, BARE, ODDLY)
        odd = np.zeros(texts, bool)
        odd[np.searchsorted(b.first, np.flatnonzero(how == ODDLY), "right") - 1] = True
        odd |= (sizes > 0) & (np.diff(b.first) == 0)
        ends_at = np.zeros(texts, np.int64)
        ends_at[text_of_head] = b.ends[b.first[1:][text_of_head] - 1]
        odd[text_of_head] |= ends_at[text_of_head] != b.offsets[1:][text_of_head]
        raw = data.tobytes()
        found = np.array([m.start() for m in ODD.finditer(raw)], np.int64)
        odd[np.searchsorted(b.offsets, found, "right") - 1] = True
        keep = ~np.repeat(odd, np.diff(b.first))
        starts, ends, how = starts[keep], b.ends[keep], how[keep]

        def make(at: np.ndarray) -> list[list[np.ndarray]]:
            return [[np.array(self.chunk(raw[s:e].decode("utf-8", "replace"), k), self.dtype) for s, e, k in zip(starts[at].tolist(), ends[at].tolist(), how[at].tolist(), strict=True)]]

        kind = b.sizes[keep].astype(np.uint64) * np.uint64(4) + how.astype(np.uint64)
        entries = self.store.lookup(mix(b.hashes[keep] + how.astype(np.uint64)), make, [b.low[keep], b.high[keep], kind])
        ids, lengths = self.store.gather(entries)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        first = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(b.first)))])
        counts = np.diff(sums[first])
        if not odd.any():
            return ids, counts
        parts, at = [], np.concatenate([[0], np.cumsum(counts)])
        for i in range(texts):
            parts.append(np.array(self.whole(raw[b.offsets[i] : b.offsets[i + 1]].decode("utf-8", "replace")), self.dtype) if odd[i] else ids[at[i] : at[i + 1]])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, texts)

    def column(self, column: pa.Array):
        """Per block of a binary column: its first row, the ids of its texts, and how many each has."""
        for b in blocks(column, BLOCK):
            yield b.lo, *self.block(b)


_ENCODERS: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for a tokenizer file; it outlives a task, and so does its store."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
