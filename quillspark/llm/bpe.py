"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so a text may be cut between the
two bytes: pairs with white space first of all, then those inside words. Fragments are encoded independently, each
distinct chunk once, and concatenated. Decoding looks every id up again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_letters
from .common import only, utf8
from .words import Block, Store, blocks

#: Letters up to which a fragment's pairs are simply looked through again after each merge.
SHORT = 24
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ForcedBpe:
    """The encoder for a tokenizer.json whose BPE marks word ends by a suffix and drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            b = [self.byte_of[c] for c in token.removesuffix(self.suffix) if c in self.byte_of]
            self.inside[b[:-1], b[1:]] = True
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.tokens = [""] * self.tok.get_vocab_size(True)
        for token, i in self.tok.get_vocab(True).items():
            self.tokens[i] = token
        self.store = Store([np.dtype("<u4"), np.dtype(np.uint8)], 22)

    def inner(self, fragment: str) -> list[int]:
        """A fragment that doesn't end its word: merges by rank, lowest first, leftmost first."""
        parts: list[str] = list(fragment) if len(fragment) <= SHORT else self._merged(fragment)
        while 1 < len(parts) <= SHORT:
            rank, k = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = ["".join(parts[k : k + 2])]
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merged(self, fragment: str) -> list[str]:
        """The same for a long fragment: pairs wait in a heap, what is left of the fragment is a chain of places."""
        parts: list[str | None] = list(fragment)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, k, p) for k, p in enumerate(zip(parts[:-1], parts[1:], strict=True)) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            if 0 <= k and after[k] < len(parts) and (r := self.ranks.get(pair := (parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (r, k, pair))

        while heap:
            _, k, pair = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] != pair[0] or nxt >= len(parts) or parts[nxt] != pair[1]:
                continue  # one of the two has become part of another
            parts[k], parts[nxt] = pair[0] + pair[1], None
            after[k] = after[nxt]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [p for p in parts if p is not None]

    def word(self, word: str) -> list[int]:
        """A pre-token, as byte letters: cut at forced boundaries."""
        b = [self.byte_of[c] for c in word]
        cuts = [k + 1 for k in range(len(b) - 1) if not self.inside[b[k], b[k + 1]]]
        out: list[int] = []
        at = 0
        for k in cuts:
            out += self.inner(word[at:k])
            at = k
        return out + [t.id for t in self.tok.model.tokenize(word[at:])]

    def chunk(self, chunk: str) -> list[int]:
        """A run without ASCII white space."""
        if self.special and len(parts := self.special.split(chunk)) > 1:
            return [i for p in parts if p for i in ([self.tok.token_to_id(p)] if self.special.fullmatch(p) else self.chunk(p))]
        text = chunk.lower() if chunk.isascii() else self.tok.normalizer.normalize_str(chunk)
        if text.isascii() and text.isalpha():
            return self.word(text)
        return [i for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text) for i in self.word(word)]

    def decode(self, ids) -> str:
        """What the library's decode gives where the file names no decoder: tokens joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])

    def block(self, b: Block):
        """Ids and decoded bytes of a block's texts, each one after the other, and how many of either a text has."""
        b.words()
        raw = b.data.tobytes()

        def make(at):
            ids = [self.chunk(raw[s:e].decode("utf-8", "replace")) for s, e in zip(b.starts[at].tolist(), b.ends[at].tolist(), strict=True)]
            return [[np.array(x, "<u4") for x in ids], [np.frombuffer((self.decode(x) + " ").encode() if x else b"", np.uint8) for x in ids]]

        entries = self.store.lookup(b.hashes, make, [b.low, b.high, b.sizes.astype(np.uint64)])
        out = []
        for field in (0, 1):
            values, lengths = self.store.gather(entries, field)
            sums = np.concatenate([[0], np.cumsum(lengths)])
            out.append((values, sums[b.first]))
        return out


_ENCODERS: dict[str, ForcedBpe] = {}


def forced_bpe(path: str) -> ForcedBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ForcedBpe(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row of ``docs(doc_id, text)``.

    A null or empty text, or one of white space only, has no ids; rows that repeat stay; other columns are not read. A word of
    any length takes time in proportion to it, but for a logarithm.
    """

    def encode(batches):
        bpe = forced_bpe(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for b in blocks(batch.column(1)):
                (ids, i), (text, t) = bpe.block(b)
                ids, text, i, t = ids.view(np.uint8), memoryview(text), i.tolist(), t.tolist()
                n = len(i) - 1
                rows = [[b_ - a for a, b_ in zip(i[:-1], i[1:], strict=True)], [sha(ids[4 * i[k] : 4 * i[k + 1]]) for k in range(n)], [sha(text[t[k] : max(t[k], t[k + 1] - 1)]) for k in range(n)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, n), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce(utf8("text"), F.lit(b"")).alias("text"))
    return d.mapInArrow(encode, ENCODED)
