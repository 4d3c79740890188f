"""Token ids of whole texts with a public byte-level BPE, cached by space-delimited chunk."""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a cut before a space could change the pre-tokens: a space after other white space, or at the end.
_UNSAFE = r"\s | \Z|\0"
_WHITE = re.compile(r"\s")
#: New words without white space are encoded this many in one text, which spares an encoding object for each.
JOINT_WORDS = 1_000
#: Characters of the texts that are laid out at once; a longer text is a block of its own.
BLOCK_CHARS = 8_000_000


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers.

    The pre-tokenizer starts a new piece at a single space that stands between two non-spaces, so such a text can be
    cut there and its chunks encoded apart; chunks repeat far more often than texts. Other texts, and those that hold
    one of the vocabulary's added tokens in letters, which the tokenizer takes for the token itself, are encoded whole.
    When the cache holds most_chunks chunks it becomes the old one and an empty one takes its place, into which what is
    still in use is carried over; so memory stays bounded and common chunks stay known.
    """

    def __init__(self, path: str, most_chunks: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.unsafe = re.compile("|".join([_UNSAFE, *map(re.escape, added)]))
        self.most, self.known, self.old = most_chunks, {}, {}
        space = self._whole([" "])[0]
        mark = self.tokenizer.id_to_token(struct.unpack("<I", space)[0])  # how the vocabulary writes a space
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # the tokens that begin with one
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(mark)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _apart(self, text: str) -> Iterator[bytes]:
        """Ids of each word of a text of words with a space before each. Only a word's first token begins with a space."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        whole = ids.tobytes()
        return (whole[a:b] for a, b in pairwise(ends))

    def _chunks(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each with a space before it."""
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = [w for w in words if w not in known]
        if old:
            known.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in known]
        odd = [w for w in new if _WHITE.search(w)] if _WHITE.search("\0".join(new)) else []
        joint = [w for w in new if not _WHITE.search(w)] if odd else new
        known.update(zip(odd, self._whole([" " + w for w in odd]), strict=True))
        for at in range(0, len(joint), JOINT_WORDS):
            part = joint[at : at + JOINT_WORDS]
            known.update(zip(part, self._apart(" " + " ".join(part)), strict=True))
        return [known[w] for w in words]

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that may be cut at their spaces: distinct words are looked up once, and Arrow lays their ids out."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().copy()
        at[starts[:-1]] = len(distinct) + np.arange(len(texts))  # a text's first word has no space before it
        first = self._whole([t.split(" ", 1)[0] for t in texts])
        laid = pa.array([*self._chunks(distinct), *first], pa.large_binary()).take(pa.array(at))
        ends, ids = np.frombuffer(laid.buffers()[1], np.int64)[starts].tolist(), memoryview(laid.buffers()[2] or b"")
        return (bytes(ids[a:b]) for a, b in pairwise(ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not self.unsafe.search(t) for t in texts]
        apart = [t for t, p in zip(texts, plain, strict=True) if p]
        rest = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        blocks, size = [[]], 0
        for t in apart:
            if size and size + len(t) > BLOCK_CHARS:
                blocks.append([])
                size = 0
            blocks[-1].append(t)
            size += len(t)
        found = chain.from_iterable(self._block(block) for block in blocks if block)
        return [next(found if p else rest) for p in plain]


@functools.lru_cache(maxsize=2)
def encoder(path: str, most_chunks: int = 150_000) -> ChunkEncoder:
    """One encoder for each worker process."""
    return ChunkEncoder(path, most_chunks)
