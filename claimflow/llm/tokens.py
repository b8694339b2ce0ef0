"""Ids of the public byte-level tokenizer."""

import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import tokenizers

from claimflow.llm.text import task_state


def located(path: str) -> str:
    """A tokenizer file: a path as it stands, or a name in the folder of the public tokenizers."""
    return path if os.path.isabs(path) else public_tokenizers.path(path)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, as the file format defines them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts as `tokenizers` does with the file, add_special_tokens=False.

    Texts go through tiktoken with the ranks of the same file: the same ids in a fifth of the
    time. A text that holds the string of a special token goes through `tokenizers`.
    """

    def __init__(self, path: str):
        path = located(path)
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.special = [t["content"] for t in held["added_tokens"]]
        byte_of, vocabulary = _byte_of(), held["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        self.short = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = list(map(len, ranks))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each of these words one after the other, and how many each has.

        They are encoded as one text, in which a space opens a piece wherever no white space stands
        before it; so words that end in white space of another kind are encoded one by one.
        """
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        apart = pc.binary_length(pc.utf8_rtrim_whitespace(words)).to_numpy(zero_copy_only=False) < sizes
        if not apart.any():
            return self._joined(words, sizes)
        ids, counts = self._joined(words.filter(pa.array(~apart)), sizes[~apart])
        alone = [self.short.encode_ordinary(" " + w) for w in words.filter(pa.array(apart)).to_pylist()]
        lengths = np.zeros(len(words), np.int64)
        lengths[~apart], lengths[apart] = counts, list(map(len, alone))
        out, own = np.empty(int(lengths.sum()), np.uint32), np.repeat(apart, lengths)
        out[~own], out[own] = ids, list(chain.from_iterable(alone))
        return out, lengths

    def _joined(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")
        ids = self.short.encode_to_numpy(" " + whole[0].as_py())
        # Where the bytes of each word end in those of the ids.
        behind = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes + 1)) + 1
        return ids, np.diff(behind, prepend=0)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; null counts as empty."""
        found = [self._text(s) if s else [] for s in texts.to_pylist()]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _text(self, text: str) -> list[int]:
        if any(t in text for t in self.special):
            self.whole = self.whole or tokenizers.Tokenizer.from_file(self.path)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.short.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    return task_state("encoder_" + re.sub(r"\W", "_", path), lambda: Encoder(path))
