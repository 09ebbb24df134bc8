"""Byte-level BPE from a public tokenizer file: the ids of the `tokenizers` library, computed on one thread by tiktoken."""

from __future__ import annotations

import functools
import json

import numpy as np

#: How GPT-2 splits text before merging, and how byte-level vocabularies write the bytes that are no printable characters.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _bytes_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """encode(text) gives what tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids gives.

    The file's ids must be its merges' ranks (checked on loading), which is what lets tiktoken, several times as fast on one thread, do
    the merging. Added tokens that stand in a text get their own id, as in that library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["model"]
        pre = file["pre_tokenizer"] or {}
        if kind["type"] != "BPE" or file["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte = _bytes_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in kind["vocab"].items() if token not in added}
        made = [ranks[bytes(byte[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in kind["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: its ids are not its merges' ranks")
        self._encoding = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self._added = frozenset(added)
        self._opens = np.zeros(max(ranks.values()) + 1, bool)
        self._opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self._added):
            return self._encoding.encode(text, allowed_special=self._added)
        return self._encoding.encode_ordinary(text)


    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each word in turn, added tokens taken as text, and which ids open a word.

        Words hold no ASCII blank, so only a word's first id holds a space first, and one call encodes them all; words with other blanks
        inside, which might merge across, are encoded one by one.
        """
        text = " " + b" ".join(words).decode("utf-8", "replace")
        if words and len(text.split()) == len(words):
            ids = np.asarray(self._encoding.encode_ordinary(text), np.int64)
            opens = self._opens[ids]
            if opens.sum() == len(words):
                return ids, opens
        each = [self._encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        ids = np.array([i for e in each for i in e], np.int64)
        opens = np.zeros(len(ids), bool)
        opens[np.cumsum([0, *map(len, each)])[:-1]] = True
        return ids, opens


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path)
