"""Byte-level BPE in worker processes, from one public vocabulary file."""

import base64
import json
import re
from functools import cache

import tiktoken
from tokenizers import Tokenizer

# Fixed value: the split pattern of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The two libraries agree on every code point below; a text with a later one goes to the slower.
_LATE = re.compile("[\U00030000-\U0010ffff]")
# Runs of blanks beyond this make the faster library's pattern backtrack deeply.
_BLANKS = re.compile(r"\s{5000}")

# The same split, as classes of the code points below U+0250.
_W, _L, _N = "\\t-\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_NOT_LATIN = re.compile("[^\x00-ɏ]")


@cache
def tokenizer(path: str) -> Tokenizer:
    """The vocabulary file read by its own library."""
    return Tokenizer.from_file(path)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """The same vocabulary as ranks. Its merges must be in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab, byte = spec["model"]["vocab"], _byte_of()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("the merges of this vocabulary are not ordered by id")
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def plain(text: str) -> bool:
    """Whether the faster library may be used; it gives equal ids then."""
    return (text.isascii() or not _LATE.search(text)) and not _BLANKS.search(text)


def latin(text: str) -> bool:
    return text.isascii() or not _NOT_LATIN.search(text)


def ids_of(path: str, text: str):
    """Ids of a whole text, special strings as the library's default has them, as numpy numbers."""
    import numpy as np

    if plain(text):
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
