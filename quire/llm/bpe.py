"""Token ids of many texts by the vocabulary files of the ``tokenizers`` library."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from quire.llm import words

# The white space of Unicode, as byte-level BPE pre-tokenisers understand it.
_SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word with the one space before it, or white space without the space that the next word takes.
_CHUNK = re.compile(f"[{_SPACES}]+(?![^{_SPACES}])| ?[^{_SPACES}]+|[{_SPACES}]+")


# The pattern by which byte-level BPE parts a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What a kept chunk costs besides its characters and ids: two objects and a slot in the table.
_ENTRY_BYTES = 220
#: Longer chunks are encoded each time: they hardly ever come again.
_LONGEST_KEPT = 64


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _by_rank(path: str, spec: dict):
    """An encoder that merges by rank, where the vocabulary's ids are in the order of its merges
    and so give the same ids; None for any other vocabulary."""
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
            or not before.get("use_regex", True) or spec.get("normalizer") or model.get("byte_fallback")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab, byte_of = model["vocab"], _byte_of()
    if any(vocab.get(left + right) != 256 + k for k, (left, right) in enumerate(merges)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian 32-bit numbers: those of ``Tokenizer.from_file(path)`` with
    ``add_special_tokens=False``, which reads the strings of added tokens in a text as these tokens.

    A byte-level BPE never merges across the chunks of ``_CHUNK``, so the ids of a chunk are kept,
    up to ``cache_bytes``; when they are full, only those of the texts at hand stay.
    New chunks of many texts are encoded together, one to a line: chunks hold no line break,
    so the id of a lone line break parts their ids. Texts with the string of an added token, and
    all texts of vocabularies of another kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str, cache_bytes: int) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.limit, self.size, self.known = path, cache_bytes, 0, {}
        self.ranked = _by_rank(path, spec)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.widest = int(top)
        if self.ranked is not None:
            self.line = self._ids("\n")[0]

    @functools.cached_property
    def own(self) -> Tokenizer:
        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.ranked.encode_ordinary(text), "<u4")

    def _learn(self, chunks: list[str], known: dict[str, bytes]) -> None:
        words_, spaces = [c for c in chunks if not c.isspace()], [c for c in chunks if c.isspace()]
        known.update((c, self._ids(c).tobytes()) for c in spaces)
        for start in range(0, len(words_), 4096):
            part = words_[start:start + 4096]
            ids = self._ids("\n".join(part))
            border = np.flatnonzero(ids == self.line)
            if len(border) != len(part) - 1:  # a chunk with a character that counts as a line break
                known.update((c, self._ids(c).tobytes()) for c in part)
                continue
            raw, at = ids.tobytes(), [-4, *(4 * border).tolist(), 4 * len(ids)]
            known.update((c, raw[i + 4:j]) for c, i, j in zip(part, at, at[1:]))

    def _plain(self, texts: list[str]) -> list[bytes]:
        chunks = [_CHUNK.findall(t) for t in texts]
        every = set().union(*chunks)
        new = [c for c in every if c not in self.known]
        rare = {}
        self._learn(sorted(c for c in new if len(c) > _LONGEST_KEPT), rare)
        new = sorted(c for c in new if len(c) <= _LONGEST_KEPT)
        need = sum(map(len, new)) * 3 + _ENTRY_BYTES * len(new)
        if self.size + need > self.limit:
            self.known = {c: self.known[c] for c in every if c in self.known}
            self.size = sum(3 * len(c) + _ENTRY_BYTES for c in self.known)
            if self.size + need > self.limit:
                self.known, self.size = dict(self.known), self.limit  # full again at the next call
        self.size += need
        self._learn(new, self.known)
        if rare:
            return [b"".join([rare[c] if len(c) > _LONGEST_KEPT else self.known[c] for c in t]) for t in chunks]
        return [b"".join(map(self.known.__getitem__, t)) for t in chunks]

    def __call__(self, texts: list[str]) -> list[bytes]:
        special = [self.ranked is None or bool(self.added and self.added.search(t)) for t in texts]
        plain = iter(self._plain([t for t, s in zip(texts, special) if not s]) if not all(special) else [])
        return [np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if s else next(plain)
                for t, s in zip(texts, special)]


@functools.lru_cache(maxsize=1)
def encoder(path: str, cache_bytes: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, cache_bytes)


def encoded(texts: pa.Array, encode: Encoder) -> Iterator[tuple[int, bytes]]:
    """(row, ids) of every text, encoded in slices of bounded size."""
    for begin, piece in words.slices(texts):
        yield from enumerate(encode(piece.to_pylist()), begin)
