"""Byte-level BPE with a two-tier lookup.

Method: whole pre-tokens are resolved by a minimal perfect hash over the vocabulary; misses are
merged with a heap over linked bytes, the hash giving the rank of each pair.
"""

from __future__ import annotations

import base64
import heapq
import os
from dataclasses import dataclass, field

import numpy as np
import regex
import xxhash

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
M64 = (1 << 64) - 1
STEP, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9  # odd multipliers that spread a 64-bit word


def _place(h: int, d: int, n: int) -> int:
    v = (h + d * STEP) & M64
    v ^= v >> 29
    return ((v * MIX & M64) >> 32) % n


class PerfectHash:
    """Maps n distinct byte strings onto 0..n-1 (hash and displace); other strings onto any slot.

    `displace[b]` >= 0 shifts the keys of bucket b to free slots; a negative value names the slot
    of a bucket's only key. Keys are kept to tell members from others.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4, tries: int = 512):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        groups: dict[int, list] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(k)
            groups.setdefault((h >> 64) % self.buckets, []).append((h & M64, i))
        self.displace = [0] * self.buckets
        slot_key = [-1] * n
        used = np.zeros(n, dtype=bool)
        singles = []
        for b, g in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(g) == 1:
                singles.append((b, g[0][1]))
                continue
            hs = np.array([h for h, _ in g], dtype=np.uint64)
            start = 0
            while True:  # the displacements of one chunk at a time
                d = np.arange(start, start + tries, dtype=np.uint64)
                v = hs[None, :] + d[:, None] * np.uint64(STEP)
                v ^= v >> np.uint64(29)
                slots = ((v * np.uint64(MIX)) >> np.uint64(32)) % np.uint64(n)
                free = ~used[slots].any(axis=1)
                for j in np.flatnonzero(free):
                    if len(set(slots[j].tolist())) == len(g):
                        break
                else:
                    start += tries
                    continue
                break
            self.displace[b] = start + int(j)
            for x, (_, i) in zip(slots[j].tolist(), g, strict=True):
                used[x], slot_key[x] = True, i
        for (b, i), x in zip(singles, np.flatnonzero(~used).tolist(), strict=True):
            self.displace[b], slot_key[x] = -x - 1, i
        self.keys = [keys[i] for i in slot_key]

    def slot(self, key: bytes) -> int:
        """The slot of a member, -1 of any other string."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.displace[(h >> 64) % self.buckets]
        x = -d - 1 if d < 0 else _place(h & M64, d, self.n)
        return x if self.keys[x] == key else -1


@dataclass
class BytePairEncoder:
    """Encodes text by a rank file. Without special tokens: their spelling is ordinary text."""

    path: str
    pattern: str = PATTERN
    cache_size: int = 1 << 17  # pre-tokens remembered by a worker; changes the speed only
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        with open(self.path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.keys]
        self.split = regex.compile(self.pattern).findall

    def rank(self, piece: bytes) -> int:
        x = self.hash.slot(piece)
        return self.ids[x] if x >= 0 else -1

    def merge(self, word: bytes) -> list[int]:
        """Pairs are joined in order of rank, the leftmost first; a linked list holds the parts."""
        n = len(word)
        end = list(range(1, n + 1))  # a part is word[i:end[i]]
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = []

        def push(i: int) -> None:
            j = end[i]
            if j < n:
                r = self.rank(word[i : end[j]])
                if r >= 0:
                    heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
                continue  # one of the parts has changed since
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.rank(word[i : end[i]]))
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of an empty or null text the empty list."""
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                r = self.rank(raw)
                ids = [r] if r >= 0 else self.merge(raw)
                if len(piece) <= 64:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The rank file of a public tokenizer. The folder is a parameter: an argument, the variable
    SKYLEDGER_TOKENIZERS, the installed package of vocabularies, or /opt/tokenizers."""
    folder = folder or os.environ.get("SKYLEDGER_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.__file__)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, f"{name}.tiktoken")
