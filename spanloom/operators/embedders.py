"""Embedders: anything with ``name`` and ``encode(texts) -> array of unit rows``."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain
from typing import Protocol

import numpy as np

from ..functions.text import TOKEN

_TOKENS = re.compile(TOKEN)
_DECIMAL, _APART = re.compile(r"\.[0-9]"), bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def token_list(text: str) -> list[str]:
    """The matches of TOKEN in a text's lower case. Without decimals they are what other characters part."""
    low = text.lower()
    if _DECIMAL.search(low):
        return _TOKENS.findall(low)
    return low.encode(errors="replace").translate(_APART).decode("ascii").split()


class Embedder(Protocol):
    """Must be picklable; heavy state is loaded lazily, once in each Python worker."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def bucket(token: str, dims: int) -> int:
    """The first 32 bits of the token's MD5, modulo ``dims``."""
    return int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:4], "big") % dims


class _Buckets(dict):
    """Buckets of the tokens met by a worker; begun anew when it holds the most that it may."""

    def __init__(self, dims: int, most: int = 1 << 16):
        self.dims, self.most = dims, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[token] = found = bucket(token, self.dims)
        return found


_buckets = lru_cache(maxsize=4)(_Buckets)


class HashingEmbedder:
    """Counts of hashed tokens, of unit length: a deterministic stand-in where no model is installed."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.encode_tokens([token_list(text) for text in texts])

    def encode_tokens(self, texts: list[list[str]]) -> np.ndarray:
        """The same from the texts' tokens, for callers that need them anyway. All counts are made at once."""
        n, dims = len(texts), self.dims
        places = np.fromiter(map(_buckets(dims).__getitem__, chain.from_iterable(texts)), np.intp)
        places += np.repeat(np.arange(0, n * dims, dims), [len(tokens) for tokens in texts])
        out = np.bincount(places, minlength=n * dims).astype(float).reshape(n, dims)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1.0)
        return out


def encoded(embedder: Embedder, texts: list[str], tokens: list[list[str]]) -> np.ndarray:
    """Vectors of texts whose tokens are known, which spares an embedder that counts tokens the search for them."""
    return embedder.encode_tokens(tokens) if hasattr(embedder, "encode_tokens") else embedder.encode(texts)


class SentenceTransformerEmbedder:
    """A sentence-transformer model, loaded on first use in each worker."""

    def __init__(self, model: str, batch_size: int = 32, device: str = "cpu"):
        self.model, self.batch_size, self.device = model, batch_size, device

    def encode(self, texts: list[str]) -> np.ndarray:
        encoder = _loaded(self.model, self.device)
        return np.asarray(encoder.encode(texts, normalize_embeddings=True, show_progress_bar=False, batch_size=self.batch_size))


@lru_cache(maxsize=2)
def _loaded(model: str, device: str):
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise RuntimeError("sentence_transformers is not installed; use HashingEmbedder or another Embedder") from e
    return SentenceTransformer(model, device=device)
