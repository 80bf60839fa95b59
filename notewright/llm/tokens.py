"""Sizes of documents in tokens of a public tokenizer, with what packing and mixing need of them."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' vocabulary files, and the one used; both are parameters.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Dimensions and bits a dimension of the space that document vectors are projected to.
DIMS, BITS = 4, 10


@lru_cache(4)
def _built(name: str, ranks_file: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_file(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> bytes:
    return (Path(folder) / vocabulary).read_bytes()


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, built once a process."""
    return _built(vocabulary, vocabulary_file(folder, vocabulary))


@lru_cache(4)
def _directions(n: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(n, dims))


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows), by Skilling's transposition."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _repeated(ids: np.ndarray, k: int = 5) -> float:
    """1 - distinct / all sequences of k tokens."""
    n = len(ids) - k + 1
    if n < 1:
        return 0.0
    code = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return 1 - len(np.unique(code)) / n


def measured(documents: DataFrame, carry: tuple[str, ...] = (), folder: str = FOLDER, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """doc_id, ``carry``, n_tokens, quality and curve_key of every document, in one pass over whole texts.

    quality is 1 minus the share of repeated five-token sequences, at least
    0.05. curve_key is the Hilbert index of the document's vector of distinct
    tokens, hashed to DIMS random directions. A null text has no tokens; rows
    without a doc_id are left out. The vocabulary file is read on the driver
    and broadcast (about a megabyte), so executors need no copy of their own.
    """
    kinds = dict(documents.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", *[f"{c} {kinds[c]}" for c in carry], "n_tokens long, quality double, curve_key long"])

    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary_file(folder, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _built(vocabulary, ranks.value)
        directions = _directions(max(enc.n_vocab, 65_536), DIMS, seed)
        for batch in batches:
            size, quality = np.zeros(len(batch), np.int64), np.ones(len(batch))
            at = np.zeros((len(batch), DIMS))
            for i, text in enumerate(batch["text"]):
                if not text:
                    continue
                ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
                size[i], quality[i] = len(ids), max(0.05, 1 - _repeated(ids))
                own = np.unique(ids)
                at[i] = directions[own].sum(axis=0) / np.sqrt(max(1, len(own)))
            cells = np.clip((at + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield batch[["doc_id", *carry]].assign(n_tokens=size, quality=quality, curve_key=hilbert(cells, BITS))

    return documents.filter("doc_id is not null").select("doc_id", *carry, "text").mapInPandas(run, schema)
