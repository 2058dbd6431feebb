"""Byte-level BPE encoding and decoding by a segment tree.

A piece's bytes are the leaves of a tree over positions; each leaf holds the rank of the pair that starts
there with the next live neighbour, each inner node the leftmost least rank below it. A merge reads the
root, joins two neighbours, and updates the leaves of the joined part and of its left neighbour:
logarithmic work each. Pieces repeat, so each worker keeps the ids of the pieces it has met, up to a bound;
of the pieces kept longest ago those that come again stay.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cluster

#: White space as Unicode's property has it; \s of this regex library also holds U+001C to U+001F.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = 1 << 60
#: Pieces that a worker keeps in either of two generations, and the longest of them in bytes.
KEPT_PIECES, KEPT_BYTES = 300_000, 64


@functools.cache
def splitter(pattern: str):
    """The pattern compiled with the white space of the property instead of this library's."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_WHITE if depth else f"[{_WHITE}]")
            i += 2
        elif two == r"\S":
            if depth:
                raise ValueError(r"\S inside a class")
            out.append(f"[^{_WHITE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            depth += (two[0] == "[") - (two[0] == "]")
            out.append(two[0])
            i += 1
    return regex.compile("".join(out))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. Of equal ranks the leftmost pair goes first."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    width = 1 << max(0, (n - 1).bit_length())
    tree = [_NONE] * (2 * width)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        tree[width + i] = ranks.get(piece[i : i + 2], _NONE)
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(leaf: int, rank: int) -> None:
        k = width + leaf
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (least := tree[1]) < _NONE:
        k = 1
        while k < width:
            k *= 2
            if tree[k] != least:  # the left half has it, or else the right half
                k += 1
        i = k - width
        j = nxt[i]
        after = nxt[j]
        nxt[i] = after
        if after < n:
            prv[after] = i
        put(j, _NONE)
        put(i, ranks.get(piece[i : nxt[after]], _NONE) if after < n else _NONE)
        if (p := prv[i]) >= 0:
            put(p, ranks.get(piece[p:after], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


class _Kept(dict):
    """Ids of pieces; one that is not there is encoded, or taken over from the generation before."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = np.array(encode_piece(raw, self.ranks), "<u4").tobytes()
            if len(raw) > KEPT_BYTES:
                return ids
        if len(self) >= KEPT_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Tokenizer:
    """Encodes whole texts to little-endian 32-bit ids and decodes them again."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.split = splitter(pattern).findall
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self.kept = _Kept(ranks)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.kept.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_tokens, ids (binary, little-endian u32), and decoded (binary, what the ids decode to).

    A null or empty text has no tokens. Texts are encoded whole, each in the task that reads it; no row moves.
    Repeated rows give repeated rows; other columns are not read, whatever their names.
    """
    cluster.ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            held = [(ids := t.encode(text) if text else b"", t.decode(ids)) for text in batch.column(1).to_pylist()]
            counts = pa.array([len(ids) // 4 for ids, _ in held], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *(pa.array([x[k] for x in held], pa.binary()) for k in (0, 1))], ["id", "n_tokens", "ids", "decoded"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
