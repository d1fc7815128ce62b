"""Byte-level BPE encoding and decoding by replaying the merges over all words of a block at once.

A task reads its texts in blocks and gathers the words that it hasn't met. A replay holds an inverted index from token pair to the word
positions that bear it, takes the pairs in order of rank and, at each position, makes the merge and looks up the two touched neighbours
alone, so a word is replayed once per block however often it occurs, and nothing is shuffled. Ids are joined by word and decoded from the
ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flatbytes import pieces

#: Text bytes of a block; words that a task remembers before it starts anew.
BLOCK_BYTES, MEMO_WORDS = 2 << 20, 250_000
_NONE = np.int64(1) << 62


def pattern(pat: str) -> str:
    """``pat`` with white space as the tokenizers' engine has it: the Unicode property, without x1C to x1F."""
    space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    for old, new in ((r"[^\s\p{L}\p{N}]", rf"[^{space}\p{{L}}\p{{N}}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pat = pat.replace(old, new)
    return pat


class Ranks:
    """A rank file's tokens, and for each pair of tokens whose bytes together are a token, that token."""

    _loaded: dict[str, Ranks] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(rank.values()) + 1)
        for token, r in rank.items():
            tokens[r] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        keys, merged = array("q"), array("q")
        for t, r in rank.items():
            for i in range(1, len(t)):
                if t[:i] in rank and t[i:] in rank:
                    keys.append(rank[t[:i]] << 32 | rank[t[i:]])
                    merged.append(r)
        pairs = np.stack([np.array(keys, np.int64), np.array(merged, np.int64)], 1)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.merged = np.append(pairs[:, 0], _NONE), np.append(pairs[:, 1], _NONE)
        self.of_pair = dict(zip(self.pairs[:-1].tolist(), self.merged[:-1].tolist(), strict=True))

    @classmethod
    def load(cls, path: str) -> Ranks:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers. No word may be empty.

        ``index`` leads from the rank of a pair to the positions that bear it, ``ranks`` is a heap of its keys. A merge can make a
        pair of lower rank than its own; that one goes first, and the positions that are left wait in the index.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(flat), _NONE)
        rank[:-1] = self.lookup(flat[:-1], flat[1:])
        rank[ends - 1] = _NONE  # no pair leaves its word
        ids, now, n = flat.tolist(), rank.tolist(), len(flat)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            before[s], after[e - 1] = -1, -1
        posted = np.flatnonzero(rank < _NONE)
        posted = posted[np.argsort(rank[posted], kind="stable")]
        kinds, cuts = np.unique(rank[posted], return_index=True)
        index = {r: p.tolist() for r, p in zip(kinds.tolist(), np.split(posted, cuts[1:]), strict=False)}
        ranks, of_pair = list(index), self.of_pair
        heapq.heapify(ranks)

        def post(at: int) -> int:
            """Look up the pair that now begins at a position and post it; its rank."""
            follow = after[at]
            r = of_pair.get(ids[at] << 32 | ids[follow], _NONE) if follow >= 0 else _NONE
            now[at] = r
            if r < _NONE:
                if r in index:
                    index[r].append(at)
                else:
                    index[r] = [at]
                    heapq.heappush(ranks, r)
            return r

        while ranks:
            r = heapq.heappop(ranks)
            places = sorted(index.pop(r))
            for i, at in enumerate(places):
                if now[at] != r:
                    continue  # merged away, or another pair by now
                gone = after[at]
                ids[at], now[gone] = r, -1
                after[at] = follow = after[gone]
                if follow >= 0:
                    before[follow] = at
                low = post(at)
                if before[at] >= 0:
                    low = min(low, post(before[at]))
                if low < r and i + 1 < len(places):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(ranks, r)
                    index[r] += places[i + 1 :]
                    break
        kept = np.array(now) != -1
        left = np.add.reduceat(kept.astype(np.int64), ends - sizes) if n else sizes
        whole = np.array(ids, np.int64)[kept].astype("<u4").tobytes()
        stops = np.cumsum(left).tolist()
        return [whole[4 * (e - k) : 4 * e] for e, k in zip(stops, left.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.first[ids] - (ends - sizes), sizes)
        return self.pool[shift + np.arange(len(shift))].tobytes()


def encode(docs: DataFrame, path: str, pat: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text; further columns are not read): the whole text's ids as little-endian 32-bit
    integers in a binary.

    A null is the empty text, whose ids are empty. Rows without doc_id and repeated rows are encoded like others. A text stands whole in
    its task. ``path`` is a rank file that the executors can open, ``pat`` its split pattern.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, _ in _encoded(batches, path, pat):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): the bytes that the ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.load(path)
        for batch in batches:
            out = [ranks.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def _encoded(batches, path: str, pat: str):
    ranks, split = Ranks.load(path), regex.compile(pattern(pat)).findall
    memo: dict[str, bytes] = {}
    for batch in pieces(batches, "text", BLOCK_BYTES):
        rows = [split(x) if x else () for x in batch.column("text").to_pylist()]
        fresh = set().union(*rows).difference(memo)
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
            fresh = set().union(*rows)
        fresh = list(fresh)
        memo.update(zip(fresh, ranks.replay([w.encode() for w in fresh]) if fresh else (), strict=True))
        yield batch.column("doc_id"), [b"".join(map(memo.__getitem__, row)) for row in rows], ranks


def digests(docs: DataFrame, path: str, pat: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode`` and ``decode`` give, as digests and in one pass; rows as there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for doc_id, ids, ranks in _encoded(batches, path, pat):
            back = [sha(ranks.decode(np.frombuffer(x, "<u4"))) for x in ids]
            columns = [doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def public_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """The path and the pattern of a rank file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_tokenizer())
