"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte runs. Each adjacent pair whose
joined bytes have a rank waits in that rank's bucket, which holds list
positions. A three-level bitmap over the ranks (64-way) tells the lowest
non-empty bucket by two or three find-first-set steps. The leftmost position of
that bucket is merged, its two neighbour pairs are queued, and entries that an
earlier merge has made stale are skipped when they surface. So a pre-token of
n bytes costs O(n log n) however long it is.

Long pre-tokens run alone (`Codec.merge`). All new short pre-tokens of a batch
share one queue (`Codec.merge_all`): the lowest rank's bucket then holds
positions of many pre-tokens, and one vectorised step merges the leftmost of
each; pre-tokens do not touch, so each sees its own order of merges.

Edge cases: a null or empty text has no ids; text that a byte vocabulary lacks
raises ValueError (byte vocabularies hold all 256 bytes); repeated rows repeat.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinfold.llm.common import arrow_map

#: Distinct pre-tokens that one worker remembers before it starts afresh; bounds memory, changes no result.
MEMORY = 600_000
#: Longer pre-tokens have a queue of their own.
SHORT_BYTES = 48
#: Bytes of text that are split before their new pre-tokens are merged together.
BATCH_BYTES = 24 << 20


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; rank -1 when empty."""
        top = self.top
        if not top:
            return -1, -1
        b = (top & -top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[a] = w = w & (w - 1)
        if not w:
            self.mid[b] = m = m & (m - 1)
            if not m:
                self.top = top & (top - 1)
        return rank, bucket[0]


class Numbers(dict):
    """Numbers keys as they are first met, and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        k = self[key] = len(self)
        self.new.append(key)
        return k


class Codec:
    """Encoder and decoder for one rank table and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.size = max(ranks.values(), default=0) + 1
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self._pair_table: tuple[np.ndarray, np.ndarray] | None = None
        self.memory = Numbers()
        self.joined: list[str] = []
        self.lengths: list[int] = []
        self.decoded: list[bytes] = []

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue, rank_of = self.queue, ranks.get
        push, pop = queue.push, queue.pop
        due = [-1] * n  # the rank under which each position waits now
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                due[i] = r
                push(r, i)
        while True:
            r, i = pop()
            if r < 0:
                break
            if due[i] != r:
                continue  # stale
            j = after[i]
            joined = part[i] + part[j]
            part[i], part[j] = joined, None
            k = after[i] = after[j]
            due[j] = -1
            if k < n:
                before[k] = i
                s = rank_of(joined + part[k])
                if s is None:
                    due[i] = -1
                else:
                    due[i] = s
                    push(s, i)
            else:
                due[i] = -1
            h = before[i]
            if h >= 0:
                s = rank_of(part[h] + joined)
                if s is None:
                    due[h] = -1
                elif due[h] != s:
                    due[h] = s
                    push(s, h)
        out, i = [], 0
        while i < n:
            r = rank_of(part[i])
            if r is None:
                raise ValueError(f"no rank for byte {part[i]!r}")
            out.append(r)
            i = after[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys left * size + right of all pairs that join to a token, and the tokens' ranks."""
        if self._pair_table is None:
            get, size = self.ranks.get, self.size
            found = [(a * size + b, r) for t, r in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
            table = np.array(sorted(found), np.int64).reshape(-1, 2)
            self._pair_table = table[:, 0].copy(), table[:, 1].astype(np.int32)
        return self._pair_table

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty pre-tokens, concatenated, and their offsets (n + 1)."""
        keys, values = self._pairs()
        size = self.size
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(pieces) else 0
        data = np.frombuffer(b"".join(pieces), np.uint8)
        # Places n and n + 1 stand behind each last and before each first run; no pair holds their token.
        token = np.full(n + 2, size, np.int64)
        token[:n] = self.byte_ids[data]
        if n and token[:n].min() < 0:
            raise ValueError("no rank for a byte")
        after = np.arange(1, n + 3)
        before = np.arange(-1, n + 1)
        after[ends - 1] = n
        before[ends - lengths] = n + 1
        owner = np.repeat(np.arange(len(pieces)), lengths)
        alive = np.ones(n, bool)

        def rank_of(left, right):
            key = left * size + right
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            return np.where((keys[at] == key) & (right < size) & (left < size), values[at], -1) if len(keys) else np.full(len(key), -1)

        due = np.full(n + 2, -1, np.int64)
        due[:n] = rank_of(token[:n], token[after[:n]])
        low, mid, top = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1), 0
        buckets: dict[int, list[np.ndarray]] = {}

        def push(rank, place):
            nonlocal top
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(place, cut) if len(cut) else [place]):
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [part]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
                else:
                    bucket.append(part)

        start = np.flatnonzero(due[:n] >= 0)
        if len(start):
            push(due[start], start)
        while top:
            b = (top & -top).bit_length() - 1
            a = b << 6 | (mid[b] & -mid[b]).bit_length() - 1
            r = a << 6 | (low[a] & -low[a]).bit_length() - 1
            low[a] &= low[a] - 1
            if not low[a]:
                mid[b] &= mid[b] - 1
                if not mid[b]:
                    top &= top - 1
            bucket = buckets.pop(r)
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[due[at] == r]  # the others are stale
            if len(at) > 1:
                own = owner[at]
                first = np.append(True, own[1:] != own[:-1])
                if not first.all():
                    rest = at[~first]
                    push(np.full(len(rest), r), rest)
                    at = at[first]
            elif not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            token[at] = r
            due[gone] = -1
            alive[gone] = False
            after[at] = behind
            before[behind] = at
            ahead = before[at]
            m = len(at)
            left = np.concatenate([at, ahead])
            ranks = rank_of(token[left], np.concatenate([token[behind], token[at]]))
            due[at] = ranks[:m]
            due[ahead] = ranks[m:]
            fine = ranks >= 0
            if fine.any():
                push(ranks[fine], left[fine])
        ids = token[:n][alive]
        return ids, np.append(0, np.cumsum(np.bincount(owner[alive], minlength=len(pieces))))

    def learn(self) -> None:
        """Give an entry to each pre-token that was met since the last call."""
        new = self.memory.new
        plain, short = [], []
        for k, p in enumerate(new, len(self.joined)):
            b = p.encode("utf-8")
            whole = self.ranks.get(b)
            plain.append([whole] if whole is not None else None if len(b) <= SHORT_BYTES else self.merge(b))
            if plain[-1] is None:
                short.append(b)
        if short:
            ids, offsets = self.merge_all(short)
            ids, offsets = ids.tolist(), offsets.tolist()
        s = 0
        for own in plain:
            if own is None:
                own = ids[offsets[s] : offsets[s + 1]]
                s += 1
            self.joined.append(",".join(map(str, own)))
            self.lengths.append(len(own))
            self.decoded.append(self.decode(own))
        new.clear()

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """For each text the numbers of its pre-tokens, which index `joined`, `lengths` and `decoded`."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
            for held in (self.joined, self.lengths, self.decoded):
                held.clear()
        number = self.memory.__getitem__
        found = [np.fromiter(map(number, self.split(t)), np.int32) for t in texts]
        self.learn()
        return found

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.merge(p.encode("utf-8"))]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, data binary: the bytes that ids stand for; null ids decode to nothing."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        data = [c.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def parts(column: pa.Array):
    """The texts (null: empty) in lists of about BATCH_BYTES characters."""
    part, held = [], 0
    for scalar in column:
        text = scalar.as_py() or ""
        part.append(text)
        held += len(text)
        if held >= BATCH_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def round_trips(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    path, pattern = vocabulary or default_vocabulary()
    sha = hashlib.sha256

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        counts, ids_hash, data_hash = [], [], []
        for part in parts(batch.column("text")):
            found = c.pieces(part)
            joined, lengths, decoded = c.joined.__getitem__, c.lengths.__getitem__, c.decoded.__getitem__
            for numbers in found:
                numbers = numbers.tolist()
                counts.append(sum(map(lengths, numbers)))
                ids_hash.append(sha(",".join(map(joined, numbers)).encode()).hexdigest())
                data_hash.append(sha(b"".join(map(decoded, numbers))).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(data_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
