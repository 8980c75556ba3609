"""Plain and normalised texts, tokens, keywords and MinHash in one pass over Arrow batches.

The same values as `text.plain`, `text.normalize`, `text.tokens` (distinct),
`text.keywords` and `hashing.minhash` give row by row in the JVM. There a word's
twelve hashes are made anew for each row that has it; here a worker keeps those of
the words that it has met, up to a bound, as words recur. Texts with references
or with characters outside of Latin and general punctuation are normalised in the
JVM, whose tables of characters count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import INVISIBLE, STOP_WORDS, _col, normalize, plain
from kinfold.plans.config import KEYWORDS, SIGNATURES

try:  # without OpenSSL's set-up for each hash
    from _sha2 import sha256
except ImportError:
    from hashlib import sha256

KINDS = {"plain": "string", "normalized": "string", "tokens": "array<string>", "keywords": "array<string>", "minhash": "array<bigint>"}
ARROW = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
#: Texts with such a character go through the JVM's functions.
HARD = r"[&[^\x00-\u024F\u2000-\u206F]]"
#: What `text.tokens` leaves out: stop words and single bytes that are no digit.
DROPPED = frozenset([b"", *(w.encode() for w in STOP_WORDS), *(bytes([c]) for c in range(256) if not 48 <= c <= 57)])
#: Words whose hashes a worker keeps (twice as many at most), and runs of other bytes than ASCII; rows in one step.
KEPT, RUNS, STEP = 1 << 17, 1 << 16, 512
TAG, RUN = re.compile(rb"<[^>]*>"), re.compile(rb"[\x80-\xff]+")
#: Bytes of ASCII as normalised: lowered, kept or blank.
ASCII = bytes(c if c >= 128 or chr(c) in "+-/=<>%." or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
BLANK = frozenset("\x85\xa0\u2028\u2029\u202f\u205f" + "".join(map(chr, range(0x2000, 0x200B))) + INVISIBLE)


class Runs(dict):
    """What a run of bytes other than ASCII becomes: blank where a character of it does not pass."""

    def __init__(self, passes):
        self.passes = passes

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= RUNS:
            self.clear()
        made = self[run] = "".join(c if self.passes(c) else " " for c in run.decode()).encode()
        return made


class Hashes(dict):
    """For each word the first 32 bits of sha256('seed:word') of each seed; words not met among the last KEPT new ones go."""

    def __init__(self):
        self.older: dict[bytes, bytes] = {}
        self.seeds = [b"%d:" % s for s in range(SIGNATURES)]

    def __missing__(self, word: bytes) -> bytes:
        made = self.older.get(word) or b"".join([sha256(s + word).digest()[:4] for s in self.seeds])
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = made
        return made

    def least(self, words: list[bytes]) -> list[int]:
        rows = b"".join([self[w] for w in words])
        return np.frombuffer(rows, ">u4").reshape(-1, SIGNATURES).min(axis=0).tolist() if words else []


#: A worker keeps them from task to task.
HASHES, LETTERS, SHOWN = Hashes(), Runs(lambda c: unicodedata.category(c)[0] in "LNM"), Runs(lambda c: c not in BLANK)


def best(counts: dict[bytes, int], words: list[bytes], limit: int = KEYWORDS) -> list[bytes]:
    """The most frequent words; ties by more bytes, then by byte order."""
    least = sorted((counts[w] for w in words), reverse=True)[:limit][-1] if words else 0
    return sorted((w for w in words if counts[w] >= least), key=lambda w: (-counts[w], -len(w), w))[:limit]


def _strings(rows: list[list[bytes] | None]) -> pa.Array:
    flat = pa.array([w for row in rows for w in row or ()], pa.binary())
    text = pa.StringArray.from_buffers(len(flat), *flat.buffers()[1:])
    ends = np.cumsum([0, *(len(row or ()) for row in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text)


def _texts(texts: list[bytes | None]) -> pa.Array:
    rows = pa.array(texts, pa.binary())
    return pa.StringArray.from_buffers(len(rows), rows.buffers()[1], rows.buffers()[2], rows.buffers()[0], rows.null_count)


def _step(easy: list[bytes | None], normal: list[bytes | None], shown: list[bytes | None], wanted: tuple[str, ...], hashes: Hashes) -> list[pa.Array]:
    """Of each row either the text or what it is normalised to (and shown as)."""
    rows: dict[str, list] = {k: [] for k in wanted}
    for text, norm, clean in zip(easy, normal, shown):
        if text is not None:
            text = TAG.sub(b" ", text) if b"<" in text else text
            latin = text.isascii()
            if "plain" in rows:
                clean = b" ".join((text if latin else RUN.sub(lambda m: SHOWN[m[0]], text)).split())
            norm = b" ".join((text if latin else RUN.sub(lambda m: LETTERS[m[0]], text)).translate(ASCII).split())
        if "plain" in rows:
            rows["plain"].append(clean)
        if "normalized" in rows:
            rows["normalized"].append(norm)
        counts = Counter((norm or b"").split(b" "))
        words = [w for w in counts if w not in DROPPED]
        if "tokens" in rows:
            rows["tokens"].append(words)
        if "keywords" in rows:
            rows["keywords"].append(best(counts, words))
        if "minhash" in rows:
            rows["minhash"].append(hashes.least(words))
    made = {"string": _texts, "array<string>": _strings, "array<bigint>": lambda v: pa.array(v, pa.list_(pa.int64()))}
    return [made[KINDS[k]](v) for k, v in rows.items()]


def features(html: Column | str, *wanted: str) -> Column:
    """A struct of those `wanted` of KINDS; of a null text it is null."""
    types = [pa.field(k, ARROW[KINDS[k]]) for k in wanted]

    @F.arrow_udf(f"struct<{','.join(f'{k}:{KINDS[k]}' for k in wanted)}>")
    def made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from kinfold.functions.features import HASHES, _step

        for batch in batches:
            parts = [pa.StructArray.from_arrays([pa.array([], f.type) for f in types], fields=types)]
            for at in range(0, len(batch[0]), STEP):
                arrays = _step(*[c.slice(at, STEP).cast(pa.binary()).to_pylist() for c in batch], wanted, HASHES)
                parts.append(pa.StructArray.from_arrays(arrays, fields=types))
            yield pa.concat_arrays(parts)

    c = _col(html)
    hard = c.rlike(HARD)
    return F.when(c.isNotNull(), made(F.when(~hard, c), F.when(hard, normalize(c)), F.when(hard, plain(c)) if "plain" in wanted else F.lit(None).cast("string")))
