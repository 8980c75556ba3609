"""The suffix array merges the starts of windows only, and ranges that cover a text are found without Python objects."""

import random

import numpy as np
import pyarrow as pa

from kinfold.llm import suffixdedup


def test_dc3_merges_only_what_is_needed():
    rng = random.Random(4)
    for n in (9, 60, 700):
        for letters in (1, 2, 200):
            s = np.array([rng.randint(1, letters) for _ in range(n)] + [0] * 3, np.int64)
            full = suffixdedup.dc3(s, 1, 10**9).tolist()
            for share in (0, 0.3, 1):
                need = np.array([rng.random() < share for _ in s], bool)
                assert suffixdedup.dc3(s, 1, 10**9, need).tolist() == [x for x in full if need[x]]
    # Names too many for one 63-bit number take the general way.
    wide = np.array([rng.randrange(1, 1 << 30) for _ in range(60)] * 2 + [0] * 3, np.int64)
    order = [x for x in suffixdedup.dc3(wide, 1, 10**9).tolist() if x < 120]
    assert order == sorted(range(120), key=lambda i: wide[i:].tolist())


def test_repeated_windows_of_blocks():
    rng = random.Random(5)
    for length in (40, 200):
        common = bytes(rng.randrange(256) for _ in range(length + 9))
        blocks = [bytes(rng.choice(b"\0\1ab\xff") for _ in range(rng.randrange(30))) + common[rng.randrange(9) :] for _ in range(12)]
        blocks += [bytes(length + 5), bytes(rng.randrange(256) for _ in range(length))]
        blocks = [b if len(b) >= length else b + bytes(length) for b in blocks]
        counts = np.array([1] * 12 + [1, 2])
        seen = {}
        for b, c in zip(blocks, counts.tolist()):
            for k in range(len(b) - length + 1):
                seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + c
        got = suffixdedup.repeated(blocks, counts, length)
        assert [g.tolist() for g in got] == [[seen[b[k : k + length]] > 1 for k in range(len(b) - length + 1)] for b in blocks]


def test_ranges_of_rows():
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]))
    rows = [[], [{"lo": 5, "begins": [0, 9], "ends": [4, 12]}, {"lo": 7, "begins": [0], "ends": [3]}], None, [{"lo": 0, "begins": [2], "ends": [3]}]]
    for cut in range(4):
        at, begins, ends = suffixdedup._ranges(pa.array(rows, kind).slice(cut))
        got = [list(zip(begins[i:j].tolist(), ends[i:j].tolist())) for i, j in zip(at[:-1], at[1:])]
        assert got == [[], [(5, 9), (14, 17), (7, 10)], [], [(2, 3)]][cut:]
    assert np.flatnonzero(suffixdedup._mask(20, np.array([5, 14, 7]), np.array([9, 17, 10]))).tolist() == [5, 6, 7, 8, 9, 14, 15, 16]
