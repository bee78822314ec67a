"""Queries that must see all of their input, against brute force."""

import numpy as np
import pandas as pd

from ondaframe import plans
from ondaframe.operators.checksums import SLAB, crc16
from ondaframe.plans import output

SF = "/root/testdata/sf0.001"


def bitwise_crc16(data):
    c = 0xFFFF
    for v in data:
        c ^= v << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
    return c


def test_crc16_of_any_length():
    x = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    for n in (0, 1, 2, 3, 31, 32, 33, 63, 64, 65, 127, 128, 129, 5000):
        assert crc16(x[:n]) == bitwise_crc16(x[:n])
    assert crc16(b"123456789") == 0xAEE7
    long = x * (SLAB // len(x) + 1)
    assert crc16(long) == bitwise_crc16(long)


def test_crc16_covers_whole_texts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.crc for r in plans.QUERIES["s23_crc16_whole"](spark, SF).collect()}
    assert got == {d: bitwise_crc16(t.encode()) if t is not None else None for d, t in text.items()}
    assert max(len(t.encode()) for t in text.values() if t) > 32


def test_crc16_of_odd_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "é" * 32 + "x"), (5, "é" * 32 + "y"), (None, "z")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.crc for r in plans.QUERIES["s23_crc16_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: 0xFFFF, 3: bitwise_crc16(b"a"), 4: bitwise_crc16(("é" * 32 + "x").encode()), 5: bitwise_crc16(("é" * 32 + "y").encode()), None: bitwise_crc16(b"z")}


def best_shift(r, t, reach, least):
    """As the reference program, a shift at a time; the shift is the test's delay."""
    found = []
    for o in range(-reach, reach + 1):
        a, b = (r[: len(r)], t[o:]) if o >= 0 else (r[-o:], t)
        n = min(len(a), len(b))
        if n >= least:
            d = a[:n].astype(float) - b[:n]
            found.append((np.sqrt((d * d).mean()), o))
    return min(found)


def test_alignment_within_the_whole_reach(spark):
    rnd = np.random.default_rng(1)
    pairs, rows = {}, {0: [], 1: []}
    for stream, delay, n in (("near", 3, 9000), ("nine", 9, 9000), ("far", 4096, 9000), ("early", -4000, 9000), ("loud", -17, 40000), ("edge", 1500, 2524), ("brief", 5, 200)):
        whole = rnd.integers(-32768, 32768, n + abs(delay))
        r, t = (whole[:n], np.concatenate([rnd.integers(-32768, 32768, delay), whole[: n - delay] // 2 * 2])) if delay >= 0 else (whole[:n], whole[-delay:] // 2 * 2)
        pairs[stream] = r, t
        for k, x in ((0, r), (1, t)):
            rows[k].append(pd.DataFrame({"stream": stream, "n": np.arange(len(x)), "s": x}))
    ref, test = (spark.createDataFrame(pd.concat(rows[k])) for k in (0, 1))
    got = {r.stream: (r["shift"], r.rms) for r in output.best_alignment(ref, test).collect()}
    want = {k: best_shift(r, t, 4096, 1024 if len(r) >= 1024 else 100) for k, (r, t) in pairs.items()}
    assert {k: v[0] for k, v in got.items()} == {k: o for k, (_, o) in want.items()} == {"near": 3, "nine": 9, "far": 4096, "early": -4000, "loud": -17, "edge": 1500, "brief": 5}
    assert all(abs(got[k][1] - rms) < 1e-7 for k, (rms, _) in want.items())
    small = {r.stream: (r["shift"], r.rms) for r in output.best_alignment(ref, test, block=512).collect()}
    assert small == got
