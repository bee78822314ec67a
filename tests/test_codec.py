"""Coder, syntax, filterbanks and layouts against definitions and round trips."""

import copy
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondaframe import api
from ondaframe.functions import books as K
from ondaframe.functions.tables import band_widths
from ondaframe.operators import bands, coder, lpc, qmf, streams
from ondaframe.operators import payload as P
from ondaframe.operators import transforms as T
from ondaframe.operators.bitio import Reader, Truncated, Writer, written
from ondaframe.operators.headers import Unsupported, container

RATE = 48000


def drawn(rnd, sequence):
    short = sequence == P.SHORT
    w = {"sequence": sequence, "shape": rnd.randint(0, 1), "max_band": 13 if short else 40, "groups": [3, 1, 4] if short else [1]}
    books = [[rnd.choice([0, *range(1, 12), 13, 15]) for _ in range(w["max_band"])] for _ in w["groups"]]
    scales, lines = [], [0] * P.LINES
    for of, spans in zip(books, P.places(w, RATE), strict=True):
        scales.append([0 if b == 0 else rnd.randint(90, 110) if b < 12 else rnd.randint(-5, 20) for b in of])
        for b, (lo, hi) in zip(of, spans, strict=False):
            most = {0: 0, 11: 900}.get(b, K.SHAPES[b][2] if b in K.SHAPES else 0)
            lines[lo:hi] = [rnd.randint(-most, most) for _ in range(hi - lo)]
    shaping = [{"resolution": 1, "of": [{"length": 4, "order": 2, "down": True, "compress": False, "coefficients": [-8, 7]}]}] + [{"resolution": 0, "of": []}] * (7 if short else 0)
    return {"gain": 100, "window": w, "books": books, "scales": scales, "pulse": None if short else {"start": 2, "steps": [[3, 15]]}, "filters": shaping, "lines": lines}


@pytest.mark.parametrize("sequence", range(4))
def test_blocks_come_back(sequence):
    rnd = random.Random(sequence)
    a, b = drawn(rnd, sequence), drawn(rnd, sequence)
    b["window"] = a["window"]
    mid_side = [[rnd.randint(0, 1) for _ in range(a["window"]["max_band"])] for _ in a["window"]["groups"]]
    els = [{"kind": P.PAIR, "tag": 1, "shared": a["window"], "mid_side": mid_side, "channels": [a, b]}, {"kind": P.DATA, "tag": 0, "aligned": True, "payload": "0f" * 300}, {"kind": P.FILL, "payload": "ab" * 40}]
    back = P.block(Reader(written(P.block, copy.deepcopy(els), RATE, K.by_rule()).data), [], RATE, K.by_rule())
    assert back == els
    other = K.from_rows((k, s, n, w) for k, book in K.by_rule().items() for s, (w, n) in book.code.items())
    assert P.block(Reader(written(P.block, copy.deepcopy(els), RATE, other).data), [], RATE, other) == els


def test_broken_and_unsupported_payloads_are_refused(spark):
    io = Writer()
    io.u(3, P.COUPLING)
    with pytest.raises(Unsupported):
        P.block(Reader(io.data), [], RATE, K.by_rule())
    with pytest.raises(Truncated):
        P.block(Reader(b"\x00"), [], RATE, K.by_rule())
    with pytest.raises(ValueError):
        K.from_rows([(1, 0, 1, 0)])
    with pytest.raises(ValueError):
        K.Book({0: (0, 1), 1: (1, 2)})
    df = spark.createDataFrame([("a", 0, bytearray(io.data)), ("a", 1, bytearray(b"")), ("b", 0, None)], "stream string, f bigint, payload binary").where("payload is not null")
    rows = df.transform(api.decode(RATE)).collect()
    assert sorted((r.f, r.error.split(":")[0]) for r in rows) == [(0, "Unsupported"), (1, "Truncated")] and all(r.samples is None for r in rows)
    assert [container(x) for x in (b"ADIF", b"\x56\xe0", b"\xff\xf1", b"", b"VUSC")] == ["adif", "loas", "adts", "raw", "private"]


def test_encoding_and_decoding_frames(spark):
    t = np.arange(5000)
    x = np.rint((9000 * np.sin(0.05 * t) + 4000 * np.cos(0.4 * t)) * np.sin(np.pi * t / 5000) ** 2).astype(int)
    df = spark.createDataFrame([(s, int(n), int(v) * (1 if s == "a" else 0)) for s in ("a", "silent") for n, v in zip(t, x, strict=True)], "stream string, n bigint, s int").repartition(4)
    payloads = api.framed(df).transform(api.encode(["x"], 44100, 128_000)).cache()
    assert payloads.groupBy("stream").count().collect()[0]["count"] == 6
    assert payloads.agg(F.max(F.octet_length("payload"))).first()[0] <= 128_000 * 1024 // 44100 // 8 + 1
    back = payloads.transform(api.decode(44100)).select("stream", F.posexplode("samples").alias("i", "s"), "f").select("stream", ((F.col("f") - 1) * 1024 + F.col("i")).alias("n"), "s")
    got = {r.stream: r for r in df.transform(api.compare(back)).collect()}
    assert got["a"].samples == 5000 and got["a"].snr > 20 and got["silent"].max_abs == 0
    whole = streams.decode_whole([bytes(r.payload) for r in payloads.where("stream = 'a'").orderBy("f").collect()], 44100)
    assert [r.s for r in back.where("stream = 'a' and n >= 0").orderBy("n").collect()] == whole[0, 1024:].astype(int).tolist()


def test_costs_are_the_bits_that_are_written():
    rnd = np.random.default_rng(1)
    widths = band_widths(RATE, False)
    lengths = coder.word_lengths(K.by_rule())
    for scale in (1, 5, 400):
        q = np.rint(rnd.normal(0, scale, 1024)).astype(int)
        cost = coder.line_costs(q, widths, lengths)
        edge = np.cumsum([0, *widths])
        for b, (n, _, most) in K.SHAPES.items():
            for k in range(0, 49, 7):
                part = q[edge[k] : edge[k + 1]].tolist()
                if max(map(abs, part)) <= (8191 if b == 11 else most):
                    io = Writer()
                    for j in range(0, len(part), n):
                        P.values(io, b, tuple(part[j : j + n]), K.by_rule())
                    assert cost[b - 1, k] == io.size
                else:
                    assert cost[b - 1, k] == 1 << 40


def test_fast_transforms_are_the_definition():
    x = np.random.default_rng(0).normal(size=(3, 256))
    m = T.mdct_matrix(128)
    assert np.allclose(T.lines_of(x), x @ m.T) and np.allclose(T.samples_of(x[:, :128]), x[:, :128] @ m)


def test_filterbank_gives_its_input_back():
    s = 0.6 * np.sin(0.19 * np.arange(160 * 32))
    y = qmf.synthesise(qmf.analyse(np.concatenate([np.zeros(288), s]), 32))[288:]
    off = s[: len(y)][: 4000] - y[:4000]
    assert 10 * np.log10((s[:4000] ** 2).sum() / (off**2).sum()) > 45


def test_line_spectra_come_back():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        a = lpc.analyse(rnd.normal(size=(1, 256)).cumsum(axis=1) * 0.1 + rnd.normal(size=(1, 256)))[0]
        lines = lpc.to_lines(a)
        assert len(lines) == 16 and np.allclose(lpc.from_lines(lines), a, atol=1e-7)
    near = lpc.spaced(np.array([10.0, 20.0, 3000.0, 3010.0, 6399.0]))
    assert near[0] >= 50 and (np.diff(near) >= 50).all() and near[-1] <= 6350


@pytest.mark.parametrize("scale", [1, 2, 3])
@pytest.mark.parametrize("warp", [False, True])
def test_geometric_bands(scale, warp):
    for k0, k2 in ((16, 32), (14, 50), (24, 48), (20, 60)):
        m = bands.master(k0, k2, scale, warp)
        assert m[0] == k0 and m[-1] == k2 and (np.diff(m) >= 0).all()
        first = m[m <= min(2 * k0, k2)]
        assert (np.diff(np.diff(first)) >= 0).all()  # widths grow
        two = 10000 * k2 > 22449 * k0
        n = bands.PER_OCTAVE[scale] if two else bands.PER_OCTAVE[scale] * np.log2(k2 / k0)
        assert abs((m.tolist().index(2 * k0) if two else len(m) - 1) - n) <= 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "stream string, n bigint, s int")
    assert api.framed(none).transform(api.encode(["x"])).transform(api.decode()).count() == 0


def test_frames_beside_much_louder_ones_come_back(spark, tmp_path):
    """d16_frame_decode on streams that end a few samples into a frame, or begin with, or hold, a quiet frame."""
    from ondaframe.plans import coding

    rnd, loud, rows = np.random.default_rng(4), 1024, []
    for left in (1, 2, 7, 60, 300):
        quiet = [*rnd.exponential(50.0, left), *[0.0] * (1024 - left)]
        first, last = rnd.exponential(50.0, (2, loud))
        for name, x in (("ends", [*first, *last, *quiet[:left]]), ("begins", [*quiet[::-1], *first]), ("holds", [*first, *quiet, *last])):
            rows += [(f"{name}{left}", float(v)) for v in x]
    spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "event_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = coding.d16(spark, str(tmp_path)).collect()
    assert len(got) == 5 * (3 + 2 + 3) * 2
    assert [r for r in got if not r["good"]] == []
    assert [coder.sequence_of(*x) for x in ((False, True, False), (True, False, True), (False, False, True), (True, False, False), (False, False, False))] == [P.SHORT, P.SHORT, 1, 3, 0]
