"""Containers, the composable steps and the streaming folds."""

import numpy as np
import pandas as pd

from ondaframe import api
from ondaframe.functions.tables import LONG_48, SHORT_48
from ondaframe.operators import folds, streams
from ondaframe.sources import containers
from ondaframe.streaming import coding
from ondaframe.streaming import folds as streaming


def header(n, idx=4):
    bits = f"{0xFFF:012b}0001{1:02b}{idx:04b}0{2:03b}0000{n:013b}{0x7FF:011b}00"
    return int(bits, 2).to_bytes(7, "big")


def test_adts_files(spark, tmp_path):
    good = header(20) + bytes(13)
    (tmp_path / "a.aac").write_bytes(b"\xff\x00junk" + good + b"\xff" + header(9) + bytes(2) + header(500) + bytes(3))
    (tmp_path / "b.aac").write_bytes(b"")
    rows = containers.read_adts(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.lo, r.hi) for r in rows] == [(0, 6, 26), (1, 27, 36)]
    assert rows[0].payload == good and rows[0].header.length == 20 and rows[0].header.rate == 44100 and rows[0].header.channels == 2 and rows[0].header.object_type == 2


def test_wav_round_trip_and_errors(spark, tmp_path):
    x = np.random.default_rng(0).integers(-32768, 32768, (100, 2)).astype(np.int16)
    (tmp_path / "a.wav").write_bytes(containers.write_wav(x, 44100))
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxxWAVE")
    rows = {(r.path[-5:], r.channel): r for r in containers.read_wav(spark, str(tmp_path)).collect()}
    assert rows["b.wav", None].error and rows["a.wav", 1].rate == 44100
    assert rows["a.wav", 0].samples == x[:, 0].tolist() and rows["a.wav", 1].samples == x[:, 1].tolist()


def test_steps_code_and_decode(spark):
    assert sum(SHORT_48) == 128 and sum(LONG_48) == 1024
    t = np.arange(128 * 8)
    pcm = spark.createDataFrame(pd.DataFrame({"stream": "s", "n": t, "s": np.round(11000 * np.sin(0.041 * t) + 6000 * np.cos(0.37 * t)).astype(int)}))
    x = pcm.transform(api.frames(128))
    coded = x.transform(api.mdct(128)).transform(api.band_energy(SHORT_48)).transform(api.mask(SHORT_48, 48000)).transform(api.quantise(120))
    assert all(e >= 0 and th > 0 for r in coded.collect() for e, th in zip(r.e, r.t, strict=True))
    back = {r.f: np.array(r.x) for r in coded.transform(api.dequantise(120)).transform(api.imdct(128)).collect()}
    frames = {r.f: np.array(r.x) for r in x.collect()}
    for f in range(1, 8):
        err = back[f] - frames[f - 1]
        assert 10 * np.log10((frames[f - 1] ** 2).sum() / (err**2).sum()) > 20


def test_streams_are_the_same_however_cut(spark, tmp_path):
    x = 40000 * np.sin(0.2 * np.arange(3000)) * np.linspace(0.2, 1, 3000)
    whole, gain, _ = folds.limit(x[:, None], 8000)
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    for k, (a, b) in enumerate([(0, 700), (700, 1500), (1500, 3000)]):
        spark.createDataFrame([("s", k, x[a:b].tolist())], "stream string, n bigint, x array<double>").coalesce(1).write.mode("append").parquet(source)
        blocks = spark.readStream.schema("stream string, n bigint, x array<double>").parquet(source)
        streaming.peak_limiter(blocks, 8000).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(out).orderBy("n").collect()
    assert np.allclose(np.concatenate([r.y for r in rows]), whole[:, 0]) and np.allclose(np.concatenate([r.gain for r in rows]), gain)


def through(spark, tmp_path, name, rows, step):
    """Blocks (n, x) of a stream, two at a time, through a streaming operator."""
    source, out, state = (str(tmp_path / f"{name}-{k}") for k in ("in", "out", "state"))
    schema = "stream string, n bigint, x array<double>"
    for at in range(0, len(rows), 2):
        spark.createDataFrame([("s", n, [float(v) for v in x]) for n, x in rows[at : at + 2]], schema).coalesce(1).write.mode("append").parquet(source)
        step(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out).orderBy("n").collect()


def test_streaming_codes_as_the_batch_does(spark, tmp_path):
    t = np.arange(5 * 1024)
    x = (8000 * np.sin(0.07 * t) + 3000 * np.cos(0.9 * t)).reshape(5, 1024)
    coded = through(spark, tmp_path, "encode", list(enumerate(x)), lambda df: coding.encode(df, 44100))
    payloads = [bytes(int(v) for v in r.payload) for r in coded]
    back = through(spark, tmp_path, "decode", list(enumerate(payloads)), lambda df: coding.decode(df, 44100))
    assert np.concatenate([r.samples for r in back]).tolist() == streams.decode_whole(payloads, 44100)[0].tolist()
    loud = x * 0.01
    loud[3, 700:760] += 20000 * np.cos(2.1 * np.arange(60))
    found = through(spark, tmp_path, "attacks", list(enumerate(loud)), coding.attacks)
    y, _ = folds.highpass().then(loud.reshape(-1))
    assert [int(r.place[0]) for r in found] == folds.attacks(folds.sub_energies(y.reshape(5, 1024)))[1].tolist() and int(found[3].place[0]) == 5


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
