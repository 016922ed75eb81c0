import hashlib
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from profilark.llm import media


def test_stored_tensors_are_read_back_with_spans(spark):
    texts = [None, "", "short", "some words of sound " * 3000, "some words of sound " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in media.media_columns(df).collect()}
    digest = {r.doc_id: r for r in media.media_digest(df).collect()}
    ms = 10
    for k, text in enumerate(texts):
        r = rows[k]
        full = media.pad((text or "").encode())
        assert bytes(media.load(bytes(r.media))[0]) == full and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        blocks = [media.load_tiles(bytes(b)) for b in r.tensors]
        kind = blocks[0].schema.field("tensor").type
        assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.TILE, media.MELS]
        values = np.concatenate([b.column(0).to_numpy_ndarray() for b in blocks])
        want = np.concatenate([m for m, _ in media.DEFAULT.log_mel(np.frombuffer(full, np.uint8))])
        assert np.array_equal(values.reshape(-1, media.MELS)[: len(want)], want)
        spans = [(s.from_ms, s.to_ms) for s in r.spans]
        assert spans == [(a, b) for x in blocks for a, b in zip(x.column(1).to_pylist(), x.column(2).to_pylist())]
        assert spans[0][0] == 0 and spans[-1][1] == len(want) * ms and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        energy = np.concatenate([e for _, e in media.DEFAULT.log_mel(np.frombuffer(full, np.uint8))])
        on = np.zeros(len(energy), bool)
        for a, b in media.segments(energy):
            on[a : b + 1] = True
        assert [s.active_ms for s in r.spans] == [int(on[a // ms : b // ms].sum()) * ms for a, b in spans]
        assert hashlib.sha256(b"".join(bytes(b) for b in r.tensors)).hexdigest() == r.tensor_sha256
        assert all(digest[k][c] == r[c] for c in digest[k].asDict())
    assert rows[3].feature == rows[4].feature and rows[3].tensor_sha256 == rows[4].tensor_sha256


def test_tiles_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(1, "tone " * 9000)], "doc_id long, text string")
    row = media.media_columns(df).first()
    tiles = media.media_tiles(df).orderBy("tile").collect()
    assert [(t.from_ms, t.to_ms, t.active_ms) for t in tiles] == [tuple(s) for s in row.spans]
    values = np.concatenate([media.load_tiles(bytes(b)).column(0).to_numpy_ndarray() for b in row.tensors])
    assert np.array_equal(np.array([t.tensor for t in tiles], np.float32).reshape(values.shape), values)


def test_features_do_not_depend_on_threads_or_block():
    """Workers run with one thread, drivers with many; a frame has the same bits whatever stands beside it."""
    code = """
import hashlib, numpy as np
from profilark.llm import media
text = np.frombuffer(media.pad(b"some words of sound " * 3000), np.uint8)
blocks, x = media.features(text)
print(hashlib.sha256(b"".join(bytes(b) for b in blocks)).hexdigest(), x["sha"])
"""
    root, got = str(Path(__file__).resolve().parents[2]), set()
    for kernel in (None, "Haswell"):
        for threads in "1", "4", "8":
            env = {**os.environ, "OMP_NUM_THREADS": threads, "PYTHONPATH": root} | ({"OPENBLAS_CORETYPE": kernel} if kernel else {})
            got.add(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout)
    assert len(got) == 1
    power = np.random.default_rng(4).random((755, media.DEFAULT.fft // 2 + 1), np.float32)
    whole = media.DEFAULT.to_bands(power)
    assert np.allclose(whole, power.astype(float) @ media.DEFAULT.mel, rtol=1e-5)
    for n in 1, 7, 16, 64, 200:
        assert np.array_equal(media.DEFAULT.to_bands(power[:n]), whole[:n])
