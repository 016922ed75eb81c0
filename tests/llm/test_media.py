import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from profilark.llm import media


def test_digest_round_trip(spark):
    texts = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "é€😀" * 50_000, "same", "same", "\0\n"]
    rows = [(k if k != 3 else None, t, "other") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string").repartition(3)
    got = {r.payload_sha256: r for r in media.media_digest(df).collect()}
    assert media.media_digest(df).count() == len(rows)
    for t in texts:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[hashlib.sha256(full).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(full), zlib.crc32(full[-32:]))
        assert r.media_bytes == 44 + len(full) and r.media_sha256 == hashlib.sha256(media.store(full, 8000)).hexdigest()
        assert bytes(media.load(media.store(full, 8000))[0]) == full
    assert media.media_digest(df.limit(0)).count() == 0


def test_resampling_in_blocks_and_of_a_tone():
    b, x = media.DEFAULT, np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    whole = b.resample(x, 0, 7000)
    assert np.array_equal(whole, np.concatenate([b.resample(x, i, min(333, 7000 - i)) for i in range(0, 7000, 333)]))
    tone = np.sin(np.arange(5000) * 2 * np.pi * 440 / 8000) * 100 + 127.5
    want = np.sin(np.arange(7500) * 2 * np.pi * 440 / 12000) * 100 / 127.5
    assert np.abs(b.resample(tone, 0, 7500) - want)[100:-100].max() < 1e-4


def test_log_mel_against_a_direct_transform():
    b, x = media.DEFAULT, np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    mel = np.concatenate([m for m, _ in b.log_mel(x)])
    y = b.resample(x, 0, 6000)
    for k in (0, 3, len(mel) - 2):
        part = y[k * b.hop : k * b.hop + b.window] * b.taper
        n = np.arange(b.window)
        power = [abs(sum(part * np.exp(-2j * np.pi * f * n / b.fft))) ** 2 for f in range(b.fft // 2 + 1)]
        assert np.allclose(mel[k], np.log(np.array(power) @ b.mel + 1e-6), atol=1e-3)


def test_hysteresis():
    e = np.array([0, 0, 9, 9, 5, 9, 0, 0, 5, 5, 5, 0, 9, 0], float)
    assert media.segments(e, rise=3, fall=-2, least=3).tolist() == [[2, 5]]
    assert len(media.segments(np.zeros(5))) == 0


def test_tiles_are_tensors(spark):
    df = spark.createDataFrame([(1, "tone " * 4000), (2, None)], "doc_id long, text string")
    rows = media.media_tiles(df).toArrow()
    t = media.tensor_table(rows)
    kind = t.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.TILE, media.MELS]
    assert rows.column("media").null_count == len(rows) - 2
    spans = sorted((r["doc_id"], r["from_ms"], r["to_ms"]) for r in rows.select(["doc_id", "from_ms", "to_ms"]).to_pylist())
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]) if a[0] == b[0])


def test_wrong_files():
    with pytest.raises(ValueError):
        media.load(b"not a file at all")
