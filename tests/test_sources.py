"""Ranged arrays against numpy, PNG files against an encoder of all filters, recordings, draws without excluded records."""

import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.metrics import segmentation_metrics
from plumbline.sources import arrays as A
from plumbline.sources import files, pictures, recordings


def rows_of(df):
    return {(r.path.rsplit("/", 1)[-1], r.pos): list(r["values"]) for r in df.collect()}


# ---------------------------------------------------------------- arrays


@pytest.mark.parametrize("dtype", ["u1", "<i2", ">i4", "<i8", "<f4", ">f8", "?"])
def test_npy_equals_numpy(spark, tmp_path, dtype):
    a = (np.arange(500 * 6).reshape(500, 2, 3) % 251).astype(dtype)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "flat.npy", a[:, 0, 0])
    np.save(tmp_path / "none.npy", a[:0])
    got = A.array_rows(spark, str(tmp_path), pattern="*.npy", partition_bytes=300)
    assert got.rdd.getNumPartitions() > 10
    found = rows_of(got)
    assert len(found) == 1000
    assert all(found["a.npy", k] == a[k].ravel().astype(float).tolist() and found["flat.npy", k] == [float(a[k, 0, 0])] for k in range(500))


def test_types_and_columns(spark, tmp_path):
    a = np.arange(120, dtype=np.uint8).reshape(10, 12)
    np.save(tmp_path / "a.npy", a)
    path = str(tmp_path / "a.npy")
    raw = A.array_rows(spark, path, schema="pos long, values binary")
    assert {r.pos: bytes(r["values"]) for r in raw.collect()} == {k: a[k].tobytes() for k in range(10)}
    whole = A.array_rows(spark, path, schema="values array<int>, pos int", first=3, end=5)
    assert whole.schema["values"].dataType.simpleString() == "array<int>"
    assert sorted((r.pos, r["values"]) for r in whole.collect()) == [(3, a[3].tolist()), (4, a[4].tolist())]
    for bad, kwargs in ((np.asfortranarray(a), {}), (np.array([{}]), {}), (np.array(3), {})):
        np.save(tmp_path / "bad.npy", bad, allow_pickle=True)
        with pytest.raises(Exception, match="can't be read|no rows|Object arrays"):
            A.array_rows(spark, str(tmp_path / "bad.npy"), **kwargs).count()
    with pytest.raises(ValueError):
        A.array_rows(spark, path, kind="tar")
    (tmp_path / "short.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-5])
    with pytest.raises(Exception, match="ends before"):
        A.array_rows(spark, str(tmp_path / "short.npy")).collect()


def test_three_gigabytes(spark, tmp_path):
    """A file of 3 GB in many tasks: positions need its header only, and a range of rows only its own bytes."""
    path, n = tmp_path / "big.npy", 1_000_000
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "|u1", "fortran_order": False, "shape": (n, 32, 32, 3)})
        begin = f.tell()
        f.seek(begin + (n - 1) * 3072)
        f.write(bytes([7]) * 3072)
    assert path.stat().st_size > 3e9
    positions = A.array_rows(spark, str(path), schema="pos long")
    assert positions.rdd.getNumPartitions() == -(-n // ((64 << 20) // 3072))
    assert positions.agg(F.count("*"), F.max("pos")).first() == (n, n - 1)
    last = A.array_rows(spark, str(path), schema="pos long, values array<int>", first=n - 2).collect()
    assert [sum(r["values"]) for r in sorted(last, key=lambda r: r.pos)] == [0, 7 * 3072]


def test_archives_idx_and_records(spark, tmp_path):
    a, b = np.arange(60, dtype="<f4").reshape(20, 3), np.arange(20, dtype="<i2")
    np.savez(tmp_path / "plain.npz", x=a, arr_0=b)
    np.savez_compressed(tmp_path / "packed.npz", x=a, arr_0=b)
    for name, parts in (("plain.npz", 20), ("packed.npz", 1)):
        got = A.array_rows(spark, str(tmp_path / name), kind="npz", member="x", partition_bytes=12)
        assert got.rdd.getNumPartitions() == parts and [v for _, v in sorted(rows_of(got).items())] == a.tolist()
        assert sorted(rows_of(A.array_rows(spark, str(tmp_path / name), kind="npz", first=4, end=6)).values()) == [[4.0], [5.0]]
    c = np.arange(24, dtype=">i4").reshape(4, 2, 3)
    (tmp_path / "c.idx").write_bytes(struct.pack(">HBB3I", 0, 0x0C, 3, 4, 2, 3) + c.tobytes())
    assert [v for _, v in sorted(rows_of(A.array_rows(spark, str(tmp_path / "c.idx"), kind="idx")).items())] == c.reshape(4, 6).tolist()
    (tmp_path / "r.bin").write_bytes(b"head" + bytes(range(25)))
    got = A.array_rows(spark, str(tmp_path / "r.bin"), kind="records", header=4, record=6, partition_bytes=6, schema="pos long, values binary")
    assert {r.pos: bytes(r["values"]) for r in got.collect()} == {k: bytes(range(6 * k, 6 * k + 6)) for k in range(4)}
    with pytest.raises(FileNotFoundError):
        A.listed([str(tmp_path / "nothing")], "*")


def test_corruptions_and_digits_by_ranges(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (40, 4, 4, 3), np.uint8)
    for name in ("fog", "snow"):
        np.save(tmp_path / f"{name}.npy", a)
    np.save(tmp_path / "labels.npy", np.arange(40) % 10)
    got = files.corrupted_arrays(spark, str(tmp_path), subsets=("fog", "snow"))
    assert {(r.subset, r.pos): (list(r["values"]), r.label) for r in got.collect()} == {(s, k): (a[k].ravel().tolist(), k % 10) for s in ("fog", "snow") for k in range(40)}


def test_draws_leave_out_excluded_records(spark, tmp_path):
    n, taken = 1000, np.r_[0, 5, 6, 7, 999, np.arange(200, 300)]
    (tmp_path / "tiny.bin").write_bytes(b"".join(struct.pack("<I", k) for k in range(n)))
    (tmp_path / "known.txt").write_text("\n".join(str(k + 1) for k in [*taken, 5000]) + "\n")
    read = lambda **k: files.tiny_images(spark, str(tmp_path / "tiny.bin"), excluded=str(tmp_path / "known.txt"), size=4, **k)
    every = read(draws=-1).collect()
    assert sorted(r.pos for r in every) == sorted(set(range(n)) - set(taken.tolist()))
    assert all(struct.unpack("<I", r.content)[0] == r.pos and r.label == -1 for r in every)
    some = [r.pos for r in read(draws=50, seed=3).collect()]
    assert len(set(some)) == 50 and some != sorted(some) and not set(some) & set(taken.tolist())
    assert {r.pos for r in read(draws=50, seed=3, partition_bytes=20).collect()} == set(some) != {r.pos for r in read(draws=50, seed=4).collect()}
    for m in (1, 2, 3, 17, 1000, 4097):
        assert sorted(A.permuted(np.arange(m), m, 9)) == list(range(m))


# ---------------------------------------------------------------- pictures


def filtered(raw, kinds, unit):
    """The five filters, by their definition, a byte at a time."""
    out = b""
    for y, row in enumerate(raw):
        line = []
        for x in range(len(row)):
            a = int(row[x - unit]) if x >= unit else 0
            b = int(raw[y - 1][x]) if y else 0
            c = int(raw[y - 1][x - unit]) if y and x >= unit else 0
            p = a + b - c
            near = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            line.append((int(row[x]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) & 255)
        out += bytes([kinds[y], *line])
    return out


def png(pixels, depth=8, colour=2, palette=None, kinds=None, interlaced=False, extra=b""):
    height, width, channels = pixels.shape

    def packed(p):
        if depth == 16:
            return p.astype(">u2").reshape(len(p), -1).view(np.uint8)
        if depth == 8:
            return p.astype(np.uint8).reshape(len(p), -1)
        bits = np.unpackbits(p.astype(np.uint8).reshape(*p.shape[:2], 1), axis=2)[:, :, 8 - depth :]
        return np.packbits(bits.reshape(len(p), -1), axis=1)

    data = b""
    for x, y, dx, dy in pictures.ADAM7 if interlaced else ((0, 0, 1, 1),):
        part = pixels[y::dy, x::dx]
        if part.size:
            which = [k % 5 for k in range(len(part))] if kinds is None else [kinds] * len(part)
            data += filtered(packed(part), which, max(1, channels * depth // 8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    z = zlib.compress(data)
    out = pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced)))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + extra + chunk(b"IDAT", z[: len(z) // 2]) + chunk(b"IDAT", z[len(z) // 2 :]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("depth, colour", [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (1, 3), (2, 3), (4, 3), (8, 3), (8, 4), (16, 4), (8, 6), (16, 6)])
def test_every_kind_of_png(depth, colour, interlaced):
    r = np.random.default_rng(depth * 10 + colour)
    for height, width in ((1, 1), (3, 2), (13, 9), (17, 21)):
        pixels = r.integers(0, 1 << depth, (height, width, pictures.CHANNELS[colour]))
        palette = r.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
        got = pictures.read_png(png(pixels, depth, colour, palette, interlaced=interlaced))
        assert (got.pixels == pixels).all() and got.colours().shape == (height, width, 3)
        if palette is not None:
            assert (got.colours() == palette[pixels[:, :, 0]]).all()


@pytest.mark.parametrize("kinds", range(5))
def test_every_filter(kinds):
    pixels = np.random.default_rng(kinds).integers(0, 256, (23, 31, 3))
    assert (pictures.read_png(png(pixels, kinds=kinds)).pixels == pixels).all()


def test_damaged_files():
    whole = png(np.zeros((4, 4, 3), int))
    for bad in (b"", b"GIF89a", whole[:-20], whole[:40], whole.replace(b"IDAT", b"IDAX"), whole[:20] + b"\xff" * 4 + whole[24:]):
        with pytest.raises(ValueError):
            pictures.read_png(bad)


def test_masked_pictures_feed_segmentation_metrics(spark, tmp_path):
    """Small trees of each masked set to labelled pixels, against the same in numpy."""
    r = np.random.default_rng(1)
    put = lambda path, data: (path.parent.mkdir(parents=True, exist_ok=True), path.write_bytes(data))
    masks, images = {}, {}
    for k in range(3):
        image, mask = r.integers(0, 256, (6, 5, 3)), r.integers(1, 18, (6, 5, 1))
        put(tmp_path / f"sh/test/images/t5/{k}.png", png(image))
        put(tmp_path / f"sh/test/annotations/t5/{k}.png", png(mask, colour=0))
        masks[f"{k}.png"], images[f"{k}.png"] = mask[:, :, 0], image
    rows = pictures.street_hazards_rows(files.street_hazards(spark, str(tmp_path / "sh"), "test"))
    labels = pictures.pixel_labels(rows)
    got = {(p.image_id.rsplit("/", 1)[-1], p.px): p.label for p in labels.collect()}
    want = {(name, k): (-1 if c >= 14 else c - 1) for name, m in masks.items() for k, c in enumerate(m.ravel().tolist())}
    assert got == want
    vectors = {(p.image_id.rsplit("/", 1)[-1], p.px): p.features for p in pictures.pixel_vectors(rows).collect()}
    assert vectors == {(name, k): [float(c) for c in v] for name, i in images.items() for k, v in enumerate(i.reshape(-1, 3).tolist())}
    scored = labels.withColumn("score", F.when(F.col("label") < 0, 1.0).otherwise(0.0) + F.col("px") * 1e-6)
    assert segmentation_metrics(scored).first()["AUROC"] == 1.0

    overlay = np.where(r.random((6, 5, 1)) < 0.3, r.integers(-60, 60, (6, 5, 3)), 0)
    void, street = r.integers(0, 2, (6, 5, 1)), r.integers(0, 256, (6, 5, 3))
    (tmp_path / "fs").mkdir()
    np.savez(tmp_path / "fs/0000_city_1_2_rgb.npz", rgb=overlay)
    put(tmp_path / "fs/0000_city_1_2_labels.png", png(void, depth=1, colour=0))
    put(tmp_path / "cs/city/city_1_2_leftImg8bit.png", png(street))
    got = pictures.fishyscapes_rows(files.fishyscapes(spark, str(tmp_path / "fs"), str(tmp_path / "cs"))).orderBy("y").collect()
    assert [list(g.labels) for g in got] == np.where((overlay != 0).any(2), -1, void[:, :, 0]).tolist()
    assert [list(g.pixels) for g in got] == np.clip(street + overlay, 0, 255).reshape(6, -1).tolist()

    put(tmp_path / "lf/0000_place_a_b_labels.png", png(np.array([[[0], [1], [255]]]), colour=0))
    put(tmp_path / "lfo/place/place_a_b_leftImg8bit.png", png(np.zeros((1, 3, 3), int)))
    got = pictures.lost_and_found_rows(files.lost_and_found(spark, str(tmp_path / "lf"), str(tmp_path / "lfo"))).collect()
    assert len(got) <= 1 and all(list(g.labels) == [0, -1, 1] for g in got)

    for place in ("carpet/test/cut/000.png", "carpet/test/good/001.png"):
        put(tmp_path / "in" / place, png(np.full((2, 2, 1), 9), colour=0))
    put(tmp_path / "in/carpet/ground_truth/cut/000_mask.png", png(np.array([[[0], [255]], [[0], [0]]]), colour=0))
    got = pictures.pixel_labels(pictures.inspection_rows(files.inspection(spark, str(tmp_path / "in"), "test"))).collect()
    assert sorted((g.image_id[-7:], g.px, g.label) for g in got) == [("000.png", k, -1 if k == 1 else 0) for k in range(4)] + [("001.png", k, 0) for k in range(4)]


# ---------------------------------------------------------------- recordings


def test_recordings(spark, tmp_path):
    r = np.random.default_rng(2)
    names = {}
    for bits in (8, 16, 24, 32):
        for channels in (1, 2, 3):
            low, high = (0, 256) if bits == 8 else (-(1 << (bits - 1)), 1 << (bits - 1))
            values = r.integers(low, high, (11, channels))
            name = tmp_path / f"{bits}_{channels}_0.wav"
            with wave.open(str(name), "wb") as w:
                w.setnchannels(channels)
                w.setsampwidth(bits // 8)
                w.setframerate(8000)
                w.writeframes(b"".join(int(v).to_bytes(bits // 8, "little", signed=bits > 8) for v in values.ravel()))
            names[name.name] = ((values - 128) / 128 if bits == 8 else values / 2.0 ** (bits - 1)).T.tolist()
    d = recordings.recording_rows(files.spoken_digits(spark, str(tmp_path)))
    got = {x.path.rsplit("/", 1)[-1]: (x.samples, x.rate, x.bits, x.label) for x in d.collect()}
    assert got == {n: (v, 8000, int(n.split("_")[0]), int(n.split("_")[0])) for n, v in names.items()}
    part = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    form = struct.pack("<HHIIHH", 3, 1, 44100, 176400, 4, 32)
    body = part(b"LIST", b"odd") + part(b"fmt ", form) + part(b"fact", b"12345") + part(b"data", struct.pack("<3f", 0.5, -1, 0.25) + b"\1")
    got = recordings.read_wav(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    assert got.samples.ravel().tolist() == [0.5, -1.0, 0.25] and got.rate == 44100
    for bad in (b"", b"RIFF1234AVI ", b"RIFF1234WAVE" + part(b"fmt ", form), b"RIFF1234WAVE" + part(b"fmt ", form[:-2] + b"\7\0") + part(b"data", b"")):
        with pytest.raises(ValueError):
            recordings.read_wav(bad)
    empty = recordings.recording_rows(spark.createDataFrame([(1, None)], "id long, content binary")).first()
    assert empty.samples is None and empty.rate is None
