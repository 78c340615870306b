"""Masks of polygons and run lengths against brute force, and from annotations to pictures with objects."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import augment
from plumbline.sources import cutouts as C


def compressed(counts):
    """Run lengths in the text form, written from its definition."""
    out = ""
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        more = True
        while more:
            bits, x = x & 31, x >> 5
            more = not ((x == 0 and not bits & 16) or (x == -1 and bits & 16))
            out += chr(48 + bits + (32 if more else 0))
    return out


def test_run_lengths():
    r = np.random.default_rng(0)
    for _ in range(300):
        counts = r.integers(0, r.choice([3, 40, 5000, 10**6]), r.integers(1, 12)).tolist()
        assert C.run_lengths(compressed(counts)) == counts
    for bad in ("o", "5\x07", "~~"):
        with pytest.raises(ValueError):
            C.run_lengths(bad)
    mask = r.random((5, 7)) < 0.4
    flat, counts = mask.T.ravel(), []
    at, value = 0, False
    while at < len(flat):
        end = at
        while end < len(flat) and flat[end] == value:
            end += 1
        counts.append(end - at)
        at, value = end, not value
    assert (C.runs_filled(counts, 5, 7) == mask).all()
    for form in (counts, compressed(counts)):
        assert (C.segment_mask(json.dumps({"size": [5, 7], "counts": form}), 5, 7) == mask).all()
    for size, runs in (([7, 5], counts), ([5, 7], counts[:-1] or [1]), ([5, 7], [40, -5])):
        with pytest.raises(ValueError):
            C.segment_mask(json.dumps({"size": size, "counts": runs}), 5, 7)


def test_scanlines_against_every_pixel():
    r = np.random.default_rng(1)
    for k in range(300):
        h, w, n = r.integers(1, 30, 3)
        points = r.uniform(-4, 30, (n, 2)) if k % 2 else r.integers(-2, 30, (n, 2)) / r.choice([1, 2])
        assert (C.ring_filled(points, h, w) == augment.polygon_mask(points, h, w).astype(bool)).all()


def test_holes_and_parts():
    box = lambda a, b, c, d: [a, b, c, b, c, d, a, d]
    m = C.rings_filled([box(3, 3, 6, 6), box(1, 1, 9, 9), box(4, 4, 5, 5), box(8, 0, 12, 3)], 12, 12)
    want = np.zeros((12, 12), bool)
    want[1:9, 1:9] = True
    want[3:6, 3:6] = False
    want[4, 4] = True
    want[0:3, 8:12] = True
    assert (m == want).all()
    with pytest.raises(ValueError):
        C.rings_filled([[1, 2, 3]], 4, 4)


def test_from_annotations_to_pictures(spark, tmp_path):
    from .test_sources import png

    r = np.random.default_rng(2)
    shapes = {1: (9, 8), 2: (6, 11), 3: (7, 7)}
    images = {k: r.integers(1, 256, (h, w, 3)) for k, (h, w) in shapes.items()}
    notes = {
        "images": [{"id": k, "height": h, "width": w} for k, (h, w) in shapes.items()],
        "annotations": [
            {"id": 10, "image_id": 1, "category_id": 5, "area": 9.0, "iscrowd": 0, "segmentation": [[1, 1, 4, 1, 4, 4, 1, 4]]},
            {"id": 11, "image_id": 1, "category_id": 6, "area": 1.0, "iscrowd": 0, "segmentation": [[6, 6, 7, 6, 7, 7, 6, 7]]},
            {"id": 12, "image_id": 2, "category_id": 5, "area": 6.0, "iscrowd": 1, "segmentation": {"size": [6, 11], "counts": compressed([6, 6, 54])}},
            {"id": 13, "image_id": 3, "category_id": 9, "area": 6.0, "iscrowd": 0, "segmentation": [[0, 0, 7, 0, 7, 7, 0, 7]]},
        ],
        "categories": [{"id": 5, "name": "cat", "supercategory": "animal"}],
    }
    (tmp_path / "notes.json").write_text(json.dumps(notes))
    found = augment.Annotations.read(spark, str(tmp_path / "notes.json"))
    files = spark.createDataFrame([(k, bytearray(png(v))) for k, v in images.items()] + [(4, None)], "image_id long, content binary")
    pictures = C.png_pictures(files, "image_id")
    cuts = {c.image_id: c for c in C.cut_outs(found, pictures, most=1).collect()}
    assert {k: (c.height, c.width) for k, c in cuts.items()} == {1: (3, 3), 2: (6, 1), 3: (7, 7)}
    assert cuts[1].pixels == images[1][1:4, 1:4].transpose(2, 0, 1).ravel().tolist() and set(cuts[1].mask) == {1}
    both = {c.image_id: c for c in C.cut_outs(found, pictures, most=2).collect()}
    assert (both[1].height, both[1].width, sum(both[1].mask)) == (6, 6, 10)

    blank = [(i, 20, 24, [0] * (3 * 480), [7] * 480, "x") for i in range(60)]
    df = spark.createDataFrame(blank, "id long, height int, width int, pixels array<int>, mask array<int>, object string")
    how = dict(without=[9], probability=0.5, n=2, seed=4)
    out = {r.id: r for r in C.insert_annotated(df, found, pictures, **how).collect()}
    again = {r.id: r for r in C.insert_annotated(df.repartition(7), found, pictures.repartition(2), **how).collect()}
    assert {k: (v.pixels, v.mask) for k, v in out.items()} == {k: (v.pixels, v.mask) for k, v in again.items()}
    changed = [v for v in out.values() if -1 in v.mask]
    assert 15 < len(changed) < 45 and all(v.object == "x" for v in out.values())
    known = {tuple(p) for k in (1, 2) for p in images[k].reshape(-1, 3).tolist()}
    for v in out.values():
        p, m = np.array(v.pixels).reshape(3, 480).T, np.array(v.mask)
        assert ((p.sum(1) > 0) == (m == -1)).all() and {tuple(x) for x in p[m == -1].tolist()} <= known
    none = C.insert_objects(df, C.cut_outs(found, pictures.where("image_id > 9")), probability=1.0).select(F.array_min("mask")).distinct().collect()
    assert [r[0] for r in none] == [7]
