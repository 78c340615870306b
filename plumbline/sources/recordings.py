"""Recordings: RIFF files to samples, on Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Format codes of whole and of floating-point samples, and of the extended header that holds one of them.
WHOLE, FLOATING, EXTENDED = 1, 3, 0xFFFE


@dataclass
class Recording:
    """``samples`` (frames x channels) from -1 to 1, ``rate`` in frames a second, ``bits`` of a stored sample."""

    samples: np.ndarray
    rate: int
    bits: int


def _parts(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Parts of the file; one of odd length is followed by a byte of padding, and the last one may be cut short."""
    at = 12
    while at + 8 <= len(content):
        kind, size = struct.unpack("<4sI", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def read_wav(content: bytes) -> Recording:
    """Decode a RIFF WAVE file: 8, 16, 24 and 32 bits whole or 32 and 64 bits floating, any number of channels.

    Frames that are cut short at the end are left out. Other files raise ValueError.
    """
    content = bytes(content)
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    form, data = None, None
    for kind, body in _parts(content):
        if kind == b"fmt ":
            code, channels, rate, _, block, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENDED and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            form = (code, channels, rate, block, bits)
        elif kind == b"data" and data is None:
            data = body
    if form is None or data is None:
        raise ValueError("a RIFF file lacks its format or its data")
    code, channels, rate, block, bits = form
    if not channels or block != channels * ((bits + 7) // 8):
        raise ValueError("a RIFF file has a header that isn't valid")
    data = data[: len(data) // block * block]
    if code == FLOATING and bits in (32, 64):
        flat = np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    elif code == WHOLE and bits == 8:  # the only unsigned size
        flat = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif code == WHOLE and bits in (16, 32):
        flat = np.frombuffer(data, f"<i{bits // 8}").astype(np.float64) / 2.0 ** (bits - 1)
    elif code == WHOLE and bits == 24:
        three = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / 2.0**23
    else:
        raise ValueError(f"samples of {bits} bits in format {code} aren't supported")
    return Recording(flat.reshape(-1, channels), rate, bits)


def recording_rows(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``samples`` (array of channels of numbers), ``rate`` and ``bits`` in place of ``content``; null stays null."""
    own = [c for c in df.columns if c not in (content, "samples", "rate", "bits")]
    d = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{content}`").alias("_content"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "_content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(len(f)):  # one recording a batch
                one = f.iloc[k : k + 1]
                raw = one["_content"].iloc[0]
                got = None if raw is None else read_wav(raw)
                new = {"samples": [None if got is None else list(got.samples.T)], "rate": [None if got is None else got.rate], "bits": [None if got is None else got.bits]}
                yield pd.concat([one.drop(columns="_content").reset_index(drop=True), pd.DataFrame(new, dtype=object)], axis=1)

    return d.mapInPandas(work, (fields + ", " if fields else "") + "samples array<array<double>>, rate int, bits int")
