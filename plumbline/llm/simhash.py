"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code and are compared there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import discard, materialize, small
from .components import connected_components

#: The covering code: 64 bits as a direct sum of perfect cyclic codes, (length, generator polynomial, covering radius):
#: two binary Golay codes, the Hamming code of length 15 and the repetition code of length 3. Its covering radius is
#: 3 + 3 + 1 + 1 = 8 and it has 2^(12+12+11+1) = 2^36 codewords.
CODE = ((23, 0xC75, 3), (23, 0xC75, 3), (15, 0x13, 1), (3, 0x7, 1))
#: An anchor with more fingerprints than this is split further before it is compared.
HOT_ANCHOR = 20_000
#: Group sizes up to which all pairs of an anchor are compared; beyond it, neighbours are looked up by their bits.
PAIRWISE = 2_048
_BLOCKS: list = []


# ---------------------------------------------------------------- fingerprints


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes, so A-Z and ASCII white space only


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint as a signed 64-bit number: a bit is 1 if set in over half of the hashes; of no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_udf(size: int):
    @pandas_udf("bigint")
    def fingerprint(text: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, size)) for t in text], dtype="int64")

    return fingerprint


# ---------------------------------------------------------------- anchors


def _blocks() -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shift, length, syndrome of each bit, coset leader of each syndrome) of each block of the code."""
    out, shift = _BLOCKS, 0
    if out:
        return out
    for n, poly, radius in CODE:
        deg = poly.bit_length() - 1
        rem = []
        for i in range(n):
            v = 1 << i
            for j in range(n - 1, deg - 1, -1):
                if v >> j & 1:
                    v ^= poly << (j - deg)
            rem.append(v)
        leader = np.zeros(1 << deg, np.uint64)
        for w in range(1, radius + 1):
            for bits in combinations(range(n), w):
                s = 0
                for i in bits:
                    s ^= rem[i]
                leader[s] = sum(1 << i for i in bits)
        out.append((shift, n, np.array(rem, np.int64), leader))
        shift += n
    return out


def anchors_of(prints: np.ndarray, flips: int) -> np.ndarray:
    """(n, m) anchors: of each fingerprint and, if ``flips`` is 1, of each of its 64 neighbours at one bit.

    Two fingerprints at distance 2 or less have a point between them that is within one bit of both, and that point's
    nearest anchor is in both rows. So anchors up to covering radius + threshold / 2 suffice when both sides replicate.
    """
    prints = prints.astype(np.uint64)
    home = np.zeros(len(prints), np.uint64)
    parts = []
    for shift, n, rem, leader in _blocks():
        word = prints >> np.uint64(shift) & np.uint64((1 << n) - 1)
        syn = np.zeros(len(prints), np.int64)
        for i in range(n):
            syn ^= np.where(word >> np.uint64(i) & np.uint64(1), rem[i], 0)
        near = word ^ leader[syn]
        home |= near << np.uint64(shift)
        parts.append((shift, n, rem, leader, word, syn, near))
    columns = [home]
    if flips:
        for shift, n, rem, leader, word, syn, near in parts:
            for i in range(n):
                other = word ^ np.uint64(1 << i) ^ leader[syn ^ rem[i]]
                columns.append(home ^ (near ^ other) << np.uint64(shift))
    return np.stack(columns, axis=1)


def _replicated(flips: int):
    def replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = frame["fp"].to_numpy(np.int64)
            for at in range(0, len(prints), 4096):
                some = prints[at : at + 4096]
                a = np.sort(anchors_of(some, flips), axis=1)
                first = np.ones(a.shape, bool)
                first[:, 1:] = a[:, 1:] != a[:, :-1]
                yield pd.DataFrame({"anchor": a[first].view(np.int64), "fp": np.repeat(some, first.sum(1))})

    return replicate


def _links_within(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one anchor's distinct fingerprints: each with the first of its local group."""
    k = len(prints)
    u = np.sort(prints.view(np.uint64))
    left, right = [], []
    if k <= PAIRWISE:
        for at in range(0, k, 512):
            i, j = np.nonzero(np.bitwise_count(u[at : at + 512, None] ^ u[None, :]) <= threshold)
            left.append(i + at)
            right.append(j)
    else:
        for w in range(1, threshold + 1):
            for bits in combinations(range(64), w):
                other = u ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(u, other), k - 1)
                hit = np.flatnonzero(u[at] == other)
                left.append(hit)
                right.append(at[hit])
    a, b = np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)
    label = np.arange(k)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(k))
    return u[label[member]].view(np.int64), u[member].view(np.int64)


def _compared(threshold: int):
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; a bucket that runs over the end of a batch is held back."""
        kept: pd.DataFrame | None = None

        def linked(frame: pd.DataFrame) -> pd.DataFrame:
            a, s, f = (frame[c].to_numpy(np.int64) for c in ("anchor", "sub", "fp"))
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
            stop = np.r_[at[1:], len(a)]
            found = [_links_within(f[x:y], threshold) for x, y in zip(at, stop) if y - x > 1]
            return pd.DataFrame({"src": np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64), "dst": np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)})

        for frame in frames:
            if kept is not None:
                frame = pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame["anchor"] == frame["anchor"].iloc[-1]) & (frame["sub"] == frame["sub"].iloc[-1])
            kept = frame[last]
            yield linked(frame[~last])
        if kept is not None:
            yield linked(kept)

    return compare


def fingerprint_links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) to links (src, dst) whose transitive closure is that of all pairs within ``threshold``.

    Each fingerprint goes to its anchors and is compared only with those at the same anchor. Anchors with more than
    HOT_ANCHOR fingerprints are split exactly: two fingerprints that differ in 2 bits agree in two of their four 16-bit
    words, so the split replicates by the 6 pairs of words. Within a bucket only spanning links are returned.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")
    spread = materialize(prints.select("fp").mapInPandas(_replicated(1 if threshold else 0), "anchor bigint, fp bigint"), "anchors")
    hot = materialize(spread.groupBy("anchor").count().where(F.col("count") > HOT_ANCHOR).select("anchor"), "hot")
    cold = spread.withColumn("sub", F.lit(0).cast("bigint"))
    if not hot.isEmpty():
        hot = small(hot)
        word = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
        subs = [F.lit(1 + i << 32).cast("bigint") + F.shiftleft(word[a], 16) + word[b] for i, (a, b) in enumerate(combinations(range(4), 2))]
        split = spread.join(hot, "anchor", "left_semi").withColumn("sub", F.explode(F.array(*subs)))
        cold = cold.join(hot, "anchor", "left_anti").unionByName(split)
    dealt = cold.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub")
    return dealt.mapInPandas(_compared(threshold), "src bigint, dst bigint")


def simhash_components(docs: DataFrame, *, shingle: int = 3, threshold: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that is reachable).

    * null or empty text, or white space only: fingerprint zero, linked like any other;
    * fewer words than a shingle: the whole sequence is the only shingle; very long texts are hashed whole;
    * equal fingerprints (copies, repeated rows) are folded to one before anything is compared;
    * null doc_id: linked like others but never a component_id, unless a component has no other (then null);
    * empty table: no rows; other columns of the input are not read.
    """
    marked = materialize(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")), "fingerprints", texts=True)
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    links = fingerprint_links(prints, threshold)
    groups = connected_components(links)
    joined = materialize(prints.join(small(groups), F.col("fp") == F.col("node"), "left").where("n > 1 OR node IS NOT NULL").select("fp", "low", F.coalesce("component", "fp").alias("root")), "joined")
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(joined.join(small(lows), "root").select(F.col("fp").alias("print"), "component_id"), "named")
    out = marked.join(small(named), F.col("fp") == F.col("print"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# ---------------------------------------------------------------- near-duplicates by similarity

#: Views of a document: its shingles are dealt to VIEWS classes by their hash, and the VIEW_SIZE smallest of a class
#: make the view's SimHash. At a Jaccard similarity of 0.8 a view of two is unchanged in about 64 % of pairs, so
#: 1 - 0.36^8 = 99.97 % of such pairs meet in some view. SKETCH smallest hashes of all estimate the similarity.
VIEWS, VIEW_SIZE, SKETCH = 8, 2, 128
#: The sketch alone rejects or accepts a pair only where a pair right at the bar has smaller odds than this to get there;
#: the pairs between are decided on their whole sets.
RISK = 1e-6
#: Rows of a block, of which two are compared at a time. Buckets of more rows are split by the sketches' rarest hashes.
BLOCK = 256
#: Blocks of this many times as many rows meet in pairs, so that a row of a large group is sent to few of them.
WIDE = 4
#: Counters of the hashes of large buckets' sketches, by a hash's low bits: at most 16 MB that pass the driver.
COUNTERS = 1 << 20
#: Bytes of whole sets that count as one row of a block, so that the held side of whole sets has about 16 MB.
SET_BYTES = 16 << 10
#: Shares of the undecided pairs that are decided in one go; the last one is all that are still in different components.
ROUNDS = (1 / 16, 1.0)
_PROFILE = "fp bigint, views array<bigint>, sketch binary, digest bigint, other bigint"


def text_digests(text: str | None) -> tuple[int, int]:
    """Two independent 64-bit digests of a text's words, as signed numbers."""
    joined = b" ".join(words_of(text))
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(joined, seed)).view(np.int64)) for seed in (7, 11))


def _profiles(shingle: int):
    @pandas_udf(_PROFILE)
    def profile(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            hashes = shingle_hashes(t, shingle)
            distinct = np.unique(hashes)
            kind = (distinct & np.uint64(VIEWS - 1)).astype(np.int64)
            views = []
            for v in range(VIEWS):
                own = distinct[kind == v][:VIEW_SIZE]
                views.append(majority(own) if len(own) else None)
            sketch = (distinct[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()
            rows.append((majority(hashes), views, sketch, *text_digests(t)))
        return pd.DataFrame(rows, columns=["fp", "views", "sketch", "digest", "other"])

    return profile


def sketch_similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets: exact if both sketches are whole, else from the smallest of the union."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        union = union[:SKETCH]
    return float(np.isin(union, np.intersect1d(x, y)).mean()) if len(union) else 1.0


@cache
def sketch_bounds(similarity: float) -> tuple[int, int]:
    """Common hashes of SKETCH below which a pair is surely under the bar, and from which it is surely above (see RISK)."""
    law = np.cumsum([comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k) for k in range(SKETCH + 1)])
    tail = np.cumsum([comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k) for k in range(SKETCH, -1, -1)])
    return int((law <= RISK).sum()), SKETCH + 1 - int((tail <= RISK).sum())


def sketch_verdict(a: bytes, b: bytes, similarity: float) -> int:
    """1: similar, 0: not, -1: too near the bar for sketches to tell. Two whole sketches always tell."""
    found = sketch_similarity(a, b)
    if len(a) < 4 * SKETCH and len(b) < 4 * SKETCH:
        return int(found >= similarity)
    low, high = sketch_bounds(similarity)
    common = round(found * SKETCH)
    return 0 if common < low else 1 if common >= high else -1


def _verdict(similarity: float):
    @pandas_udf("int")
    def verdict(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sketch_verdict(x, y, similarity) for x, y in zip(a, b)], dtype="int32")

    return verdict


def _whole_set(shingle: int):
    @pandas_udf("binary")
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).tobytes() for t in text])

    return whole


def prefix_size(size: int, similarity: float) -> int:
    """How many of a sketch's ``size`` hashes, in any one order for all, hold at least one that a similar text's have too.

    Similar sketches have at least ``similarity`` of a whole one's hashes in common, or the lower bound of
    :func:`sketch_bounds` if one of the two isn't whole; all but one less than that may be left out.
    """
    common = sketch_bounds(similarity)[0] if size == SKETCH else min(ceil(similarity * size), max(1, sketch_bounds(similarity)[0]))
    return size - min(size, common) + 1 if size else 0


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(slot, n): how many hashes of a task's sketches fall on each counter that has any."""
    total = np.zeros(COUNTERS, np.int64)
    for f in frames:
        total += np.bincount(np.frombuffer(b"".join(f["sketch"]), "<u4") & (COUNTERS - 1), minlength=COUNTERS)
    slot = np.flatnonzero(total)
    yield pd.DataFrame({"slot": slot, "n": total[slot]})


def _counters(wide: DataFrame) -> np.ndarray:
    """Counters of the hashes of all sketches; 1 stands for at most one, so that hash is in no other sketch."""
    sums = wide.select("sketch").mapInPandas(_counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.ones(COUNTERS, np.int64)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return out


def _prefixes(similarity: float, counters):
    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds each sketch's prefix, by counter and hash, as ``heads`` and packed; hashes that no other sketch has are left out."""
        for f in frames:
            heads = []
            for x in f["sketch"]:
                own = np.frombuffer(x, "<u4")
                times = counters.value[own & (COUNTERS - 1)]
                first = np.lexsort((own, times))[: prefix_size(len(own), similarity)]
                heads.append(own[first[times[first] > 1]])
            yield f.assign(heads=[h.astype(np.int64) for h in heads], prefix=[h.tobytes() for h in heads])

    return prefixes


def _coded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, codes, sizes): distinct hashes, and each sketch as a row of positions among them, padded with -1."""
    sizes = np.array([len(s) // 4 for s in sketches], np.int64)
    values, inverse = np.unique(np.frombuffer(b"".join(sketches), "<u4"), return_inverse=True)
    codes = np.full((len(sketches), max(1, sizes.max(initial=0))), -1, np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = inverse
    return values, codes, sizes


def _verdicts(x: int, other: np.ndarray, codes: np.ndarray, sizes: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """:func:`sketch_verdict` of row x with each of the others; ``place`` is being used for x and left as it was.

    A hash that both have, at positions i and j, is the (i + j - r)th of the union, if it is the r-th that both have.
    """
    own = codes[x, : sizes[x]]
    place[own] = np.arange(1, sizes[x] + 1)
    i = place[codes[other]]
    place[own] = 0
    both = i > 0
    common = both.sum(1)
    union = sizes[x] + sizes[other] - common
    cut = (sizes[other] == SKETCH) | (sizes[x] == SKETCH)
    seen = np.where(cut, np.minimum(SKETCH, union), union)
    low, high = sketch_bounds(similarity)
    out = np.zeros(len(other), np.int64)
    near = np.flatnonzero(common >= np.where(cut, low, similarity * union))
    i, both, seen = i[near], both[near], seen[near]
    rank = i + np.arange(1, i.shape[1] + 1) - np.cumsum(both, axis=1)
    found = (both & (rank <= seen[:, None])).sum(1) / np.maximum(seen, 1)
    found = np.where(seen == 0, 1.0, found)
    rough = np.rint(found * SKETCH)
    out[near] = np.where(~cut[near], found >= similarity, np.where(rough < low, 0, np.where(rough >= high, 1, -1)))
    return out


def _joined_in_block(label: np.ndarray, first: np.ndarray, sketches: list[bytes], similarity: float, prefixes: list[bytes] | None = None, shared: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links (label, label) between the components of a block's rows: rows marked ``first`` against all the others.

    Rows of components that are joined already aren't compared. Rows that met by the hash ``shared`` of their ``prefixes``
    are compared only if it is the first that both have, so each pair is compared once, wherever else it meets. The second
    result are the pairs (row, row) that the sketches can't decide, but for those whose components are joined in the end.
    """
    values, codes, sizes = _coded(sketches)
    place = np.zeros(len(values) + 1, np.int64)  # the last entry stands for padding and stays 0
    if prefixes is not None:
        lengths = np.array([len(p) // 4 for p in prefixes])
        heads = np.full((len(prefixes), max(1, lengths.max(initial=0))), -1, np.int64)
        heads[np.arange(heads.shape[1]) < lengths[:, None]] = np.searchsorted(values, np.frombuffer(b"".join(prefixes), "<u4"))
        mark, wanted = np.zeros(len(values) + 1, bool), np.searchsorted(values, shared)
    now, found, undecided = label.copy(), [], []
    for x in np.flatnonzero(first):
        other = np.flatnonzero(now != now[x])
        if prefixes is not None and len(other):
            own = heads[x, : lengths[x]]
            mark[own] = True
            meets = mark[heads[other]]
            mark[own] = False
            other = other[heads[other, meets.argmax(1)] == wanted]
        if not len(other):
            continue
        verdict = _verdicts(x, other, codes, sizes, place, similarity)
        for y in other[verdict == 1]:
            if now[y] != now[x]:
                found.append((label[x], label[y]))
                now[now == now[y]] = now[x]
        undecided += [(x, y) for y in other[verdict == -1]]
    return found, [(x, y) for x, y in undecided if now[x] != now[y]]


_DEAL = ["view", "print", "sub"]
#: View of the buckets in which rows meet by a hash of their prefixes.
MEET = -1
_JOINED = "src bigint, dst bigint, a bigint, b bigint, dense boolean"
#: Undecided pairs a text of a block up to which each pair is passed on; with more, only a forest of them is.
PASSED = 4


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Some of the pairs, without circles, that join what all of them join."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for x, y in pairs:
        a, b = top(x), top(y)
        if a != b:
            up[b] = a
            out.append((x, y))
    return out


def _joined(similarity: float):
    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block pair; one that runs over the end of a batch is held back.

        Returned are links (src, dst) between components, and pairs (a, b) of texts, with their components, that need
        their whole sets. Where a block has many such pairs for its texts, only a forest of them comes, marked as dense: all
        texts that it joins are then compared, so the pairs that go out grow with the texts and not with their square.
        """
        kept: pd.DataFrame | None = None

        def linked(frame: pd.DataFrame) -> pd.DataFrame:
            keys = frame[_DEAL].to_numpy(np.int64)
            at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)
            label, first, digest = (frame[c].to_numpy() for c in ("label", "first", "digest"))
            sketch, prefix = frame["sketch"].tolist(), frame["prefix"].tolist()
            links: set[tuple[int, int]] = set()
            pairs: dict[tuple[int, int], tuple[int, int, bool]] = {}
            for i, j in zip(at, np.r_[at[1:], len(keys)]):
                if j - i > 1 and (label[i:j] != label[i]).any():
                    met = prefix[i:j] if keys[i, 0] == MEET else None
                    found, undecided = _joined_in_block(label[i:j], first[i:j], sketch[i:j], similarity, met, keys[i, 1])
                    links |= {(min(x, y), max(x, y)) for x, y in found}
                    dense = len(undecided) > PASSED * len({x for pair in undecided for x in pair})
                    for x, y in _forest(undecided) if dense else undecided:
                        x, y = (x, y) if digest[i + x] < digest[i + y] else (y, x)
                        pairs[digest[i + x], digest[i + y]] = (label[i + x], label[i + y], dense)
            rows = [(x, y, None, None, None) for x, y in links] + [(x, y, *p, dense) for p, (x, y, dense) in pairs.items()]
            return pd.DataFrame(rows, columns=["src", "dst", "a", "b", "dense"]).astype({c: "Int64" for c in ("src", "dst", "a", "b")} | {"dense": "boolean"})

        for frame in frames:
            if kept is not None:
                frame = pd.concat([kept, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[_DEAL] == frame[_DEAL].iloc[-1]).all(axis=1)
            kept = frame[last]
            yield linked(frame[~last])
        if kept is not None:
            yield linked(kept)

    return join


def _regrouped(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``links`` (src, dst) between components, or nodes that have none."""
    links = materialize(links, "links")
    if links.isEmpty():
        return labels
    more = connected_components(links)
    again = small(more.select(F.col("node").alias("was"), F.col("component").alias("now")))
    moved = labels.join(again, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    alone = more.join(small(labels.select(F.col("node").alias("known"))), F.col("node") == F.col("known"), "left_anti")
    out = materialize(moved.unionByName(alone), "groups")
    discard(more)
    return out


def _mixed(rows: DataFrame) -> DataFrame:
    """(view, print, main, n, top): buckets of several components, their largest one, and the sizes of both."""
    per = rows.groupBy("view", "print", "label").agg(F.sum("weight").alias("n") if "weight" in rows.columns else F.count("*").alias("n"))
    got = per.groupBy("view", "print").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    return materialize(got.select("view", "print", F.col("top.label").alias("main"), "n", F.col("top.n").alias("top")), "mixed")


def _dealt(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows (view, print, sub, first, digest, label) such that all pairs of a bucket across its components meet.

    A bucket's largest component needs no comparison within itself. Its rows and the others are dealt to blocks of
    about WIDE * BLOCK rows, and every block of the others meets each later block.
    """
    size = WIDE * BLOCK
    counts = mixed.select("view", "print", "main", F.ceil((F.col("n") - F.col("top")) / size).cast("int").alias("rest"), F.ceil(F.col("top") / size).cast("int").alias("mains"))
    at = F.when(F.col("label") == F.col("main"), F.col("rest") + F.pmod(F.hash("digest"), F.col("mains"))).otherwise(F.pmod(F.hash("digest"), F.col("rest")))
    met = F.when(F.col("at") < F.col("rest"), F.sequence(F.lit(0), F.col("rest") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") - 1))
    d = rows.join(small(counts), ["view", "print"]).withColumn("at", at).withColumn("with", F.explode(met)).where("at <> with")
    sub = F.least("at", "with").cast("bigint") * F.lit(1 << 31) + F.greatest("at", "with")
    return d.select("view", "print", sub.alias("sub"), (F.col("at") < F.col("with")).alias("first"), "digest", "label")


def _open_blocks(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Rows (view, print, sub, first, digest, label, sketch, prefix) in which all similar candidates of different components meet.

    Buckets of up to BLOCK rows are compared as they are. Texts of larger ones share something that many have, a passage
    for instance, so they meet by their rarest hashes instead: each is dealt to the hashes of its prefix (see
    :func:`prefix_size`), in an order by a counter of how many of these texts have a hash. Similar texts share one of those,
    while texts that have but a passage in common don't, since its hashes are the frequent ones. Nothing is left out by that:
    hashes that share a counter change the order only, and one that is alone on its counter is in no other text.
    """
    labelled = buckets.join(small(labels), F.col("digest") == F.col("node"), "left").select("view", "print", "digest", F.coalesce("component", "digest").alias("label"))
    mixed = _mixed(labelled)
    direct = _dealt(labelled, mixed.where(F.col("n") <= BLOCK)).join(nodes.select("digest", "sketch"), "digest").withColumn("prefix", F.lit(None).cast("binary"))
    large = mixed.where(F.col("n") > BLOCK).select("view", "print")
    if not large.isEmpty():
        wide = labelled.join(small(large), ["view", "print"], "left_semi").select("digest", "label").distinct()
        wide = materialize(wide.join(nodes.select("digest", "sketch"), "digest"), "wide")
        counters = wide.sparkSession.sparkContext.broadcast(_counters(wide))
        heads = wide.mapInPandas(_prefixes(similarity, counters), "digest bigint, label bigint, sketch binary, heads array<bigint>, prefix binary")
        heads = materialize(heads, "heads")
        rare = materialize(heads.select(F.lit(MEET).alias("view"), F.explode("heads").alias("print"), "digest", "label"), "rare")
        met = _dealt(rare, _mixed(rare)).join(heads.select("digest", "sketch", "prefix"), "digest")
        direct = direct.unionByName(met)
    return direct


def _labelled(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that are in different components, with these (at_a, at_b); written. Dense pairs all stay: they stand for others."""
    for end in ("a", "b"):
        at = small(groups.select(F.col("node").alias(end), F.col("component").alias(f"at_{end}")))
        pairs = pairs.join(at, end, "left").withColumn(f"at_{end}", F.coalesce(f"at_{end}", end))
    return materialize(pairs.where("at_a <> at_b OR dense" if "dense" in pairs.columns else "at_a <> at_b"), "near")


def _dense(pairs: DataFrame) -> DataFrame | None:
    """(digest, cluster, label) of the clusters of undecided pairs that are cheaper to compare in blocks than one by one.

    A cluster of n texts sends n (n / (WIDE BLOCK) + 1) sets in blocks, and two for each of its pairs otherwise. Clusters with a dense
    pair are always compared in blocks, since not all of their pairs are listed.
    """
    clusters = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    dense = F.col("dense") if "dense" in pairs.columns else F.lit(False)
    ends = pairs.select(dense.alias("dense"), F.explode(F.array(F.struct(F.col("a").alias("digest"), F.col("at_a").alias("label")), F.struct(F.col("b").alias("digest"), F.col("at_b").alias("label")))).alias("e")).select("dense", "e.*")
    texts = ends.groupBy("digest", "label").agg(F.count("*").alias("pairs"), F.max("dense").alias("dense")).join(small(clusters), F.col("digest") == F.col("node"))
    size = texts.groupBy("component").agg(F.count("*").alias("n"), F.sum("pairs").alias("sent"), F.max("dense").alias("dense")).where(F.col("dense") | (F.col("n") * (F.col("n") / (WIDE * BLOCK) + 1) < F.col("sent")))
    out = materialize(texts.join(small(size.select("component")), "component").select("digest", F.col("component").alias("cluster"), "label"), "dense")
    return None if out.isEmpty() else out


def _alike(similarity: float):
    """Whether two whole sets, as bytes of ascending hashes, are similar enough."""

    @pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two ascending runs: a merge
            common = int((both[1:] == both[:-1]).sum())
            out.append(common >= similarity * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return alike


class _Held:
    """The first side of a block pair, with its whole sets coded; sets of the other side stream past it."""

    def __init__(self, labels: list[int], sets: list[bytes]) -> None:
        parts = [np.frombuffer(s, np.uint64) for s in sets]
        self.now, self.labels, self.sizes = np.array(labels), np.array(labels), np.array([len(p) for p in parts])
        self.values, self.flat = np.unique(np.concatenate(parts), return_inverse=True)
        self.flat = self.flat.astype(np.int32)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flag = np.zeros(len(self.values), np.int8)
        self.joined: dict[int, int] = {}

    def codes(self, whole: bytes) -> tuple[np.ndarray, int]:
        own = np.frombuffer(whole, np.uint64)
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        return at[self.values[at] == own], len(own)

    def links(self, label: int, codes: np.ndarray, size: int, similarity: float) -> list[tuple[int, int]]:
        """Links of a set's component with those of similar held sets; joined ones count as one from then on."""
        while label in self.joined:
            label = self.joined[label]
        if not (self.now != label).any():
            return []
        self.flag[codes] = 1
        common = np.add.reduceat(self.flag[self.flat], self.begins, dtype=np.int64)
        self.flag[codes] = 0
        found = []
        for y in np.flatnonzero((common >= similarity * (self.sizes + size - common)) & (self.now != label)):
            if self.now[y] != label:
                found.append((int(self.labels[y]), label))
                self.joined[int(self.now[y])] = label
                self.now[self.now == self.now[y]] = label
        return found


def _exact_in_blocks(similarity: float):
    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block pair, the first side in front, with their whole sets; returned are links (src, dst).

        One side is held, about WIDE * BLOCK * SET_BYTES of it, and the other streams past.
        """
        key, held, labels, sets = None, None, [], []

        def begun() -> list[tuple[int, int]]:
            """The held side is complete: compare it with itself, in the pair with the next block only."""
            nonlocal held
            held, found = _Held(labels, sets), []
            if key[2] % (1 << 31) == (key[2] >> 31) + 1:
                for k in range(1, len(sets)):
                    found += held.links(int(held.now[k]), *held.codes(sets[k]), similarity)
            return found

        for f in frames:
            found = []
            for *k, label, first, whole in f[[*_DEAL, "label", "first", "whole"]].itertuples(index=False):
                if k != key:
                    if held is None and len(sets) > 1:
                        found += begun()
                    key, held, labels, sets = k, None, [], []
                if first:
                    labels.append(label)
                    sets.append(whole)
                elif sets:
                    if held is None:
                        found += begun()
                    found += held.links(label, *held.codes(whole), similarity)
            yield pd.DataFrame(found, columns=["src", "dst"]).astype("int64")
        if held is None and len(sets) > 1:
            yield pd.DataFrame(begun(), columns=["src", "dst"]).astype("int64")

    return exact


def _decided(groups: DataFrame, pairs: DataFrame, whole_sets: Callable[[DataFrame], DataFrame] | None, similarity: float) -> DataFrame:
    """``groups`` (node, component) after the pairs (a, b), distinct, whose whole sets are similar enough.

    Jaccard similarities are exact, on both whole sets of shingle hashes. Pairs of clusters in which many texts are near
    the bar are decided in blocks; the others one by one, in ROUNDS, each over a share of those that are still in different
    components, so that components which any pair joins cost few comparisons.
    """
    pairs = _labelled(pairs, groups)
    if pairs.isEmpty():
        return groups
    if whole_sets is None:
        raise ValueError("some pairs are too near the bar for their sketches, and there are no whole sets")
    sets = materialize(whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()), "wholes", texts=True)
    dense = _dense(pairs)
    if dense is not None:
        weight = F.ceil(F.greatest(F.lit(1), F.length("whole")) / SET_BYTES).alias("weight")
        rows = materialize(dense.join(sets, "digest").select(F.lit(0).alias("view"), F.col("cluster").alias("print"), "digest", "label", weight), "weighed")
        dealt = _dealt(rows, _mixed(rows)).join(sets, "digest").drop("digest").repartition(*_DEAL).sortWithinPartitions(*_DEAL, F.desc("first"))
        links = dealt.mapInPandas(_exact_in_blocks(similarity), "src bigint, dst bigint")
        groups = _regrouped(groups, materialize(links, "links", texts=True).distinct())
        inside = small(dense.select(F.col("digest").alias("a")))
        pairs = _labelled(pairs.join(inside, "a", "left_anti").select("a", "b"), groups)
    for share in ROUNDS:
        if pairs.isEmpty():
            break
        part = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) < int(share * (1 << 20))
        near = pairs.where(part)
        for end in ("a", "b"):
            near = near.join(sets.select(F.col("digest").alias(end), F.col("whole").alias(f"whole_{end}")), end)
        near = near.where(_alike(similarity)("whole_a", "whole_b")).select(F.col("at_a").alias("src"), F.col("at_b").alias("dst"))
        groups = _regrouped(groups, materialize(near, "near", texts=True).distinct())
        pairs = _labelled(pairs.where(~part).select("a", "b"), groups)
    discard(sets)
    return groups


def similar_components(nodes: DataFrame, similarity: float, whole_sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) over texts (digest, fp, views, sketch) that have a link; components of all candidate pairs.

    Candidates share a bucket: an equal view, or whole-text fingerprints in one component of links within 2 bits. Each
    bucket's rows are first compared with four of its members, which joins large groups of copies at a cost in
    proportion to their rows. Then every pair whose members are still in different components is compared, in blocks.

    Pairs that the sketches can't decide are decided on the sets of all their shingle hashes: ``whole_sets`` gets a table
    of digests and returns (digest, whole: the ascending hashes as bytes). Only texts of such pairs are asked for, once for the copies and
    once for the blocks. Without it all sketches must be whole, that is of fewer than SKETCH hashes.
    """
    prints = fingerprint_links(nodes.select("fp").distinct(), 2)
    close = connected_components(prints)
    whole = nodes.join(small(close), F.col("fp") == F.col("node"), "left").select("digest", F.lit(VIEWS).alias("view"), F.coalesce("component", "fp").alias("print"))
    buckets = nodes.select("digest", F.posexplode("views").alias("view", "print")).where("print IS NOT NULL").unionByName(whole)
    key = F.xxhash64("digest", "view")
    hubs = buckets.groupBy("view", "print").agg(
        F.array_distinct(F.array(F.min("digest"), F.max("digest"), F.min_by("digest", key), F.max_by("digest", key))).alias("hubs"),
        F.count("*").alias("n"),
    )
    hubs = materialize(hubs.where("n > 1").select("view", "print", "hubs"), "hubs")
    buckets = materialize(buckets.join(small(hubs), ["view", "print"]), "buckets")
    left = nodes.select(F.col("digest").alias("a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("digest").alias("b"), F.col("sketch").alias("sketch_b"))
    labels, unsure, used = None, None, []
    for turn in (F.slice("hubs", 1, 1), F.slice("hubs", 2, 3)):  # the first hub joins most, the others meet what is left
        met = buckets.select(F.col("digest").alias("a"), F.explode(turn).alias("b"))
        pairs = materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        if labels is not None:
            pairs = _labelled(pairs, labels).select("a", "b")
        judged = pairs.join(left, "a").join(right, "b").select("a", "b", _verdict(similarity)("sketch_a", "sketch_b").alias("verdict"))
        judged = materialize(judged.where("verdict <> 0"), "judged", texts=True)
        near = judged.where("verdict = 1").select("a", "b")
        if labels is None:
            labels = connected_components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        else:
            labels = _regrouped(labels, _labelled(near, labels).select(F.col("at_a").alias("src"), F.col("at_b").alias("dst")).distinct())
        more = judged.where("verdict = -1").select("a", "b")
        unsure = more if unsure is None else unsure.unionByName(more)
        used += [pairs, judged]
    labels = _decided(labels, unsure.distinct(), whole_sets, similarity)

    dealt = _open_blocks(buckets.drop("hubs"), labels, nodes, similarity).repartition(*_DEAL).sortWithinPartitions(*_DEAL)
    met = materialize(dealt.mapInPandas(_joined(similarity), _JOINED), "met", texts=True)
    groups = _regrouped(labels, met.where("a IS NULL").select("src", "dst").distinct())
    unsure = met.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("dense").alias("dense"))
    groups = _decided(groups, unsure, whole_sets, similarity)
    for table in (close, hubs, buckets, *used, labels, met):
        if table is not groups:
            discard(table)
    return groups


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of the smallest doc_id; columns stay as they are.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of ``similarity`` or more and they were
    candidates: whole-text SimHashes joined by links within 2 bits, met at anchors, or an equal SimHash in one of the
    views. Sketches of the 128 smallest hashes decide pairs that are far from the bar (see RISK) or have fewer shingles;
    all others are decided exactly, on both whole sets of shingle hashes. Groups are the components;
    no candidate pair of different components is left uncompared (see :func:`similar_components`).

    Texts that are equal but for ASCII case and white space are folded first, by two 64-bit digests of their words.

    * null text, empty text or white space only: copies of each other; very long texts are hashed whole;
    * null doc_id sorts last; rows that repeat doc_id and text: one stays; empty table: no rows;
    * columns of the input are carried in a struct, so their names never clash.
    """
    own = docs.columns
    key, second = F.xxhash64("doc_id", "text"), F.hash("text", "doc_id")
    marks = docs.select("doc_id", key.alias("key"), second.alias("key2"), _profiles(shingle)("text").alias("p")).select("doc_id", "key", "key2", "p.*")
    marks = materialize(marks, "profiles", texts=True)
    clash = materialize(marks.groupBy("digest").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("digest"), "clash")
    if not clash.isEmpty():  # texts that share one digest by chance get another
        apart = F.xxhash64("digest", "other")
        marks = materialize(marks.join(small(clash.withColumn("twin", F.lit(True))), "digest", "left").withColumn("digest", F.when(F.col("twin"), apart).otherwise(F.col("digest"))).drop("twin"), "profiles")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"), F.col("key2").alias("key2"))).alias("best")
    nodes = marks.groupBy("digest").agg(best, F.any_value("fp").alias("fp"), F.any_value("views").alias("views"), F.any_value("sketch").alias("sketch"), F.count("*").alias("n"))
    nodes = materialize(nodes, "nodes")

    def whole_sets(digests: DataFrame) -> DataFrame:
        wanted = nodes.join(small(digests), "digest").select("digest", F.col("best.key").alias("k"), F.col("best.key2").alias("k2"))
        texts = docs.select("text", key.alias("key"), second.alias("key2")).join(small(wanted), (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2"))).select("digest", "text").dropDuplicates(["digest"])
        return texts.select("digest", _whole_set(shingle)("text").alias("whole"))

    groups = similar_components(nodes, similarity, whole_sets)

    placed = nodes.select("digest", "best", "n").join(small(groups), F.col("digest") == F.col("node"), "left").where("n > 1 OR node IS NOT NULL")
    placed = materialize(placed.select("digest", "best", F.coalesce("component", "digest").alias("root")), "placed")
    winners = placed.groupBy("root").agg(F.min("best").alias("winner"))
    fate = materialize(placed.join(small(winners), "root").select("digest", F.col("winner.key").alias("win"), F.col("winner.key2").alias("win2")), "fate")
    lost = marks.select("key", "key2", "digest").join(small(fate), "digest").where("key <> win OR key2 <> win2").select(F.col("key").alias("k"), F.col("key2").alias("k2"))
    lost = materialize(lost.distinct(), "lost")
    twice = materialize(marks.groupBy("key", "key2").count().where("count > 1").select(F.col("key").alias("k"), F.col("key2").alias("k2")), "twice")
    for used in (marks, nodes, groups, placed, fate, clash):
        discard(used)
    same = (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key.alias("key"), second.alias("key2"))
    kept = rows.join(small(lost), same, "left_anti")
    if not twice.isEmpty():
        twice = small(twice)
        once = kept.join(twice, same, "left_anti").select("row")
        again = kept.join(twice, same, "left_semi").groupBy(F.col("row.doc_id").alias("id"), F.col("row.text").alias("text")).agg(F.first("row").alias("row")).select("row")
        kept = once.unionByName(again)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in own])
