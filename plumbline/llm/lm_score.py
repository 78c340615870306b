"""Language-model scores from a class-factored log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize

#: Codes of the model: begin (context only), all words without a code of their own, end; then words by falling count.
BEGIN, RARE, END, FIRST = 0, 1, 2, 3
#: Words with a code and vectors of their own: all that occur, up to what 16 bits can number.
WORDS = (1 << 16) - FIRST
#: Classes that the words are dealt to; a token's probability is its class's times its own within the class.
CLASSES = 128
#: Vector length; noise classes of a batch; noise words of a token; tokens of a batch; step size.
DIM, NOISE, INNER, BATCH, STEP = 16, 32, 1, 16384, 0.1
#: Bound of the table of frequent words that is sent to executors (16 bytes each).
HEAD_WORDS = 500_000
#: Bound of the sample that gives all shards a common start.
WARM_DOCS = 2_000
#: Training tokens of a shard, about; tokens that are shuffled together in it.
SHARD_TOKENS, CHUNK = 1 << 22, 1 << 18
#: Numbers of a block when trained parameters are averaged; models that one task averages.
PIECE, FAN = 1 << 14, 16
#: Tokens that are scored in one matrix product.
SCORED = 1 << 14
END_HASH = int(np.uint64(xxhash.xxh64_intdigest(b"\n")).view(np.int64))


# ---------------------------------------------------------------- tokens


def tokenised(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, index, ends): the distinct tokens' 64-bit hashes, each token's place among them, and where texts end.

    A-Z are lower-cased, words are split at ASCII white space, null counts as empty, an end token closes each text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts.fillna("").astype(object), pa.large_string())))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    found = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in found] + [0], np.uint64).view(np.int64)
    hashes[-1] = END_HASH
    if "" in found:  # white space at the ends leaves empty words
        keep = index != found.index("")
        offsets = np.r_[0, np.cumsum(keep)][offsets]
        index = index[keep]
    index = np.insert(index, offsets[1:], len(found))
    return hashes, index, offsets[1:] + np.arange(1, len(offsets))


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a distinct token and task (or a million tokens kept), pre-aggregated before the shuffle."""
    hashes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for frame in frames:
        if not len(frame):
            continue
        h, index, _ = tokenised(frame["text"])
        both = np.concatenate([hashes, h])
        n = np.concatenate([counts, np.bincount(index, minlength=len(h))])
        hashes, inverse = np.unique(both, return_inverse=True)
        counts = np.bincount(inverse, n).astype(np.int64)
        if len(hashes) > 1_000_000:
            yield pd.DataFrame({"h": hashes, "n": counts})
            hashes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield pd.DataFrame({"h": hashes, "n": counts})


# ---------------------------------------------------------------- vocabulary

#: A vocabulary is a plain dict, so that a broadcast of it needs nothing but numpy on the executors: tokens and types (of the
#: training texts), hashes (sorted), counts and codes of the frequent words, starts (first code of each class, then the
#: number of codes), mass (training tokens of each code), rare_mass (what a word without a code is a share of).
Vocabulary = dict


def look_up(vocab: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, code) of hashes; count -1 for words that are not among the frequent ones."""
    if not len(vocab["hashes"]):
        return np.full(len(hashes), -1, np.int64), np.where(hashes == END_HASH, END, RARE)
    at = np.minimum(np.searchsorted(vocab["hashes"], hashes), len(vocab["hashes"]) - 1)
    hit = vocab["hashes"][at] == hashes
    return np.where(hit, vocab["counts"][at], -1), np.where(hashes == END_HASH, END, np.where(hit, vocab["codes"][at], RARE))


def class_starts(counts: np.ndarray) -> np.ndarray:
    """First code of each class and the number of codes: RARE and END alone, then words in runs of equal root counts."""
    total = np.cumsum(np.sqrt(counts))
    n = min(CLASSES - 2, len(counts))
    if not n:
        return np.array([RARE, END, FIRST])
    group = np.minimum((total - np.sqrt(counts)) / total[-1] * n, n - 1).astype(np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.r_[RARE, END, FIRST + first, FIRST + len(counts)]


def fit_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """From (h, c) of all training tokens; also the count from which a word is frequent.

    A histogram of the counts finds the lowest count at which HEAD_WORDS words at most are frequent.
    """
    level = F.floor(F.log2("c") * 64).cast("int")
    bars = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("low")).collect()
    tokens, types = sum(b.tokens for b in bars), sum(b.words for b in bars)
    taken, cut = 0, 1 << 62
    for b in sorted(bars, key=lambda b: -b.level):
        if taken + b.words > HEAD_WORDS:
            break
        taken, cut = taken + b.words, b.low
    head = counts.where(F.col("c") >= cut).select("h", "c").toArrow()
    h, c = head["h"].to_numpy(), head["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    words = np.flatnonzero(h != END_HASH)
    ranked = words[np.lexsort((h[words], -c[words]))][:WORDS]
    codes = np.full(len(h), RARE, np.int32)
    codes[ranked] = np.arange(FIRST, FIRST + len(ranked))
    ends = int(c[h == END_HASH].sum())
    mass = np.zeros(FIRST + len(ranked))
    mass[FIRST:] = c[ranked]
    rare_tokens, rare_types = tokens - int(c[ranked].sum()) - ends, types - len(ranked) - bool(ends)
    mass[RARE], mass[END] = rare_tokens, ends
    vocab = {"tokens": tokens, "types": types, "hashes": h, "counts": c, "codes": codes, "starts": class_starts(c[ranked]), "mass": mass, "rare_mass": float(rare_tokens + rare_types + 1)}
    return vocab, cut


# ---------------------------------------------------------------- the model


def shapes(vocab: Vocabulary) -> list[tuple[int, ...]]:
    n, k = len(vocab["mass"]), len(vocab["starts"]) - 1
    return [(n, DIM), (2, DIM), (k, DIM), (k,), (k + 1, DIM), (n, DIM), (n,)]


class LogBilinear:
    """P(w | u, v) = P(class of w | u, v) P(w | its class, class of v), u two tokens and v one token before.

    Classes k: softmax of (r_u c_1 + r_v c_2) . a_k + d_k. Words of a class: softmax of s_(class of v) . q_w + b_w.
    """

    def __init__(self, vocab: Vocabulary, flat: np.ndarray) -> None:
        self.starts, at, parts = vocab["starts"], 0, []
        for shape in shapes(vocab):
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        self.r, self.c, self.a, self.d, self.s, self.q, self.b = self.parts = parts
        sizes = np.diff(self.starts)
        self.class_of = np.r_[len(sizes), np.repeat(np.arange(len(sizes)), sizes)]  # BEGIN has a class as a context only
        self.several = sizes[self.class_of[1:]] > 1  # whether the class of code i + 1 has other words

    @classmethod
    def start(cls, vocab: Vocabulary) -> LogBilinear:
        rng = np.random.default_rng(5)
        m = cls(vocab, np.concatenate([rng.normal(0, 0.1, int(np.prod(s))).astype(np.float32) for s in shapes(vocab)]))
        m.c[:] = [[0.5], [1.0]]
        m.d[:] = np.log(class_noise(vocab))
        m.b[:] = np.log(word_noise(vocab))
        return m

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def inner_norms(self) -> np.ndarray:
        """Log of the normaliser of each class's words, for each class of the token before."""
        cuts, sizes = self.starts[:-1] - 1, np.diff(self.starts)
        out = np.empty((len(self.s), len(sizes)), np.float32)
        for at in range(0, len(self.s), 16):
            x = self.s[at : at + 16] @ self.q[1:].T + self.b[1:]
            top = np.maximum.reduceat(x, cuts, axis=1)
            x -= np.repeat(top, sizes, axis=1)
            out[at : at + 16] = np.log(np.add.reduceat(np.exp(x, out=x), cuts, axis=1)) + top
        return out

    def log_probs(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(w | u, v), normalised, with ``norms`` from :meth:`inner_norms`."""
        out = np.empty(len(w), np.float64)
        for at in range(0, len(w), SCORED):
            x, y, z = (t[at : at + SCORED] for t in (u, v, w))
            k = self.class_of[z]
            logits = (self.r[x] * self.c[0] + self.r[y] * self.c[1]) @ self.a.T + self.d
            own = logits[np.arange(len(z)), k]
            top = logits.max(1)
            logits -= top[:, None]
            outer = own - top - np.log(np.exp(logits, out=logits).sum(1))
            before = self.class_of[y]
            out[at : at + len(z)] = outer + np.einsum("ij,ij->i", self.s[before], self.q[z]) + self.b[z] - norms[before, k]
        return out


def class_noise(vocab: Vocabulary) -> np.ndarray:
    """Smoothed share of each class among the training tokens."""
    p = np.add.reduceat(vocab["mass"][1:], vocab["starts"][:-1] - 1) + 1
    return p / p.sum()


def word_noise(vocab: Vocabulary) -> np.ndarray:
    """Share of each code within its class, smoothed; 1 for BEGIN, which is never drawn."""
    cuts, sizes = vocab["starts"][:-1] - 1, np.diff(vocab["starts"])
    m = vocab["mass"][1:] + 1
    return np.r_[1.0, m / np.repeat(np.add.reduceat(m, cuts), sizes)]


def _descend(rows: np.ndarray, *steps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """One AdaGrad step on the given rows of each (parameters, squares, gradients); gradients of a repeated row are summed."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
    ids = rows[order]
    at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    ids = ids[at]
    for x, square, grads in steps:
        g = np.add.reduceat(grads[order], at)
        total = square[ids] + g * g
        square[ids] = total
        x[ids] -= STEP * g / np.sqrt(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with AdaGrad. The noise classes of a batch are shared by its tokens; noise words are
    drawn for each token from its class."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray, seed: int) -> None:
        self.m = LogBilinear(vocab, flat.copy())
        self.rng = np.random.default_rng(seed)
        self.squares = [np.ones(x.shape, np.float32) for x in self.m.parts]
        outer, inner = class_noise(vocab), word_noise(vocab)
        self.outer_kq, self.inner_kq = np.log(NOISE * outer).astype(np.float32), np.log(INNER * inner).astype(np.float32)
        self.outer_sum = np.cumsum(outer)
        self.inner_sum = np.cumsum(inner)  # grows by 1 from the first word of a class to that of the next
        self.starts = vocab["starts"]

    def batch(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m, (sr, sc, sa, sd, ss, sq, sb) = self.m, self.squares
        k = m.class_of[w]
        drawn = np.minimum(np.searchsorted(self.outer_sum, self.rng.random(NOISE) * self.outer_sum[-1]), len(self.outer_sum) - 1)
        ru, rv = m.r[u], m.r[v]
        made = ru * m.c[0] + rv * m.c[1]
        ak, an = m.a[k], m.a[drawn]
        g = _sigmoid(np.einsum("ij,ij->i", made, ak) + m.d[k] - self.outer_kq[k]) - 1
        gn = _sigmoid(made @ an.T + (m.d[drawn] - self.outer_kq[drawn]))
        d_made = g[:, None] * ak + gn @ an
        _descend(np.r_[k, drawn], (m.a, sa, np.concatenate([g[:, None] * made, gn.T @ made])), (m.d, sd, np.r_[g, gn.sum(0)]))
        _descend(np.r_[u, v], (m.r, sr, np.concatenate([d_made * m.c[0], d_made * m.c[1]])))
        _descend(np.arange(2), (m.c, sc, np.stack([(d_made * ru).sum(0), (d_made * rv).sum(0)])))

        some = np.flatnonzero(m.several[w - 1])
        if len(some):
            w, before, k = w[some], m.class_of[v[some]], k[some]
            sv, qw = m.s[before], m.q[w]
            low = self.inner_sum[self.starts[k] - 1]
            noise = np.searchsorted(self.inner_sum, low[:, None] + self.rng.random((len(w), INNER)), side="right")
            noise = np.minimum(np.maximum(noise, self.starts[k][:, None]), self.starts[k + 1][:, None] - 1)
            qn = m.q[noise]
            g = _sigmoid(np.einsum("ij,ij->i", sv, qw) + m.b[w] - self.inner_kq[w]) - 1
            gn = _sigmoid(np.einsum("ij,ikj->ik", sv, qn) + m.b[noise] - self.inner_kq[noise])
            d_sv = g[:, None] * qw + np.einsum("ik,ikj->ij", gn, qn)
            rows = np.r_[w, noise.ravel()]
            d_q = np.concatenate([g[:, None] * sv, (gn[:, :, None] * sv[:, None, :]).reshape(-1, DIM)])
            _descend(rows, (m.q, sq, d_q), (m.b, sb, np.r_[g, gn.ravel()]))
            _descend(before, (m.s, ss, d_sv))

    def texts(self, codes: np.ndarray, ends: np.ndarray) -> None:
        u, v = contexts_of(codes, ends)
        order = self.rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self.batch(u[some], v[some], codes[some])


def contexts_of(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes two and one before each token; BEGIN before a text's first."""
    starts = np.r_[0, ends[:-1]]
    v = np.r_[BEGIN, codes[:-1]]
    u = np.r_[BEGIN, BEGIN, codes[:-2]][: len(codes)]
    v[starts] = BEGIN
    u[starts] = BEGIN
    second = starts + 1
    u[second[second < ends]] = BEGIN
    return u, v


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of several texts one after the other, and where each ends."""
    parts = [np.frombuffer(r, "<u2") for r in rows]
    return np.concatenate(parts).astype(np.int64), np.cumsum([len(p) for p in parts])


# ---------------------------------------------------------------- training


def warm_sample(train: DataFrame) -> DataFrame:
    """At most WARM_DOCS rows, those with the smallest ``key``.

    A threshold on the key leaves about twice as many in all before any are put in order, so what tasks send doesn't
    grow with their number.
    """
    low = min((1 << 64) - 1, (2 * WARM_DOCS << 64) // max(1, train.count())) - (1 << 63)
    return train.where(F.col("key") <= low).orderBy("key").limit(WARM_DOCS)


def fit_model(train: DataFrame, vocab: Vocabulary, shared) -> np.ndarray:
    """Parameters from training rows (key, codes): a warm start on a bounded sample, then every shard trains on all of its
    rows, and the shards' parameters are averaged by tokens.

    Rows are dealt to shards by their key and read in its order, and the number of shards follows from the number of
    tokens alone, so nothing depends on how the table is partitioned. The warm start runs in one task, since its sample is
    bounded; only parameters reach the driver. They travel in pieces of PIECE numbers, which are averaged in a tree: no
    task holds more than FAN of one piece, however many shards there are.
    """
    spark = train.sparkSession

    def warmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        rows = [bytes(c) for f in frames for c in f["codes"]]
        trainer = Trainer(v, LogBilinear.start(v).vector(), 1)
        for _ in range(3 if rows else 0):
            trainer.texts(*_joined(rows))
        yield pd.DataFrame({"w": [trainer.m.vector().tobytes()]})

    first = warm_sample(train).select("codes").mapInPandas(warmed, "w binary").head()
    start = np.frombuffer(bytes(first.w), np.float32) if first else LogBilinear.start(vocab).vector()
    begun = spark.sparkContext.broadcast(start)

    def trained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, trainer, held, size, seen = None, None, [], 0, 0

        def done() -> pd.DataFrame:
            if held:
                trainer.texts(*_joined(held))
            flat = trainer.m.vector()
            cuts = range(0, len(flat), PIECE)
            return pd.DataFrame({"shard": now, "piece": [c // PIECE for c in cuts], "tokens": float(seen), "w": [flat[c : c + PIECE].tobytes() for c in cuts]})

        for f in frames:
            for shard, codes in zip(f["shard"], f["codes"]):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, trainer, held, size, seen = int(shard), Trainer(shared.value, begun.value, 2 + int(shard)), [], 0, 0
                held.append(bytes(codes))
                size += len(codes) // 2
                seen += len(codes) // 2
                if size >= CHUNK:
                    trainer.texts(*_joined(held))
                    held, size = [], 0
        if now is not None:
            yield done()

    def averaged(pieces: pd.DataFrame) -> pd.DataFrame:
        p = pieces.sort_values("shard")
        tokens = p["tokens"].sum()
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * t for w, t in zip(p["w"], p["tokens"]))
        return pd.DataFrame({"shard": [p["shard"].iloc[0] // FAN], "piece": [p["piece"].iloc[0]], "tokens": [tokens], "w": [(total / tokens).astype(np.float32).tobytes()]})

    schema = "shard bigint, piece int, tokens double, w binary"
    n = max(1, -(-vocab["tokens"] // SHARD_TOKENS))
    dealt = train.select(F.pmod("key", F.lit(n)).alias("shard"), "key", "codes")
    dealt = dealt.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "key").select("shard", "codes")
    parts = materialize(dealt.mapInPandas(trained, schema), "shards")
    while True:
        parts = parts.groupBy("piece", F.floor(F.col("shard") / FAN).alias("group")).applyInPandas(averaged, schema)
        n = -(-n // FAN)
        if n == 1:
            break
    got = sorted((r.piece, bytes(r.w)) for r in parts.select("piece", "w").collect())
    return np.frombuffer(b"".join(w for _, w in got), np.float32) if got else start


# ---------------------------------------------------------------- documents

_ENCODED = "doc_id bigint, held_out boolean, key bigint, n_tokens bigint, known bigint, head double, rare double, n_rare bigint, codes binary, tail array<bigint>"
_SCORED = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, head double, rare double, n_rare bigint, model double"


def _encoder(shared):
    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for frame in frames:
            for at in range(0, len(frame), 1000):
                some = frame.iloc[at : at + 1000]
                h, index, ends = tokenised(some["text"])
                count, code = look_up(v, h)
                owner = np.repeat(np.arange(len(some)), np.diff(np.r_[0, ends]))
                codes, c = code[index], count[index]
                head, is_rare = c >= 0, codes == RARE
                seen = np.where(head, np.log10(np.maximum(c, 0) + 1.0), 0.0)

                def total(x, owner=owner, n=len(some)):
                    return np.bincount(owner, x, n)

                tail = h[index[~head]]
                cuts = np.cumsum(total(~head).astype(np.int64))
                raw, stops = codes.astype("<u2").tobytes(), ends.tolist()
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].to_numpy(),
                        "held_out": some["held_out"].to_numpy(),
                        "key": some["key"].to_numpy(),
                        "n_tokens": np.diff(np.r_[0, ends]),
                        "known": total(head & (c > 0)).astype(np.int64),
                        "head": total(seen),
                        "rare": total(seen * is_rare),
                        "n_rare": total(is_rare).astype(np.int64),
                        "codes": [raw[2 * a : 2 * b] for a, b in zip([0, *stops[:-1]], stops)],
                        "tail": np.split(tail, cuts[:-1]),
                    }
                )

    return encoded


def _scorer(shared, model):
    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LogBilinear(shared.value, model.value)
        norms = m.inner_norms()
        for frame in frames:
            group = (frame["n_tokens"].cumsum() // (1 << 18)).to_numpy()
            for k in np.unique(group):
                some = frame[group == k]
                codes, ends = _joined([bytes(c) for c in some["codes"]])
                logp = m.log_probs(*contexts_of(codes, ends), codes, norms) / np.log(10)
                owner = np.repeat(np.arange(len(some)), np.diff(np.r_[0, ends]))
                yield some.drop(columns="codes").assign(model=np.bincount(owner, logp, len(some)))

    return scored


def fit(docs: DataFrame):
    """(encoded, counts, cut, vocabulary, parameters) from the training documents of ``docs``; see :func:`score_documents`."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.pmod(fold(F.col("doc_id")), F.lit(7)) == 2).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"), "text")
    train = d.where(~F.col("held_out"))
    counts = materialize(train.select("text").mapInPandas(_counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    vocab, cut = fit_vocabulary(counts)
    shared = sc.broadcast(vocab)
    rows = d.mapInPandas(_encoder(shared), _ENCODED).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "encoded")
    return rows, counts, cut, vocab, fit_model(rows.where(~F.col("held_out")).select("key", "codes"), vocab, shared)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(doc_id) mod 7 is not 2; held_out marks the rest. ``base_score`` is the
    add-one unigram score. ``score`` is the log10 probability under the log-bilinear model over codes (one for each of the
    WORDS most frequent words, the end, and one for all others), times the add-one share of each word without a code among
    these, where all unseen words together count as one further word. Both are proper distributions over the same events.

    Counts of all training tokens are gathered by hash (64 bits). The most frequent HEAD_WORDS go to the executors;
    each document's other tokens are joined with the rest of the counts, none of which is frequent, so no key is hot.
    Rows that repeat doc_id and text share a training shard, which reads its rows as a stream.

    * null or empty text: the end token alone; very long texts are scored whole; empty table: no rows;
    * null doc_id: its fold is that of the empty string; repeated rows get equal rows;
    * no training documents: train_tokens 0 and base_score 0; other columns of the input are not read.
    """
    rows, counts, cut, vocab, model = fit(docs)
    sc = docs.sparkSession.sparkContext
    rest = rows.select("uid", F.explode("tail").alias("h")).join(counts.where(F.col("c") < cut), "h", "left")
    rest = rest.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("t"), F.count("c").alias("t_known"))
    scored = rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "head", "rare", "n_rare", "codes")
    out = scored.mapInPandas(_scorer(sc.broadcast(vocab), sc.broadcast(model)), _SCORED).join(rest, "uid", "left")
    t = F.coalesce("t", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("t_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocab["tokens"]).cast("bigint").alias("train_tokens"),
        (F.col("head") + t - F.col("n_tokens") * float(np.log10(vocab["tokens"] + vocab["types"] + 1))).alias("base_score"),
        (F.col("model") + F.col("rare") + t - F.col("n_rare") * float(np.log10(vocab["rare_mass"]))).alias("score"),
    )


def op8_log_bilinear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
