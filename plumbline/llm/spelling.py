"""Spelling variants: minimal acyclic automata of words and of reversed words, matched with half exact and one error in the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialize

#: The letters of a run, the noise's modulus, the fewest code points and occurrences of a word.
LETTERS, NOISE, SHORTEST, FEWEST = "[A-Za-zÀ-ÿ]+", 97, 5, 3
#: Words of one automaton that share a half, and rows that a task holds at a time.
BLOCK, CHUNK = 20_000, 60_000
_LETTER = 1 << 21  # above any code point


class Automaton:
    """The minimal acyclic automaton of ascending ``words``, as arrays of states and edges; accepted words have numbers.

    ``skip`` of an edge is how many accepted words precede those that go through it, so its sum along a path is the
    word's place in ``words``.
    """

    def __init__(self, words: list[str]) -> None:
        known: dict[tuple, int] = {}
        first, self_counts, final, letters, targets, skips = [0], [], [], [], [], []

        def frozen(node: list) -> int:
            sign = (node[0], tuple(node[1]))
            got = known.get(sign)
            if got is None:
                got = known[sign] = len(final)
                before = int(node[0])
                for letter, target in node[1]:
                    letters.append(ord(letter))
                    targets.append(target)
                    skips.append(before)
                    before += self_counts[target]
                final.append(node[0])
                self_counts.append(before)
                first.append(len(letters))
            return got

        path, last = [[False, []]], ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][1].append((last[depth - 1], frozen(path.pop())))
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0], last = True, word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], frozen(path.pop())))
        self.root = frozen(path[0])
        self.first, self.final = np.array(first), np.array(final, bool)
        self.letters, self.targets, self.skips = np.array(letters, np.int64), np.array(targets, np.int64), np.array(skips, np.int64)
        self.keys = np.repeat(np.arange(len(final)), np.diff(self.first)) * _LETTER + self.letters

    def step(self, at: tuple, letters: np.ndarray) -> tuple:
        """Follow one letter a row of (query, state, number); rows without such an edge go."""
        q, s, n = at
        key = s * _LETTER + letters
        e = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        ok = self.keys[e] == key if len(self.keys) else np.zeros(len(key), bool)
        e = e[ok]
        return q[ok], self.targets[e], n[ok] + self.skips[e]

    def fan(self, at: tuple) -> tuple[tuple, np.ndarray]:
        """All edges of each row, and their letters."""
        q, s, n = at
        width = self.first[s + 1] - self.first[s]
        row = np.repeat(np.arange(len(q)), width)
        e = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + self.first[s][row]
        return (q[row], self.targets[e], n[row] + self.skips[e]), self.letters[e]

    def one_error(self, codes: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number), each pair once: words that agree in the first ``exact`` letters and differ by one edit after.

        ``codes`` has a row of code points for each query; all rows advance together.
        """
        n, length = codes.shape
        none = np.zeros(0, np.int64)
        whole, used = (np.arange(n), np.full(n, self.root), np.zeros(n, np.int64)), (none, none, none)
        for i in range(exact):
            whole = self.step(whole, codes[whole[0], i])
        for i in range(exact, length + 1):
            more, letters = self.fan(whole)
            used = tuple(np.concatenate(x) for x in zip(used, more))  # the word has a letter more here
            if i == length:
                break
            used = self.step(used, codes[used[0], i])
            other = letters != codes[more[0], i]
            used = tuple(np.concatenate(x) for x in zip(used, whole, (v[other] for v in more)))  # a letter less, another letter
            whole = self.step(whole, codes[whole[0], i])
        q, s, number = used
        ok = self.final[s]
        pairs = np.unique(np.stack([q[ok], number[ok]]), axis=1) if ok.any() else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]


def _answers(rows: pd.DataFrame) -> list[pd.DataFrame]:
    """The asked words of one chunk (a single direction) that have near words in it: how many, and the best of them."""
    back = bool(rows["back"].iloc[0])
    stored = rows[rows["stored"]].drop_duplicates("word").sort_values("word")
    words, counts = stored["word"].tolist(), stored["n"].to_numpy()
    forward = np.array([w[::-1] for w in words] if back else words, object)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(forward, kind="stable")] = np.arange(len(words))
    automaton, found = Automaton(words), []
    asked = rows["word"][rows["asked"]]
    for length, group in asked.groupby(asked.str.len()):
        texts = group.tolist()
        codes = np.array(texts, f"<U{length}").view(np.uint32).reshape(len(texts), length).astype(np.int64)
        q, number = automaton.one_error(codes, (length + 1) // 2 if back else length // 2)
        if back and len(q):  # a word that also shares the first half was found forward
            tails = [t[length - length // 2 :] for t in texts]
            new = np.array([not words[w].endswith(tails[k]) for k, w in zip(q.tolist(), number.tolist())])
            q, number = q[new], number[new]
        if len(q):
            order = np.lexsort((rank[number], -counts[number], q))
            q, number = q[order], number[order]
            at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            own = pd.Series([texts[k][::-1] if back else texts[k] for k in q[at]], dtype=object)
            found.append(pd.DataFrame({"word": own, "near": np.diff(np.r_[at, len(q)]), "best_n": counts[number[at]], "best": forward[number[at]]}))
    return found


def _borders(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return (rows[columns] != rows[columns].shift()).any(axis=1).to_numpy()


def _pieces(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of one automaton: groups of one direction together, but each block of a cut group by itself.

    A word of a cut group may also be in another group with it, and would be found once more from there.
    """
    edge = _borders(rows, ["back", "big"]) | (rows["big"].to_numpy() & _borders(rows, _GROUP))
    at = np.flatnonzero(edge)
    for low, high in zip(at, np.r_[at[1:], len(rows)]):
        yield rows[low:high]


_GROUP = ["back", "half", "sub"]


def _matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by direction, half and block, stored ones first: answers chunks of whole groups.

    A group that is longer than a chunk holds a block of stored words and streams its asked words past it.
    """
    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        if len(held) <= CHUNK:
            continue
        cut = int(np.flatnonzero(_borders(held, _GROUP))[-1])
        if cut:
            for rows in _pieces(held[:cut]):
                yield from _answers(rows)
            held = held[cut:].reset_index(drop=True)
        elif not held["stored"].iloc[-1]:
            yield from _answers(held)
            held = held[held["stored"]].assign(asked=False)
    if held is not None and len(held):
        for rows in _pieces(held):
            yield from _answers(rows)


def _halves(direction: int, text: Column, length: Column) -> Column:
    """(back, half, word, asked) for each exact half under which a query of one letter less, equal or one more looks for the word."""
    half = lambda n: F.floor((n + direction) / 2).cast("int")
    sizes = F.array_distinct(F.transform(F.filter(F.array(length - 1, length, length + 1), lambda n: n >= SHORTEST), half))
    word = F.reverse(text) if direction else text
    return F.transform(sizes, lambda m: F.struct(F.lit(direction).alias("back"), F.substring(word, F.lit(1), m).alias("half"), word.alias("word"), (m == half(length)).alias("asked")))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the rows (word, n) that have near words: all of one edit, counted once.

    An edit is in the second half of the asked word or in the first. So words meet by an exact half: its first letters in the
    forward automata, its last ones in the automata of reversed words. A half that more than ``block`` words share is cut
    into blocks by hash, and each of its queries looks into every block.
    """
    d = words.where(F.length("word") >= SHORTEST)
    entries = d.select("n", F.inline(F.concat(_halves(0, F.col("word"), F.length("word")), _halves(1, F.col("word"), F.length("word")))))
    big = entries.groupBy("back", "half").agg(F.count("*").alias("k")).where(F.col("k") > block)
    blocks = big.select("back", "half", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    d = entries.join(blocks, ["back", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks").cast("bigint")).cast("int")
    d = d.withColumn("own", own).withColumn("sub", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    d = d.select("back", "half", "sub", "word", "n", "asked", (F.col("sub") == F.col("own")).alias("stored"), (F.col("blocks") > 1).alias("big"))
    d = d.repartition("back", "half", "sub").sortWithinPartitions("back", "half", "sub", F.desc("stored"), "word")
    found = d.mapInPandas(_matched, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def chain_ends(links: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last word of each chain, by doubling; chains have no circles."""
    ends = materialize(links.select("word", F.col("form").alias("root")), "chain")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        discard(ends)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        ends = new


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of which one in NOISE loses a letter by a hash of id and run."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST).select("id", lower_ascii(F.col("run")).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    d = h.select(word.alias("word")).where(F.length("word") >= SHORTEST)
    return d.groupBy("word").agg(F.count("*").alias("n"))


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of rows (word, n); words are distinct.

    A word's form is its near word of largest n (ties: smallest in code-point order), if that is twice its own n at least;
    its root is where the forms lead to.

    * words of under SHORTEST code points are left out; an empty table gives no rows;
    * a form's n is twice the word's, so chains end and have at most 63 links;
    * extra columns are left out, so their names can't clash.
    """
    words = materialize(words.select("word", F.col("n").cast("bigint").alias("n")).where(F.length("word") >= SHORTEST), "words")
    near = words.join(near_words(words), "word", "left").withColumn("ok", F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False)))
    formed = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("ok"), F.col("best")).alias("form"), F.when(F.col("ok"), F.col("best_n")).alias("form_n")), "forms")
    ends = chain_ends(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST) -> DataFrame:
    """:func:`variants` of the words that occur ``fewest`` times in ``docs``.

    * null or empty text: no words; null id: the empty string in the noise's hash; repeated rows count each time;
    * a very long text is one row of one task; a very long run is one word, walked a letter at a time;
    * empty table: no rows; only the id and the text are read, so other columns can't clash.
    """
    return variants(noisy_words(docs, id_col, text_col).where(F.col("n") >= fewest))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 by a table of 256 entries, which the first two queries make; two words are near if they are equal after the loss of
#: one letter of either, or of a letter at the same place of both.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
     UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
     crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
     runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
     counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
     bytes AS (SELECT run, n, list_transform(string_split(doc_id || ':' || run, ''), lambda x: unicode(x)::BIGINT) AS b FROM counted),
     utf AS (SELECT run, n, flatten(list_transform(b, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)) AS b FROM bytes),
     hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM utf, crc),
     noisy AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
     w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     cut AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w)),
     near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM w a JOIN cut b ON a.word = b.rest
              UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word),
     best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
     picked AS (SELECT b.word, b.n_near, b.top, min(near.other) AS form FROM best b JOIN near ON near.word = b.word AND near.n = b.top GROUP BY ALL),
     formed AS (SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.top >= 2 * w.n THEN p.form END AS form,
                       CASE WHEN p.top >= 2 * w.n THEN p.top END AS form_n FROM w LEFT JOIN picked p ON p.word = w.word),
     chains AS (SELECT word, word AS root, 0 AS k FROM formed
                UNION ALL SELECT c.word, f.form, k + 1 FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
     ends AS (SELECT word, arg_max(root, k) AS root FROM chains GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
