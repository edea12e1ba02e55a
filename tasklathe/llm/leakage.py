"""Evaluation passages leaking into a corpus, by latent semantic retrieval.

1. Texts are reduced to words once and kept in the shared folder.
2. Distinct passages are taken in slices of about SLICE_WORDS words.  Document
   frequencies of a slice's words are counted over all documents.
3. A randomised SVD of the TF-IDF matrix of all windows of 12 words of the
   slice's passages, in passes over the passages, gives a latent space; the
   latent vector of a window is the sum of its words' vectors.
4. Every window of every document (at every fourth word) that could hold part
   of a leak is projected into it.  Such a window shares at least SHARED of its
   12 words, in order, with the passage, so one of its 12 - SHARED + 1 rarest
   words is among them: the places of those words in the passages name the
   passage windows it is compared with, and no other one needs to be.
5. Pairs with a cosine above the threshold go on.  The threshold is measured on
   all windows of the slice: damaged as far as a leak may be, at most MISS of
   them fall below it.  So recall does not depend on how many passages there
   are, or on how much of them the latent space holds.
6. Pairs (document, passage) with a close window are aligned: a longest common
   subsequence with bounded errors grown from exact blocks of five words.  A
   document is reported if it holds at least ``min_run`` consecutive words of
   the passage with at most one error in eight.

Items that share a passage are one passage until the last join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklathe.llm.words import words
from tasklathe.shared import written

WINDOW = 12
DOC_STRIDE = 4
SHARED = 9  # words of a document's window that a leak shares with the passage in order: 12, less 2 for the stride and 1 error
LIKE = 6  # the same for a paraphrase: half
MISS = 0.002  # share of damaged windows that may fall below the threshold
TRIALS = 1 << 14  # damaged windows that a threshold is measured on at least; few windows are damaged several times
RANK = 160
OVERSAMPLE = 16
POWER_ROUNDS = 2
MIN_RUN = 12
ERRORS_IN = 8
SEED_WORDS = 5
SLICE_WORDS = 1 << 18  # words of the passages that are searched at once; sets the size of what is broadcast
PAIRS = 1 << 18  # pairs of windows compared at once
FAN_IN = 64
HALF = 0.5  # of a passage's words in order: a paraphrase
HALF_WITH_ANSWER = 0.4  # the same where the item's answer occurs as well


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the words of every text, joined by spaces, as a written table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words(t)) for t in b.column(1).to_pylist()], pa.string())], ["id", "words"])

    return written(docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, words string"), "words")


def _tree_sum(parts: DataFrame, rounds: int = 3, fan_in: int = FAN_IN, kind: type = np.float64) -> np.ndarray | None:
    """Sum of the binary vectors in column ``v``, along a tree; the driver gets one vector."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("v"):
            a = np.frombuffer(x.as_buffer(), kind)
            total = a.copy() if total is None else np.add(total, a, out=total)
        return pa.table({"salt": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    for _ in range(rounds):
        parts = parts.withColumn("salt", F.floor(F.col("salt") / fan_in)).groupBy("salt").applyInArrow(add, "salt bigint, v binary")
    rows = parts.collect()  # one row for up to fan_in ** rounds input partitions
    return sum((np.frombuffer(bytes(r["v"]), kind) for r in rows[1:]), np.frombuffer(bytes(rows[0]["v"]), kind)) if rows else None


class Passages:
    """A slice of distinct passages: their words as numbers, and the windows they are cut into, at every word."""

    def __init__(self, texts: list[list[str]]):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        sizes = np.array([len(t) for t in texts], np.int64)
        self.words = np.fromiter((self.vocabulary[w] for t in texts for w in t), np.int32, count=int(sizes.sum()))
        self.start = np.append(0, np.cumsum(sizes))  # a passage's first word
        self.n_windows = np.maximum(1, sizes - WINDOW + 1)
        self.first_window = np.append(0, np.cumsum(self.n_windows))

    @staticmethod
    def again(parts: tuple) -> Passages:
        """From ``parts``: what is broadcast is plain data, for executors that don't have this package."""
        p = Passages.__new__(Passages)
        p.vocabulary, p.words, p.start, p.n_windows, p.first_window = parts
        return p

    def parts(self) -> tuple:
        return self.vocabulary, self.words, self.start, self.n_windows, self.first_window

    def of(self, k: int) -> list[int]:
        return self.words[self.start[k] : self.start[k + 1]].tolist()

    def window_words(self, a: int, b: int) -> np.ndarray:
        """Words of the windows a..b-1 (n x WINDOW); beyond a short passage the number after the last word."""
        w = np.arange(a, b)
        k = np.searchsorted(self.first_window, w, "right") - 1
        at = (self.start[k] + w - self.first_window[k])[:, None] + np.arange(WINDOW)
        inside = at < self.start[k + 1][:, None]
        return np.where(inside, self.words[np.minimum(at, len(self.words) - 1)], len(self.vocabulary))


def document_frequencies(table: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many texts of ``table`` (words) each word of the vocabulary occurs, and the number of texts."""
    spark = table.sparkSession
    known = spark.createDataFrame(pd.DataFrame({"word": list(vocabulary), "no": list(vocabulary.values())}), "word string, no int")
    spread = table.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    df = np.zeros(len(vocabulary))
    for r in spread.join(known, "word").groupBy("no").count().toLocalIterator():  # a row per word of the slice
        df[r["no"]] = r["count"]
    return df, table.count()


def _vectors(w: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the words' rows of ``table`` (with a row of zeros at the end) for windows of words."""
    out = table[w[:, 0]].copy()
    for j in range(1, w.shape[1]):
        out += table[w[:, j]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def randomised_svd(passages: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the TF-IDF windows of passages (column ``words``): words x rank.

    Each pass multiplies A'A into a thin matrix: a partition adds up its
    windows' part, and only that words x (rank + OVERSAMPLE) matrix leaves it.
    Passages of a slice are few, so eight partitions make it.
    """
    d = len(vocabulary)
    width = min(d, rank + OVERSAMPLE)
    spark = passages.sparkSession
    few = passages.select("words").coalesce(8)

    def times(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((np.vstack([q * idf[:, None], np.zeros((1, q.shape[1]))]).astype(np.float32), np.append(idf, 0).astype(np.float32), vocabulary))

        def run(batches):
            from pyspark.taskcontext import TaskContext

            basis, weights, known = sent.value
            total = np.zeros(basis.shape, np.float32)
            for b in batches:
                own = Passages([t.split() for t in b.column("words").to_pylist()])
                back = np.array([known[w] for w in own.vocabulary] + [len(known)], np.int64)
                for a in range(0, int(own.first_window[-1]), 8192):
                    w = back[own.window_words(a, min(a + 8192, int(own.first_window[-1])))]
                    norm = np.sqrt(np.maximum((weights[w] ** 2).sum(1), 1e-12))
                    y = _vectors(w, basis) / (norm**2)[:, None]
                    for j in range(WINDOW):
                        order = np.argsort(w[:, j], kind="stable")
                        cut = np.flatnonzero(np.append(True, np.diff(w[order, j]) != 0))
                        total[w[order[cut], j]] += np.add.reduceat(y[order] * weights[w[order, j]][:, None], cut, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total[:-1].tobytes()], pa.binary())], ["salt", "v"])

        got = _tree_sum(few.mapInArrow(run, "salt bigint, v binary"), rounds=1, fan_in=8, kind=np.float32).reshape(q.shape)
        sent.unpersist()
        return got.astype(np.float64)

    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))
    for _ in range(POWER_ROUNDS):
        q, _ = np.linalg.qr(times(q))
    small = q.T @ times(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(values)[::-1][: min(rank, width)]
    return q @ vectors[:, top]


def threshold(passages: Passages, table: np.ndarray, shared: int, miss: float = MISS, seed: int = 11) -> float:
    """The cosine that all but ``miss`` of the windows keep with themselves when 12 - ``shared`` of their words become other ones.

    All windows of the passages are tried (several times if there are fewer than TRIALS), with other words drawn from the
    passages and with words unknown to them; the lower cosine counts.  Half of
    the damage is at an edge, as where a window reaches beyond a run, the rest
    anywhere.
    """
    r = np.random.default_rng(seed)
    hist = np.zeros((2, 2001))
    n = int(passages.first_window[-1])
    gone = WINDOW - shared
    for a in list(range(0, n, 8192)) * -(-TRIALS // n):
        w = passages.window_words(a, min(a + 8192, n))
        other = w.copy()
        edge = gone - gone // 2
        left = r.random(len(w)) < 0.5
        order = np.argsort(r.random((len(w), WINDOW - edge)), axis=1)[:, : gone // 2]
        at = np.concatenate([np.tile(np.arange(edge), (len(w), 1)), edge + order], axis=1)
        at = np.where(left[:, None], at, WINDOW - 1 - at)
        whole = _unit(_vectors(w, table))
        for kind, drawn in enumerate((passages.words[r.integers(0, len(passages.words), at.shape)], len(passages.vocabulary))):
            other[np.arange(len(w))[:, None], at] = drawn
            cos = (whole * _unit(_vectors(other, table))).sum(1)
            hist[kind] += np.bincount(np.clip(((cos + 1) * 1000).astype(np.int64), 0, 2000), minlength=2001)
    return min(float(np.searchsorted(np.cumsum(h), miss * h.sum(), "right")) for h in hist) / 1000 - 1


# --- alignment ---------------------------------------------------------------


def _reach(p: list, d: list, most: int) -> list[int]:
    """For e = 0, 1, ... errors: how many leading words of ``p`` can be consumed against ``d`` with at most e edits of whole words.

    Furthest-reaching alignment by diagonals; stops when all of ``p`` is consumed.
    """
    n, m = len(p), len(d)

    def slide(i: int, k: int) -> int:
        while i < n and 0 <= i + k < m and p[i] == d[i + k]:
            i += 1
        return i

    far = {0: slide(0, 0)}
    top = far[0]
    out = [top]
    for e in range(1, most + 1):
        if top >= n:
            break
        new: dict[int, int] = {}
        for k in range(-e, e + 1):
            best = -1
            if k in far and 0 <= far[k] + k < m:
                best = max(best, far[k] + 1)  # another word in its place
            if k + 1 in far:
                best = max(best, far[k + 1] + 1)  # missing in the document
            if k - 1 in far and far[k - 1] + k <= m:
                best = max(best, far[k - 1])  # added in the document
            if best >= 0 and best <= n and 0 <= best + k <= m:
                new[k] = slide(best, k)
                if new[k] > best:  # a run ends with a word that is the passage's own
                    top = max(top, new[k])
            if far.get(k, -1) > new.get(k, -1):
                new[k] = far[k]
        far = new
        out.append(top)
    return out


def longest_run(p: list, d: list, seeds: dict[tuple, list[int]] | None = None, min_run: int = MIN_RUN, errors_in: int = ERRORS_IN, at: list[tuple[int, int]] | None = None) -> int:
    """Length of a run of ``p`` in ``d`` with at most one error in ``errors_in`` words; 0 if none has ``min_run`` words.

    ``at``: the places (in ``p``, in ``d``) where both have the same block of
    SEED_WORDS words, by place in ``d``; found from ``seeds`` (``seeds_of(p)``)
    if not given.  A run with so few errors always holds such a block unharmed.
    """
    if at is None:
        at = [(i, j) for j in range(len(d) - SEED_WORDS + 1) for i in seeds.get(tuple(d[j : j + SEED_WORDS]), ())]
    most = len(p) // errors_in + 1
    seen: set[tuple[int, int]] = set()
    best = 0
    for i, j in at:
        if (i, j) in seen:
            continue
        n = SEED_WORDS
        seen.add((i, j))
        while i + n < len(p) and j + n < len(d) and p[i + n] == d[j + n]:
            n += 1
            seen.add((i + n - SEED_WORDS, j + n - SEED_WORDS))
        room = len(p) + most
        right = _reach(p[i + n :], d[j + n : j + n + room], most)
        left = _reach(p[:i][::-1], d[max(0, j - room) : j][::-1], most)
        for x, r in enumerate(right):
            for y, q in enumerate(left):
                run = n + r + q
                if run >= min_run and run >= errors_in * (x + y):
                    best = max(best, run)
    return best


def seeds_of(p: list) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for i in range(len(p) - SEED_WORDS + 1):
        out.setdefault(tuple(p[i : i + SEED_WORDS]), []).append(i)
    return out


# --- search ------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words, and one for all others, which aren't kept."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(vocabulary)
        self.other = len(vocabulary)

    def __missing__(self, word: str) -> int:
        return self.other


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of the range of each of their members, and the members."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


class _Index:
    """What a worker needs to search one slice of passages; made once per task from what was sent."""

    def __init__(self, passages: Passages, table: np.ndarray, latent: np.ndarray, floor: float, shared: int):
        self.p, self.table, self.latent, self.floor, self.rare = passages, table, latent, floor, WINDOW - shared + 1
        d = len(passages.vocabulary)
        self.numbers = _Numbers(passages.vocabulary)
        self.places = np.argsort(passages.words, kind="stable")
        self.count = np.append(np.bincount(passages.words, minlength=d), 0)
        self.first = np.append(0, np.cumsum(self.count))
        self.passage_of = np.repeat(np.arange(len(passages.n_windows)), np.diff(passages.start))
        self.grams, self.gram_places = self._blocks()

    def _hashes(self, flat: np.ndarray) -> np.ndarray:
        """Hash of every block of SEED_WORDS words; equality is decided on the words."""
        h = np.zeros(max(0, len(flat) - SEED_WORDS + 1), np.uint64)
        for i in range(SEED_WORDS):
            h = (h ^ flat[i : i + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _blocks(self) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes(self.p.words)
        at = np.arange(len(h))
        whole = self.passage_of[at] == self.passage_of[at + SEED_WORDS - 1]
        at = at[whole]
        order = np.argsort(h[at], kind="stable")
        return h[at][order], at[order]

    def near(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents, passages and cosines of pairs with a close window. flat: all words, sizes: words per document."""
        ends = np.cumsum(sizes)
        last = np.maximum(0, sizes - WINDOW)
        n = np.where(sizes > 0, -(-last // DOC_STRIDE) + 1, 0)
        doc, k = _spread(np.zeros(len(n), np.int64), n)
        begin = (ends - sizes)[doc] + np.minimum(k * DOC_STRIDE, last[doc])
        other = len(self.p.vocabulary)
        for c in range(0, len(doc), 32_768):
            of, at = doc[c : c + 32_768], begin[c : c + 32_768, None] + np.arange(WINDOW)
            w = np.where(at < ends[of][:, None], flat[np.minimum(at, len(flat) - 1)], other)
            rare = np.argpartition(self.count[w], self.rare - 1, axis=1)[:, : self.rare]
            which = np.take_along_axis(w, rare, axis=1)
            hits = self.count[which]
            some = np.flatnonzero(hits.any(1))
            if not len(some):
                continue
            of, w, rare, which, hits = of[some], w[some], rare[some], which[some], hits[some]
            x = _unit(_vectors(w, self.table))
            total = np.cumsum(hits.sum(1))
            a = 0
            while a < len(of):  # as many windows at once as have PAIRS pairs; one at least
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
                cell, slot = _spread(self.first[which[a:b]].ravel(), hits[a:b].ravel())
                place = self.places[slot]
                window = a + cell // self.rare
                passage = self.passage_of[place]
                row = np.clip(place - rare[a:b].ravel()[cell] - self.p.start[passage], 0, self.p.n_windows[passage] - 1) + self.p.first_window[passage]
                cos = np.empty(len(row), np.float32)
                for s in range(0, len(row), 16_384):
                    cos[s : s + 16_384] = np.einsum("ij,ij->i", x[window[s : s + 16_384]], self.latent[row[s : s + 16_384]].astype(np.float32))
                keep = np.flatnonzero(cos >= self.floor)
                if len(keep):
                    yield of[window[keep]], passage[keep], cos[keep]
                a = b

    def shared_blocks(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the passages, in the document) of equal blocks of SEED_WORDS words, by place in the document."""
        h = self._hashes(doc)
        lo, hi = np.searchsorted(self.grams, h, "left"), np.searchsorted(self.grams, h, "right")
        at, slot = _spread(lo, hi - lo)
        place = self.gram_places[slot]
        same = np.ones(len(at), bool)
        for i in range(SEED_WORDS):
            same &= self.p.words[place + i] == doc[at + i]
        return place[same], at[same]


def _search(batches: Iterator[pa.RecordBatch], sent, exact: bool) -> Iterator[pa.RecordBatch]:
    parts, *rest = sent.value
    index = _Index(Passages.again(parts), *rest)
    p = index.p
    for b in batches:
        docs, found = b.column("words").to_pylist(), []
        for lo in range(0, len(docs), 1024):
            toks = [t.split() for t in docs[lo : lo + 1024]]
            sizes = np.array([len(t) for t in toks], np.int64)
            flat = np.fromiter(map(index.numbers.__getitem__, chain.from_iterable(toks)), np.int32, count=int(sizes.sum()))
            pairs: dict[tuple[int, int], float] = {}
            for of, passage, cos in index.near(flat, sizes):
                key = of * len(p.n_windows) + passage
                order = np.lexsort((-cos, key))
                first = order[np.append(True, np.diff(key[order]) != 0)]
                for i, k, c in zip(of[first].tolist(), passage[first].tolist(), cos[first].tolist()):
                    pairs[i, k] = max(pairs.get((i, k), -1.0), c)
            by: dict[int, list[int]] = {}
            for i, k in pairs:
                by.setdefault(i, []).append(k)
            ends = np.cumsum(sizes)
            for i, near in by.items():
                doc = flat[ends[i] - sizes[i] : ends[i]]
                place, at = index.shared_blocks(doc)
                owner = index.passage_of[place]
                blocks: dict[int, list[tuple[int, int]]] = {}
                wanted = np.isin(owner, near)
                for k, x, j in zip(owner[wanted].tolist(), (place - p.start[owner])[wanted].tolist(), at[wanted].tolist()):
                    blocks.setdefault(k, []).append((x, j))
                own = doc.tolist() if blocks else []
                for k in blocks if exact else near:
                    run = longest_run(p.of(k), own, at=blocks[k]) if k in blocks else 0
                    if run or not exact:
                        found.append((lo + i, k, pairs[i, k], run))
        rows = pa.array([x[0] for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(rows), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3] for x in found], pa.int32())],
            ["id", "passage_no", "cosine", "run"],
        )


def find_leaks(docs: DataFrame, items: DataFrame, *, exact: bool = True, shared: int | None = None, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, run: items whose passage occurs in a document, in whole or in part.

    ``docs``: doc_id, text; ``items``: item_id, passage.  ``exact=False`` keeps
    every pair with a close window (candidates of paraphrases), with run 0
    where no run of 12 words was aligned.  ``shared``: words of a window of 12
    that a document must share in order to be found for sure.  Null, empty and
    wordless texts match nothing, nor do passages of fewer than 12 words
    (``exact=False``: fewer than five).  Repeated rows give repeated pairs.
    """
    spark = docs.sparkSession
    shared = shared or (SHARED if exact else LIKE)
    passages = word_table(items.select(F.xxhash64("passage").alias("h"), "passage").filter("passage is not null").dropDuplicates(["passage"]), "h", "passage")
    n_words = F.size(F.split("words", " "))
    queries = passages.select("words").filter(n_words >= (MIN_RUN if exact else SEED_WORDS)).distinct()
    size = queries.agg(F.sum(n_words)).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not size:
        return spark.createDataFrame([], f"doc_id {kind}, item_id {items.schema['item_id'].dataType.simpleString()}, cosine double, run int")
    queries = written(queries, "passages")
    table = word_table(docs, "doc_id", "text")
    slices = -(-size // SLICE_WORDS)
    out = None
    for k in range(slices):
        mine = queries.filter(F.pmod(F.xxhash64("words"), F.lit(slices)) == k)
        texts = [r[0] for r in mine.orderBy("words").collect()]  # about SLICE_WORDS words
        if not texts:
            continue
        p = Passages([t.split() for t in texts])
        df, n = document_frequencies(table, p.vocabulary)
        idf = np.log((n + 1) / (df + 1)) + 1e-3
        basis = randomised_svd(mine, p.vocabulary, idf, rank)
        vectors = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        total = int(p.first_window[-1])
        latent = np.concatenate([_unit(_vectors(p.window_words(a, min(a + 8192, total)), vectors)).astype(np.float16) for a in range(0, total, 8192)])
        sent = spark.sparkContext.broadcast((p.parts(), vectors, latent, threshold(p, vectors, shared), shared))
        hits = table.mapInArrow(lambda it, sent=sent: _search(it, sent, exact), f"id {kind}, passage_no int, cosine double, run int")
        names = spark.createDataFrame(list(enumerate(texts)), "passage_no int, words string")
        part = hits.join(names, "passage_no").select("id", "words", "cosine", "run")
        out = part if out is None else out.unionByName(part)
    by_words = items.select("item_id", "passage").join(_passage_words(items), "passage").select("item_id", "words")
    return out.join(by_words, "words").select(F.col("id").alias("doc_id"), "item_id", "cosine", "run")


def _passage_words(items: DataFrame) -> DataFrame:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            yield p.assign(words=[" ".join(words(t)) for t in p["passage"]])

    return items.select("passage").filter("passage is not null").distinct().mapInPandas(run, "passage string, words string")


def leaked(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id of every leak; one row per pair."""
    return find_leaks(docs, items, **how).select("doc_id", "item_id").distinct()


def paraphrases(docs: DataFrame, items: DataFrame, shared: int = LIKE) -> DataFrame:
    """Pairs with a close window but no exact run, decided by longest common subsequence and answer.

    The cosine only picks candidates: windows that share half of their words.
    Most of them are chance likenesses; all are returned with their checks.
    lcs_share: longest common subsequence of the document's words and the
    passage's, per word of the passage; answer_found: the item's answer, if it
    has more than one letter, occurs in the document as whole words;
    paraphrase: HALF of the passage's words (rounded down) occur in their
    order, or HALF_WITH_ANSWER of them and the answer.
    """
    near = find_leaks(docs, items, exact=False, shared=shared).filter("run = 0")
    near = near.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"))
    full = near.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "passage", "answer"), "item_id")

    def check(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            known = {t: words(t) for c in ("text", "passage", "answer") for t in p[c].unique()}  # a document has several candidates
            inside = {t: f" {' '.join(known[t])} " for t in p["text"].unique()}
            share, seen, decided = [], [], []
            for text, passage, answer in zip(p["text"], p["passage"], p["answer"]):
                q, a = known[passage], known[answer]
                common = lcs_length(q, known[text])
                share.append(common / max(1, len(q)))
                seen.append(sum(map(len, a)) > 1 and f" {' '.join(a)} " in inside[text])
                decided.append(common >= max(1, int(len(q) * (HALF_WITH_ANSWER if seen[-1] else HALF))))
            yield pd.DataFrame({"doc_id": p["doc_id"], "item_id": p["item_id"], "cosine": p["cosine"], "lcs_share": share, "answer_found": seen, "paraphrase": decided})

    return full.mapInPandas(check, "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean, paraphrase boolean")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, a bit per word of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    v = full = (1 << len(a)) - 1
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()
