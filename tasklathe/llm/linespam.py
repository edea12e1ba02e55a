"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

A text is cut into lines: at line breaks, at ends of sentences, and every
``LINE_WORDS`` words where neither comes.  A line is reduced to nine small
categorical features: share of links, hash tags, product codes, separators; its
vocabulary; how it ends; how often its words recur in the text; length; words
said twice in a row.

Which words belong to sentences is learnt from the corpus, in any language: of
every word that enough documents have it is counted how often it stands in
lines that are built like sentences (they end like one and hold no links, tags
or codes) and in lines that are built like lists (of links, tags, codes or
separated items, or with doubled words).  Words with more of sentences than the
average one are sentence words, words with far less are list words.  A line's
vocabulary is the share of sentence words among the words known as one or the
other.

A hidden Markov model with the states prose, link list, tag list and menu labels
the lines; a page is flagged if its non-prose lines hold more than half of its
words.  The model starts from the tables below, which say what each kind of line
looks like, and is fitted to the whole corpus by expectation maximisation: every
pass adds up expected counts over all documents (a fixed number of figures), and
each new table is a mixture of what the corpus shows and the starting table, so
that states keep their meaning whatever the corpus holds.

Null and blank texts have no lines and are never flagged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklathe.llm.leakage import _tree_sum
from tasklathe.shared import written

STATES = ("prose", "link list", "tag list", "menu")
LINE_WORDS = 24
# The first seven are a line's own; the last two need the vocabulary and the page.
BINS = (3, 3, 3, 3, 3, 4, 2, 5, 4)  # links, tags, codes, separators, ending, length, doubling, vocabulary, recurrence
OWN = int(np.prod(BINS[:7]))
ROUNDS = 2
ANCHOR = 0.5  # weight of the starting tables
NON_PROSE = 0.5
SPREAD = 0.0005  # share of documents that must have a word for it to be known; so at most (distinct words of a mean document) / SPREAD words are
LIST_ODDS = 0.1  # odds of standing in a sentence and not in a list, against the average word's, up to which a word is a list word
PRIOR = 10  # times that a word is taken to have been seen like the average one, before it is counted
KNOWN = 0.3  # share of a line's words that must be known for its vocabulary to say anything
MAX_COUNTED = 200_000  # words that a task counts before it hands its counts on

# What lines of each kind look like, per feature and bin, one row per state.
LOOKS = (
    # share of links: none, some, most
    ((0.96, 0.03, 0.01), (0.002, 0.198, 0.80), (0.90, 0.08, 0.02), (0.90, 0.08, 0.02)),
    # share of hash tags
    ((0.97, 0.02, 0.01), (0.96, 0.03, 0.01), (0.75, 0.05, 0.20), (0.96, 0.03, 0.01)),
    # share of product codes
    ((0.96, 0.03, 0.01), (0.96, 0.03, 0.01), (0.70, 0.10, 0.20), (0.60, 0.30, 0.10)),
    # share of separators
    ((0.90, 0.08, 0.02), (0.80, 0.15, 0.05), (0.60, 0.20, 0.20), (0.05, 0.15, 0.80)),
    # ends like a sentence: no, yes, not known because it was cut
    ((0.20, 0.70, 0.10), (0.67, 0.03, 0.30), (0.66, 0.04, 0.30), (0.67, 0.03, 0.30)),
    # words in it: up to 3, up to 8, more, cut for its length
    ((0.20, 0.30, 0.40, 0.10), (0.30, 0.20, 0.20, 0.30), (0.05, 0.15, 0.50, 0.30), (0.25, 0.20, 0.25, 0.30)),
    # a word or a pair of words twice in a row: no, yes
    ((0.98, 0.02), (0.93, 0.07), (0.75, 0.25), (0.92, 0.08)),
    # vocabulary: unknown, list words, mostly list words, mostly sentence words, sentence words
    ((0.06, 0.015, 0.035, 0.14, 0.75), (0.35, 0.40, 0.15, 0.06, 0.04), (0.13, 0.55, 0.19, 0.09, 0.04), (0.18, 0.50, 0.19, 0.09, 0.04)),
    # recurrence in the text of its words that are no sentence words: once, twice, a few times, often
    ((0.58, 0.26, 0.11, 0.05), (0.50, 0.25, 0.15, 0.10), (0.12, 0.19, 0.28, 0.41), (0.10, 0.25, 0.30, 0.35)),
)
START = (0.76, 0.08, 0.08, 0.08)
STAY = 0.9

_LINK = regex.compile(r"""<a\s[^<>]*+>|</a>|\[[^\[\]\n]*+\]\([^()\s]++\)|(?:https?://|www\.)\S++|(?<![\w@-])[\w-]++(?:\.[\w-]++)++(?:/[\w\-./?=&%+#~]*+)?+""", regex.I)
_LINKED = re.compile(r"\w\.\w|<[aA]|\]\(|www\.|://")
_ANCHOR = regex.compile(r"<a\s[^<>]*+>[^<>]*+</a>", regex.I)
_TAG = regex.compile(r"#[^\s#,;|]++")
_DIGITS = re.compile(r"\d\d")
_CODE = regex.compile(r"(?<![^\W_])[A-Z][A-Z0-9]*+(?:[-_/][A-Z0-9]++)*+(?![^\W_])")
_SIGN = re.compile(r"[|·•»›→]|\s[>/\-–—*;+]\s|;\s|\s,\s")
_SEPARATOR = regex.compile(r"[|·•»›→]|(?<=\s)[>/\-–—*,;+](?=\s)|,(?=\s)|;(?=\s)|\s/\s")
_CUT_ASCII = re.compile(r"""\n+|(?<=[.!?])\s+|(?<=[.!?]["')\]])\s+|(?<=[.!?]["')\]]{2})\s+""")
_CUT = re.compile(r"""\n+|(?<=[.!?…。！？])\s+|(?<=[.!?…。！？]["'”»)\]])\s+|(?<=[.!?…。！？]["'”»)\]]{2})\s+|(?<=[。！？])""")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
_PIECE = regex.compile(r"([\p{Hiragana}\p{Katakana}\p{Han}ー]++)|[^\W_\p{Hiragana}\p{Katakana}\p{Han}]++")
_RUN = re.compile(r"[^\W_]+")
_CLOSERS, _ENDS = "\"'”»)] \t\r", frozenset(".!?…。！？")


def lines_of(text: str) -> Iterator[tuple[str, bool]]:
    """Lines of a text, and whether they were cut for their length: at line breaks and ends of sentences, and every LINE_WORDS words."""
    for piece in (_CUT_ASCII if text.isascii() else _CUT).split(text):
        if not piece or piece.isspace():
            continue
        parts = piece.split(None, LINE_WORDS)
        if len(parts) <= LINE_WORDS:
            yield piece, False
        else:
            parts = piece.split()
            for a in range(0, len(parts), LINE_WORDS):
                yield " ".join(parts[a : a + LINE_WORDS]), True


def tokens_of(line: str) -> list[str]:
    """Words of a line in lower case; of a script without spaces, its pairs of neighbouring signs."""
    runs = _RUN.findall(line.lower())
    if line.isascii() or not _CJK.search(line):
        return runs
    out: list[str] = []
    for run in runs:
        for m in _PIECE.finditer(run):
            piece = m[0]
            if m[1] and len(piece) > 2:
                out += [piece[i : i + 2] for i in range(len(piece) - 1)]
            else:
                out.append(piece)
    return out


def _share(x: float) -> int:
    return 0 if x < 0.08 else 1 if x < 0.4 else 2


def signs_of(text: str) -> tuple[bool, bool, bool, bool]:
    """May there be links, tags, codes, separators other than commas in a text? Most texts have none, and their lines needn't be searched."""
    return bool(_LINKED.search(text)), "#" in text, bool(_DIGITS.search(text)), bool(_SIGN.search(text))


def own_features(line: str, words: list[str], cut: bool, may: tuple[bool, bool, bool, bool] = (True,) * 4) -> int:
    """The first seven features of a line as one number (mixed radix BINS). may: what to look for (``signs_of`` its text)."""
    n, size = len(words), max(1, len(line))
    rest, linked, tags, codes = line, 0, 0, 0
    if may[0] and _LINKED.search(line):
        rest = _LINK.sub(" ", _ANCHOR.sub(" ", line))
        linked = len(line) - len(rest) + (line.count("](") + line.lower().count("<a ")) * 2
    if may[1] and "#" in rest:
        tags = sum(map(len, _TAG.findall(rest)))
    if may[2] and _DIGITS.search(rest):
        codes = sum(len(c) for c in _CODE.findall(rest) if _DIGITS.search(c))
    signs = len(_SEPARATOR.findall(rest)) if may[3] and _SIGN.search(rest) else rest.count(", ")
    doubled = False
    if len(set(words)) < n:
        pairs = list(zip(words, words[1:]))
        doubled = any(map(eq, words, words[1:])) or any(map(eq, pairs, pairs[2:]))
    end = line.rstrip(_CLOSERS)[-1:] in _ENDS
    code = (_share(min(1.0, linked / size)) * 3 + _share(tags / size)) * 3 + _share(codes / size)
    code = (code * 3 + _share(2 * signs / n)) * 3 + (1 if end else 2 if cut else 0)
    return (code * 4 + (3 if cut else 0 if n <= 3 else 1 if n <= 8 else 2)) * 2 + doubled


def lines_with_features(text: str) -> tuple[list[int], list[str]]:
    """Per line of a text that has words: its own features, and its words joined by spaces."""
    codes, kept = [], []
    may = signs_of(text)
    for line, cut in lines_of(text):
        words = tokens_of(line)
        if words:
            codes.append(own_features(line, words, cut, may))
            kept.append(" ".join(words))
    return codes, kept


def is_sentence(code: np.ndarray) -> np.ndarray:
    """Is a line built like a sentence, by its own features: it ends like one, has more than three words and no links, tags or codes?"""
    length, end, free = code // 2 % 4, code // 8 % 3, code // 72
    return (end == 1) & (length > 0) & (free == 0)


def is_list(code: np.ndarray) -> np.ndarray:
    """Is a line built like a list: mostly links, tags or codes, or of separated items or doubled words without the end of a sentence?"""
    doubled, end, signs, free = code % 2, code // 8 % 3, code // 24 % 3, code // 72
    return (((doubled == 1) | (signs == 2)) & (end != 1)) | (free % 3 == 2) | (free // 3 % 3 == 2) | (free // 9 == 2)


SENTENCE, LISTED = 1, 2


class Vocabulary:
    """Sentence words and list words of a corpus."""

    def __init__(self, sentence: set[str], listed: set[str]):
        self.kind = dict.fromkeys(sentence, SENTENCE) | dict.fromkeys(listed, LISTED)
        self.sentence = sentence

    @property
    def listed(self) -> set[str]:
        return {w for w, k in self.kind.items() if k == LISTED}

    def features(self, lines: list[list[str]]) -> list[int]:
        """The last two features of every line of a text, as one number."""
        often = Counter(chain.from_iterable(lines))
        out = []
        for line in lines:
            kinds = list(map(self.kind.get, line))
            good = kinds.count(SENTENCE)
            known = good + kinds.count(LISTED)
            if known < KNOWN * len(line):
                vocabulary = 0
            else:
                s = good / known
                vocabulary = 1 if s < 0.2 else 2 if s < 0.45 else 3 if s < 0.75 else 4
            rest = [often[w] for w in line if w not in self.sentence]
            again = sum(6 if x > 6 else x for x in rest) / len(rest) if rest else 2.0
            out.append(vocabulary * 4 + (again >= 1.5) + (again >= 2.5) + (again >= 3.5))
        return out


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, codes (own features), words (arrays with one entry per line) as a written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lines_with_features(t) if t else ([], []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.string()))], ["doc_id", "codes", "words"])

    return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, codes array<int>, words array<string>"), "lines")


def word_counts(lines: DataFrame) -> DataFrame:
    """word, docs (texts that have it), sentences and lists (times in lines built like these), over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sentences, lists = Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(docs)
            cols = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (docs, sentences, lists))]
            for c in (docs, sentences, lists):
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "docs", "sentences", "lists"])

        for b in batches:
            flat = b.column("codes").flatten().to_numpy()
            good, bad = is_sentence(flat).tolist(), is_list(flat).tolist()
            at = 0
            for text in b.column("words").to_pylist():
                if not text:
                    continue
                to = at + len(text)
                whole = " ".join(text).split()
                docs.update(set(whole))
                fine = good[at:to]
                sentences.update(whole if all(fine) else " ".join(compress(text, fine)).split())
                if True in bad[at:to]:
                    lists.update(" ".join(compress(text, bad[at:to])).split())
                at = to
                if len(docs) > MAX_COUNTED:
                    yield flush()
        yield flush()

    part = lines.select("codes", "words").mapInArrow(run, "word string, docs bigint, sentences bigint, lists bigint")
    return part.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("docs", "sentences", "lists")))


def vocabulary(lines: DataFrame) -> Vocabulary:
    """The corpus' sentence and list words."""
    counts = written(word_counts(lines), "words")
    every = counts.agg(F.sum("sentences").alias("s"), F.sum("lists").alias("l")).first()
    n_docs = lines.filter(F.size("codes") > 0).count()
    if not n_docs:
        return Vocabulary(set(), set())
    share = (every["l"] + 1) / (every["s"] + every["l"] + 2)  # of words that stand in lists
    odds = (F.col("sentences") + PRIOR * (1 - share)) / (F.col("lists") + PRIOR * share)
    usual = (1 - share) / share
    known = counts.filter(F.col("docs") >= SPREAD * n_docs).filter("sentences > 0 or lists > 0").select("word", (odds / F.lit(usual)).alias("odds"))
    sentence, listed = set(), set()
    for r in known.filter((F.col("odds") >= 1) | (F.col("odds") <= LIST_ODDS)).toLocalIterator():  # bounded by SPREAD
        (sentence if r["odds"] >= 1 else listed).add(r["word"])
    return Vocabulary(sentence, listed)


def bins_of(codes: np.ndarray) -> np.ndarray:
    """Bins (n x features) of feature codes."""
    out = np.empty((len(codes), len(BINS)), np.int64)
    for j in range(len(BINS) - 1, -1, -1):
        codes, out[:, j] = np.divmod(codes, BINS[j])
    return out


N_CODES = int(np.prod(BINS))


class Model:
    """Start, transition and emission tables of the hidden Markov model."""

    def __init__(self, start: np.ndarray, step: np.ndarray, looks: list[np.ndarray]):
        self.start, self.step, self.looks = start, step, looks

    @staticmethod
    def initial() -> Model:
        k = len(STATES)
        step = np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1))
        return Model(np.array(START), step, [np.array(x) for x in LOOKS])

    def emission(self) -> np.ndarray:
        """Probability of every feature code in every state (codes x states)."""
        bins = bins_of(np.arange(N_CODES))
        out = np.ones((N_CODES, len(STATES)))
        for j, table in enumerate(self.looks):
            out *= table[:, bins[:, j]].T
        return out

    def mixed(self, counts: np.ndarray) -> Model:
        """The next model: expected counts of the corpus, mixed with the initial tables (their share: ANCHOR)."""
        k, first = len(STATES), Model.initial()
        mix = lambda got, base: np.where(got.sum(-1, keepdims=True) > 0, (1 - ANCHOR) * got / np.maximum(got.sum(-1, keepdims=True), 1e-12) + ANCHOR * base, base)
        start, step = counts[:k], counts[k : k + k * k].reshape(k, k)
        codes = counts[k + k * k :].reshape(N_CODES, k)
        bins = bins_of(np.arange(N_CODES))
        looks = []
        for j, base in enumerate(first.looks):
            got = np.stack([np.bincount(bins[:, j], codes[:, s], BINS[j]) for s in range(k)])
            looks.append(mix(got, base))
        return Model(mix(start, first.start), mix(step, first.step), looks)


def posteriors(docs: list[np.ndarray], model: Model, emission: np.ndarray, counts: np.ndarray | None = None) -> list[np.ndarray]:
    """State probabilities of every line of every document (forward-backward over documents side by side).

    counts: if given, expected counts (start, step, codes) are added to it.
    """
    k = len(STATES)
    out: list[np.ndarray] = [np.zeros((0, k))] * len(docs)
    order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: len(docs[i]))
    for c in range(0, len(order), 256):
        some = order[c : c + 256]
        size = np.array([len(docs[i]) for i in some])
        n, top = len(some), int(size[-1])
        codes = np.zeros((n, top), np.int64)
        for r, i in enumerate(some):
            codes[r, : size[r]] = docs[i]
        e = emission[codes]
        live = np.arange(top)[None, :] < size[:, None]
        e[~live] = 1.0
        fwd, bwd = np.empty((n, top, k)), np.ones((n, top, k))
        a = model.start[None, :] * e[:, 0]
        fwd[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, top):
            a = (fwd[:, t - 1] @ model.step) * e[:, t]
            fwd[:, t] = a / a.sum(1, keepdims=True)
        for t in range(top - 2, -1, -1):
            b = (e[:, t + 1] * bwd[:, t + 1]) @ model.step.T
            b[~live[:, t + 1]] = 1.0
            bwd[:, t] = b / b.sum(1, keepdims=True)
        post = fwd * bwd
        post /= post.sum(2, keepdims=True)
        if counts is not None:
            counts[:k] += post[:, 0].sum(0)
            for t in range(1, top):
                x = fwd[:, t - 1, :, None] * model.step[None] * (e[:, t] * bwd[:, t])[:, None, :]
                x /= x.sum((1, 2), keepdims=True)
                counts[k : k + k * k] += x[live[:, t]].sum(0).ravel()
            np.add.at(counts[k + k * k :].reshape(N_CODES, k), codes[live], post[live])
        for r, i in enumerate(some):
            out[i] = post[r, : size[r]]
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, codes, sizes (arrays with one entry per line) as a written table."""
    lines = line_table(docs)
    known = vocabulary(lines)
    sent = docs.sparkSession.sparkContext.broadcast((known.sentence, known.listed))  # plain data, for executors that don't have this package
    kind = lines.schema["doc_id"].dataType.simpleString()
    places = BINS[7] * BINS[8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Vocabulary(*sent.value)
        for b in batches:
            codes, sizes = [], []
            for own, text in zip(b.column("codes").to_pylist(), b.column("words").to_pylist()):
                words = [t.split(" ") for t in text]
                codes.append([c * places + x for c, x in zip(own, words_of.features(words))])
                sizes.append([len(w) for w in words])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(codes, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "codes", "sizes"])

    return written(lines.mapInArrow(run, f"doc_id {kind}, codes array<int>, sizes array<int>"), "features")


def _arrays(col: pa.Array) -> list[np.ndarray]:
    flat, at = col.flatten().to_numpy(), col.offsets.to_numpy()
    return np.split(flat.astype(np.int64), (at[1:-1] - at[0])) if len(col) else []


def fit(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over all documents; the driver gets one vector of counts a round."""
    model = Model.initial()
    k = len(STATES)
    for _ in range(rounds):

        def run(batches, model=model):
            from pyspark.taskcontext import TaskContext

            counts, emission = np.zeros(k + k * k + N_CODES * k), model.emission()
            for b in batches:
                posteriors(_arrays(b.column("codes")), model, emission, counts)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["salt", "v"])

        got = _tree_sum(table.select("codes").mapInArrow(run, "salt bigint, v binary"))
        if got is not None:
            model = model.mixed(got)
    return model


def page_shares(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_lines, n_words, non_prose (share of words in lines labelled link list, tag list or menu), main_kind (the state with most words)."""
    table = feature_table(docs)
    model = fit(table, rounds)
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = model.emission()
        for b in batches:
            codes, sizes = _arrays(b.column("codes")), _arrays(b.column("sizes"))
            post = posteriors(codes, model, emission)
            by = np.array([np.bincount(p.argmax(1), s, len(STATES)) if len(s) else np.zeros(len(STATES)) for p, s in zip(post, sizes)]).reshape(-1, len(STATES))
            n = by.sum(1)
            share = np.where(n > 0, 1 - by[:, 0] / np.maximum(n, 1), 0.0)
            main = [STATES[i] if m else None for i, m in zip(by.argmax(1), n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(c) for c in codes], pa.int64()), pa.array(n.astype(np.int64)), pa.array(share), pa.array(main, pa.string())],
                ["doc_id", "n_lines", "n_words", "non_prose", "main_kind"],
            )

    return table.mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_words bigint, non_prose double, main_kind string")


def spam_pages(docs: DataFrame, over: float = NON_PROSE) -> DataFrame:
    """Pages of which more than the share ``over`` of the words is no prose."""
    return page_shares(docs).filter(F.col("non_prose") > over)
