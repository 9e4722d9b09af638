"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word (a run of letters, lower-cased, with the
vocabulary's word mark before it) scores the sum over all its segmentations of the product of piece probabilities, by
the forward algorithm; a text scores the sum of its words' logs. Unknown characters have a floor, so every word has a
segmentation. A word may have any length: the algorithm keeps a window of the longest piece and rescales it, so nothing underflows.

The piece probabilities are learned by expectation-maximisation (forward-backward, in logarithms) over training rows, a sample of at
most about ``MAX_TRAIN`` per language chosen by the hash of the id, which is materialised once; expected counts are summed by Spark, so
the driver receives languages x vocabulary numbers. The distinct words of a worker are scored together, once (``MAX_KNOWN``).

Expected counts and log scores are whole steps of 1 / ``SCALE``, so sums are exact: the model and the result of a row don't depend
on the rows beside it. The model (``PART`` languages of the vocabulary at a time, so of a bounded size) goes to the tasks as broadcast
variables.

Defined cases: null text or text without a letter is ``und`` with score 0; ties go to the first language in order;
no training rows: every text is ``und``; repeated rows are judged each; an empty table gives no rows; other columns
that the caller keeps pass through, an input column with an output's name is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm import textkit as tk

MAX_TRAIN = 2000
MAX_KNOWN = 1 << 18
#: Steps of a log score and of an expected count.
SCALE = 1 << 20
#: Languages of one broadcast variable.
PART = 64
#: Characters times languages of words that are worked on together.
CELLS = 1 << 20
ROUNDS = 2
FLOOR = 1e-7
SMOOTH = 0.5
CHUNK = 4 << 20

_LETTERS = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as sorted piece hashes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = sorted({p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]})
        self.size = len(names)
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, name in enumerate(names):
            h = 0
            for ch in name:
                h = (h * int(_MULT) + ord(ch) + 1) & ((1 << 64) - 1)
            by[len(name)].append((h, number))
        self.by_length = {n: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)], np.int64)) for n, v in by.items()}
        self.longest = max(self.by_length)

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Piece number of each substring hash, or ``size`` where there is none."""
        if length not in self.by_length:
            return np.full(len(hashes), self.size)
        keys, numbers = self.by_length[length]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, numbers[at], self.size)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def mark(word: str) -> str:
    return "▁" + word


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of code points + 1, padded by 0, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(words), int(lengths.max(initial=1))), np.uint64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat.astype(np.uint64) + np.uint64(1)
    return out, lengths


def _matches(vocabulary: Pieces, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Piece number of the substring of k + 1 characters that ends at each place (k, place, word); ``size`` where there is none."""
    n, width = codes.shape
    prefix = np.zeros((width + 1, n), np.uint64)
    for j in range(width):
        prefix[j + 1] = prefix[j] * _MULT + codes[:, j]
    out = np.full((min(width, vocabulary.longest), width, n), vocabulary.size, np.int32)
    inside = np.arange(1, width + 1)[:, None] <= lengths
    for k in range(1, len(out) + 1):
        power = np.uint64(pow(int(_MULT), k, 1 << 64))
        found = vocabulary.find((prefix[k:] - prefix[:-k] * power).reshape(-1), k).reshape(width - k + 1, n)
        out[k - 1, k - 1 :] = np.where(inside[k - 1 :], found, vocabulary.size)
    return out


def batches_of(words: list[str], cells: int) -> Iterator[np.ndarray]:
    """Places of words of like length whose padded characters are at most ``cells``, or of one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        step = max(1, cells // max(1, int(lengths[order[lo]])))
        hi = min(len(order), lo + step)
        while hi - lo > 1 and (hi - lo) * int(lengths[order[hi - 1]]) > cells:
            hi = lo + max(1, (hi - lo) // 2)
        yield order[lo:hi]
        lo = hi


def forward(vocabulary: Pieces, words: list[str], probability: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations, word by language."""
    out = np.zeros((len(words), probability.shape[1]))
    table = np.vstack([np.maximum(probability, 0), np.zeros((1, probability.shape[1]))])
    for rows in batches_of(words, max(64, CELLS // max(1, probability.shape[1]))):
        out[rows] = _forward(vocabulary, [words[i] for i in rows.tolist()], table)
    return out


#: Sums below ``_TINY`` are carried on times its inverse.
_TINY = 1e-150


def _forward(vocabulary: Pieces, words: list[str], table: np.ndarray) -> np.ndarray:
    codes, lengths = _codes(words)
    found = _matches(vocabulary, codes, lengths)
    depth, width, n = found.shape
    # The sums of the last ``depth`` places, newest last; words are in the order of their lengths.
    window = np.zeros((depth, n, table.shape[1]))
    window[-1] = 1
    raised = np.zeros((n, table.shape[1]))
    out = np.zeros((n, table.shape[1]))
    for end in range(width):
        going = int(np.searchsorted(lengths, end + 1))
        total = np.maximum(table[found[0, end, going:]], FLOOR) * window[-1, going:]
        for k in range(1, min(end + 1, depth)):
            hit = np.flatnonzero(found[k, end, going:] < vocabulary.size)
            if len(hit):
                total[hit] += table[found[k, end, going:][hit]] * window[-1 - k, going:][hit]
        window[:-1, going:] = window[1:, going:]
        window[-1, going:] = total
        low = total < _TINY
        if low.any():
            word, language = np.nonzero(low)
            window[:, going + word, language] /= _TINY
            raised[going + word, language] += np.log(_TINY)
        ended = slice(going, int(np.searchsorted(lengths, end + 1, "right")))
        out[ended] = np.log(window[-1, ended]) + raised[ended]
    return out


def expected(vocabulary: Pieces, words: list[str], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in steps of 1 / ``SCALE``, summed over the words by ``weights``, for one language."""
    out = np.zeros(vocabulary.size + 1)
    table = np.log(np.maximum(np.append(probability, 0), 1e-300))
    for rows in batches_of(words, CELLS // 32):
        codes, lengths = _codes([words[i] for i in rows.tolist()])
        found = _matches(vocabulary, codes, lengths)
        depth, width, n = found.shape
        steps = [(end, k, hit, found[k, end, hit]) for end in range(width) for k in range(min(end + 1, depth)) for hit in [np.flatnonzero((found[k, end] < vocabulary.size) | ((k == 0) & (lengths > end)))] if len(hit)]
        logs = [np.maximum(table[f], np.log(FLOOR)) if k == 0 else table[f] for _, k, _, f in steps]
        alpha, beta = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        beta[lengths, np.arange(n)] = 0
        for (end, k, hit, _), p in zip(steps, logs, strict=True):
            alpha[end + 1, hit] = np.logaddexp(alpha[end + 1, hit], alpha[end - k, hit] + p)
        for (end, k, hit, _), p in zip(reversed(steps), reversed(logs), strict=True):
            beta[end - k, hit] = np.logaddexp(beta[end - k, hit], beta[end + 1, hit] + p)
        total = alpha[lengths, np.arange(n)]
        for (end, k, hit, f), p in zip(steps, logs, strict=True):
            share = np.exp(alpha[end - k, hit] + p + beta[end + 1, hit] - total[hit])
            out += np.bincount(f, np.rint(share * SCALE) * weights[rows[hit]], minlength=len(out))
    return out[:-1]


@dataclass(frozen=True)
class Model:
    """Languages in order, and piece by language probabilities."""

    languages: list[str]
    probability: np.ndarray
    path: str

    def send(self, context: SparkContext) -> Sent:
        parts = [np.ascontiguousarray(self.probability[:, at : at + PART]) for at in range(0, len(self.languages), PART)]
        return Sent(self.languages, [context.broadcast(p) for p in parts], self.path)


@dataclass(frozen=True)
class Sent:
    """A model whose numbers are broadcast variables."""

    languages: list[str]
    parts: list[Broadcast]
    path: str

    def probability(self) -> np.ndarray:
        return np.hstack([p.value for p in self.parts]) if self.parts else np.zeros((0, 0))


def fit(docs: DataFrame, path: str, *, text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN, order: Column | None = None) -> Model:
    """Learns from ``docs``, whose rows are all training rows; ``order`` is what a row is sampled by."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # A row a language, of which the world has some thousands.
    counted = sorted((r[lang], r["n"]) for r in usable.groupBy(lang).agg(F.count("*").alias("n")).collect())
    languages = [c for c, _ in counted]
    vocabulary = pieces(path)
    if not languages:
        return Model([], np.zeros((vocabulary.size, 0)), path)
    # A row is in the sample if its hash lies in its language's share.
    share = F.create_map(*(x for c, n in counted for x in (F.lit(c), F.lit(min(1.0, max_train / n)))))
    place = F.pmod(F.xxhash64(order if order is not None else F.col(text)), F.lit(1 << 20)) / float(1 << 20)
    tk.checkpoint_dir(docs.sparkSession)
    sample = usable.filter(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).checkpoint()
    number = {c: i for i, c in enumerate(languages)}
    probability = np.full((vocabulary.size, len(languages)), 1.0 / vocabulary.size)
    for _ in range(ROUNDS):
        sent = Model(languages, probability, path).send(docs.sparkSession.sparkContext)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = pieces(path)
            current = sent.probability()
            total = np.zeros((own.size, len(languages)))
            for batch in batches:
                words: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
                for code, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    tally = words[number[code]]
                    for word in _LETTERS.findall(body.lower()):
                        tally[mark(word)] += 1
                for i, tally in words.items():
                    listed = list(tally)
                    for lo in range(0, len(listed), 20_000):
                        some = listed[lo : lo + 20_000]
                        total[:, i] += expected(own, some, np.array([tally[w] for w in some], float), current[:, i])
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language].astype(np.int64))], names=["piece", "language", "uses"])

        rows = sample.mapInArrow(count, "piece int, language int, uses long").groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(probability.shape, SMOOTH / vocabulary.size)
        uses[rows["piece"], rows["language"]] += rows["uses"] / SCALE
        probability = uses / uses.sum(axis=0)
    return Model(languages, probability, path)


class Scorer:
    """Scores words once per worker."""

    def __init__(self, model: Sent):
        self.model, self.pieces, self.probability = model, pieces(model.path), model.probability()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.int64)
        self.lettered = np.zeros(0, bool)

    def words(self, words: list[str]) -> None:
        """Adds new words to the table, in steps of 1 / ``SCALE``."""
        scores = np.rint(forward(self.pieces, [mark(w) for w in words], self.probability) * SCALE).astype(np.int64)
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
        scores[~lettered] = 0
        self.table, self.lettered = np.vstack([self.table, scores]), np.append(self.lettered, lettered)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.number) > MAX_KNOWN:
            self.forget()
        number, new, found = self.number, [], []
        for text in texts:
            words = _LETTERS.findall(text.lower())
            for word in words:
                if word not in number:
                    number[word] = len(number)
                    new.append(word)
            found.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        if new:
            self.words(new)
        rows = np.concatenate([np.zeros(0, np.int64), *found])
        bounds = tk.sums(np.array([len(f) for f in found], np.int64))
        totals = np.stack([np.diff(tk.sums(self.table[rows, k])[bounds]) for k in range(self.table.shape[1])], axis=1) / SCALE
        some = np.diff(tk.sums(self.lettered[rows])[bounds]) > 0
        best = totals.argmax(axis=1)
        share = 1 / np.exp(np.minimum(0, totals - totals.max(axis=1, keepdims=True))).sum(axis=1)
        return [self.model.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, share, 0.0)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    taken = docs.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*(taken.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = taken.columns.index(text)

    sent = model.send(docs.sparkSession.sparkContext)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent)
        for batch in batches:
            for lo, hi, buf, offs in tk.chunks(batch.column(at), CHUNK):
                raw, ends = buf.tobytes(), offs.tolist()
                found, score = scorer.judge([raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(kept)], pa.array(found, pa.string()), pa.array(score)], names=schema.names)

    return taken.mapInArrow(judge, schema)
