"""Toxicity by a support vector machine over a subsequence string kernel.

Words are compared by the gap-weighted subsequence kernel: all subsequences of
three letters count, each gap costing a factor, so an insult with letters put
in between stays close to the plain one. Landmarks are the words that tell toxic
labels best from clean ones, better than chance among so many words, each among the texts
that the ones before leave unexplained; their kernel matrix K gives the Nystroem map
k(word, landmarks) K^-1/2. A text is the largest kernel value of its words to
each landmark. A linear support vector machine with squared hinge loss is trained
on the mapped texts and its margin is turned into a probability.

Words are what stands between white space, and the parts of it that punctuation
joins. Every word of three to ``MAX_LETTERS`` letters is compared with every landmark
through a table of the landmarks' letter triples. A word more than twice as long as a landmark
is compared by overlapping pieces of twice the landmark too, the largest value counting, if it
has the share ``SHARED`` of the letters of a landmark of that length. Values below ``FLOOR``
count as none; a word that no landmark reaches that far, by the least norm of its length, gets none of its
own norm computed. Kernel rows of words are kept in a memo of bounded size in each worker.

The fit uses about ``max_labels`` labelled rows, taken by a hash of the id; that
is its only bound, and every text is scored whole.

Defined cases: null and empty texts have no words and get the score of a text
without signs; null labels are ignored, contradicting ones count as toxic; with
no labels, or labels of one kind only, the score is the share of toxic ones (0
without any). Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import annotate, id_remainder, kept, plain, read_table, saved

MAX_LABELS = 12_000
LANDMARKS = 128
CANDIDATES = 4  # words for each landmark to choose from
FEWEST = 16
ORDER, DECAY, SHARPNESS = 3, 0.7, 4
MAX_LETTERS = 32
SHARED = 0.6
PIECES = 20_000
FLOOR = 1e-3  # smaller values count as none
SMALL = FLOOR ** (1 / SHARPNESS)
ROWS, CELLS = 2_000, 60_000  # words, and triples of letters in words, that are worked on at a time
MEMO_WORDS, MEMO_ROWS = 400_000, 50_000
RIDGE = 1.0

_LETTERS = re.compile(r"[\W_]+")
_SINGLE = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_EDGES = ".,;:!?'\"()[]{}<>-_*/\u2026\u2019\u201c\u201d\u00ab\u00bb"
_FIELDS = [T.StructField("score", T.DoubleType())]


# --- words ----------------------------------------------------------------------


def word_of(chunk: str) -> str:
    """Letters and digits of a chunk, in lower case."""
    return _LETTERS.sub("", chunk).lower()


def chunks_of(text: str) -> set[str]:
    """Distinct words of a text: chunks between white space, their parts between punctuation, and runs of single letters written as one."""
    text = text.lower()
    found = set(text.split())
    odd = [c for c in found if not c.isalnum()]
    found.difference_update(odd)
    for c in odd:
        word = c.strip(_EDGES)
        if not word.isalnum():
            parts = [p for p in _LETTERS.split(c) if p]
            word = "".join(parts)
            if len(parts) > 1:
                found.update(p for p in parts if len(p) >= ORDER)
        found.add(word)
    if any(len(c) == 1 for c in odd) or any(len(c) == 1 for c in found):
        found.update(word_of("".join(run.split())) for run in _SINGLE.findall(text))
    found.discard("")
    return found


# --- kernel ---------------------------------------------------------------------


def coded(words: list[str]) -> np.ndarray:
    """Code points in rows of equal length, filled up with zeros."""
    width = max([1, *map(len, words)])
    flat = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "replace")
    return np.frombuffer(flat, np.uint32).reshape(len(words), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of row pairs of two code arrays; s may be one row for all of t."""
    n, rows = t.shape[1], len(t)
    t = np.ascontiguousarray(t.T)
    filled = t > 0
    place = np.arange(n)
    fade = np.tril(np.float32(DECAY) ** np.maximum(place[:, None] - place, 0).astype(np.float32))
    once, total = np.float32(DECAY * DECAY), np.zeros(rows, np.float32)
    # before[i][b]: common subsequences of i + 1 letters in the letters of s so far and the first b of t, faded to their ends
    before = [np.zeros((n + 1, rows), np.float32) for _ in range(ORDER - 1)]
    for a in range(s.shape[1]):
        same = ((t == s[:, a]) & filled).astype(np.float32)
        same *= once
        total += np.einsum("br,br->r", same, before[-1][:-1])
        for i in reversed(range(ORDER - 1)):
            ended = same * before[i - 1][:-1] if i else same
            before[i] *= np.float32(DECAY)
            before[i][1:] += fade @ ended
    return total


def least_norm(n: int) -> float:
    """What the kernel of any word of n letters with itself is at least: each place with itself."""
    return sum((n - span + 1) * (span - 2) * DECAY ** (2 * span) for span in range(ORDER, n + 1))


def letters_of(codes: np.ndarray) -> np.ndarray:
    """Bit sets of letters, hashed to 64 bits."""
    bits = np.where(codes > 0, np.uint64(1) << (codes.astype(np.uint64) % np.uint64(61)), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


@lru_cache(maxsize=MAX_LETTERS)
def places(n: int) -> tuple[np.ndarray, ...]:
    """First and second places of pairs in n letters; pair, third place and fade of triples."""
    first, second = np.triu_indices(n, 1)
    pair, third = np.nonzero(second[:, None] < np.arange(n))
    return first, second, pair, third, (DECAY ** (third - first[pair] + 1)).astype(np.float32)


class Landmarks:
    """Kernel values of words to the landmarks, sharpened to a power.

    The subsequences of three letters of all landmarks stand in one table with a row for each
    that some landmark has. A word looks up its own triples there, first pairs and
    then third letters, and adds up the rows found, which is the kernel with every landmark.
    """

    def __init__(self, words: list[str]) -> None:
        self.words = words
        codes = [coded([w]) for w in words]
        self.letters = np.array([letters_of(c)[0] for c in codes], np.uint64)
        self.need = np.ceil(SHARED * np.bitwise_count(self.letters)).astype(np.int64)
        self.length = np.array([len(w) for w in words])
        self.norm = np.array([max(1e-9, float(subsequence_kernel(c, c)[0])) for c in codes])
        alphabet = np.unique(np.concatenate([np.zeros(1, np.uint32), *[c[0] for c in codes]]))
        self.letter = np.zeros(int(alphabet[-1]) + 2, np.int64)
        self.letter[alphabet] = np.arange(len(alphabet))
        self.width = len(alphabet)
        found: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for mark, code in enumerate(codes):
            ids = self._ids(code)[0].tolist()
            first, second, pair, third, fade = places(len(ids))
            for a, b, k, w in zip(first[pair].tolist(), second[pair].tolist(), third.tolist(), fade.tolist()):
                row = found.setdefault((ids[a], ids[b]), {}).setdefault(ids[k], np.zeros(len(words), np.float32))
                row[mark] += w
        self.pair = np.zeros(self.width**2, np.int32)
        self.triple = np.zeros((len(found) + 1) * self.width, np.int32)
        table = [np.zeros(len(words), np.float32)]
        for k, ((a, b), thirds) in enumerate(found.items(), 1):
            self.pair[a * self.width + b] = k
            for c, row in thirds.items():
                self.triple[k * self.width + c] = len(table)
                table.append(row)
        self.table = np.array(table)

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        return self.letter[np.minimum(codes, len(self.letter) - 1)]

    def _products(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Kernel of words of one length with the landmarks whose columns the table has."""
        first, second, pair, third, fade = places(codes.shape[1])
        out = np.zeros((len(codes), table.shape[1]), np.float32)
        step = max(1, CELLS // max(1, len(fade)))
        for lo in range(0, len(codes), step):
            ids = self._ids(codes[lo : lo + step])
            pairs = self.pair[ids[:, first] * self.width + ids[:, second]]
            triples = self.triple[pairs[:, pair] * self.width + ids[:, third]]
            row, at = np.nonzero(triples)
            if len(row):
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                out[lo + row[starts]] = np.add.reduceat(table[triples[row, at]] * fade[at, None], starts)
        return out

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not self.words:
            return out
        whole = [k for k, w in enumerate(words) if ORDER <= len(w) <= MAX_LETTERS]
        self._compare(out, whole, [words[k] for k in whole], np.arange(len(self.words)))
        least = max(2 * int(self.length.min()), ORDER - 1)
        longer = sorted((k for k, w in enumerate(words) if len(w) > least), key=lambda k: len(words[k]))
        lengths = np.array([len(words[k]) for k in longer], np.int64)
        brief = int(np.searchsorted(lengths, MAX_LETTERS, "right"))
        each = [letters_of(coded([words[k]])) for k in longer[brief:]]
        letters = np.concatenate([letters_of(coded([words[k] for k in longer[:brief]]))[:brief], *each])
        for n in np.unique(self.length).tolist():
            marks = np.flatnonzero(self.length == n)
            near = (np.bitwise_count(letters[:, None] & self.letters[marks]) >= self.need[marks]).any(axis=1)
            long = [longer[k] for k in np.flatnonzero(near & (lengths > 2 * n)).tolist()]
            pieces = ((k, words[k][at : at + 2 * n]) for k in long for at in range(0, len(words[k]) - n, n))
            for some in batched(pieces, PIECES):
                self._compare(out, [k for k, _ in some], [p for _, p in some], marks)
        return out

    def _compare(self, out: np.ndarray, owner: list[int], words: list[str], marks: np.ndarray) -> None:
        """Raises the rows of the owners of words to the values of the words to some landmarks."""
        index, lengths, table = np.array(owner, np.int64), np.array([len(w) for w in words], np.int64), self.table[:, marks]
        order = np.argsort(lengths, kind="stable")
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            alike = order[np.searchsorted(lengths[order], n) : np.searchsorted(lengths[order], n, "right")]
            for lo in range(0, len(alike), ROWS):
                at = alike[lo : lo + ROWS]
                codes = coded([words[k] for k in at.tolist()])
                value = self._products(codes, table) / np.sqrt(self.norm[marks])
                some = np.flatnonzero(value.max(axis=1) > SMALL * math.sqrt(least_norm(n)))
                if len(some):
                    own = subsequence_kernel(codes[some], codes[some])
                    near = (value[some] / np.sqrt(own)[:, None]) ** SHARPNESS
                    place = np.ix_(index[at[some]], marks)
                    if len(np.unique(place[0])) == len(some):
                        out[place] = np.maximum(out[place], near)
                    else:
                        np.maximum.at(out, place, near)


def pool_of(landmarks: tuple[str, ...]) -> Pool:
    """One memo for the tasks of a worker process."""
    return kept(("kernel rows", landmarks), lambda: Pool(list(landmarks)))


class Pool:
    """Largest kernel values of a text's words to each landmark.

    Words without a value and rows of those with one are kept, at most MEMO_WORDS and
    MEMO_ROWS of them, and the older half goes when a memo is full.
    """

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = Landmarks(landmarks)
        self.nothing: tuple[set[str], set[str]] = (set(), set())
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [chunks_of(t).difference(*self.nothing) for t in texts]
        missing = sorted(set().union(*words).difference(self.known))
        values = self.landmarks.rows(missing)
        filled = values.max(axis=1, initial=0) > FLOOR
        fresh = {missing[k]: values[k] for k in np.flatnonzero(filled).tolist()}
        out = np.zeros((len(texts), values.shape[1]), np.float32)
        for k, found in enumerate(words):
            rows = [r for w in found if (r := self.known.get(w, fresh.get(w))) is not None]
            if rows:
                out[k] = np.max(rows, axis=0)
        self._keep([w for w, has in zip(missing, filled.tolist()) if not has], fresh)
        return out

    def _keep(self, nothing: list[str], fresh: dict[str, np.ndarray]) -> None:
        self.nothing[0].update(w for w in nothing if len(w) <= MAX_LETTERS)
        if len(self.nothing[0]) > MEMO_WORDS // 2:
            self.nothing = (set(), self.nothing[0] if MEMO_WORDS else set())
        self.known.update((w, row.copy()) for w, row in fresh.items() if len(w) <= MAX_LETTERS)
        if len(self.known) > MEMO_ROWS:
            self.known = dict(list(self.known.items())[MEMO_ROWS // 2 :]) if MEMO_WORDS else {}


# --- fit ------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the kernel values, the Nystroem map included
    bias: float
    slope: float
    shift: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        margin = pooled @ self.weights + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


@dataclass(frozen=True)
class Constant:
    landmarks: list[str]
    share: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return np.full(len(pooled), self.share)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model | Constant:
    """A model of labels (doc_id, toxic) over the texts of docs."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = max_labels / max(1, known.count())
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))
    sample = docs.select("doc_id", "text").join(F.broadcast(known.where(taken)), "doc_id").select("text", "toxic").distinct()
    sample = saved(sample, "labelled")
    counts = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_clean = sum(n for k, n in counts.items() if k > 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return Constant([], n_toxic / max(1, n_toxic + n_clean))
    landmarks = telling_words(sample, n_toxic, n_clean)

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = pool_of(tuple(landmarks))
        for p in frames:
            for lo in range(0, len(p), 500):
                part = p.iloc[lo : lo + 500]
                yield pd.DataFrame({"toxic": part.toxic, "values": list(pool(part.text.fillna("").tolist()))})

    data = sample.repartition(32).mapInPandas(pooled, "toxic int, values array<float>").toPandas()
    return trained(landmarks, np.stack(data["values"]).astype(np.float64), data.toxic.to_numpy() > 0)


def telling_words(sample: DataFrame, n_toxic: int, n_clean: int, count: int = LANDMARKS) -> list[str]:
    """Words whose share of toxic texts is largest against that of clean ones, by likelihood ratio."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            found = [(w, y) for t, y in zip(p.text.fillna(""), p.toxic) for w in chunks_of(t)]
            yield pd.DataFrame(found, columns=["word", "toxic"]).astype({"word": "object", "toxic": "int32"})

    seen = sample.mapInPandas(words, "word string, toxic int").where(F.length("word").between(ORDER, MAX_LETTERS))
    seen = seen.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    rate = (F.col("t") + F.col("c")) / (n_toxic + n_clean)
    gain = F.col("t") * F.log(F.col("t") / (rate * n_toxic)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (rate * n_clean))).otherwise(0)
    seen = seen.where((F.col("t") > 1) & (F.col("t") / n_toxic > 2 * F.col("c") / n_clean))
    seen = saved(seen.withColumn("gain", gain), "words")
    chance = math.log(max(1, seen.count()))
    best = seen.orderBy(F.desc("gain"), "word").limit(CANDIDATES * count).collect()
    best = [r.word for k, r in enumerate(best) if k < FEWEST or r.gain > chance]

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            found = (chunks_of(t) for t in p.text.fillna(""))
            yield pd.DataFrame({"toxic": p.toxic, "held": [np.packbits([w in f for w in best]).tobytes() for f in found]})

    rows = sample.mapInPandas(held, "toxic int, held binary").toPandas()
    bits = np.frombuffer(b"".join(map(bytes, rows.held)), np.uint8).reshape(len(rows), -1)
    chosen = chosen_words(np.unpackbits(bits, axis=1)[:, : len(best)].astype(bool), rows.toxic.to_numpy() > 0, chance, count)
    return [best[k] for k in chosen]


def chosen_words(held: np.ndarray, toxic: np.ndarray, chance: float, count: int) -> list[int]:
    """Columns in the order chosen: each tells most among the texts that hold none of those chosen before.

    A family of copies that shares many words gets few of them. The first FEWEST by order are taken in any case.
    """
    left, chosen = np.ones(len(toxic), bool), []
    while len(chosen) < min(count, held.shape[1]):
        t, c = held[left & toxic].sum(axis=0).astype(float), held[left & ~toxic].sum(axis=0).astype(float)
        n_toxic, n_clean = (left & toxic).sum(), (left & ~toxic).sum()
        rate = np.maximum(t + c, 1) / max(1, n_toxic + n_clean)
        gain = t * np.log(np.maximum(t, 1) / np.maximum(rate * n_toxic, 1e-9)) + c * np.log(np.maximum(c, 1) / np.maximum(rate * n_clean, 1e-9))
        gain[t * n_clean <= 2 * c * n_toxic] = 0
        best = int(np.argmax(gain))
        if gain[best] <= chance:
            break
        chosen.append(best)
        left &= ~held[:, best]
    rest = [k for k in range(held.shape[1]) if k not in chosen]
    return chosen + rest[: max(0, FEWEST - len(chosen))]


def trained(landmarks: list[str], pooled: np.ndarray, toxic: np.ndarray) -> Model | Constant:
    if not landmarks:
        return Constant([], float(toxic.mean()))
    own = Landmarks(landmarks).rows(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    x = np.hstack([pooled @ root, np.ones((len(pooled), 1))])
    y = np.where(toxic, 1.0, -1.0)
    cost = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(y)
    w = np.zeros(x.shape[1])
    penalty = RIDGE * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):  # Newton steps; the set of points inside the margin settles after a few
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(penalty + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    slope, shift = platt(x @ w, toxic)
    return Model(landmarks, root @ w[:-1], float(w[-1]), slope, shift)


def platt(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, with smoothed targets."""
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    z = np.column_stack([margin, np.ones(len(margin))])
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (p - target) + 1e-3 * v)
        v -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(v[0], 1e-3)), float(v[1])


# --- scores ---------------------------------------------------------------------


def score(docs: DataFrame, model: Model | Constant, carry: list[str] | None = None) -> DataFrame:
    """Documents with their score; the carried columns are in the struct column ``common.ROW``."""

    def make():
        pool = pool_of(tuple(model.landmarks))

        def work(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
            pooled = pool([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()])
            return [pa.array(model.scores(pooled.astype(np.float64)), pa.float64())]

        return work

    return annotate(docs, _FIELDS, make, docs.columns if carry is None else carry)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows that may be learned from: those with remainder 0 are held out."""
    return read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_remainder("doc_id", 5) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, training_labels(spark, sf_dir)), ["doc_id"])
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    scored = plain(scored, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model | Constant) -> DataFrame:
    """The documents that score below one half, as they came."""
    return plain(score(docs, model).where("score < 0.5"))
