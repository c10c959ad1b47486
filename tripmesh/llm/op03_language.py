"""Language by cross-parsing entropy against suffix automata of labelled text.

For each language a suffix automaton of sample text accepts all its substrings.
A text is parsed greedily: a phrase goes on while the automaton of a language
accepts it and ends where it does not. Few, long phrases mean a language that
has said this before: the count of phrases times log2 of the sample's length,
per letter, estimates the cross entropy, and the smallest one wins. Texts are
parsed in segments of 1024 letters, a phrase ending with its segment, so a very
long text is many segments and all segments of a slice move in step.

The sample is bounded: ``sample_chars`` letters per language, or all it has, from
distinct texts in the order of a hash, so copies count once however many they
are. Every text is scored whole.

Letters are lower-cased; runs of anything else become one blank. Defined cases:
a text that is null or without letters is ``und`` with score 0, as is every text
if no language was learned; equal costs go to the first language by name;
repeated rows get equal answers; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.llm.common import annotate, id_remainder, plain, read_table, saved

SAMPLE_CHARS = 24_000
SEGMENT = 1024
UNKNOWN = "und"
MAX_ORDER = 1 << 30

_OTHER = re.compile(r"[\W\d_]+")
_NAMES = ["lang", "order", "key", "letters"]
_TAKEN = [pa.string(), pa.int64(), pa.int64(), pa.string()]
_FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def letters_of(text: str) -> str:
    """Lower-case letters with single blanks between words; empty without a letter."""
    return _OTHER.sub(" ", text).lower().strip()


@dataclass(frozen=True)
class Samples:
    """Sample letters by language, in order of name."""

    languages: tuple[str, ...]
    texts: tuple[str, ...]


class FirstTexts:
    """Of the texts of a language that are offered, the first by hash that hold ``chars`` letters. Copies count once."""

    def __init__(self, chars: int) -> None:
        self.chars, self.letters, self.limit = chars, 0, MAX_ORDER
        self.kept: list[tuple[int, int, str]] = []
        self.known: set[int] = set()

    def offer(self, order: int, key: int, text: bytes) -> None:
        if key in self.known or not (found := letters_of(text.decode("utf-8", "replace"))[: self.chars]):
            return
        insort(self.kept, (order, key, found))
        self.known.add(key)
        self.letters += len(found)
        while self.letters - len(self.kept[-1][2]) >= self.chars:
            _, key, last = self.kept.pop()
            self.known.discard(key)
            self.letters -= len(last)
        if self.letters >= self.chars:
            self.limit = self.kept[-1][0]


def learn(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Samples:
    """Samples of docs (text, lang); the rows that may not be learned from are left out by the caller.

    One scan: each task keeps the first texts by hash of each language that hold
    ``sample_chars`` letters. The first ones of all are among them, as fewer
    letters come before them in a task than in the whole.
    """
    key = F.xxhash64("text")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", F.pmod(key, F.lit(MAX_ORDER)).alias("order"), key.alias("key"), F.col("text").cast("binary").alias("text")
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, FirstTexts] = {}
        for batch in batches:
            langs, order, keys, texts = batch.columns
            coded = langs.dictionary_encode()
            mine = [found.setdefault(k, FirstTexts(sample_chars)) for k in coded.dictionary.to_pylist()]
            code, order = coded.indices.to_numpy(), order.to_numpy()
            limits = np.array([m.limit for m in mine], np.int64)
            for k in np.flatnonzero(order <= limits[code]).tolist():
                if order[k] <= mine[code[k]].limit:
                    mine[code[k]].offer(int(order[k]), keys[k].as_py(), texts[k].as_py())
        for lang, texts in found.items():
            columns = zip(*[(lang, *t) for t in texts.kept])
            yield from [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TAKEN)], names=_NAMES)] if texts.kept else []

    taken = saved(known.mapInArrow(first, "lang string, order long, key long, letters string"), "sample")
    before = Window.partitionBy("lang").orderBy("order", "key", "letters").rowsBetween(Window.unboundedPreceding, -1)
    some = taken.distinct().withColumn("before", F.coalesce(F.sum(F.length("letters")).over(before), F.lit(0)))
    texts: dict[str, list[str]] = defaultdict(list)
    for r in some.where(F.col("before") < sample_chars).orderBy("lang", "order", "key", "letters").toLocalIterator():
        texts[r.lang].append(r.letters)
    found = {k: " ".join(v)[:sample_chars] for k, v in texts.items()}
    return Samples(tuple(sorted(found)), tuple(found[k] for k in sorted(found)))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def packed(step: list[dict[int, int]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Transitions in one row of slots: that of state s by code c is in slot base[s] + c. Bases differ.

    Returns the bases, and for each slot the state that owns it (-1: none) and where it leads.
    """
    order = sorted(range(len(step)), key=lambda s: -len(step[s]))
    top = max((c for out in step for c in out), default=0)
    size = 2 * sum(map(len, step)) + len(step) + 2 * top + 2
    free, unused = np.ones(size, bool), np.ones(size, bool)
    owner, target = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    base, low = [0] * len(step), {}
    for s in order:
        codes = np.array(sorted(step[s]), np.int64)
        at = low.get(len(codes), 0)
        while True:
            here = np.arange(at, min(at + 256, size - top - 1))
            if not len(here):  # no place is left: more slots
                free, unused = np.pad(free, (0, size), constant_values=True), np.pad(unused, (0, size), constant_values=True)
                owner, target = np.pad(owner, (0, size), constant_values=-1), np.pad(target, (0, size))
                size *= 2
                continue
            good = unused[here]
            for c in codes.tolist():
                good = good & free[here + c]
            if good.any():
                break
            at += 256
        base[s] = int(here[good.argmax()])
        low[len(codes)] = at
        unused[base[s]] = False
        free[base[s] + codes] = False
        owner[base[s] + codes] = s
        target[base[s] + codes] = [step[s][c] for c in codes.tolist()]
    return base, owner, target


class Parser:
    """All automata in one row of slots. A state is the number of its first slot; 0 stands for no way on.

    A slot holds the state that owns it in the upper half and the next state in the lower one.
    """

    def __init__(self, samples: Samples) -> None:
        self.samples = samples
        letters = sorted(set("".join(samples.texts)))
        self.symbols = np.zeros(0x110000, np.int32)  # 0: a letter of no sample, which ends every phrase
        for k, c in enumerate(letters, 1):
            self.symbols[ord(c)] = k
        slots, self.starts, at = [np.zeros(1, np.int64)], [], 1
        for text in samples.texts:
            base, owner, target = packed(suffix_automaton([int(self.symbols[ord(c)]) for c in text]))
            state = np.array(base, np.int64) + at
            slots.append(np.where(owner < 0, 0, state[owner] << 32 | state[target]))
            self.starts.append(int(state[0]))
            at += len(owner)
        self.slots = np.concatenate([*slots, np.zeros(len(letters) + 1, np.int64)])
        self.cost = np.log2([max(2, len(t)) for t in samples.texts])

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        slot = self.slots[state + codes]
        return np.where(slot >> 32 == state, slot & 0xFFFFFFFF, 0)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text by each language."""
        lengths = np.array([len(t) for t in texts])
        codes = self.symbols[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
        n = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = (np.cumsum(lengths) - lengths)[row] + nth * SEGMENT
        size = np.minimum(SEGMENT, lengths[row] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        start = np.repeat(np.array(self.starts, np.int64)[:, None], len(row), axis=1)
        state, begun = start.copy(), np.zeros(start.shape, np.int32)
        live = len(row)
        for k in range(SEGMENT if len(size) else 0):
            while live and size[live - 1] <= k:
                live -= 1
            if not live:
                break
            c = codes[begin[:live] + k].astype(np.int64)
            now = self.step(state[:, :live], c)
            stuck = now == 0
            begun[:, :live] += stuck | (state[:, :live] == start[:, :live])
            again = self.step(start[:, :live], c)
            np.copyto(now, again, where=stuck)
            state[:, :live] = np.where(now == 0, start[:, :live], now)
        total = np.zeros((len(texts), len(self.starts)))
        np.add.at(total, row, begun.T)
        return total


@lru_cache(maxsize=1)
def parser_of(samples: Samples) -> Parser:
    """The automata are built once in each worker process."""
    return Parser(samples)


def predict(docs: DataFrame, samples: Samples, carry: list[str] | None = None) -> DataFrame:
    """Documents with lang_pred and score; the carried columns are in ``common.ROW``."""

    def make():
        parser = parser_of(samples) if samples.languages else None

        def work(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
            found = [letters_of((t or b"").decode("utf-8", "replace")) for t in texts.to_pylist()]
            if parser is None:
                return [pa.array([UNKNOWN] * len(found), pa.string()), pa.array(np.zeros(len(found)))]
            cost = parser.phrases(found) * parser.cost
            best = cost.argmin(axis=1)
            # Costs are bits; a language's share falls by a factor of e for each 8 bits more.
            weight = np.exp(-(cost - cost.min(axis=1, keepdims=True)) / 8)
            score = weight.max(axis=1) / weight.sum(axis=1)
            names = [samples.languages[k] if t else UNKNOWN for k, t in zip(best, found)]
            return [pa.array(names, pa.string()), pa.array(np.where([bool(t) for t in found], score, 0.0))]

        return work

    return annotate(docs, _FIELDS, make, docs.columns if carry is None else carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    samples = learn(docs.where(~held_out).select("text", "lang"))
    found = predict(docs.select("doc_id", "text", held_out.alias("held_out")), samples, ["doc_id", "held_out"])
    return plain(found, "lang_pred", "score")
