"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, lower-cased) has a potential per language from hashed character n-grams (2 to 4, with the word's boundaries, so
those at a boundary are its prefixes and suffixes) and from a lexicon of training words; adjacent words have a learned transition table.
Forward-backward gives each word's language marginals, also in code-switched text; a document's language has the greatest sum of
marginals, its score is the mean of them.

The model is fitted on the driver by the likelihood's gradient, on at most ``per_lang`` whole documents and ``per_lang_chars`` characters
a language (those with the smallest hash of their id; longer documents aren't trained on), cut into stretches of many lengths that are
strung together across languages, so transitions are learned from code-switching. The ``max_langs`` languages with the most documents
are learned; a document of another is given the learned one that fits best. Prediction covers whole texts, in slices of
SLICE characters or one longer text; only texts go to Python, all other columns stay where they are.

Nulls: a null text, one without letters, and any text where nothing could be learned give ``und`` with score and certainty 0. A null
lang isn't trained on. Ties go to the first language by code point. Repeated rows are independent in prediction; in training they
count as rows of one document. Empty table: no rows. Extra columns may have any name.
"""
from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 16
STEP = 64  # words of a training sequence
SLICE = 2_000_000  # characters predicted at once, but for a longer single text


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def words_of(text: str | None) -> list[str]:
    """Empty unless there is a letter."""
    found = LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words without repeats: (place of the word, feature) of all n-grams, and a 64-bit hash of each word."""
    c = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = c == 10
    owner = np.cumsum(gap) - 1
    at, feat = [], []
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            ok = np.ones(len(h), bool)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + c[k : len(h) + k]
                if 0 < k < n - 1:
                    ok &= ~gap[k : len(h) + k]
            ok &= owner[: len(h)] < len(words)
            at.append(owner[: len(h)][ok])
            feat.append((_mix(h[ok]) & np.uint64((1 << BITS) - 1)).astype(np.int64))
        power = np.cumprod(np.full(len(c), 0x9E3779B97F4A7C15, np.uint64))
        total = np.concatenate([[0], np.cumsum(_mix(c + np.uint64(7)) * power)]).astype(np.uint64)
        edge = np.flatnonzero(gap)
        inverse = np.cumprod(np.full(len(c), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))
        whole = _mix((total[edge[1:]] - total[edge[:-1] + 1]) * inverse[edge[:-1]])
    return np.concatenate(at), np.concatenate(feat), whole


class Crf:
    def __init__(self, langs: list[str], lexicon: np.ndarray) -> None:
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon  # sorted hashes of words
        self.w = np.zeros((1 << BITS, k), np.float64)
        self.lex = np.zeros((len(lexicon) + 1, k), np.float64)  # the last row is for unknown words and stays 0
        self.trans = np.zeros((k, k))

    def _known(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(whole), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, at, len(self.lexicon))

    def potentials(self, grams: tuple, n: int) -> np.ndarray:
        at, feat, whole = grams
        out = self.lex[self._known(whole)]
        out = out + np.stack([np.bincount(at, self.w[feat, k], n) for k in range(len(self.langs))], 1)
        return np.exp(np.clip(out, -30, 30))

    def marginals(self, pot: np.ndarray, word: np.ndarray, length: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Marginals of the words of sequences laid one after the other; with pairs, also the summed pair marginals.

        Sequences go in step, longest first, so each step is one operation on all that are that long; a step's words lie together.
        """
        k, t = pot.shape[1], np.exp(self.trans)
        order = np.argsort(-length, kind="stable")
        size = length[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        upto = np.concatenate([[0], np.cumsum(active)])
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length))
        place = upto[np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)] + np.repeat(rank, length)
        p = np.empty((len(word), k))
        p[place] = pot[word]
        a, b = np.empty((len(word), k)), np.empty((len(word), k))
        upto, active = upto.tolist(), active.tolist()
        x = None
        for i, n in enumerate(active):
            at = slice(upto[i], upto[i + 1])
            x = p[at] if x is None else (x[:n] @ t) * p[at]
            x = x / x.sum(1, keepdims=True)
            a[at] = x
        joint = np.zeros((k, k)) if pairs else None
        y = np.ones((0, k))
        for i in range(len(active) - 1, -1, -1):
            n, at = active[i], slice(upto[i], upto[i + 1])
            if len(y) < n:
                y = np.concatenate([y, np.ones((n - len(y), k))])
            b[at] = y
            if i:
                z = y * p[at]
                if pairs:
                    j = a[upto[i - 1] : upto[i - 1] + n][:, :, None] * t * z[:, None, :]
                    joint += (j / j.sum((1, 2), keepdims=True)).sum(0)
                y = z @ t.T
                y = y / y.sum(1, keepdims=True)
        m = a * b
        return (m / m.sum(1, keepdims=True))[place], joint

    def fit(self, sequences: list[tuple[list[str], list[int]]], rounds: int = 40, rate: float = 0.3, l2: float = 1e-4) -> "Crf":
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in sequences for w in ws))}
        grams = ngrams(list(vocabulary))
        known = self._known(grams[2])
        word = np.array([vocabulary[w] for ws, _ in sequences for w in ws])
        gold = np.array([y for _, ys in sequences for y in ys])
        length = np.array([len(ws) for ws, _ in sequences])
        k, n = len(self.langs), len(vocabulary)
        first = np.zeros(len(word), bool)
        first[np.cumsum(length) - length] = True
        follows = np.flatnonzero(~first)
        real = np.bincount(gold[follows - 1] * k + gold[follows], minlength=k * k).reshape(k, k)
        store = {"w": np.full_like(self.w, 1e-6), "lex": np.full_like(self.lex, 1e-6), "trans": np.full_like(self.trans, 1e-6)}
        for _ in range(rounds):
            m, joint = self.marginals(self.potentials(grams, n), word, length, True)
            g = -m
            g[np.arange(len(word)), gold] += 1
            per = np.stack([np.bincount(word, g[:, j], n) for j in range(k)], 1)
            grad = {"w": np.stack([np.bincount(grams[1], per[grams[0], j], 1 << BITS) for j in range(k)], 1), "lex": np.stack([np.bincount(known, per[:, j], len(self.lex)) for j in range(k)], 1), "trans": real - joint}
            grad["lex"][-1] = 0
            for name, d in grad.items():
                v = getattr(self, name)
                d = d - l2 * v
                store[name] += d * d
                v += rate * d / np.sqrt(store[name])
        return self

    def predict(self, docs: list[list[str]]) -> list[tuple[str, float, float]]:
        """(lang, score, certainty) of word lists, none of which is empty. certainty: mean of each word's greatest marginal."""
        if not docs:
            return []
        length = np.array([len(d) for d in docs])
        vocabulary: dict[str, int] = defaultdict(itertools.count().__next__)
        word = np.fromiter(map(vocabulary.__getitem__, itertools.chain.from_iterable(docs)), np.int64, int(length.sum()))
        pot = self.potentials(ngrams(list(vocabulary)), len(vocabulary))
        m, _ = self.marginals(pot, word, length)
        start = np.cumsum(length) - length
        mean = np.add.reduceat(m, start) / length[:, None]
        sure = np.minimum(1.0, np.add.reduceat(m.max(1), start) / length)
        best = mean.argmax(1)
        return [(self.langs[j], float(min(1.0, mean[i, j])), float(sure[i])) for i, j in enumerate(best)]


def sample(docs: DataFrame, per_lang: int, per_lang_chars: int, max_langs: int) -> DataFrame:
    """lang, text and rank of the training documents, at most per_lang rows and per_lang_chars characters a language.

    Ids are ranked first, each once (map-side limits of the rank), texts are joined to few ids, and the rows, of which an id may have
    many, are ranked again.
    """
    fit = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).filter("lang is not null and doc_id is not null").filter(F.length("text") <= per_lang_chars).filter(~held_out(F.col("doc_id")))
    langs = F.broadcast(fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).select("lang"))
    ids = fit.join(langs, "lang", "left_semi").select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    pick = ids.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_lang)
    pick = F.broadcast(pick.select(F.col("doc_id").alias("_i"), F.col("lang").alias("_g"), "_r"))  # at most per_lang rows a language
    rows = fit.join(pick, (F.col("doc_id") == F.col("_i")) & (F.col("lang") == F.col("_g"))).select("lang", "text", "_r")
    order = Window.partitionBy("lang").orderBy("_r", F.xxhash64("text"), "text")
    rows = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_lang)
    upto = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_c", upto).filter(F.col("_c") <= per_lang_chars).select("lang", "text", "_r")


def train(docs: DataFrame, per_lang: int = 120, per_lang_chars: int = 1_000_000, max_langs: int = 256, seed: int = 5) -> Crf | None:
    """None if there is nothing to learn from."""
    rows = sample(docs, per_lang, per_lang_chars, max_langs).collect()  # at most max_langs * per_lang_chars characters
    by: dict[str, list[list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r.lang.encode(), r._r, r.text)):
        if w := words_of(r.text):
            by.setdefault(r.lang, []).append(w)
    if not by:
        return None
    langs, rnd = list(by), np.random.default_rng(seed)
    stretches = []
    for y, lang in enumerate(langs):
        for w in by[lang]:
            at = 0
            while at < len(w):
                n = int(rnd.choice((3, 8, 20, 40, 80)))
                stretches.append((w[at : at + n], y))
                at += n
    flat = [(w, y) for i in rnd.permutation(len(stretches)) for w in stretches[i][0] for y in (stretches[i][1],)]
    seqs = [([w for w, _ in flat[i : i + STEP]], [y for _, y in flat[i : i + STEP]]) for i in range(0, len(flat), STEP)]
    counts: dict[str, int] = {}
    for w, _ in flat:
        counts[w] = counts.get(w, 0) + 1
    often = [w for w, c in counts.items() if c >= 3]
    lexicon = np.unique(ngrams(often)[2]) if often else np.zeros(0, np.uint64)
    return Crf(langs, lexicon).fit(seqs)


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in order, in lists of at most SLICE bytes of UTF-8 unless a single text is longer."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        yield texts.slice(at, end - at).to_pylist()
        at = end


def _by_size(texts: pa.Array) -> pa.Array:
    """Places of the texts, shortest first: a slice takes as many steps as its longest text has words, so texts of like sizes go together."""
    import pyarrow.compute as pc

    return pa.array(np.argsort(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), kind="stable"), pa.int64())


def predictor(spark: SparkSession, model: Crf | None) -> Callable[[Column], Column]:
    """A function from a text column to a struct (lang_pred, score, certainty)."""
    if model is not None:
        model.w, model.lex = model.w.astype(np.float32), model.lex.astype(np.float32)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, certainty double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = held.value
        for texts in batches:
            order = _by_size(texts)
            out: list[tuple[str, float, float]] = []
            for part in _slices(texts.take(order)):
                words = [words_of(t) if crf is not None else [] for t in part]
                some = iter(crf.predict([w for w in words if w]) if crf is not None else [])
                out += [next(some) if w else ("und", 0.0, 0.0) for w in words]
            back = np.argsort(order.to_numpy())
            out = [out[k] for k in back.tolist()]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["lang_pred", "score", "certainty"])

    predict = predict.asNondeterministic()  # else a filter on it would run it again
    return lambda text: predict(text.cast("string"))


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score, certainty."""
    return docs.select("doc_id", predictor(docs.sparkSession, model)(F.col("text")).alias("p")).select("doc_id", "p.lang_pred", "p.score", "p.certainty")
