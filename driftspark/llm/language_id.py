"""Language ID of words by a linear-chain conditional random field, and of texts by their words.

A word's features are its prefixes and suffixes (1 to 3 letters), its character 2- and 3-grams with word edges, and the
word itself where a language's lexicon (its most frequent training words) holds it. Learned transitions join
neighbouring words, so a text that switches languages changes label where its words do. Forward-backward gives each
word's label probabilities; a text's language is the one with the largest sum of them, and the score is their mean.

Training takes a bounded sample of labelled documents: about ``SAMPLE_DOCS`` whole texts of at most ``SAMPLE_BYTES``
together, shared equally by all languages that occur (one text each at least): those with the smallest hashes of their
doc_id, a text that would take more than an eighth of its language's bytes only where there is no other. Everything
else covers all rows. The model's size follows the number of languages.

Defined results: a null text or one without a letter (Unicode L*) is ``und`` with score 0; without any training document
every text is ``und``; a null doc_id counts as held out; repeated rows are kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm._common import apart, crc_mod, lean, small_batches, trim

UND = "und"
SAMPLE_DOCS, SAMPLE_BYTES = 600, 1_600_000
LEXICON, FEATURES = 2000, 200_000
CHUNK = 80
#: Values of the hash that orders documents.
PLACES = 1_000_000_007
ROUNDS, RATE, DECAY = 40, 0.4, 1e-5
#: Numbers (words by labels) that are labelled at once, and that are remembered of known words.
PIECE_CELLS, CACHE_CELLS = 1_200_000, 800_000
#: Positions after which messages are normalised; with fewer than 90 labels a step changes their sum by far less than 2^100.
STEPS = 8
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_WORDS = re.compile(r"[^\W\d_]+")


def split(text: str) -> list[str]:
    """Runs of letters; numbers that are no decimal digits (such as fractions) are no letters either."""
    words = _WORDS.findall(text.lower())
    if text.isascii() or "".join(words).isalpha():
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[str]:
    w = f"^{word}$"
    out = [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    out += [f"<{word[:n]}" for n in (1, 2, 3)] + [f">{word[-n:]}" for n in (1, 2, 3)]
    if word in lexicon:
        out.append(f"={word}")
    return out


def messages(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages of sequences laid end to end (all sizes at least 1).

    One loop goes through all sequences from their front and from their back: a backward message times its emission
    follows the same rule as a forward message, with transposed transitions."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    # the rows of position 0 of all sequences, then those of position 1, and so on
    t = np.repeat(np.arange(len(active)), active)
    k = np.arange(len(t)) - np.repeat(np.cumsum(active) - active, active)
    front, back = first[k] + t, (first + sizes - 1)[k] - t
    both, pair = np.stack([emit[front], emit[back]]), np.stack([step, step.T])
    before, begin = both[:, : active[0]], active[0]
    before[0] *= start
    for t, n in enumerate(active[1:].tolist(), 1):
        here = both[:, begin : begin + n]
        here *= before[:, :n] @ pair
        if t % STEPS == 0:
            here /= here.sum(axis=2, keepdims=True)
        before, begin = here, begin + n
    both /= both.sum(axis=2, keepdims=True)
    alpha, beta, later = np.empty_like(emit), np.ones_like(emit), np.empty_like(emit)
    alpha[front], later[back] = both
    inner = np.ones(len(emit), bool)
    inner[first + sizes - 1] = False
    inner = np.flatnonzero(inner)
    beta[inner] = later[inner + 1] @ step.T
    return alpha, beta / beta.sum(axis=1, keepdims=True)


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def key(letters: str) -> int:
    """Up to three letters as one number, 21 bits each."""
    out = 0
    for c in letters:
        out = out << 21 | ord(c)
    return out


class Places:
    """The place of each feature, by sorted numbers of letters; -1 for an unknown one."""

    def __init__(self, places: dict[str, int]):
        found = sorted((key(f), i) for f, i in places.items())
        self.keys = np.array([k for k, _ in found] or [0], np.uint64)
        self.place = np.array([i for _, i in found] or [-1], np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.place[at], -1)


class Model:
    """Weights of features, transitions and starts; ``learn`` maximises the conditional likelihood of word labels."""

    def __init__(self, texts: list[tuple[str, str]], rounds: int = ROUNDS):
        self.labels = sorted({lang for _, lang in texts})
        n = len(self.labels)
        words = [(split(t), self.labels.index(lang)) for t, lang in texts]
        words = [(w, y) for w, y in words if w]
        by_label = [Counter() for _ in self.labels]
        for w, y in words:
            by_label[y].update(w)
        self.lexicon = frozenset(w for c in by_label for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if k > 1)
        vocab: dict[str, int] = {}
        flat = [vocab.setdefault(x, len(vocab)) for w, _ in words for x in w]
        seen = Counter(f for w in vocab for f in set(features(w, self.lexicon)))
        kept = sorted((f for f, k in seen.items() if k > 1 or f[0] == "="), key=lambda f: (-seen[f], f))[:FEATURES]
        del seen
        self.index = {f: i for i, f in enumerate(kept)}
        of = lambda c: {f[1:]: i for f, i in self.index.items() if f[0] == c}
        self.prefixes, self.suffixes = Places(of("<")), Places(of(">"))
        self.grams = Places({f: i for f, i in self.index.items() if f[0] not in "<>="})
        self.weights = np.zeros((len(kept) + 1, n))  # the last row is the bias
        self.step, self.start = np.zeros((n, n)), np.zeros(n)
        if n > 1 and flat:
            self._learn(np.array(flat), words, list(vocab), rounds)
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, n))

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known ``features`` of words, end to end, and their numbers. The last of a word is its bias."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letter = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        bits, all_ = np.uint64(21), np.arange(len(words))
        owner = np.repeat(all_, size + 2)
        two = letter[:-1] << bits | letter[1:]
        three = two[:-1] << bits | letter[2:]
        places, owners = [], []
        for gram, n in ((two, 1), (three, 2)):
            whole = owner[:-n] == owner[n:]
            places.append(self.grams(gram[whole]))
            owners.append(owner[:-n][whole])
        end = np.cumsum(size + 2) - 2  # the last letter
        start = end - size + 1
        for table, first in ((self.prefixes, lambda n: start), (self.suffixes, lambda n: end - n + 1)):
            for n in (1, 2, 3):  # of a shorter word, the whole word again
                m = np.minimum(size, n)
                at = first(m)
                keys = letter[at]
                for i in range(1, n):
                    keys = np.where(i < m, keys << bits | letter[np.minimum(at + i, end)], keys)
                places.append(table(keys))
                owners.append(all_)
        get = self.index.get
        places.append(np.fromiter((get("=" + w, -1) if w in self.lexicon else -1 for w in words), np.int32, len(words)))
        places.append(np.full(len(words), len(self.index), np.int32))
        place, owner = np.concatenate(places), np.concatenate([*owners, all_, all_])
        known = place >= 0
        place, owner = place[known], owner[known]
        return place[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def scores(self, words: list[str]) -> np.ndarray:
        at, n = self._rows(words)
        return np.add.reduceat(self.weights[at], np.cumsum(n) - n)

    def _learn(self, flat, words, found, rounds) -> None:
        """``flat`` has, for each word of all texts, its place in ``found``, the distinct words."""
        n = len(self.labels)
        y = np.concatenate([np.full(len(w), label) for w, label in words])
        sizes = np.concatenate([[CHUNK] * (len(w) // CHUNK) + ([len(w) % CHUNK] if len(w) % CHUNK else []) for w, _ in words]).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        inner = np.ones(len(flat), bool)
        inner[begin] = False
        inner = np.flatnonzero(inner)
        at, count = self._rows(found)
        owner = np.repeat(np.arange(len(found)), count)
        gold = np.zeros((len(found), n))
        np.add.at(gold, (flat, y), 1)
        gold_step = np.zeros((n, n))
        np.add.at(gold_step, (y[inner - 1], y[inner]), 1)
        gold_start = np.bincount(y[begin], minlength=n)
        params = [self.weights, self.step, self.start]
        past = [np.full_like(p, 1e-8) for p in params]
        for _ in range(rounds):
            e = np.add.reduceat(self.weights[at], np.cumsum(count) - count)
            emit = np.exp(e - e.max(axis=1, keepdims=True))[flat]
            step = np.exp(self.step)
            alpha, beta = messages(emit, sizes, step, np.exp(self.start))
            p = marginals(alpha, beta)
            pair = alpha[inner - 1][:, :, None] * step[None] * (emit[inner] * beta[inner])[:, None, :]
            pair = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            mean = np.column_stack([np.bincount(flat, p[:, k], len(found)) for k in range(n)])
            diff = (gold - mean)[owner]
            grad = np.column_stack([np.bincount(at, diff[:, k], len(self.weights)) for k in range(n)])
            grads = [grad - DECAY * len(flat) * self.weights, gold_step - pair, gold_start - p[begin].sum(axis=0)]
            for w, g, h in zip(params, grads, past, strict=True):
                g = g / len(flat)
                h += g * g
                w += RATE * g / np.sqrt(h)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Exponentiated scores of words, remembered in ``table``."""
        known = self.known
        if len(known) * len(self.labels) > CACHE_CELLS:
            known.clear()
        if new := list(set(words).difference(known)):
            e = self.scores(new)
            first = len(known)
            while first + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = np.exp(e - e.max(axis=1, keepdims=True))
            known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def label_words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of each word of each text (each with a word at least)."""
        sizes = np.array([len(w) for w in texts], np.int64)
        emit = self.emissions([w for text in texts for w in text])
        p = marginals(*messages(emit, sizes, np.exp(self.step), np.exp(self.start)))
        return np.split(p, np.cumsum(sizes)[:-1])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
        rows: list[int] = []
        held: list[list[str]] = []
        total = 0

        def flush():
            for i, p in zip(rows, self.label_words(held), strict=True):
                mean = p.mean(axis=0)
                best = int(np.argmax(mean))
                out[i] = (self.labels[best], min(1.0, float(mean[best])))
            rows.clear()
            held.clear()

        for i, t in enumerate(texts):
            if self.labels and t and (w := split(t)):
                rows.append(i)
                held.append(w)
                total += len(w)
                if total * len(self.labels) >= PIECE_CELLS:
                    flush()
                    total = 0
        if rows:
            flush()
        return out


def train(documents: DataFrame, learn_from) -> Model:
    """A model of documents (doc_id, text, lang) that meet a condition, from a bounded sample."""
    labelled = documents.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place")
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang"), F.octet_length("text").alias("size"), place)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    docs, size = max(1, SAMPLE_DOCS // max(1, len(counts))), SAMPLE_BYTES // max(1, len(counts))
    # twice the expected number, then the first of what that leaves
    shares = documents.sparkSession.createDataFrame(
        [(r["lang"], min(PLACES, 2 * docs * PLACES // r["n"] + 1)) for r in counts], "lang string, share long"
    )
    near = labelled.join(F.broadcast(shares), "lang").where("place < share")  # the driver has just held it
    long = F.when(F.col("size") > size // 8, F.col("size")).otherwise(0)
    order = Window.partitionBy("lang").orderBy(long, "place", "text")
    together = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sample = near.withColumn("n", F.row_number().over(order)).withColumn("together", together)
    rows = sample.where((F.col("n") <= docs) & ((F.col("together") <= size) | (F.col("n") == 1))).select("text", "lang").collect()
    model = Model(sorted((r["text"], r["lang"]) for r in rows))
    trim()
    return model


def predict(documents: DataFrame, model: Model, *kept: str) -> DataFrame:
    """doc_id, lang_pred, score and the columns named in ``kept`` for every document; only texts are looked at. A further
    column that is named like a result comes back as own_<name>."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *apart(kept)[0], F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema[:-1])

    def run(batches):
        for b in batches:
            out = shared.value.predict(b.column("_text").to_pylist())
            lang, score = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*b.schema.names[:-1], "lang_pred", "score"],
            )

    names = ["doc_id", "lang_pred", "score"]
    return table.mapInArrow(lean(run), f"{schema}, lang_pred string, score double").select(*names, *apart(kept, *names)[1])


def held_out(column: str = "doc_id"):
    return crc_mod(column, 5) == 0


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    model = train(documents, ~held_out())
    found = predict(documents.select("doc_id", "text", held_out().alias("held_out")), model, "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score")
