"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed embeddings of the word and of its first letters, so that words
not seen in training share what their stems taught.  Filters over one, two and three words slide over
the whole text; each filter's maximum over the text goes to one logistic output.  Since only maxima pass, a text's
length is no hindrance: long ones go through in windows that overlap by the widest filter.

Training starts from embeddings whose first component is a word's log odds between the classes and
goes on by stochastic gradients with sparse steps.  The logit is then shifted by a threshold calibrated for
each language on rows kept out of the fit; the language is guessed from a text's own function words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, release, small_batches, text_column
from .labelled import fold, sample

#: Hash buckets of the embedding table, its width, filters of each width, and the widths.
BUCKETS = 1 << 15
WIDTH = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
STEMS = (4, 5, 6)
#: Labelled rows to learn from, of each class, and the longest text among them.
PER_CLASS = 3_000
MOST_CHARS = 60_000
#: Words of a window, and words remembered in a worker.
WINDOW = 100_000
MEMO = 150_000
#: Characters of texts whose words are held at once, about.  A worker's slice is one part.
PART_CHARS = 1_000_000
#: Function words by which a text's language is guessed; any other text is of language 0.
FUNCTION_WORDS = (
    "the of and to in is was that with for are this from have which",
    "der die das und ist ein eine nicht mit für den dem von im werden",
    "le les des est une dans pour qui sur par au du avec sont cette",
    "el los las del una por con para su como más pero sus está este",
)
LANGUAGES = 1 + len(FUNCTION_WORDS)
_LANGUAGE = {w: i + 1 for i, ws in enumerate(FUNCTION_WORDS) for w in ws.split()}
_EDGES = ".,;:!?\"'()[]{}<>|*#&%$-_~`/\\"


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its stems; always of the same number."""
    w = word.strip(_EDGES)
    out = [zlib.crc32(b"=" + w.encode()) % BUCKETS]
    return out + [zlib.crc32(b"^" + w[:n].encode()) % BUCKETS if len(w) > n else out[0] for n in STEMS]


def _parts(texts: list[str]) -> list[list[str]]:
    """Texts in lists of about PART_CHARS characters, in order; at least one list."""
    out, size = [[]], 0
    for t in texts:
        if size >= PART_CHARS:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


class Words:
    """Rows for words: their features and guessed language, kept until there are too many.  Row 0 is padding."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.features = np.zeros((1 << 12, 1 + len(STEMS)), np.int32)
        self.language = np.zeros(1 << 12, np.int8)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.row) > MEMO:
            self.clear()
        # Words of a large sample's texts take many times its characters: only those of one part are held, and later parts are split twice.
        parts = _parts(texts)
        first = [t.lower().split() for t in parts[0]]
        new = set().union(*first)
        for part in parts[1:]:
            new.update(*(t.lower().split() for t in part))
        fresh = sorted(new.difference(self.row))
        start = len(self.row) + 1
        while start + len(fresh) > len(self.language):
            self.features = np.concatenate([self.features, np.zeros_like(self.features)])
            self.language = np.concatenate([self.language, np.zeros_like(self.language)])
        for i, w in enumerate(fresh):
            self.row[w] = start + i
            self.features[start + i] = features(w)
            self.language[start + i] = _LANGUAGE.get(w.strip(_EDGES), 0)
        get = self.row.__getitem__
        rows = [np.fromiter(map(get, ws), np.int32, len(ws)) for ws in first]
        for t in (t for part in parts[1:] for t in part):
            ws = t.lower().split()
            rows.append(np.fromiter(map(get, ws), np.int32, len(ws)))
        return rows

    def guess(self, rows: np.ndarray) -> int:
        votes = np.bincount(self.language[rows], minlength=LANGUAGES)
        votes[0] = 0
        return int(votes.argmax()) if votes.any() else 0


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
        self.filters = [(rng.standard_normal((w, WIDTH, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0, :] = np.abs(f[0, 0, :]) + 0.5
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.out_bias = np.float32(-1.0)
        self.shift = np.zeros(LANGUAGES)
        self.slope = 1.0

    def pool(self, embedded: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Filter values at each place, and their maxima over the first `own` places of the documents that begin at `starts`.

        Documents end with padding, over which filters reach but where none begins; a document without
        places has the value of padding, which is 0.
        """
        values = []
        at = np.arange(len(embedded))
        last = np.repeat(starts + own, np.diff(np.append(starts, len(embedded))))
        beyond = at >= last
        for f in self.filters:
            v = embedded @ f[0]
            for k in range(1, len(f)):
                v[:-k] += embedded[k:] @ f[k]
            v[beyond] = -np.inf
            values.append(v)
        maxima = np.concatenate([np.maximum.reduceat(v, starts, axis=0) for v in values], axis=1)
        maxima[own == 0] = 0
        return maxima, values

    def logits(self, docs: list[np.ndarray], features_: np.ndarray) -> np.ndarray:
        """The output for whole documents, given as rows of `features_`."""
        best = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        pad = np.zeros(max(WIDTHS) - 1, np.int32)
        parts: list[np.ndarray] = []
        owners: list[int] = []
        own: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal parts, owners, own, size
            if parts:
                lengths = np.array([len(p) for p in parts])
                flat = np.concatenate(parts)
                used, back = np.unique(flat, return_inverse=True)
                embedded = self.table[features_[used]].mean(axis=1)
                embedded[used == 0] = 0
                maxima, _ = self.pool(embedded[back], np.cumsum(lengths) - lengths, np.array(own))
                np.maximum.at(best, np.array(owners), maxima)
            parts, owners, own, size = [], [], [], 0

        for i, d in enumerate(docs):
            for at in range(0, max(len(d), 1), WINDOW):
                parts.append(np.concatenate([d[at : at + WINDOW + len(pad)], pad]))
                owners.append(i)
                own.append(min(WINDOW, len(d) - at))
                size += len(parts[-1])
                if size >= WINDOW:
                    flush()
        flush()
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def train(self, docs: list[np.ndarray], y: np.ndarray, features_: np.ndarray, epochs: int = 4, batch: int = 48, rate: float = 0.05) -> None:
        self._start(docs, y, features_)
        rng = np.random.default_rng(2)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        dense = [*self.filters, self.bias, self.out]
        squares = [np.full_like(p, 0.1) for p in dense]
        table_squares = np.full(BUCKETS, 0.1, np.float32)
        bias_square = 0.1
        pad = np.zeros(max(WIDTHS) - 1, np.int32)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                mine = order[at : at + batch]
                parts = [np.concatenate([docs[i], pad]) for i in mine]
                lengths = np.array([len(p) for p in parts])
                flat = np.concatenate(parts)
                starts = np.cumsum(lengths) - lengths
                used, back = np.unique(flat, return_inverse=True)
                word = self.table[features_[used]].mean(axis=1)
                word[used == 0] = 0
                embedded = word[back]
                maxima, values = self.pool(embedded, starts, lengths - len(pad))
                hidden = np.maximum(maxima + self.bias, 0)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.out_bias)))
                g = ((p - y[mine]) * weight[mine] / len(mine)).astype(np.float32)
                grads_f = [np.zeros_like(f) for f in self.filters]
                g_hidden = (g[:, None] * self.out) * (maxima + self.bias > 0)
                g_word = np.zeros_like(word)
                for n, f in enumerate(self.filters):
                    cols = slice(n * FILTERS, (n + 1) * FILTERS)
                    for d, (s, e) in enumerate(zip(starts, starts + lengths, strict=True)):
                        gd = g_hidden[d, cols]
                        if not gd.any() or e - s <= len(pad):
                            continue
                        top = s + values[n][s:e].argmax(axis=0)
                        for k in range(len(f)):
                            place = top + k
                            ok = place < e
                            grads_f[n][k] += (embedded[np.minimum(place, e - 1)] * (gd * ok)[:, None]).T
                            np.add.at(g_word, back[np.minimum(place, e - 1)], (f[k] * (gd * ok)).T)
                dense_grads = [*grads_f, g_hidden.sum(axis=0), hidden.T @ g]
                for q, dq, sq in zip(dense, dense_grads, squares, strict=True):
                    sq += dq * dq
                    q -= rate * dq / np.sqrt(sq)
                bias_square += float(g.sum()) ** 2
                self.out_bias -= np.float32(rate * float(g.sum()) / np.sqrt(bias_square))
                hit = np.flatnonzero(np.abs(g_word).sum(axis=1) * (used != 0))
                buckets = features_[used[hit]]
                step = np.zeros((0, WIDTH), np.float32)
                if len(hit):
                    ids, inverse = np.unique(buckets, return_inverse=True)
                    step = np.zeros((len(ids), WIDTH), np.float32)
                    np.add.at(step, inverse.reshape(buckets.shape), g_word[hit][:, None, :] / buckets.shape[1])
                    table_squares[ids] += (step * step).mean(axis=1)
                    self.table[ids] -= rate * step / np.sqrt(table_squares[ids])[:, None]

    def _start(self, docs: list[np.ndarray], y: np.ndarray, features_: np.ndarray) -> None:
        """The first component of each bucket: the log odds that a document of a class holds it."""
        n = np.zeros((2, BUCKETS))
        for d, label in zip(docs, y, strict=True):
            n[label, np.unique(features_[np.unique(d)])] += 1
        clean, toxic = (n[c] + 0.5 for c in (0, 1))
        odds = np.log(toxic / ((y == 1).sum() + 1)) - np.log(clean / ((y == 0).sum() + 1))
        seen = n.sum(axis=0)
        self.table[:, 0] = np.clip(odds * seen / (seen + 3), -3, 6) / 3

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray, language: np.ndarray, features_: np.ndarray) -> None:
        """A threshold for each language: the logit at which the two classes' error rates add up to least."""
        z = self.logits(docs, features_)
        weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))

        def best(mask: np.ndarray) -> float:
            order = np.argsort(z[mask])
            s, t, w = z[mask][order], y[mask][order], weight[mask][order]
            # A cut before place i: label 1 below it and label 0 from it on are errors.
            errors = np.concatenate([[0], np.cumsum(w * t)]) + np.concatenate([np.cumsum((w * (1 - t))[::-1])[::-1], [0]])
            low, high = np.concatenate([[s[0] - 1], s]), np.concatenate([s, [s[-1] + 1]])
            near = np.flatnonzero(errors <= errors.min() + 1e-12)
            pick = near[(high - low)[near].argmax()]
            return float(low[pick] + high[pick]) / 2

        if len(y) and 0 < y.sum() < len(y):
            self.shift[:] = best(np.ones(len(y), bool))
            for lang in range(LANGUAGES):
                mask = language == lang
                if min((y[mask] == 1).sum(), (y[mask] == 0).sum()) >= 15:
                    self.shift[lang] = best(mask)

    def scores(self, texts: list[str], words: Words) -> np.ndarray:
        rows = words.rows(texts)
        z = self.logits(rows, words.features) - self.shift[[words.guess(r) for r in rows]]
        return 1 / (1 + np.exp(-np.clip(self.slope * z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """A network fitted on the bounded sample; none if the labels hold only one class."""
    texts, y, _ = sample(docs, labels, label, per_class, most_chars, id_col, text_col)
    y = np.array(y, np.int64)
    if len(set(y.tolist())) < 2:
        return None
    words = Words()
    rows = words.rows(texts)
    del texts
    # Every fourth row, in the order of hashes, is kept out of the fit to calibrate on.
    held = np.arange(len(y)) % 4 == 3
    if min((y[held] == 1).sum(), (y[held] == 0).sum()) < 5:
        held[:] = False
    net = Network()
    net.train([r for r, h in zip(rows, held, strict=True) if not h], y[~held], words.features)
    part = held if held.any() else ~held
    language = np.array([words.guess(r) for r, p in zip(rows, part, strict=True) if p])
    net.calibrate([r for r, p in zip(rows, part, strict=True) if p], y[part], language, words.features)
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Scores use whole texts and nothing else.  Null texts count as empty; an empty text has a score as any other, that of no
    words.  Where the labels do not hold both classes, every score is 0.  A null id is not held out.
    Repeated rows are kept.
    """
    return scored(docs, model(docs, labels, per_class, most_chars, id_col, text_col), threshold, id_col, text_col)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with a score below the threshold."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(model(docs, labels, per_class, most_chars, id_col, text_col), F.col(text_col)) < threshold)


def model(docs: DataFrame, labels: DataFrame, per_class: int, most_chars: int, id_col: str, text_col: str):
    """A function that loads the fitted network in a worker's task and gives a function of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, "toxic", per_class, most_chars, id_col, text_col))  # a table of fixed size
    release()  # the sample's memory

    def load():
        words, net = Words(), shared.value
        return lambda texts: net.scores(texts, words) if net is not None and texts else np.zeros(len(texts))

    return load


def score_column(load, text: Column) -> Column:
    """Scores of a text column as an expression."""

    def arrays():
        of = load()
        return lambda texts: pa.array(np.asarray(of(texts), np.float64), pa.float64())

    return text_column(arrays, text, "double")


def scored(docs: DataFrame, load, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Rows with a model's score and its decision."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def arrays():
        of = load()
        return lambda texts: [pa.array(np.asarray(of(texts), np.float64), pa.float64())]

    made = map_texts(source, "text", arrays, f"doc_id {kind}, score double", ["doc_id"])
    return made.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
