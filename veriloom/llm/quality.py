"""Quality by a compression classifier.

A zstandard dictionary is built from good labelled text and one from bad.  A text is cut into blocks,
each block is compressed with either dictionary and with none, and the difference of the two sizes over the plain size
says which class the block is written like.  A logistic curve fitted on labelled rows that
are in neither dictionary turns the sizes into a probability that the text is good.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches
from .labelled import sample
from .toxicity import score_column, scored

#: Bytes of each dictionary, which are shared out evenly to the texts that it is made of but for SHARE bytes each at least, and of a block.
DICTIONARY = 96 * 1024
SHARE = 256
BLOCK = 2048
LEVEL = 6
#: Labelled rows to learn from, of each class, and the longest text among them.
PER_CLASS = 2_000
MOST_CHARS = 60_000


class Compressor:
    """Dictionaries and the curve that calibrates what they say."""

    def __init__(self, good: list[bytes], bad: list[bytes], dictionary: int = DICTIONARY, share: int = SHARE):
        self.raw = [self._join(good, dictionary, share), self._join(bad, dictionary, share)]
        self.weights = np.zeros(1)
        self.mean, self.spread = np.zeros(1), np.ones(1)
        self._made = None

    @staticmethod
    def _join(texts: list[bytes], dictionary: int, share: int) -> bytes:
        """Pieces from the middle of texts, short texts whole, until the dictionary is full."""
        out, size, share = [], 0, max(share, dictionary // max(1, len(texts)))
        for t in texts:
            at = max(0, (len(t) - share) // 2)
            out.append(t[at : at + share])
            size += len(out[-1])
            if size >= dictionary:
                break
        return b"\n".join(out)[-dictionary:] or b"-" * 16

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def _compressors(self) -> list:
        if self._made is None:
            with_dict = []
            for raw in self.raw:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                with_dict.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
            self._made = [c.compress for c in (*with_dict, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))]
        return self._made

    def measures(self, text: str) -> list[float]:
        """What a text's compressed sizes say: the difference over the plain size on the whole and in its worst block, and how far it shrinks."""
        data = text.encode()
        if not data:
            return [0.0, 0.0, 1.0, 1.0]  # what ever shorter texts come to
        good, bad, plain = self._compressors()
        n = max(1, round(len(data) / BLOCK))
        cuts = [len(data) * i // n for i in range(n + 1)]
        sizes = np.array([[len(good(b)), len(bad(b)), len(plain(b))] for b in (data[s:e] for s, e in zip(cuts, cuts[1:], strict=False))], np.float64)
        differ = (sizes[:, 1] - sizes[:, 0]) / sizes[:, 2]
        whole = sizes.sum(axis=0)
        return [float((whole[1] - whole[0]) / whole[2]), float(differ.min()), float(whole[2] / len(data)), 1 / (1 + len(data) / 200)]

    def _inputs(self, m: np.ndarray) -> np.ndarray:
        z = (m - self.mean) / self.spread
        d, w, r, s = z.T
        return np.stack([np.ones(len(z)), d, w, r, s, d * s, r * s, w * s], axis=1)

    def calibrate(self, texts: list[str], y: np.ndarray, share: float) -> None:
        """Logistic regression by Newton's steps, with rows weighted to the classes' true shares and a small ridge."""
        m = np.array([self.measures(t) for t in texts])
        self.mean, self.spread = m.mean(axis=0), m.std(axis=0) + 1e-6
        x = self._inputs(np.clip(m, self.mean - 4 * self.spread, self.mean + 4 * self.spread))
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
        ridge[0] = 1e-3
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, texts: list[str]) -> np.ndarray:
        m = np.array([self.measures(t) for t in texts]).reshape(len(texts), 4)
        x = self._inputs(np.clip(m, self.mean - 4 * self.spread, self.mean + 4 * self.spread))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(texts: list[str], y: list[int], share: float, dictionary: int = DICTIONARY, piece: int = SHARE) -> Compressor | None:
    """Dictionaries of at most `dictionary` bytes, of at least `piece` bytes from the middle of a text, from the first half of the rows and the curve from the second; all rows for both where there are few.  None without both classes."""
    labels = np.array(y, np.int64)
    if len(set(y)) < 2:
        return None
    half = np.arange(len(labels)) % 2 == 0
    if min((labels[~half] == c).sum() for c in (0, 1)) < 20:
        # Too few for halves: a third of the rows calibrates.
        half = np.arange(len(labels)) % 3 != 0
    rest = ~half if all((labels[~half] == c).any() for c in (0, 1)) else np.ones(len(labels), bool)
    model = Compressor(*([t.encode() for t, c, h in zip(texts, y, half, strict=True) if h and c == k] for k in (1, 0)), dictionary, piece)
    model.calibrate([t for t, r in zip(texts, rest, strict=True) if r], labels[rest], share)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Scores use whole texts and nothing else.  Of the bounded sample, half makes the dictionaries: at most `DICTIONARY`
    bytes for a class, in pieces from the middles of its texts, of `SHARE` bytes or an even share if that is more; the
    other half calibrates.  Null texts count as empty; an empty text has the score that ever shorter texts come to, which no dictionary shortens.  Where the labels do not hold both classes, every score is 1.  A
    null id is not held out.  Repeated rows are kept.
    """
    return scored(docs, model(docs, labels, per_class, most_chars, id_col, text_col), threshold, id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with a score of the threshold or more."""
    small_batches(docs.sparkSession)
    return docs.where(score_column(model(docs, labels, per_class, most_chars, id_col, text_col), F.col(text_col)) >= threshold)


def model(docs: DataFrame, labels: DataFrame, per_class: int, most_chars: int, id_col: str, text_col: str):
    """A function that loads the fitted model in a worker's task and gives a function of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, "quality", per_class, most_chars, id_col, text_col)))  # two dictionaries of fixed size
    release()  # the sample's memory

    def load():
        held = shared.value
        return lambda texts: held.scores(texts) if held is not None and texts else np.ones(len(texts))

    return load
