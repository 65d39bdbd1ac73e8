"""Best-fit packing of documents into fixed-length sequences by pattern packing.

Documents become token ids and then pieces of at most a sequence's length.  The plan is made on the
driver from the histogram of piece lengths alone (at most `seq_len` counts, whatever the corpus):

1. patterns of few lengths that fill a sequence exactly are enumerated (pairs, triples, and a few
   copies of one length with a few of another);
2. repeat counts for them are fitted to the histogram by non-negative least squares;
3. the counts are rounded, and cut to what the histogram holds;
4. the pieces left over are packed best-fit decreasing, on the histogram as well.

Each piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, map_texts, materialize, release

#: Words that a worker adds to its memo before the memo grows old; the old one is kept as long again.  Longer words are not remembered.
MEMO = 300_000
MEMO_CHARS = 48
#: The pre-tokenizer's white space, and the characters that Python splits at but it does not.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = "\x1c\x1d\x1e\x1f᠎"
#: Ranks are counted within this many salted groups at least, so that a length that many pieces share is spread.
GROUPS = 256
GROUP_ROWS = 2_000


#: A word of Latin-1 letters with symbols after it.  The normaliser only lowers these letters, the
#: pre-tokenizer cuts between letters and a run of symbols, and so the word's ids are those of its two parts.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]{0,3})").fullmatch
#: How the byte-level pre-tokenizer writes the UTF-8 bytes of lower-case Latin-1 letters: each as the character of that number, but for those that are no printable characters of Latin-1.
_BYTES = {b: chr(256 + 33 + b - 127) if 127 <= b <= 160 else chr(256 + 67) if b == 173 else chr(b) for b in range(33, 256)}


#: The settings under which a text's ids are those of its words.  White space becomes one space and is dropped
#: by the split, which keeps runs of letters, single digits and runs of other signs; nothing else looks beyond a word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def goes_by_words(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those that the shortcut by words is proved for.

    Its added tokens must hold no white space and be matched before normalisation, and its merges must be plain.
    """
    model = settings.get("model") or {}
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
    added = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].split() == [t["content"]] and not t["content"][0].isalnum() for t in settings.get("added_tokens") or [])
    return plain and added and all(settings.get(k) == v for k, v in BY_WORDS.items())


class WordIds(dict):
    """Ids of words as the tokenizer gives them, as little-endian bytes; of(text) gives those of a whole text.

    Where the tokenizer's settings are those of `BY_WORDS`, it drops white space before it merges, and its normaliser changes
    nothing across white space, so a text's ids are those of its words one after another.  A word is encoded when it is first
    met and remembered: plain words go to the tokenizer's merges directly, others through the whole of it.  With
    any other settings each text is encoded whole.
    """

    def __init__(self, path: str, end_id: int = 0):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_words = goes_by_words(json.load(f))
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.merge = self.model.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.model.get_vocab(with_added_tokens=True).values()) + 1)]
        self.end = int(end_id).to_bytes(4, "little")
        self.marks = {"": b""}
        self.old: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.model.encode(word, add_special_tokens=False).ids])

    def _core(self, core: str) -> bytes:
        ids = self.get(core) or self.old.get(core)
        if ids is None:
            spelt = core if core.isascii() else "".join(map(_BYTES.__getitem__, core.encode()))
            ids = b"".join([self.packed[t.id] for t in self.merge(spelt)])
            if len(core) <= MEMO_CHARS:
                self[core] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            m = _PLAIN(word)
            if m is None:
                ids = self._whole(word)
            else:
                mark = self.marks.get(m[2])
                if mark is None:
                    mark = self.marks[m[2]] = self._whole(m[2])
                ids = self._core(m[1].lower()) + mark
            if len(word) > MEMO_CHARS:
                return ids
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """The text's ids and the end id."""
        if not self.by_words:
            return self._whole(text) + self.end
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        words = text.split() if not any(c in text for c in _ODD) else [w for w in _SPACE.split(text) if w]
        return b"".join(map(self.__getitem__, words)) + self.end


def word_ids(path: str, end_id: int) -> WordIds:
    """Kept in a Python worker from task to task."""
    return keep(f"words {path} {end_id}", lambda: WordIds(path, end_id))


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_id, piece, start, length, ids_crc32): each row's ids and the end id, cut where longer than `seq_len`; row_id is a row's own number."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def load():
        ids = word_ids(tokenizer_path, end_id)

        def cut(texts: list[str]) -> list[pa.Array]:
            cuts = [[(i, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(d[a : a + 4 * seq_len] for a in range(0, len(d), 4 * seq_len))] for d in map(ids.of, texts)]
            return [pa.array([[{"piece": i, "length": n, "ids_crc32": c} for i, n, c in ps] for ps in cuts], _CUTS)]

        return cut

    made = map_texts(source, "text", load, f"doc_id {kind}, row_id bigint, cuts array<struct<piece:int,length:bigint,ids_crc32:bigint>>", ["doc_id", "row_id"])
    flat = made.select("doc_id", "row_id", F.explode("cuts").alias("c")).select("doc_id", "row_id", "c.*")
    return flat.select("doc_id", "row_id", "piece", (F.col("piece").cast("long") * seq_len).alias("start"), "length", "ids_crc32")


_CUTS = pa.list_(pa.struct([("piece", pa.int32()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def patterns(lengths: np.ndarray, seq_len: int) -> np.ndarray:
    """Patterns over the given lengths that fill `seq_len` exactly, a row each: three times a length and its copies, 0 and 0 where there are fewer.

    All pairs and triples of lengths, and up to eight pieces of two lengths; their number is bounded by
    `seq_len` squared over six, whatever the corpus.  As an array they take 24 bytes each on the driver.
    """
    have = np.zeros(seq_len + 1, bool)
    have[lengths[lengths <= seq_len]] = True
    have[0] = False
    values = np.flatnonzero(have)
    found: set[tuple[tuple[int, int], ...]] = set()
    for m in range(1, 9):  # m copies of a and n of b
        for n in range(0, 9 - m):
            a = values[values * m <= seq_len]
            rest = seq_len - a * m
            if n == 0:
                found.update(((x, m),) for x in a[rest == 0].tolist())
                continue
            b = rest // n
            ok = (rest % n == 0) & (b > 0) & have[b] & (b != a)
            found.update(tuple(sorted(((x, m), (y, n)), reverse=True)) for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True))
    out = [np.array([[*sum(p, ()), 0, 0, 0, 0][:6] for p in sorted(found, reverse=True)], np.int32).reshape(-1, 6)]
    for a in values[values > seq_len // 3].tolist():
        b = values[(values < a) & (values < seq_len - a)]
        c = seq_len - a - b
        ok = (c < b) & (c > 0)
        ok[ok] = have[c[ok]]
        triples = np.ones((int(ok.sum()), 6), np.int32)
        triples[:, 0], triples[:, 2], triples[:, 4] = a, b[ok], c[ok]
        out.append(triples)
    return np.concatenate(out)


#: What `fit` leaves unexplained of the pieces, as a share, at which it stops; and the most passes over all patterns.
SETTLED = 1e-4
SWEEPS = 12


#: Patterns that are Python objects at a time.
AT_ONCE = 4_096


def fit(found: np.ndarray, histogram: Mapping[int, int], sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """Repeat counts x >= 0 that minimise the squared difference between the pieces that patterns use and the histogram, and that difference's root over the histogram's.

    Non-negative least squares by cyclic coordinate descent, until a pass moves less than SETTLED of the pieces.  Each pass visits the
    patterns in one fixed shuffled order; as early patterns take up what they can, few patterns end above zero, which keeps
    the loss from rounding small.
    """
    order = np.random.default_rng(7).permutation(len(found))
    x = array("d", bytes(8 * len(found)))
    rest = {k: float(v) for k, v in histogram.items()} | {0: 0.0}  # nothing is taken from length 0
    for _ in range(sweeps):
        moved = 0.0
        for at in range(0, len(order), AT_ONCE):
            part = order[at : at + AT_ONCE]
            for j, (a, m, b, n, c, o) in zip(part.tolist(), found[part].tolist(), strict=True):
                step = sum((m * rest[a], n * rest[b], o * rest[c])) / (m * m + n * n + o * o)
                new = x[j] + step
                if new < 0.0:
                    new = 0.0
                d = new - x[j]
                if d > 1e-3 or d < -1e-3:
                    x[j] = new
                    moved += abs(d)
                    rest[a] -= m * d
                    rest[b] -= n * d
                    rest[c] -= o * d
        if moved <= max(1.0, SETTLED * sum(histogram.values())):
            break
    residual = (sum(v * v for v in rest.values()) / max(1.0, sum(float(v) ** 2 for v in histogram.values()))) ** 0.5
    return np.array(x), residual


def best_fit(left: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths: (lengths in order, how many sequences like it).

    Equal pieces are placed together: into the fullest sequences that hold them, and then into new ones,
    as one by one they would be.
    """
    room: dict[int, dict[tuple[int, ...], int]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], free: int, n: int) -> None:
        if n and free == 0:
            done.append((pattern, n))
        elif n:
            at = room.setdefault(free, {})
            at[pattern] = at.get(pattern, 0) + n

    for length in sorted(left, reverse=True):
        count, free = left[length], length
        while count and free < seq_len:
            at = room.get(free)
            while at and count:
                pattern, n = at.popitem()
                k = min(n, count)
                if n > k:
                    at[pattern] = n - k
                # The sequence stays the fullest that holds the next equal piece while it has room for it.
                fits = free // length
                each, more = divmod(k if fits == 1 else min(count, k * fits), fits)
                put(pattern + (length,) * fits, free - length * fits, each)
                if more:
                    put(pattern + (length,) * more, free - length * more, 1)
                used = each + bool(more)
                if k > used:
                    at[pattern] = at.get(pattern, 0) + k - used
                count -= each * fits + more
            free += 1
        fits = seq_len // length
        each, more = divmod(count, fits)
        if each:
            put((length,) * fits, seq_len - length * fits, each)
        if more:
            put((length,) * more, seq_len - length * more, 1)
    return done + [(p, n) for at in room.values() for p, n in at.items()]


def plan(histogram: Mapping[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces in order, how many sequences are like it); together they use the histogram up."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(seq_len):
        out.append(((seq_len,), left.pop(seq_len)))
    found = patterns(np.array(sorted(left), np.int64), seq_len)
    if len(found):
        x, _ = fit(found, left)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            row = found[j].tolist()
            pattern = [(k, m) for k, m in zip(row[::2], row[1::2], strict=True) if m]
            n = min(int(x[j] + 0.5), *(left[k] // m for k, m in pattern))
            if n > 0:
                out.append((tuple(k for k, m in pattern for _ in range(m)), n))
                for k, m in pattern:
                    left[k] -= m * n
    return out + best_fit({k: v for k, v in left.items() if v}, seq_len)


def _slots(made: list[tuple[tuple[int, ...], int]], seq_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), with the first rank, the first sequence and the offset of each run of places."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in made:
        at = 0
        for k in lengths:
            rows.append((k, used.get(k, 0), base, at))
            used[k] = used.get(k, 0) + n
            at += k
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row_id, sequence_id, offset.

    A null text counts as empty; an empty one is the end id alone.  Each row of `docs` is packed by
    itself, rows that repeat an id included: their pieces have row_ids of their own.  Null ids stay null.  Only documents of more than
    `seq_len` ids are cut.  Sequences are gapless from offset 0.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = materialize(pieces(docs, tokenizer_path, seq_len, end_id, id_col, text_col), "pieces")
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}  # at most seq_len rows
    lengths, firsts, bases, offsets = _slots(plan(histogram, seq_len), seq_len)
    release()
    groups = max(GROUPS, -(-sum(histogram.values()) // GROUP_ROWS))
    # The pieces are written already, so each keeps its group and its rank when a task is repeated.
    salted = held.withColumn("grp", F.pmod(F.xxhash64("row_id", "piece"), F.lit(groups)))
    counts = salted.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "grp", (F.sum("n").over(Window.partitionBy("length").orderBy("grp")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "grp").orderBy("row_id", "piece")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "grp"]).withColumn("rank", F.col("before") + F.col("within"))
    stride = int(max(histogram.values(), default=0)) + 1
    shared = spark.sparkContext.broadcast((lengths * stride + firsts, firsts, bases, offsets))  # a few thousand runs of places

    def place(batches):
        keys, first, base, offset = shared.value
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, n * stride + r, side="right") - 1
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base[at] + r - first[at], pa.int64()), pa.array(offset[at], pa.int64())], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_id"]
    kind = held.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row_id bigint, sequence_id bigint, offset bigint"
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
