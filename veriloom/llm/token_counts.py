"""Token counts with a whole-token shortcut.

A pre-token is a run of spaces with the characters after it, up to the next space or line feed.  No
piece of the vocabulary holds a space after another character, and none holds a line feed; both are
proved from the vocabulary and the normaliser's settings when the model is loaded; where they do not hold, texts are counted whole.  So no merge crosses from one pre-token into the next,
and a text's count is the sum over its pre-tokens.  Vocabulary strings that the library encodes as
one token are found once, offline; pre-tokens among them count as one without any merging, and the
rest are merged by the library, each distinct one once a batch, with a bounded memo between batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_texts

#: Counts remembered in a worker, and the longest pre-token that is remembered; beyond the first all go.
MEMO = 400_000
MEMO_CHARS = 64
SPACE = "▁"
_PRETOKEN = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def keeps_text(model_path: str) -> bool:
    """Whether the model's file says that its normaliser keeps texts as they are, but for one space put before them and spaces written as a sign."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False  # nothing is proved; texts are counted whole
    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    same = not n.precompiled_charsmap and not n.normalization_rule_tsv and not model.denormalizer_spec.precompiled_charsmap
    return same and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not t.treat_whitespace_as_suffix and t.model_type == t.BPE


class PieceCounter:
    """Counts tokens of whole texts as the sentencepiece model does, without begin or end tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.split = all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in plain) and keeps_text(model_path)
        self.whole = self._prove(plain) if self.split else {}
        self.memo: dict[str, int] = dict(self.whole)

    def _prove(self, plain: list[str]) -> dict[str, int]:
        """The vocabulary strings that alone are one token: after a space, or (marked by a line feed) at a line's start."""
        # A line feed alone is a space and a line feed for the library; what either counts follows from one and two of them.
        one, two = (len(x) for x in self.model.encode(["\n", "\n\n"], num_threads=1))
        feed, space = two - one, 2 * one - two
        after = [p[1:] for p in plain if p[0] == SPACE and len(p) > 1 and SPACE not in p[1:]]
        known = {w: 1 for w, ids in zip(after, self.model.encode(after, num_threads=1), strict=True) if len(ids) == 1}
        first = ["\n" + p for p in plain if SPACE not in p]
        # "\nword" is a space, a line feed and the word; the space is not part of the pre-token.
        known |= {w: feed + 1 for w, ids in zip(first, self.model.encode(first, num_threads=1), strict=True) if len(ids) == space + feed + 1}
        self.space = space
        return known | {"": space, "\n": feed}

    def _pretokens(self, text: str) -> list[str]:
        """Keys of `memo`: a word after one space as it is, with n further spaces before it if there are more, a line's first word with its line feed."""
        if SPACE not in text and "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        keys, feed = [], False
        for p in _PRETOKEN.findall(SPACE + text.replace(" ", SPACE)):
            if feed:
                feed = False
                if p[0] != SPACE and p != "\n":
                    keys[-1] += p
                    continue
            keys.append(p[1:].replace(SPACE, " ") if p[0] == SPACE else p)
            feed = p == "\n"
        return keys

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        keys = [self._pretokens(t) if t else [] for t in texts]
        need = set().union(*keys).difference(self.memo) if keys else set()
        if len(need) + len(self.memo) > MEMO + len(self.whole):
            self.memo = dict(self.whole)
            need = set().union(*keys).difference(self.memo)
        words = list(need)
        for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True):
            self.memo[w] = len(ids) - self.space * (w[0] == "\n")
        of = self.memo.__getitem__
        out = [sum(map(of, k)) for k in keys]
        for w in words:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return out


def piece_counter(model_path: str) -> PieceCounter:
    """Kept in a Python worker from task to task."""
    return keep(f"pieces {model_path}", lambda: PieceCounter(model_path))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as an empty one: no bytes, no tokens.  Repeated rows and null ids are kept as
    they are; other columns are not read.  Texts are counted whole, whatever their length.
    """

    def load():
        counter = piece_counter(model_path)
        return lambda texts: [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())]

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, "text", load, f"doc_id {kind}, n_bytes bigint, n_tokens bigint", ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
