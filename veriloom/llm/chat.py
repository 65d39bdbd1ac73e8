"""Chat formatting: roles of raw transcripts recovered by a hidden Markov model, then turns rendered alike.

A transcript is a sequence of lines.  Its hidden states are the three roles, each as the first line of
a turn or a later one.  A line is observed as a speaker marker (one that names a role, a name followed by a colon, or none)
with a few features of its text.  Viterbi's path gives each line its role and says where turns begin;
markers are taken off, and turns are rendered in one canonical form.

Which words before a colon are speakers is decided from the whole transcript, by counts that are summed
before the lines are read in order.  The path is that of the whole transcript as well, however long it is: lines
go through one after another, and a state is settled as soon as all paths that may still win agree on it.  What is
held is the lines since then, a few as a rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ROLES = ("system", "user", "assistant")
#: Lines after which a decoder looks for states that are settled.
CHUNK = 1_024
#: Labelled turns that weights are estimated from, at most.
LEARNT = 5_000

# Speaker markers in use for each role.
MARKERS = {
    "system": ("system", "system prompt", "instructions"),
    "user": ("user", "human", "question", "q", "prompter", "customer", "me", "instruction", "input"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "agent", "response", "output", "model"),
}
_ROLE_OF = {m: r for r, ms in enumerate(MARKERS.values()) for m in ms}
_NAMES = "|".join(sorted(map(re.escape, _ROLE_OF), key=len, reverse=True))
#: "User: ...", "### Human:", "**Assistant**: ...", "[user] ...", and the tags of chat templates on a line.
_MARK = re.compile(rf"^\s*(?:[#>*\-]+\s*)?(?:\*\*)?(?:(?P<colon>{_NAMES})(?:\*\*)?\s*(?::|：)(?:\*\*)?|\[(?P<square>{_NAMES})\]:?|<\|(?:im_start\|>)?(?P<tag>{_NAMES})(?:\|>)?)\s*", re.I)
_END = re.compile(r"\s*(?:<\|(?:im_end|end|eot_id|endoftext)\|>|</s>)\s*$")
_NAME = re.compile(r"^\s*(?P<name>[^\W\d_][\w.\-]{0,19}(?: [A-Z][\w.\-]{0,19})?)\s*(?::|：)\s+(?=\S)")
_RULES = re.compile(r"^\s*(?:you are|you're|act as|always|never|respond|be )\b", re.I)

#: Observed marker classes: none, a marker of each role, a first and a second other name.
NONE, OTHER = 0, 4
#: Features of a line: after a blank line or a known boundary, ends in a question mark, sets rules in its first words, is long, follows a question.
FEATURES = ("apart", "asks", "rules", "long", "asked")


@dataclass
class Weights:
    """Probabilities of the model over the states (role, first line) and (role, later line), six in all."""

    start: np.ndarray = field(default_factory=lambda: np.array([0.15, 0.80, 0.05]))
    #: The next turn's role, and that a line goes on with its turn.
    follow: np.ndarray = field(default_factory=lambda: np.array([[0.02, 0.93, 0.05], [0.01, 0.09, 0.90], [0.01, 0.91, 0.08]]))
    goes_on: float = 0.6
    #: Each feature by state.
    features: np.ndarray = field(default_factory=lambda: np.array([
        [0.50, 0.03, 0.50, 0.10, 0.02],
        [0.10, 0.03, 0.10, 0.10, 0.05],
        [0.50, 0.45, 0.02, 0.05, 0.05],
        [0.10, 0.15, 0.02, 0.05, 0.08],
        [0.50, 0.05, 0.02, 0.15, 0.55],
        [0.10, 0.08, 0.02, 0.12, 0.08],
    ]))
    #: A first line: with its role's own marker, with another role's, with a name, with none; a later one: with a marker, with a name.
    own, foreign, named, bare, stray_marker, stray_name = 0.55, 0.002, 0.15, 0.03, 0.0005, 0.01

    def tables(self, marked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log weights: start, moves, marker classes, and features absent or present.  Where nothing in a transcript is marked, a line without a marker says nothing."""
        start, move = np.full(6, -np.inf), np.full((6, 6), -np.inf)
        start[[0, 2, 4]] = np.log(self.start)
        marks = np.empty((6, 6))
        for r in range(3):
            for place in (0, 1):
                move[2 * r + place, 2 * r + 1] = np.log(self.goes_on)
                move[2 * r + place, [0, 2, 4]] = np.log((1 - self.goes_on) * self.follow[r])
            for m in range(6):
                marks[2 * r, m] = np.log((self.bare if marked else 0.93) if m == NONE else self.own if m == r + 1 else self.foreign if m < OTHER else self.named)
                marks[2 * r + 1, m] = np.log(0.93 if m == NONE else self.stray_marker if m < OTHER else self.stray_name)
        # In a transcript of names the first to speak asks and the second answers.
        marks[2, OTHER] += 1.0
        marks[4, OTHER + 1] += 1.0
        marks[0, OTHER:] -= 2.0
        return start, move, marks, np.log(np.stack([1 - self.features, self.features]))


def estimate(turns: list[tuple[object, str, str]], prior: float = 20.0) -> Weights:
    """Weights from turns (conversation, role, text) of known roles, in order; each of the fixed weights counts as `prior` observations."""
    w = Weights()
    start, follow = w.start * prior, w.follow * prior
    seen, total = w.features * prior, np.full(6, prior)
    goes = [w.goes_on * prior, prior]
    last, before, asked = None, None, False
    for conv, role, text in turns:
        r = ROLES.index(role) if role in ROLES else 1
        if conv != last:
            start[r] += 1
            asked = False
        else:
            follow[before, r] += 1
        last, before = conv, r
        for i, line in enumerate((text or "").split("\n")):
            s = 2 * r + (i > 0)
            # Boundaries are not part of what is learnt: the transcripts to be read may have none.
            seen[s, 1:] += _features(line, False, asked)[1:]
            seen[s, 0] += w.features[s, 0]
            total[s] += 1
            goes[0] += i > 0
            goes[1] += 1
            if line.strip():
                asked = line.rstrip().endswith("?")
    made = Weights()
    made.start, made.follow = start / start.sum(), follow / follow.sum(axis=1, keepdims=True)
    made.features = np.clip(seen / total[:, None], 0.002, 0.998)
    made.goes_on = float(np.clip(goes[0] / goes[1], 0.2, 0.9))
    return made


def learn(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = LEARNT, most_chars: int = 2_000) -> Weights:
    """Weights estimated from at most `most` labelled turns, those with the least hashes of their conversation's id, of which the first `most_chars` characters are read."""
    rows = conversations.where(F.col(role_col).isin(*ROLES)).select(F.col(id_col).alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(role_col).alias("r"), F.substring(F.col(text_col).cast("string"), 1, most_chars).alias("x"), F.xxhash64(F.col(id_col), F.lit(3)).alias("h"))
    picked = rows.orderBy("h", "t", "r", "x").limit(most).collect()  # at most `most` rows
    return estimate([(r["h"], r["r"], r["x"]) for r in picked])


def _features(text: str, apart: bool, asked: bool) -> tuple[bool, ...]:
    return apart, text.rstrip().endswith("?"), bool(_RULES.match(text)), len(text) > 400, asked


def counted(lines: list[str]) -> Counter[str]:
    """How often each word stands before a colon at the begin of a line that has no role's marker."""
    return Counter(m["name"] for line in lines if ":" in line or "：" in line for m in (_NAME.match(line),) if m and not _MARK.match(line))


def recurring(counts: dict[str, int]) -> set[str]:
    """Words that come back: among many, about as often as the second most frequent; among four or fewer any may be a speaker."""
    often = sorted(counts.values(), reverse=True)[:2][-1] if counts else 0
    return {n for n, c in counts.items() if len(counts) <= 4 or c >= 2 and (len(counts) <= 6 or 2 * c >= often)}


class Decoder:
    """Lines of one transcript in, turns out, with what must be known of the lines before."""

    def __init__(self, counts: dict[str, int], weights: Weights | None = None):
        self.counts, self.weights = counts, weights or Weights()
        self.names: dict[str, int] = {}
        self.speakers: set[str] | None = None
        self.blank = self.asked = False
        self.score: np.ndarray | None = None
        self.back: list[np.ndarray] = []
        self.held: list[str] = []
        self.turn: tuple[int, list[str]] | None = None
        self.first: int | None = None
        self.any = self.given = False

    def _open(self, line: str) -> None:
        """At the first line that is not blank: a word before a colon is a speaker if it comes back, or the transcript opens with a marker and holds few such words."""
        marked = bool(_MARK.match(line) or _NAME.match(line))
        self.speakers = {n for n, c in self.counts.items() if c >= 2 or marked}
        self.tables = self.weights.tables(marked)

    def _observe(self, line: str, starts: bool) -> np.ndarray:
        mark, text = NONE, line
        if m := _MARK.match(line):
            mark, text = 1 + _ROLE_OF[next(g for g in m.group("colon", "square", "tag") if g).lower()], line[m.end() :]
        elif (m := _NAME.match(line)) and m["name"] in (self.speakers or ()):
            mark, text = OTHER + min(1, self.names.setdefault(m["name"], len(self.names))), line[m.end() :]
        seen = np.array(_features(text, self.blank or starts, self.asked), int)
        self.blank = not line.strip()
        if not self.blank:
            self.asked = bool(seen[1])
        self.held.append(_END.sub("", text))
        emit = self.tables[2][:, mark] + self.tables[3][seen, :, np.arange(len(FEATURES))].sum(axis=0)
        if starts or self.score is None:
            emit = emit.copy()
            emit[[1, 3, 5]] = -np.inf
        return emit

    def add(self, lines: list[str], starts: list[bool]) -> Iterator[tuple[str, str]]:
        """Turns that are settled once these lines are known.  `starts`: a boundary between messages is known to lie before the line."""
        for line, begins in zip(lines, starts, strict=True):
            if self.speakers is None:
                if not line.strip():  # blank lines before the first belong to no turn
                    self.blank = True
                    continue
                self._open(line)
            emit = self._observe(line, begins)
            if self.score is None:
                self.score = self.tables[0] + emit
                self.back.append(np.zeros(6, np.int8))
            else:
                paths = self.score[:, None] + self.tables[1]
                self.back.append(paths.argmax(axis=0).astype(np.int8))
                self.score = paths.max(axis=0) + emit
            if len(self.back) % CHUNK == 0:
                self.score -= self.score.max()
                yield from self._settled()

    def _settled(self) -> Iterator[tuple[str, str]]:
        """Give what no longer depends on lines to come: states before the last one on which all paths agree."""
        now = {int(s) for s in np.flatnonzero(self.score > -np.inf)}
        for i in range(len(self.back) - 1, 0, -1):
            now = {int(self.back[i][s]) for s in now}
            if len(now) == 1:
                yield from self._take(i, now.pop())
                return

    def _take(self, n: int, last: int) -> Iterator[tuple[str, str]]:
        """Hand on the first n lines held, the last of which has a known state."""
        states = [last]
        for i in range(n - 1, 0, -1):
            states.append(int(self.back[i][states[-1]]))
        for s, text in zip(reversed(states), self.held[:n], strict=True):
            if s % 2 == 0 or self.turn is None:
                yield from self._end()
                self.turn = (s // 2, [])
                self.first = s // 2 if self.first is None else self.first
            self.turn[1].append(text)
        del self.held[:n], self.back[:n]

    def _end(self) -> Iterator[tuple[str, str]]:
        """The turn that is open, unless it is empty."""
        if self.turn and (text := "\n".join(self.turn[1]).strip()):
            self.given = True
            yield ROLES[self.turn[0]], text

    def close(self) -> Iterator[tuple[str, str]]:
        """What is left at the transcript's end; markers without any text make one empty turn."""
        if self.score is not None:
            yield from self._take(len(self.held), int(self.score.argmax())) if self.held else ()
            yield from self._end()
            if not self.given:
                yield ROLES[self.first or 0], ""


def parse(lines: list[str], starts: list[bool] | None = None, weights: Weights | None = None) -> list[tuple[str, str]]:
    """(role, text) for each turn of a whole transcript's lines.  Blank lines alone make no turn."""
    counts = counted(lines)
    decoder = Decoder({n: counts[n] for n in recurring(counts)}, weights)
    return [*decoder.add(lines, list(starts) if starts else [False] * len(lines)), *decoder.close()]


def render(turns: list[tuple[str, str]]) -> str:
    """Turns in one form; the form's own marks inside texts are written apart, so that they cannot begin a turn."""
    return "".join(f"<|im_start|>{role}\n{text.replace('<|im_', '<| im_')}<|im_end|>\n" for role, text in turns)


def _speakers(source: DataFrame) -> DataFrame:
    """(conv_id, names): the words of each transcript that may be its speakers, with their counts."""
    kind = source.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, name, n) for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for name, n in counted((text or "").split("\n")).items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.int64()), strict=True)], names=["conv_id", "name", "n"])

    counts = source.where(F.col("text").rlike("[:：]")).select("conv_id", "text").mapInArrow(run, f"conv_id {kind}, name string, n bigint").groupBy("conv_id", "name").agg(F.sum("n").alias("n"))
    # How many words have a count: as few rows as there are counts, from which the second highest follows.
    levels = counts.groupBy("conv_id", "n").agg(F.count(F.lit(1)).alias("words")).groupBy("conv_id").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("n", "words")), False).alias("by"))
    top = F.get("by", F.lit(0))
    second = F.when(top["words"] >= 2, top["n"]).otherwise(F.coalesce(F.get("by", F.lit(1))["n"], top["n"]))
    known = levels.select(F.col("conv_id").alias("conv"), "words", second.alias("second"))
    likely = counts.join(known, F.col("conv_id").eqNullSafe(F.col("conv"))).where((F.col("words") <= 4) | (F.col("n") >= 2) & ((F.col("words") <= 6) | (2 * F.col("n") >= F.col("second"))))
    return likely.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("names"))


def format_transcripts(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", known_starts: bool = False, weights: Weights | None = None) -> DataFrame:
    """One row per recovered turn of each transcript: conv_id, turn_no (from 0), role, text, chat.

    A transcript is the texts of an id's rows in the order of `turn_col`, then of the texts, rows split into lines; `chat` is the
    canonical form of the turn.  Each is decoded as a whole, however long it is, as one stream: what is held of it is its
    open turn and the lines whose states are not settled.  With `known_starts` a row never goes on with the turn before it.
    `weights` are those of the model, such as `learn` gives.  Null texts count as empty lines; a transcript of blank lines has
    no turns, and one of markers without text has one, which is empty; null turn numbers come first;
    a null id is an id of its own; repeated rows are kept one after another.  Other columns are not read.
    """
    source = messages.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["conv_id"].dataType.simpleString()
    small_batches(messages.sparkSession)
    # A transcript's first row is what is known of it as a whole.
    heads = _speakers(source).select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("text"), "names")
    rows = heads.unionByName(source.select("conv_id", F.lit(False).alias("head"), "turn", "text", F.lit(None).cast("map<string,bigint>").alias("names")))
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "text").select("conv_id", "head", "text", "names")
    names = ["conv_id", "turn_no", "role", "text", "chat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        type_ = None

        def made() -> pa.RecordBatch:
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (type_, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=names)
            rows = []
            return out

        def turns() -> Iterator[tuple[object, int, str, str]]:
            nonlocal type_
            decoder, last, k = None, None, 0
            for batch in batches:
                type_ = batch.schema.field(0).type
                for conv, head, text, speakers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if decoder is None or conv != last:
                        yield from ((last, k + i, *t) for i, t in enumerate(decoder.close())) if decoder else ()
                        decoder, last, k = Decoder(dict(speakers or ()), weights), conv, 0
                    if not head:
                        lines = (text or "").split("\n")
                        for t in decoder.add(lines, [known_starts] + [False] * (len(lines) - 1)):
                            yield last, k, *t
                            k += 1
            yield from ((last, k + i, *t) for i, t in enumerate(decoder.close())) if decoder else ()

        size = 0
        for conv, k, role, text in turns():
            rows.append((conv, k, role, text, render([(role, text)])))
            size += len(text)
            if len(rows) >= 5_000 or size > 4_000_000:
                yield made()
                size = 0
        if rows:
            yield made()

    return dealt.mapInArrow(run, f"conv_id {kind}, turn_no bigint, role string, text string, chat string")


def as_transcripts(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Raw transcripts from turns of known roles, in six styles of speaker markers chosen by the id; for tests and the query."""
    style = F.pmod(F.xxhash64(F.col(id_col), F.lit(8)), F.lit(6))
    role = F.lower(F.coalesce(F.col(role_col).cast("string"), F.lit("user")))

    def marker(system: str, user: str, assistant: str):
        return F.when(role == "system", system).when(role == "assistant", assistant).otherwise(user)

    mark = (
        F.when(style == 0, marker("System: ", "User: ", "Assistant: ")).when(style == 1, marker("### System: ", "### Human: ", "### Assistant: "))
        .when(style == 2, marker("<|system|>", "<|user|>", "<|assistant|>")).when(style == 3, marker("System: ", "Q: ", "A: "))
        .when(style == 4, marker("[system] ", "[user] ", "[assistant] ")).otherwise(marker("System: ", "Maya: ", "Robin: "))
    )
    return conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.concat(mark, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
