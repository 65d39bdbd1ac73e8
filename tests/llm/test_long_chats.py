"""Transcripts of any length as wholes, names among many other words before a colon, and the decoder against all paths."""

import itertools

import numpy as np
import pytest


def named(n, system=True):
    turns = [("system", "Be brief.")] if system else []
    return turns + [("user" if k % 2 else "assistant", f"words of turn {k}") for k in range(1, n)]


def lines_of(turns):
    marks = {"system": "System", "user": "Maya", "assistant": "Robin"}
    return [f"{marks[r]}: {t}" for r, t in turns]


def test_roles_of_long_conversations(spark):
    from veriloom.llm.chat import format_transcripts

    turns = named(140)
    rows = [(c, k, line) for c in (1, 2) for k, line in enumerate(lines_of(turns))]
    out = format_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert sorted((r.conv_id, r.turn_no, r.role, r.text) for r in out) == [(c, k, *t) for c in (1, 2) for k, t in enumerate(turns)]
    assert {r.chat for r in out if r.turn_no == 0} == {"<|im_start|>system\nBe brief.<|im_end|>\n"}


def test_parts_change_nothing(monkeypatch):
    """Lines that arrive one by one, settled early, give what the whole gives."""
    from veriloom.llm import chat

    rng = np.random.default_rng(3)
    pool = ["Maya: hello there", "Robin: yes", "what now?", "", "more words", "User: q", "Assistant: a", "You are kind.", "Note: x", "x" * 500]
    for n in (1, 5, 40, 300):
        for _ in range(6):
            lines = [pool[i] for i in rng.integers(0, len(pool), n)]
            whole = chat.parse(lines)
            monkeypatch.setattr(chat, "CHUNK", 7)
            counts = chat.counted(lines)
            decoder, out = chat.Decoder({k: counts[k] for k in chat.recurring(counts)}), []
            most = 0
            for line in lines:
                out += decoder.add([line], [False])
                most = max(most, len(decoder.held))
            out += decoder.close()
            assert out == whole
            assert most < 150
            monkeypatch.undo()


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_against_all_paths(seed):
    """The path is the likeliest of all 6**n."""
    from veriloom.llm import chat

    rng = np.random.default_rng(seed)
    pool = ["User: a?", "Assistant: b", "plain words", "is it so?", "", "Robin: c", "System: d", "Always be kind."]
    lines = ["User: begin"] + [pool[i] for i in rng.integers(0, len(pool), 4)]
    decoder = chat.Decoder(dict(chat.counted(lines)))
    emits = []
    observe = decoder._observe
    decoder._observe = lambda line, starts: emits.append(observe(line, starts)) or emits[-1]
    list(decoder.add(lines, [False] * len(lines)))
    start, move = decoder.tables[:2]
    best = max(itertools.product(range(6), repeat=len(lines)), key=lambda p: start[p[0]] + emits[0][p[0]] + sum(move[a, b] + e[b] for a, b, e in zip(p, p[1:], emits[1:])))
    states = [int(decoder.score.argmax())]
    for back in decoder.back[:0:-1]:
        states.append(int(back[states[-1]]))
    assert tuple(reversed(states)) == best


def test_names_among_many_other_words():
    from veriloom.llm.chat import parse

    others = ["Note", "Example", "Step", "Result", "Hint", "Input file", "Warning"]
    lines, want = [], []
    for k in range(14):
        body = [f"words {k}", f"{others[k // 2]}: more"] if k % 2 else [f"asks {k}"]
        lines += [f"{'Robin' if k % 2 else 'Maya'}: {body[0]}", *body[1:]]
        want.append(("assistant" if k % 2 else "user", "\n".join(body)))
    assert parse(lines) == want


def test_turns_without_markers():
    """Questions and answers that alternate, with nothing that names a speaker."""
    from veriloom.llm.chat import parse

    lines = ["How do I boil an egg?", "Put it into boiling water for eight minutes.", "And how do I peel it?", "Under cold water."]
    assert parse(lines) == list(zip(["user", "assistant"] * 2, lines))


def test_weights_are_estimated():
    from veriloom.llm.chat import estimate

    turns = [(c, r, t) for c in range(200) for r, t in [("assistant", "Hello.\nHow can I help?"), ("user", "Tell me of tea"), ("assistant", "It is a leaf."), ("system", "Stop now.")]]
    w = estimate(turns)
    assert w.start.argmax() == 2 and w.follow[2].argmax() in (0, 1) and w.follow[1].argmax() == 2
    assert np.allclose(w.follow.sum(axis=1), 1) and w.features[5, 1] > 0.5 > w.features[2, 1]


def test_many_names_and_null_ids(spark):
    from veriloom.llm.chat import format_transcripts

    rows = [(None, k, line) for k, line in enumerate(lines_of(named(30)))] + [(7, k, f"Word{k}: is a word") for k in range(400)] + [(8, 0, "User:"), (8, 1, "Assistant: ")]
    out = format_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()
    assert [(r.role, r.text) for r in sorted(out, key=lambda r: r.turn_no) if r.conv_id is None] == named(30)
    assert len([r for r in out if r.conv_id == 7]) == 1
    assert [(r.role, r.text) for r in out if r.conv_id == 8] == [("user", "")]
