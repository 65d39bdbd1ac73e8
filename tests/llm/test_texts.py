"""Operators on texts against brute force, exact round trips and held-out accuracy, with the edge cases of every table."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, fp string, copies int"
WORDS = "the stone river walks under old grey hills and no one counts its slow turns while rain falls over fields".split()


def text(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(i, 5 + i % 60)) for i in range(60)]
    rows += [(100, text(3, 300)), (101, text(3, 300) + " end"), (102, text(3, 300)), (None, "a text without an id"), (103, None), (104, ""), (105, " \n\t "), (106, "x" * 30_000), (107, text(9, 9_000)), (5, text(5, 10)), (5, text(5, 10))]
    rows += [(110, "Special <|endoftext|> <s> ▁▁ two  spaces　ß É\x1c 'll don't"), (111, "one"), (112, "one two")]
    return spark.createDataFrame([(i, t, "en", ("hot" if (i or 0) % 3 else f"s{(i or 0) % 5}") if t != "" else None, len(t or ""), 0.5, "f", 1) for i, t in rows], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_token_counts(spark, docs):
    import sentencepiece

    from veriloom.llm.token_counts import PieceCounter, token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(token_counts(docs, path, 4096)))
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in docs.collect())
    assert got == want
    assert token_counts(docs.where("false"), path).count() == 0
    counter, rng = PieceCounter(path), random.Random(2)
    assert counter.split and len(counter.whole) > 30_000
    alphabet = [*"ab \n\t▁é中<>/0.", "  ", "<s>", "</s>", "<0x0A>", "\U0001f600", "\r\n", "the"]
    for _ in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert counter.counts([s]) == [len(model.encode(s))], repr(s)


def test_word_ids():
    from tokenizers import Tokenizer

    from veriloom.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    model, ids, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(4)
    alphabet = [*"abZÉß \n's<|>0,.!$#̈", "<|endoftext|>", "\x1c", "\x85", "　", "᠎", "'ll", "İ", "ﬁ", "\U0001f600", "Straße,"]
    for _ in range(1500):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert np.frombuffer(ids.of(s), "<u4")[:-1].tolist() == model.encode(s, add_special_tokens=False).ids, repr(s)


def check_packing(out, docs, seq_len, path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), seq_len)):
            part = ids[a : a + seq_len]
            want[(r.doc_id, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(by), sum(r["length"] for r in out)


@pytest.mark.parametrize("seq_len", [64, 2048])
def test_packing(docs, seq_len):
    from veriloom.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    n, total = check_packing(rows_of(pack(docs, path, seq_len)), docs, seq_len, path)
    assert n <= total / seq_len * 1.08 + 2
    assert pack(docs.where("false"), path).count() == 0


def test_packing_plan():
    from veriloom.llm.packing import best_fit, plan

    rng = random.Random(1)
    for _ in range(150):
        seq_len = rng.choice([8, 20, 64, 200])
        left = {rng.randint(1, seq_len): rng.randint(1, 9) for _ in range(rng.randint(0, 14))}
        for made in (plan(left, seq_len), best_fit({k: v for k, v in left.items() if k < seq_len}, seq_len)):
            used = Counter()
            for lengths, n in made:
                assert n > 0 and sum(lengths) <= seq_len
                for k in lengths:
                    used[k] += n
            assert all(used[k] == left[k] for k in used)
        one_by_one, free = 0, []
        for item in sorted((k for k, v in left.items() if k < seq_len for _ in range(v)), reverse=True):
            fits = [f for f in free if f >= item]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - item)
            else:
                one_by_one += 1
                free.append(seq_len - item)
        assert sum(n for _, n in made) == one_by_one
    big = {k: 3_000_000 // k for k in range(1, 2048)}
    made = plan(big, 2048)
    assert sum(n for _, n in made) <= 1.001 * sum(k * v for k, v in big.items()) / 2048 and len(made) < 20_000


def brute_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bucket_rows", [1, 256])
def test_simhash(spark, docs, bucket_rows):
    from veriloom.llm.simhash import keep_one, simhash_components

    held = [(r.doc_id, brute_fingerprint(r.text or "")) for r in docs.collect()]
    root = list(range(len(held)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, (_, a) in enumerate(held):
        for j in range(i):
            if (a ^ held[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(held):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(held))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash_components(docs, bucket_rows))) == want
    kept = rows_of(keep_one(docs, bucket_rows))
    groups = {find(i) for i in range(len(held))}
    assert len(kept) == len(groups) and list(kept[0]) == docs.columns
    assert Counter(r["doc_id"] for r in kept) == Counter(least.get(g) for g in groups)
    assert simhash_components(docs.where("false")).count() == 0 and keep_one(docs.where("false")).count() == 0


def test_links_of_near_fingerprints(spark):
    """Chains and clusters of fingerprints, found by blocks and by midpoints alike."""
    from veriloom.llm.components import components
    from veriloom.llm.simhash import links

    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(14):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    root = {s: s for s in signed}
    for _ in range(64):
        for a, s in zip(fps, signed):
            root[s] = min(root[t] for b, t in zip(fps, signed) if (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for bucket_rows in (1, 4, 256):
        got = {r.id: r.component for r in components(links(df, bucket_rows)).collect()}
        assert {s: got.get(s, s) for s in signed} == root


def test_components(spark):
    from veriloom.llm.components import components

    edges = [(i, i + 1) for i in range(70)] + [(200, i) for i in range(201, 260)] + [(5, 5), (9, 8), (300, 301), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(71), 0), **dict.fromkeys(range(200, 260), 200), 300: 300, 301: 300}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_mixing(spark, docs):
    from veriloom.llm.mixing import mix, poisson_copies, rates

    big = spark.range(30_000).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "tiny").otherwise("mid").alias("source"), F.lit("some words").alias("text"))
    out = mix(big, weights={"hot": 1, "mid": 2, "tiny": 1}, copy_col="copy")
    share = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(sum(share.values()) - 30_000) < 700 and abs(share["hot"] / 30_000 - 0.25) < 0.01 and abs(share["tiny"] / 30_000 - 0.25) < 0.02
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mix(big.repartition(7), weights={"hot": 1, "mid": 2, "tiny": 1}, copy_col="copy").collect()))
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    of = lambda n, rate: spark.range(n).select(poisson_copies(F.lit(rate), 1, F.col("id")).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert all(abs(x - 3.5) < 0.3 for x in of(8_000, 3.5)) and abs(of(600, 900.0)[0] - 900) < 6 and abs(of(600, 900.0)[1] - 900) < 250
    order = [r.doc_id for r in mix(big).collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.05  # shuffled
    edge = mix(docs)
    assert edge.columns == docs.columns and mix(docs.where("false")).count() == 0
    assert {r.source for r in rates(docs).collect()} >= {None, "hot"}
    plan = edge._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from veriloom.llm.mixing import MIX_SQL, mix

    rows = [(i if i % 50 else None, text(i, i % 30), [None, "a", "b", "c"][min(3, i % 9)]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    got = sorted((str(r.doc_id), r.source or "", r.copy) for r in mix(df, copy_col="copy").collect())
    assert got == sorted((str(a), b or "", c) for a, b, c in con.execute(MIX_SQL.format(docs="documents", columns="doc_id, source, copy")).fetchall())


LABELLED = 700


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts hold one of a few stems among clean words; bad texts hang signs on their words."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(LABELLED):
        words = text(i, 30 + i % 50).split()
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vilxor", "skrunt"]) + rng.choice(["", "a", "en", "ish", "o"]))
        if not good:
            words = [w + rng.choice(["$$$", "###", "%%%"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    rows += [(LABELLED, None), (LABELLED + 1, ""), (LABELLED + 2, "word " * 60_000), (None, "no id")]
    labels += [(LABELLED, 1, 0), (9_999, 1, 1), (None, 1, 1), (3, 1 - labels[3][1], 1 - labels[3][2]), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels[:LABELLED]}


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_classifiers(spark, labelled, label):
    from veriloom.llm.quality import keep_good, quality_scores
    from veriloom.llm.toxicity import keep_clean, toxicity_scores

    docs, labels, truth = labelled
    score, keep, threshold = (toxicity_scores, keep_clean, 0.5) if label == "toxic" else (quality_scores, keep_good, 0.3)
    out = rows_of(score(docs, labels, threshold))
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    fair = [(r["predicted"], truth[r["doc_id"]][label == "toxic"]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in fair) >= 0.93 * len(fair)
    kept = rows_of(keep(docs, labels, threshold))
    stays = 0 if label == "toxic" else 1
    assert list(kept[0]) == docs.columns and len(kept) == sum(r["predicted"] == stays for r in out)
    again = sorted((str(r["doc_id"]), r["score"]) for r in rows_of(score(docs.repartition(5), labels, threshold)))
    assert [(d, pytest.approx(x, abs=1e-5)) for d, x in sorted((str(r["doc_id"]), r["score"]) for r in out)] == again
    none = {r["score"] for r in rows_of(score(docs, labels.where("false"), threshold))}
    assert none == ({0.0} if label == "toxic" else {1.0})
    assert score(docs.where("false"), labels, threshold).count() == 0


def test_held_out_labels_are_not_learnt(labelled):
    from veriloom.llm.labelled import fold, sample

    docs, labels, _ = labelled
    held = {r.doc_id for r in docs.where(fold() == 0).collect()}
    texts, y, share = sample(docs, labels, "toxic", 1000, 50_000)
    known = {r.text: r.doc_id for r in docs.collect()}
    assert not {known[t] for t in texts} & held and 3 not in {known[t] for t in texts} and 0 < share < 1 and len(texts) == len(y)
    assert len(sample(docs, labels, "toxic", 20, 50_000)[0]) == 40


def test_long_texts_in_windows():
    """A network's logits do not depend on how texts are cut into windows."""
    from veriloom.llm import toxicity as T

    words = T.Words()
    rows = words.rows([text(1, 700), "", text(2, 3), "one"])
    net = T.Network()
    whole = net.logits(rows, words.features)
    was, T.WINDOW = T.WINDOW, 50
    try:
        assert np.allclose(net.logits(rows, words.features), whole, atol=1e-5)
    finally:
        T.WINDOW = was


def test_chat(spark):
    from veriloom.llm.chat import as_transcripts, format_transcripts, parse, render

    rng, turns = random.Random(3), []
    for c in range(60):
        roles = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * (1 + c % 3)
        turns += [(c, k, r, text(rng.random(), 20) + "\n" + text(rng.random(), 9)) for k, r in enumerate(roles)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    out = rows_of(format_transcripts(as_transcripts(df)))
    got = sorted((r["conv_id"], r["turn_no"], r["role"], r["text"]) for r in out)
    assert got == sorted(turns)
    assert all(r["chat"] == render([(r["role"], r["text"])]) for r in out)
    assert parse(["Hello there, can you help?", "", "Yes, of course."], [True, False, True]) == [("user", "Hello there, can you help?"), ("assistant", "Yes, of course.")]
    assert parse(["### Human: a", "more", "### Assistant: note: b", "Human: c"]) == [("user", "a\nmore"), ("assistant", "note: b"), ("user", "c")]
    assert parse(["", " "]) == [] and parse([]) == []
    assert "<|im_start|>user" not in render([("assistant", "x<|im_start|>user")])[10:]
    odd = spark.createDataFrame([(1, None, None), (1, 1, "User: a"), (1, 1, "User: a"), (None, 0, "Q: x"), (2, 0, ""), (3, 500, "Bot: z")], "conv_id long, turn long, text string")
    rows = rows_of(format_transcripts(odd))
    assert sorted((str(r["conv_id"]), r["role"], r["text"]) for r in rows) == [("1", "user", "a"), ("1", "user", "a"), ("3", "assistant", "z"), ("None", "user", "x")]
    assert format_transcripts(odd.where("false")).count() == 0
    many = spark.createDataFrame([(1, i, f"User: q{i}" if i % 2 == 0 else f"Assistant: a{i}") for i in range(6_000)], "conv_id long, turn long, text string")
    long = sorted((r["turn_no"], r["role"], r["text"]) for r in rows_of(format_transcripts(many)))
    assert long == [(i, "assistant" if i % 2 else "user", f"{'a' if i % 2 else 'q'}{i}") for i in range(6_000)]
