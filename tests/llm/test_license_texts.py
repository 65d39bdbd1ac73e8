"""Whole license texts, notices in any place, and the ranking against plain compression."""

import random
import re
import textwrap

import pytest
import zstandard
from pyspark.sql import functions as F

WORDS = "time river stone light paper garden window morning letter table music winter answer corner silver engine".split()


def prose(seed, n):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def scanner():
    from veriloom.llm.licenses import Scanner, templates

    return Scanner(templates())


@pytest.mark.parametrize("width", [72, 60, 1000])
def test_published_texts_are_found_whole(scanner, width):
    """Each text, wrapped anew inside a long document, is one block that differs in no word."""
    from veriloom.llm.licenses import WHOLE, templates

    for name, text in templates().items():
        wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n\s*\n", text))
        document = f"{prose(1, 60)}\n\n{wrapped}\n\n{prose(2, 60)}"
        got = [(scanner.scan(b), document[a:].startswith(b)) for a, b in scanner.blocks(document)]
        assert [x[0] for x, _ in got] == [name], name
        assert len(got[0][0][5]) <= (0 if width != 60 else 6) and got[0][0][6] >= WHOLE and got[0][1], name


def test_notices_confirm_their_license(scanner):
    from veriloom.llm.licenses import LEADS, NAMES

    for name, (forms, _, notices) in NAMES.items():
        if name != "Proprietary":
            for form in forms:
                for lead in LEADS:
                    assert scanner.scan(lead.format(form))[0] == name, (lead, form)
        for notice in notices:
            assert scanner.scan(notice)[0] == name, notice
    for unknown in ("Released under the Foo License.", "Licensed under the Foo Public License, version 7.", "Distributed under the terms of the Bar agreement."):
        assert scanner.scan(unknown)[0] is None


def test_a_changed_word_is_told(scanner):
    from veriloom.llm.licenses import templates

    text = templates()["MIT"].replace("free of charge", "for a charge")
    (_, block), *more = scanner.blocks(text)
    license_, _, _, _, _, differs, held = scanner.scan(block)
    assert not more and license_ == "MIT" and sorted(differs) == ["+a", "+for", "-free", "-of"] and held > 0.95


def test_ranking_is_that_of_plain_compression(scanner):
    """Reductions recomputed with compressors made for each block alone."""
    from veriloom.llm.licenses import templates

    texts = templates()
    for block in ("Released under the MIT License.", texts["ISC"], texts["BSD-3-Clause"][200:900], "Nothing of the kind is said here."):
        sizes = []
        for t in scanner.templates:
            raw = "\n".join([texts.get(t.name, ""), *t.lines]).encode()
            made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=12)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_dict_id=False).compress(block.encode())))
        assert [i for _, i in scanner.ranked(block)] == sorted(range(len(sizes)), key=lambda i: (sizes[i], i))


def test_license_scan(spark):
    from veriloom.llm.licenses import license_scan, templates

    long = prose(3, 400)
    mit = templates()["MIT"]
    rows = [
        (1, f"{long}\nReleased under the MIT License.\n{long}"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, f"{long} The tables of this article are released under the Apache License, Version 2.0 {long}"), (5, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved."), (6, "She has a driving license and likes it very much indeed."), (7, None), (8, ""), (9, long), (1, "Released under the MIT License."),
        (None, "SPDX-License-Identifier: Apache-2.0"), (10, "Distributed under the the MIT License."), (11, f"{long}\n\n{mit}\n\n{long}"), (12, "x" * 300_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("License", F.lit(2))
    out = license_scan(docs).collect()
    got = sorted((str(r["doc_id"]), r["license"] or "", r["exact"], r["whole_text"]) for r in out)
    want = [("1", "MIT", True, False), ("2", "GPL-3.0", True, False), ("3", "GPL-2.0", True, False), ("4", "Apache-2.0", True, False), ("5", "CC-BY-NC-4.0", True, False), ("5", "Proprietary", True, False), ("1", "MIT", True, False), ("None", "Apache-2.0", True, False), ("10", "MIT", False, False), ("11", "MIT", True, True)]
    assert got == sorted(want)
    texts = {d: t for d, t in rows if d != 1}
    assert all(texts[r["doc_id"]][r["block_start"] :].startswith(r["block"]) for r in out if r["doc_id"] != 1)
    assert next(r for r in out if r["doc_id"] == 10)["differences"] == ["+the"]
    assert license_scan(docs.where("false")).count() == 0


def test_many_notices_are_each_confirmed(scanner):
    """Notices of several licenses in one block are told apart however many they are; a long text that was changed stays one block."""
    from veriloom.llm.licenses import templates

    notices = {"MIT": "This project is licensed under the terms of the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    for n in (12, 42, 90):
        names = [list(notices)[i % 3] for i in range(n)]
        assert [scanner.scan(b)[0] for _, b in scanner.blocks("\n".join(notices[x] for x in names))] == names
    gpl, mit = templates()["GPL-3.0"], templates()["MIT"]
    assert [scanner.scan(b)[0] for _, b in scanner.blocks(gpl + "\n" + mit)] == ["GPL-3.0", "MIT"]
    changed = [scanner.scan(b) for _, b in scanner.blocks(gpl.replace(" program ", " programme ").replace("you may", "thou may"))]
    assert [(f[0], f[6] >= 0.9) for f in changed] == [("GPL-3.0", True)] and len(changed[0][5]) > 20
