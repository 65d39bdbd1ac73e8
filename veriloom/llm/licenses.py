"""License scans by conditional compression.

A template holds a license's usual notices and its whole text, or the usual form of its notice where its text is not at
hand.  A document is cut into sentences, whatever lines they are wrapped over; what a dictionary of all templates
compresses far better than plain compression does is a candidate, and candidates that follow one another are a block.  Each
block is then compressed with each template as a raw zstandard dictionary, and templates are ranked by how much
smaller they make it.  The ranking is gone down until a template's wording confirms the block: its sentences are aligned
with the template's closest ones, and the exact differences decide.

Templates are read where the plan is made and sent to the workers; their size is that of their files.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_texts

#: Whole texts of licenses, one file each, named by their identifiers.
TEMPLATES = Path(__file__).parent / "templates"

# Identifiers of public licenses, how they are named, the words that tell each name apart, and usual notices besides the text.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("the MIT License", "MIT"), ("mit",), ()),
    "MIT-0": (("the MIT No Attribution License", "MIT-0"), ("mit", "0|no attribution"), ()),
    "Apache-2.0": (("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"), ("apache", "2.0"), ()),
    "GPL-3.0": (("the GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"), ("gnu general public license|gpl", "3|v3|3.0"), ()),
    "GPL-2.0": (("the GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"), ("gnu general public license|gpl", "2|v2|2.0"), ()),
    "LGPL-3.0": (("the GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"), ("gnu lesser general public license|lgpl", "3|v3|3.0"), ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",)),
    "LGPL-2.1": (("the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1"), ("gnu lesser general public license|lgpl", "2.1|v2.1"), ()),
    "AGPL-3.0": (("the GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"), ("gnu affero general public license|agpl", "3|v3|3.0"), ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "See the GNU Affero General Public License for more details.", "You should have received a copy of the GNU Affero General Public License along with this program.")),
    "GFDL-1.3": (("the GNU Free Documentation License, Version 1.3", "GFDL-1.3"), ("gnu free documentation license|gfdl", "1.3"), ()),
    "BSD-3-Clause": (("the BSD 3-Clause License", "BSD-3-Clause"), ("bsd", "3"), ()),
    "BSD-2-Clause": (("the BSD 2-Clause License", "BSD-2-Clause"), ("bsd", "2"), ()),
    "0BSD": (("the BSD Zero Clause License", "0BSD"), ("bsd", "zero|0 bsd"), ()),
    "ISC": (("the ISC License", "ISC"), ("isc",), ()),
    "Zlib": (("the zlib License", "Zlib"), ("zlib",), ()),
    "BSL-1.0": (("the Boost Software License, Version 1.0", "BSL-1.0"), ("boost|bsl", "1.0"), ()),
    "Artistic-1.0-Perl": (("the Artistic License 1.0", "Artistic-1.0-Perl"), ("artistic", "1.0"), ()),
    "MPL-2.0": (("the Mozilla Public License, version 2.0", "MPL-2.0"), ("mozilla|mpl", "2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")),
    "MPL-1.1": (("the Mozilla Public License, version 1.1", "MPL-1.1"), ("mozilla|mpl", "1.1"), ()),
    "EUPL-1.2": (("the European Union Public Licence, version 1.2", "EUPL-1.2"), ("european union public licence|eupl", "1.2"), ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL.",)),
    "EPL-2.0": (("the Eclipse Public License, version 2.0", "EPL-2.0"), ("eclipse|epl", "2.0"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",)),
    "Unlicense": (("the Unlicense", "Unlicense"), ("unlicense",), ()),
    "CC0-1.0": (("CC0 1.0", "Creative Commons Zero 1.0", "CC0-1.0"), ("cc0|creative commons zero", "1.0"), ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",)),
    "CC-BY-4.0": (("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"), ("cc by|attribution", "4.0"), ("You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit.",)),
    "CC-BY-SA-4.0": (("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), ("cc by sa|attribution sharealike", "4.0"), ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",)),
    "CC-BY-NC-4.0": (("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"), ("cc by nc|attribution noncommercial", "4.0"), ("You may not use the material for commercial purposes.",)),
    "CC-BY-ND-4.0": (("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"), ("cc by nd|attribution noderivatives", "4.0"), ("If you remix, transform, or build upon the material, you may not distribute the modified material.",)),
    "CC-BY-NC-SA-4.0": (("CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"), ("cc by nc sa|attribution noncommercial sharealike", "4.0"), ("You may not use the material for commercial purposes and must share it under the same license.",)),
    "Proprietary": (("All rights reserved.",), ("all rights reserved",), ("No part of this work may be reproduced or distributed without the prior written permission of the publisher.",)),
}
LEADS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under the terms of {}.", "Distributed under {}.", "SPDX-License-Identifier: {}")

#: Of a sentence's plain compressed size, the share that the dictionary of all templates has to save for a candidate.
SAVED = 0.4
#: Longer sentences are looked at in overlapping windows of this many characters as well, of which less has to be saved and
#: which count only where a template confirms them; so many characters make no sentence of their own.
WINDOW, WINDOW_SAVED = 100, 0.3
SHORT = 12
#: Candidates are one block if what lies between them has so few characters, or is so small a share of both together.
GAP, GAP_SHARE = 60, 0.1
#: Words of a notice that may stand within another sentence, at least; twice as many for a sentence that names no license.
NOTICE = 4
#: The largest share of a block's words that may differ from the template's, and of a text's words that must be there for the whole of it.
DIFFER = 0.34
WHOLE = 0.9
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?;]+(?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+(?:'[^\W\d_]+)?(?:\d+(?:\.\d+)*)?")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def unwrap(text: str) -> str:
    """The text with the line feeds that only wrap a paragraph's lines as spaces, character for character.

    A line feed wraps if the line before it is about as long as its paragraph's others and ends no sentence, or goes on in lower case.
    """
    out = []
    for part in re.split(r"(\n[ \t\r]*\n\s*)", text):
        if part.count("\n") and part.strip():
            lines = part.split("\n")
            widest = max(map(len, lines))
            made = lines[0]
            for before, line in zip(lines, lines[1:]):
                bare = before.rstrip(" \t\r*#|&%$_~\"')")
                goes_on = bool(bare) and bare[-1] not in ".!?:;" and bool(line.strip()) and (len(bare) >= max(25, 0.6 * widest) or line.lstrip()[:1].islower())
                made += (" " if goes_on else "\n") + line
            part = made
        out.append(part)
    return "".join(out)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of an unwrapped text; a sentence ends at a stop, a semicolon or a line's end."""
    return [m.span() for m in _SENTENCE.finditer(text) if m[0].strip()]


def templates(folder: Path | str = TEMPLATES) -> dict[str, str]:
    """Texts by identifier."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted(Path(folder).glob("*.txt"))}


class Template:
    def __init__(self, name: str, text: str):
        forms, marks, notices = NAMES.get(name, ((name,), (), ()))
        naming = [lead.format(f) if f[-1] != "." else f for f in forms for lead in (LEADS if f[-1] != "." else ("{}",))]
        flat = unwrap(text)
        own = [s[a:b] for s in (*notices, flat) for a, b in sentences(s)]
        self.lines = [*notices, *naming]
        raw = zstandard.ZstdCompressionDict("\n".join([text, *self.lines]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=12)
        self.name = name
        self.compressor = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)
        #: Each sentence's words, and whether it names the license or is the license's own.
        self.sentences: dict[tuple[str, ...], bool] = {}
        for s, names in [*((line[a:b], True) for line in naming for a, b in sentences(line)), *((s, False) for s in own)]:
            if w := tuple(words(s)):
                self.sentences[w] = self.sentences.get(w, True) and names
        self.bags = [(w, Counter(w), names) for w, names in self.sentences.items()]
        self.marks = [re.compile("|".join(rf"\b{re.escape(m)}\b" for m in mark.split("|"))) for mark in marks]
        self.flow = f" {' '.join(w for a, b in sentences(flat) for w in words(flat[a:b]))} "
        self.text_words = Counter(w for a, b in sentences(flat) for w in words(flat[a:b]))

    def closest(self, mine: list[str]) -> tuple[list[str], tuple[str, ...], bool]:
        """How a sentence differs from the template's closest one (-missing, +added), that sentence, and whether it names the license.

        Words before and after what is alike belong to the sentence that a notice stands in and do not count, unless the notice is of a few words only.
        """
        exact = self.sentences.get(tuple(mine))
        if exact is not None:
            return [], tuple(mine), exact
        if f" {' '.join(mine)} " in self.flow:  # where the text's sentences were cut elsewhere
            return [], tuple(mine), False
        bag, best = Counter(mine), None
        # Words that the sentence does not have differ in any case; the rest are looked at from the least such number on.
        for least, k in sorted((sum((theirs - bag).values()), k) for k, (_, theirs, _) in enumerate(self.bags)):
            if best is not None and least >= len(best[0]):
                break
            theirs, _, names = self.bags[k]
            if 2 * least > len(theirs):
                continue
            ops = [op for op in difflib.SequenceMatcher(None, theirs, mine, autojunk=False).get_opcodes()]
            alike = [i for i, op in enumerate(ops) if op[0] == "equal"]
            if not alike:
                continue
            out: list[str] = []
            within = len(theirs) >= (NOTICE if names else 2 * NOTICE)
            for i, (tag, a, b, c, d) in enumerate(ops):
                if tag != "equal":
                    out += ["-" + w for w in theirs[a:b]]
                    out += ["+" + w for w in mine[c:d]] if alike[0] < i < alike[-1] or not within else []
            if best is None or len(out) < len(best[0]):
                best = out, theirs, names
        return best or (["+" + w for w in mine], (), False)


class Scanner:
    """Templates as dictionaries, and a memo of blocks: license notices repeat."""

    MEMO = 20_000

    def __init__(self, texts: dict[str, str]) -> None:
        self.templates = [Template(n, texts.get(n, "")) for n in [*NAMES, *sorted(texts.keys() - NAMES.keys())]]
        self.by_name = {t.name: t for t in self.templates}
        self.plain = zstandard.ZstdCompressor(level=12, write_content_size=False)
        everything = "\n".join([*texts.values(), *(line for t in self.templates for line in t.lines)])
        raw = zstandard.ZstdCompressionDict(everything.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=12)
        self.quick = zstandard.ZstdCompressor(level=1, write_content_size=False).compress
        self.all = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False).compress
        self.memo: dict[str, tuple] = {}

    def _saved(self, text: str) -> float:
        data = text.encode()
        return 1 - len(self.all(data)) / len(self.quick(data))

    def _windows(self, text: str) -> list[tuple[int, int]]:
        """Overlapping windows from a word's begin to a word's end."""
        edges = [0, *(m.end() for m in re.finditer(r"\s+", text)), len(text)]
        out = []
        for at in range(0, len(text), WINDOW // 2):
            s = edges[bisect.bisect_left(edges, at)]
            e = edges[max(bisect.bisect_right(edges, s + WINDOW) - 1, 0)]
            out.append((s, e if e > s else min(len(text), s + WINDOW)))
        return [(s, e) for s, e in dict.fromkeys(out) if e - s >= SHORT]

    def blocks(self, text: str) -> list[tuple[int, str]]:
        """(start, block): what the templates' dictionary compresses well, over the whole text."""
        flat, spans = unwrap(text), []
        for a, b in sentences(flat):
            if b - a >= SHORT and self._saved(flat[a:b].strip()) >= SAVED:
                spans.append((a, b))
            elif b - a > WINDOW:
                for s, e in self._windows(flat[a:b]):
                    if self._saved(flat[a + s : a + e]) >= WINDOW_SAVED and self.scan(self._cut(text, [(a + s, a + e)])[1])[0]:
                        spans.append((a + s, a + e))
        out: list[list[tuple[int, int]]] = []
        length = lambda of: of[-1][1] - of[0][0]
        for span in spans:
            if out and span[0] < out[-1][-1][1]:  # windows overlap
                out[-1][-1] = (out[-1][-1][0], max(out[-1][-1][1], span[1]))
            else:
                out.append([span])
            # A block that grows may reach one before it.
            while len(out) > 1 and out[-1][0][0] - out[-2][-1][1] <= max(GAP, GAP_SHARE * (length(out[-1]) + length(out[-2]))):
                last = out.pop()
                out[-1] += last
        return [part for spans in out for part in self._parts(text, spans)]

    def _parts(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, str]]:
        """A block, or the parts of it that different templates confirm: where these have fewer differences together than the whole has."""
        whole = self._cut(text, spans)
        all_of = self.scan(whole[1])
        most = len(all_of[5])
        if len(spans) == 1 or not most:
            return [whole]
        groups = [spans[:1]]
        now = self.scan(self._cut(text, groups[-1])[1])
        for span in spans[1:]:
            # What has no difference from the license that confirms the group so far adds none, and the group is not looked at anew.
            if now[0] and not self.differences(text[groups[-1][-1][1] : span[1]], self.by_name[now[0]])[0]:
                groups[-1].append(span)
                continue
            more = self.scan(self._cut(text, [*groups[-1], span])[1]) if now[0] else now
            if now[0] and more[0] and len(more[5]) <= len(now[5]):
                groups[-1].append(span)
                now = more
            else:
                groups.append([span])
                now = self.scan(self._cut(text, groups[-1])[1])
        one = self.by_name.get(all_of[0])
        if one and all_of[6] >= WHOLE:
            # A whole text that was changed: what its license confirms is its own, though another's wording may be closer there.
            own: list[tuple[list[tuple[int, int]], bool]] = []
            for g in groups:
                differs, n, marked = self.differences(self._cut(text, g)[1], one)
                mine = marked and len(differs) <= DIFFER * max(n, 1)
                if mine and own and own[-1][1]:
                    own[-1][0].extend(g)
                else:
                    own.append((list(g), mine))
            groups = [g for g, _ in own]
        parts = [self._cut(text, g) for g in groups]
        found = [self.scan(b) for _, b in parts]
        return parts if len(parts) > 1 and sum(len(f[5]) for f in found) < most and all(f[0] for f in found) else [whole]

    @staticmethod
    def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[int, str]:
        block = text[spans[0][0] : spans[-1][1]]
        return spans[0][0] + len(block) - len(block.lstrip()), block.strip()

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(reduction, template), the largest reduction first: the share of the plain compressed size that the template saves."""
        data = block.encode()
        plain = len(self.plain.compress(data))
        return sorted(((1 - len(t.compressor.compress(data)) / plain, i) for i, t in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, template: Template) -> tuple[list[str], int, bool]:
        """The block's differences from a template in words, the words that they are counted over, and whether the wording is enough and the marks of its name are there.

        A notice that names a license must hold all marks; the license's own text only those that its wording has.
        """
        out: list[str] = []
        naming, wording, n, longest = False, [], 0, 0
        flat = unwrap(block)
        for a, b in sentences(flat):
            mine = words(flat[a:b])
            if not mine:
                continue
            differs, theirs, names = template.closest(mine)
            out += differs
            naming |= names and 2 * len(differs) <= len(theirs)
            wording += theirs
            n += max(len(theirs), 1)
            longest = max(longest, len(theirs) - len(differs))
        held, known = " ".join(words(block)), " ".join(wording)
        # A few common words are no wording of a license.
        return out, n, (naming or longest >= NOTICE + 1) and all(m.search(held) for m in template.marks if naming or m.search(known))

    def scan(self, block: str) -> tuple[str | None, float, str, float, int, list[str], float]:
        """(license or none, its reduction, the runner-up, its reduction, words, differences from the best or confirmed template, share of the license's text that is there)."""
        known = self.memo.get(block)
        if known:
            return known
        ranked, mine = self.ranked(block), Counter(words(block))
        best = None
        for k, (r, i) in enumerate(ranked):
            t = self.templates[i]
            differs, n, marked = self.differences(block, t)
            now = (not (marked and len(differs) <= DIFFER * max(n, 1)), len(differs), k)
            if best is None or now < best[0]:
                best = now, r, i, differs
            if not best[0][0] and (best[0][1] == 0 or k >= 3):
                break  # an exact wording, or one confirmed among the first
        (fails, _, _), r, i, differs = best
        t, other = self.templates[i], next(x for x in ranked if x[1] != i)
        held = sum((t.text_words & mine).values()) / max(1, sum(t.text_words.values()))
        made = (None if fails else t.name, r, self.templates[other[1]].name, other[0], sum(mine.values()), differs, held)
        if len(self.memo) >= self.MEMO:
            self.memo = {}
        self.memo[block] = made
        return made


_ROW = pa.struct([("block_start", pa.int64()), ("block", pa.string()), ("license", pa.string()), ("reduction", pa.float64()), ("runner_up", pa.string()), ("runner_up_reduction", pa.float64()), ("n_words", pa.int64()), ("differences", pa.list_(pa.string())), ("coverage", pa.float64())])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: Path | str = TEMPLATES) -> DataFrame:
    """One row per candidate block: doc_id, block_start, block, license, reduction, runner_up, runner_up_reduction, n_words, differences, coverage, n_differ, exact, whole_text.

    `license` is the confirmed template, or null where the wording confirms none; `exact` says that
    no word differs from it; `coverage` is the share of the license's own text that stands in the block, and `whole_text` says that it is
    nearly all.  Of templates that confirm alike the one with fewer differences counts, then the one that compresses better, then the one that
    comes first in the list.  block_start counts characters from 0.  Texts are read whole, long sentences in
    overlapping windows.  Null and empty texts, and texts that no template shortens much, give no rows; repeated rows give
    theirs each; null ids stay null.  `folder` holds the templates' texts.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text") != "")
    shared = docs.sparkSession.sparkContext.broadcast(templates(folder))  # the files of one folder, some hundred kilobytes

    def load():
        s = keep("licenses", lambda: Scanner(shared.value))

        def of(texts: list[str]) -> list[pa.Array]:
            rows = []
            for t in texts:
                found = [(a, b, *s.scan(b)) for a, b in s.blocks(t)]
                rows.append([dict(zip(_ROW.names, x, strict=True)) for x in found])
            return [pa.array(rows, pa.list_(_ROW))]

        return of

    kind = source.schema["doc_id"].dataType.simpleString()
    made = map_texts(source, "text", load, f"doc_id {kind}, found array<struct<block_start:bigint,block:string,license:string,reduction:double,runner_up:string,runner_up_reduction:double,n_words:bigint,differences:array<string>,coverage:double>>", ["doc_id"])
    flat = made.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    n = F.size("differences")
    return flat.withColumns({"n_differ": n, "exact": F.col("license").isNotNull() & (n == 0), "whole_text": F.col("license").isNotNull() & (F.col("coverage") >= WHOLE)})
