"""License notices by conditional compression.

Candidates are the words of a paragraph, whatever its lines, around a template's rarest words:
so many that a notice with all the differences allowed still has one of them. The part of a
candidate that templates may account for is compressed alone and with each template as a raw
Zstandard dictionary, and the templates are ranked by the bytes they save. Those that save
most or nearly so are the winners, and exact wording differences confirm one: words that the text adds inside the notice, lacks or
replaces are counted and reported, and with too many of them it is no match. The notice by
itself must save enough bytes too. The text before and after it is searched again until nothing is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ledgerwatch.llm.common import ids_and_texts, send, text_blocks

# Usual notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "all-rights-reserved": "All rights reserved.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
}

_paragraph_end = re.compile(r"\n[^\S\n]*\n")
_words = re.compile(r"\w+(?:[.-]\w+)*").finditer

#: Templates that save this share of the most that any saves are winners; the wording decides among them.
WINNERS = 0.9
#: Least bytes saved, as a share of the template's own; most wording differences by template word.
LEAST_SAVED, MOST_CHANGED = 0.4, 0.25


def _plain(text: str) -> bytes:
    """What is compressed: the words in lower case, a space between; marks and line ends don't matter."""
    return " ".join(m[0].lower() for m in _words(text)).encode()


class Scanner:
    """Templates with their words; compressors are made once a process."""

    def __init__(self, templates: dict[str, str]):
        self.templates = templates
        self.words = {k: [m[0].lower() for m in _words(t)] for k, t in templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.most = {k: int(MOST_CHANGED * len(w)) for k, w in self.words.items()}
        self.cue = self._cues()
        #: Words that a notice can span, so that all of it is within reach of any word in it.
        self.reach = max((len(w) + self.most[k] for k, w in self.words.items()), default=0)
        self.packers, self.seen = None, {}

    def _cues(self) -> re.Pattern:
        """Any of the words that a notice cannot lack all of: each template's rarest, one more than may be missing.

        Rare is what few templates have, then what is long.
        """
        held = Counter(w for words in self.words.values() for w in set(words))
        cues = {w for k, words in self.words.items() for w in sorted(set(words), key=lambda w: (held[w], -len(w), w))[: self._least_cues(k)]}
        if not cues:
            return re.compile(r"(?!)")
        return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(cues, key=lambda w: (-len(w), w))) + r")(?!\w)", re.I)

    def _least_cues(self, name: str) -> int:
        """How many of a template's rarest different words a notice cannot lack: those that occur more often count so."""
        rare = sorted(self.counts[name].values())
        return next((n for n in range(1, len(rare) + 1) if sum(rare[:n]) > self.most[name]), len(rare))

    def __getstate__(self):
        return self.__dict__ | {"packers": None, "seen": {}, "alone": None, "sizes": None, "frame": None}

    def savings(self, block: str) -> list[tuple[int, str, int, int]]:
        """``(bytes saved, template, bytes alone, bytes given the template)``, best first."""
        if self.packers is None:
            raw = lambda t: zstandard.ZstdCompressionDict(_plain(t), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.alone = zstandard.ZstdCompressor(level=19, write_content_size=False)
            self.packers = {k: zstandard.ZstdCompressor(level=19, dict_data=raw(t), write_content_size=False) for k, t in self.templates.items()}
            self.frame = len(self.alone.compress(b""))  # bytes of an empty frame, which no template can save
            self.sizes = {k: len(self.alone.compress(_plain(t))) for k, t in self.templates.items()}
        data = _plain(block)
        alone = len(self.alone.compress(data))
        found = [(alone - n, k, alone, n) for k, p in self.packers.items() for n in [len(p.compress(data))]]
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def enough(self, there: Counter, template: str) -> bool:
        """Whether some words hold as many of the template's as a notice must."""
        return sum(min(n, there[w]) for w, n in self.counts[template].items() if w in there) >= len(self.words[template]) - self.most[template]

    def differences(self, have: list[str], template: str) -> tuple[int, int, int, int] | None:
        """Words lacking and words put in, and the first and last word of the notice; None if there is none."""
        want, most = self.words[template], self.most[template]
        longest = SequenceMatcher(None, have, want, autojunk=False).find_longest_match()
        low = max(0, longest.a - longest.b - most)
        high = longest.a + len(want) - longest.b + most
        same = [m for m in SequenceMatcher(None, have[low:high], want, autojunk=False).get_matching_blocks() if m.size]
        # A word that merely stands near the notice is no part of it.
        while len(same) > 1 and same[1].a - same[0].a - same[0].size > same[0].size:
            same.pop(0)
        while len(same) > 1 and same[-1].a - same[-2].a - same[-2].size > same[-1].size:
            same.pop()
        first, last = same[0].a, same[-1].a + same[-1].size
        kept = sum(m.size for m in same)
        lacking, added = len(want) - kept, last - first - kept
        if lacking + added <= most:
            return lacking, added, low + first, low + last - 1
        for start, stop in ((0, longest.a), (longest.a + longest.size, len(have))):  # the longest run may stand by itself
            if self.enough(Counter(have[start:stop]), template) and (found := self.differences(have[start:stop], template)):
                return *found[:2], start + found[2], start + found[3]
        return None

    def saved(self, notice: str, name: str) -> tuple[int, int, int, bool]:
        """The template's place by bytes saved, bytes alone and given it, and whether it saves enough."""
        if notice not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[notice] = {k: (place, alone, given, saved >= LEAST_SAVED * (min(alone, self.sizes[k]) - self.frame))
                                 for place, (saved, k, alone, given) in enumerate(self.savings(notice))}
        return self.seen[notice][name]

    def match(self, text: str, spans: list[tuple[int, int]], have: list[str]):
        """The best notice among some words of a text: its rank, first and last word and what is reported; or None."""
        there, confirmed = Counter(have), {}
        for name in self.words:
            found = self.differences(have, name) if self.enough(there, name) else None
            if found is None:
                continue
            lacking, added, first, last = found
            start, end = spans[first][0], spans[last][1]
            _, alone, given, enough = self.saved(text[start:end], name)
            if enough:
                confirmed[name] = (first, last, (name, lacking, added, start, end, alone, given))
        if not confirmed:
            return None
        # All that the templates may account for, compressed with each: those that save most are the winners.
        block = text[min(n[3] for _, _, n in confirmed.values()) : max(n[4] for _, _, n in confirmed.values())]
        ranked = [(saved, name) for saved, name, _, _ in self.savings(block) if name in confirmed]
        winners = [(sum(confirmed[name][2][1:3]), -saved, name) for saved, name in ranked if saved >= WINNERS * ranked[0][0]]
        off, saved, name = min(winners)
        first, last, notice = confirmed[name]
        return (saved, off, name), first, last, notice

    def near(self, text: str, spans: list[tuple[int, int]], have: list[str]):
        """Notices among some words of a text; what stands before and after one is searched again."""
        found = self.match(text, spans, have)
        if found:
            rank, first, last, notice = found
            yield rank, notice
            for part in (slice(0, first), slice(last + 1, None)):
                if have[part]:
                    yield from self.near(text, spans[part], have[part])

    def scan(self, text: str):
        """Every notice of a whole text: ``(template, lacking, put in, start, end, alone, given)`` in order, none inside another.

        Where two overlap, the one that saved more bytes stays, then that with fewer differences.
        """
        if not self.cue.search(text):
            return []
        out, at = [], 0
        for m in (*_paragraph_end.finditer(text), None):
            end = m.start() if m else len(text)
            if self.cue.search(text, at, end):
                out += self._in(text, at, end)
            at = m.end() if m else end
        return out

    def _in(self, text: str, at: int, end: int) -> list:
        """Notices of the paragraph between two places."""
        spans = [m.span() for m in _words(text, at, end)]
        starts = [a for a, _ in spans]
        have = [text[a:b].lower() for a, b in spans]
        found, done = {}, -1  # by place and template; the last word with all of its reach searched
        for cue in self.cue.finditer(text, at, end):
            first, last = bisect_right(starts, cue.start()) - 1, bisect_left(starts, cue.end())
            if last <= done:
                continue
            low, done = max(0, first - self.reach), last + self.reach
            high = done + self.reach
            for rank, notice in self.near(text, spans[low:high], have[low:high]):
                found[notice[0], notice[3], notice[4]] = (rank, notice)
        kept = []
        for _, notice in sorted(found.values(), key=lambda x: (*x[0], x[1][3], x[1][0])):
            i = bisect_left(kept, notice[3], key=lambda k: k[3])
            if (i == 0 or kept[i - 1][4] <= notice[3]) and (i == len(kept) or notice[4] <= kept[i][3]):
                kept.insert(i, notice)
        return kept


FOUND = "id long, license string, start long, end long, words_lacking long, words_added long, bytes_alone long, bytes_given long"


def scan(df: DataFrame, id_col: str, text_col: str, templates: dict[str, str] | None = None) -> DataFrame:
    """License notices of every whole text, a row each, with place (code points) and wording differences.

    ``templates`` are notices by name; texts are searched for those that are given. Null and empty
    texts have none; null ids stay; repeated rows each give their rows; other columns are ignored; an
    empty table gives no rows; whole texts of any length are read, a paragraph at a time. Of templates
    with equal savings and differences the first by name wins.
    """
    get = send(df.sparkSession, Scanner(TEMPLATES if templates is None else templates))

    def run(batches):
        scanner = get()
        for ids, texts in text_blocks(batches):
            rows = [(i, n, s, e, lack, more, alone, given) for i, t in zip(ids, texts) for n, lack, more, s, e, alone, given in scanner.scan(t)]
            if rows:
                kinds = (pa.int64(), pa.string()) + (pa.int64(),) * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, FOUND)
