"""Licence scan by template markup: optional and replaceable regions compiled into automata over words.

Markup: ``[ ... ]`` is optional and may hold markup, ``{a|b c|d}`` is one of these wordings, ``{0,6}`` is any 0 to 6
words; all other words are mandatory. A template is accepted where a run of the text's words is a run of the automaton
from its start to its end, so mandatory wording matches word for word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Parts that several templates share.
GRANT = "{released|licensed|distributed|available|provided|published} under the [terms [and conditions] of the]"
GNU_NOTICE = (
    "redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation [either] version {} "
    "[of the license] [or at your option any later version]"
)
CC_GRANT = "{licensed|released|available|distributed|published|provided} under {a|the|} [terms of the]"
CC_END = "[{1|2|3|4} {0|5}] [international|unported|generic] {license|licence}"
CC_SHORT = "{1|2|3|4} {0|5} [international|unported|generic] [license|licence]"

#: Templates as (label, wording), a label may have several: short grants, notices of source files and whole licences.
TEMPLATES = (
    ("mit", f"{GRANT} mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files {the software|the {0,2}} to deal in the software without restriction"),
    ("mit-full", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
            "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
            "conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial "
            "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and {noninfringement|non infringement} in no event shall {the {0,3} authors or "
            "copyright holders|{1,6}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
            "connection with the software or the use or other dealings in the software"),
    ("apache-2.0", f"{GRANT} apache license [version] 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use {this file|these files|this {1,3}} except in compliance with the license"),
    ("gpl-3.0", f"{GRANT} gnu general public license [as published by the free software foundation] [either] {{version|v}} 3"),
    ("gpl-3.0", GNU_NOTICE.format("general public license", 3)),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", f"{GRANT} gnu general public license [as published by the free software foundation] [either] {{version|v}} 2"),
    ("gpl-2.0", GNU_NOTICE.format("general public license", 2)),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("lgpl", "under the [terms of the] gnu {lesser|library} general public license"),
    ("agpl", "under the [terms of the] gnu affero general public license"),
    ("mpl-2.0", "{under the|subject to the terms of the} [terms of the] mozilla public license {v|version|} 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("bsd", f"{GRANT.replace('the [terms', '[the] [terms')} {{a|the|}} [{{2|3|two|three}} clause] bsd [style] license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-full", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions "
            "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
            "materials provided with the distribution [[3] neither the name of {1,8} nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission] this software is provided by {the copyright holders and contributors|{1,6}} as is "
            "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-nd", f"{CC_GRANT} {{cc by nc nd {CC_SHORT}|creative commons attribution noncommercial {{noderivs|noderivatives}} {CC_END}}}"),
    ("cc-by-nc-sa", f"{CC_GRANT} {{cc by nc sa {CC_SHORT}|creative commons attribution noncommercial sharealike {CC_END}}}"),
    ("cc-by-nc", f"{CC_GRANT} {{cc by nc {CC_SHORT}|creative commons attribution noncommercial {CC_END}}}"),
    ("cc-by-nd", f"{CC_GRANT} {{cc by nd {CC_SHORT}|creative commons attribution {{noderivs|noderivatives}} {CC_END}}}"),
    ("cc-by-sa", f"{CC_GRANT} {{cc by sa {CC_SHORT}|creative commons attribution sharealike {CC_END}}}"),
    ("cc-by", f"{CC_GRANT} creative commons attribution {CC_END}"),
    ("cc0", "{cc0 1 0|creative commons zero|public domain dedication}"),
    ("copyright", "copyright {0,8} all rights reserved"),
)

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"

#: All ASCII characters that are no digit and no lower-case letter part words.
PARTS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
ANY = None


@dataclass(frozen=True)
class Automaton:
    """States 0 to ``end``; ``steps[s]`` are (word or any, next state), ``jumps[s]`` states reached without a word.

    needed: mandatory words at the top level. depth[s]: the most of them that lie before state s.
    """

    label: str
    steps: tuple
    jumps: tuple
    end: int
    needed: tuple
    depth: tuple

    def reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.jumps[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first_words(self) -> set:
        return {w for s in self.reach({0}) for w, _ in self.steps[s]}

    def run(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """The last word of the shortest accepted run that begins at a word (None without one), and the most mandatory
        words that runs from there meet. No run is longer than the automaton, so this is short."""
        states, furthest = self.reach({0}), 0
        for k in range(at, len(words)):
            word = words[k]
            states = self.reach({t for s in states for w, t in self.steps[s] if w is ANY or w == word})
            if not states:
                break
            furthest = max(furthest, max(self.depth[s] for s in states))
            if self.end in states:
                return k, furthest
        return None, furthest

    def scan(self, words: list[bytes], starts: list[int]) -> tuple[list[tuple[int, int]], float]:
        """(first, last) of accepted runs, the shortest from each of ``starts`` and none inside another; the furthest share
        of mandatory words reached."""
        ends, furthest = [], 0
        for at in starts:
            end, far = self.run(words, at)
            furthest = max(furthest, far)
            if end is not None:
                ends.append((end, at))
        spans: list[tuple[int, int]] = []
        for end, at in sorted(ends):
            if not spans or at > spans[-1][1]:
                spans.append((at, end))
        return spans, furthest / max(1, len(self.needed))


def compiled(label: str, wording: str) -> Automaton:
    """The automaton of a template."""
    steps: list[list] = [[]]
    jumps: list[set[int]] = [set()]
    depth = [0]
    needed: list[bytes] = []

    def state(d: int) -> int:
        steps.append([])
        jumps.append(set())
        depth.append(d)
        return len(steps) - 1

    tokens = re.findall(r"[\[\]{}|]|\d+,\d+|[^\s\[\]{}|]+", wording)
    at = 0

    def sequence(here: int, stop: str, top: bool) -> int:
        nonlocal at
        while at < len(tokens) and tokens[at] not in stop:
            token = tokens[at]
            at += 1
            if token in "[{":
                here = region(here, "]" if token == "[" else "}", optional=token == "[")
            elif re.fullmatch(r"\d+,\d+", token):
                low, high = map(int, token.split(","))
                ends = [here] if not low else []
                for k in range(1, high + 1):
                    after = state(depth[here])
                    steps[here].append((ANY, after))
                    here = after
                    if k >= low:
                        ends.append(here)
                out = state(depth[here])
                for e in ends:
                    jumps[e].add(out)
                here = out
            else:
                after = state(depth[here] + top)
                steps[here].append((token.encode(), after))
                if top:
                    needed.append(token.encode())
                here = after
        return here

    def region(here: int, close: str, optional: bool) -> int:
        nonlocal at
        ends = [here] if optional else []
        while True:
            begin = state(depth[here])
            jumps[here].add(begin)
            ends.append(sequence(begin, close + "|", False))
            at += 1
            if tokens[at - 1] == close:
                break
        out = state(depth[here])
        for e in ends:
            jumps[e].add(out)
        return out

    end = sequence(0, "", True)
    return Automaton(label, tuple(map(tuple, steps)), tuple(map(frozenset, jumps)), end, tuple(needed), tuple(depth))


@lru_cache(maxsize=8)
def automata(templates: tuple) -> tuple[tuple[Automaton, ...], dict]:
    """The automata, and which of them may begin with a word (with any, under ``ANY``)."""
    machines = tuple(compiled(*t) for t in templates)
    beginning: dict = {}
    for m in machines:
        for w in m.first_words():
            beginning.setdefault(w, []).append(m)
    return machines, beginning


def scan_text(text: str | None, beginning: dict, phrases) -> tuple:
    """One row of ``RESULT``."""
    words = (text or "").encode().lower().translate(PARTS).split()
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases:
        raw = phrase.encode()
        if b" " + raw + b" " in joined:
            first, *rest = raw.split()
            n = len(rest)
            found = [k for k, w in enumerate(words) if w == first and words[k + 1 : k + 1 + n] == rest]
            places += found
            base.add(label)
    labels, spans, score = set(base), [], 0.5 if base else 0.0
    starts: dict[int, tuple[Automaton, list[int]]] = {}
    for k, w in enumerate(words):
        if w in beginning or ANY in beginning:
            for m in {id(m): m for key in (w, ANY) for m in beginning.get(key, ())}.values():
                starts.setdefault(id(m), (m, []))[1].append(k)
    for m, at in starts.values():
        found, share = m.scan(words, at)
        score = max(score, 1.0 if found else min(share, 0.99))
        if found:
            labels.add(m.label)
            spans += [(m.label, a, b) for a, b in found]
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "first", "last"), s, strict=True)) for s in sorted(spans, key=lambda s: s[1:])],
    )


def licences(text: Column, templates=TEMPLATES, phrases=PHRASES) -> Column:
    """A struct of ``RESULT`` for each text.

    Words are runs of digits, a-z and characters beyond ASCII after A-Z are lower-cased. n_base counts all places of base
    phrases, first_word and last_word are their smallest and largest first word, null if there are none. labels has
    those of accepted templates as well; score is 1 for an accepted template, else the largest share of mandatory words
    that an automaton got to, and at least 0.5 with a base phrase. Null and empty texts have no words, no labels and a
    score of 0. Texts are judged one by one; other columns play no part.
    """

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        _, beginning = automata(templates)
        rows = [scan_text(t.as_py(), beginning, phrases) for t in texts]
        cols = list(zip(*rows, strict=True)) or [()] * 8
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return scan(text)


def scan_table(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: its id and the columns of ``RESULT``."""
    return docs.select(F.col(id_col), licences(F.col(text_col), templates, phrases).alias("__l")).select(id_col, "__l.*")
