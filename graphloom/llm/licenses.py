"""License scan with a positional rare-token index.

Each template is a notice, or the whole text of a short license, with mandatory key phrases. The index has, for each phrase, its
RARE words of highest inverse document frequency, with their position in the template;
frequencies are counted over the whole table first. A file's words that the index knows
are looked up, rarest first; postings that put a template at the same place of the file
are intersected, and where all indexed words of a template agree, its key phrases are
compared word by word. As the indexed words are part of mandatory phrases, nothing that
has the phrases is missed.

Defined results: null, empty and wordless texts have no license; a null doc_id is carried
as null; repeated rows give repeated results, two texts of one doc_id each their own; of several places of one license in a file
the first is reported; ties in frequency go to the word that is first in the alphabet; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lowered, read, with_ids
from .text import Tokens, chunks, word_hash

RARE = 3

#: license, notice; the key phrases stand in brackets.
TEMPLATES = [
    ("MIT", "released under the [mit license]"),
    ("MIT", "[permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files]"),
    ("Apache-2.0", "licensed under the [apache license version 2 0]"),
    ("Apache-2.0", "licensed under the [apache license 2 0]"),
    ("GPL-3.0", "this work is licensed under the [gnu general public license version 3]"),
    ("GPL-3.0", "the [gnu general public license] as published by the free software foundation either [version 3 of the license]"),
    ("GPL-2.0", "this work is licensed under the [gnu general public license version 2]"),
    ("GPL-2.0", "the [gnu general public license] as published by the free software foundation either [version 2 of the license]"),
    ("LGPL-3.0", "this library is licensed under the [gnu lesser general public license version 3]"),
    ("AGPL-3.0", "this program is licensed under the [gnu affero general public license version 3]"),
    ("BSD", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that the following conditions are met]"),
    ("BSD", "licensed under the [bsd license]"),
    ("BSD-3-Clause", "licensed under the [bsd 3 clause license]"),
    ("ISC", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    ("MPL-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("MPL-2.0", "licensed under the [mozilla public license version 2 0]"),
    ("CC-BY-4.0", "licensed under [cc by 4 0]"),
    ("CC-BY-SA-4.0", "licensed under [cc by sa 4 0]"),
    ("CC-BY-NC-4.0", "licensed under [cc by nc 4 0]"),
    ("CC0-1.0", "released under [cc0 1 0]"),
    ("Unlicense", "this is [free and unencumbered software released into the public domain]"),
    ("BSD-2-Clause", "licensed under the [bsd 2 clause license]"),
    ("LGPL-2.1", "the [gnu lesser general public license] as published by the free software foundation either [version 2 1 of the license]"),
    ("LGPL-3.0", "the [gnu lesser general public license] as published by the free software foundation either [version 3 of the license]"),
    ("AGPL-3.0", "the [gnu affero general public license] as published by the free software foundation either [version 3 of the license]"),
    ("EPL-2.0", "under the terms of the [eclipse public license 2 0]"),
    ("EPL-2.0", "under the terms of the [eclipse public license v 2 0]"),
    ("EUPL-1.2", "licensed under the [european union public licence v 1 2]"),
    ("Artistic-2.0", "licensed under the [artistic license 2 0]"),
    ("BSL-1.0", "distributed under the [boost software license version 1 0]"),
    ("OFL-1.1", "licensed under the [sil open font license version 1 1]"),
    ("WTFPL", "licensed under the [do what the fuck you want to public license]"),
    ("CC-BY-4.0", "[creative commons attribution 4 0 international license]"),
    ("CC-BY-SA-4.0", "[creative commons attribution sharealike 4 0 international license]"),
    ("CC-BY-NC-4.0", "[creative commons attribution noncommercial 4 0 international license]"),
    ("CC-BY-ND-4.0", "licensed under [cc by nd 4 0]"),
    ("CC-BY-NC-SA-4.0", "licensed under [cc by nc sa 4 0]"),
    ("CC-BY-NC-ND-4.0", "licensed under [cc by nc nd 4 0]"),
    # whole texts: every phrase must stand in its place
    (
        "MIT (full text)",
        "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software [to deal in the software without restriction] including without limitation the rights to"
        " use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions [the above copyright notice and this permission"
        " notice shall be included] in all copies or substantial portions of the software [the software is provided as is without warranty of any kind]",
    ),
    (
        "ISC (full text)",
        "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that [the above copyright notice and this permission notice appear in all copies] the software is provided"
        " as is and [the author disclaims all warranties with regard to this software]",
    ),
    (
        "BSD-2-Clause (full text)",
        "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met 1 [redistributions of source code must retain the above copyright notice] this list of"
        " conditions and the following disclaimer 2 [redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution [this software is provided by the copyright holders and contributors]",
    ),
    (
        "BSD-3-Clause (full text)",
        "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met 1 [redistributions of source code must retain the above copyright notice] this list of"
        " conditions and the following disclaimer 2 [redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution 3 [neither the name of the copyright holder nor the names of its contributors] may be used to endorse or promote products",
    ),
    (
        "Zlib (full text)",
        "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software [permission is granted to anyone to use this software for any"
        " purpose] including commercial applications and to alter it and redistribute it freely",
    ),
    (
        "Unlicense (full text)",
        "this is [free and unencumbered software released into the public domain] [anyone is free to copy modify publish use compile sell or distribute this software] either in source code form or as a compiled binary for any purpose"
        " commercial or non commercial and by any means",
    ),
]


def parse(notice: str) -> list[tuple[int, list[str]]]:
    """Key phrases of a notice as (position, words)."""
    phrases, inside = [], None
    for k, w in enumerate(notice.replace("[", " [ ").replace("]", " ] ").split()):
        if w == "[":
            inside = []
            phrases.append((k - 2 * len(phrases), inside))
        elif w == "]":
            inside = None
        elif inside is not None:
            inside.append(w)
    return phrases


class Index:
    """Postings of rare words: word number -> (template, position)."""

    def __init__(self, df: dict[str, int], templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.phrases = [parse(t) for _, t in templates]
        postings, self.need = defaultdict(set), []
        for k, phrases in enumerate(self.phrases):
            chosen = set()
            for start, words in phrases:
                rare = sorted(range(len(words)), key=lambda i: (df.get(words[i], 0), words[i], i))[:RARE]
                chosen |= {(words[i], start + i) for i in rare}
            for w, p in chosen:
                postings[w].add((k, p))
            self.need.append(len(chosen))
        order = sorted(postings, key=lambda w: (df.get(w, 0), w))  # highest inverse document frequency first
        keys = np.array([word_hash(w) for w in order], np.uint64)
        at = np.argsort(keys)
        self.keys, self.rank = keys[at], at
        self.postings = [sorted(postings[w]) for w in order]

    def find(self, tokens: Tokens) -> list[tuple[int, str, int]]:
        """(row, license, first word of its key phrase), one for each row and license."""
        h = tokens.hashes
        if not len(h):
            return []
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[i] == h)
        rank = self.rank[i[at]]
        doc = np.searchsorted(tokens.bounds, at, "right") - 1
        found: dict[tuple[int, str], int] = {}
        edges = np.flatnonzero(np.diff(doc)) + 1
        for part in np.split(np.arange(len(at)), edges) if len(at) else []:
            d = int(doc[part[0]])
            votes: dict[tuple[int, int], int] = defaultdict(int)
            for j in part[np.argsort(rank[part], kind="stable")].tolist():
                for template, position in self.postings[rank[j]]:
                    votes[template, int(at[j]) - position] += 1
            lo, hi = int(tokens.bounds[d]), int(tokens.bounds[d + 1])
            for (template, offset), n in votes.items():
                if n == self.need[template] and self._holds(tokens, template, offset, lo, hi):
                    place = offset + self.phrases[template][0][0] - lo
                    key = (d, self.names[template])
                    found[key] = min(found.get(key, place), place)
        return [(d, name, p) for (d, name), p in sorted(found.items())]

    def _holds(self, tokens: Tokens, template: int, offset: int, lo: int, hi: int) -> bool:
        for start, words in self.phrases[template]:
            a = offset + start
            if a < lo or a + len(words) > hi or tokens.words(a, a + len(words)) != [w.encode() for w in words]:
                return False
        return True


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs."""
    keys = np.array([word_hash(w) for w in vocabulary], np.uint64)
    order = np.argsort(keys)
    keys = keys[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys), np.int64)
        for batch in chunks(batches, "t"):
            tokens = Tokens(batch.column("t"))
            if len(tokens):
                i = np.minimum(np.searchsorted(keys, tokens.hashes), len(keys) - 1)
                hit = keys[i] == tokens.hashes
                n += np.bincount(np.unique(tokens.doc[hit] * len(keys) + i[hit]) % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(n)], ["word", "n"])

    rows = lowered(docs).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates
    return {vocabulary[r["word"]]: r["n"] for r in rows}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, first_word) for each license whose key phrases a document has."""
    vocabulary = sorted({w for _, t in TEMPLATES for _, words in parse(t) for w in words})
    index = Index(frequencies(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            rows = index.find(Tokens(batch.column("t")))
            if rows:
                at, name, first = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(name), pa.array(first, pa.int64())], ["doc_id", "license", "first_word"])

    return lowered(with_ids(docs), "doc_id").mapInArrow(run, "doc_id long, license string, first_word long")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    single = [(name, " ".join(p[0][1])) for name, t in TEMPLATES if len(p := parse(t)) == 1]
    values = ", ".join(f"('{n}', ' {p} ')" for n, p in single)
    parts = [rf"SELECT doc_id, text_row, name, strpos(s, p) AS pos, s FROM d, (VALUES {values}) v(name, p) WHERE contains(s, p)"]
    for name, t in TEMPLATES:
        phrases = parse(t)
        if len(phrases) > 1:
            rx, at = "", phrases[0][0]
            for start, words in phrases:
                gap = start - at
                rx += (r"( [^ ]+)" + f"{{{gap}}}" if gap else "") + f" {' '.join(words)}"
                at = start + len(words)
            rx += " "
            parts.append(f"SELECT doc_id, text_row, '{name}', strpos(s, regexp_extract(s, '{rx}')), s FROM d WHERE regexp_matches(s, '{rx}')")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS text_row, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+'), ' ') || ' ' AS s FROM documents WHERE text IS NOT NULL),
h AS ({" UNION ALL ".join(parts)})
SELECT doc_id, name AS license, CAST(min(pos - 1 - length(replace(substr(s, 1, pos - 1), ' ', ''))) AS BIGINT) AS first_word FROM h GROUP BY doc_id, name, text_row
"""


OP3_SQL = _sql()
