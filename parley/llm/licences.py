"""Licence scans by diagonal voting.

Every rolling k-gram of a document's words whose hash is some template gram's is joined to the template positions of
that gram. A position in the document less the position in the template is the diagonal a gram votes for; votes are
counted by diagonal, and neighbouring diagonals (where words were added or left out) are merged. A merged span is then
verified: along it, grams must stand in the template's order, the template positions they cover (each once) must be
enough of it, and the words that tell this template from others must be among them. Short phrases have every gram's vote
on one diagonal, so they stand exactly.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stretches, flat_chunks, mixed, words_of

#: Phrases that stand exactly, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_HOLDERS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_PROGRAM = "is free software you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the free software foundation either version {1} of the license or at your option any later version"
#: Texts and notices of public licences, and the method's own labels for them. Words between [ ] must stand in a span.
NOTICES = {
    "mit-notice": "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS,
    "mit-grant": "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-2-clause": f"[redistribution and use in source and binary forms]{_CONDITIONS.removeprefix('redistribution and use in source and binary forms')} {_HOLDERS}",
    "bsd-3-clause": f"{_CONDITIONS} [neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote] products derived from this software without specific prior written permission {_HOLDERS}",
    "bsd-conditions": f"[redistribution and use in source and binary forms]{_CONDITIONS.removeprefix('redistribution and use in source and binary forms')}",
    "isc-notice": "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted] provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [the origin of this software must not be misrepresented]",
    "boost-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to [prepare derivative works of the software and to permit third parties] to whom the software is furnished to do so",
    "unlicense": "this is [free and unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "unlicense-line": "[this is free and unencumbered software released into the public domain]",
    "apache-2.0-notice": "licensed under the apache license [version 2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "gpl-2.0-notice": "this program " + _PROGRAM.format("", "[2]").replace("  ", " "),
    "gpl-3.0-notice": "this program " + _PROGRAM.format("", "[3]").replace("  ", " "),
    "lgpl-2.1-notice": "this library " + _PROGRAM.format("[lesser]", "[2 1]"),
    "agpl-3.0-notice": "this program " + _PROGRAM.format("[affero]", "[3]"),
    "gpl-work": "this work is licensed under the [gnu general public license] version",
    "mpl-2.0-notice": "this source code form is subject to the terms of the [mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mit-release": "released under the [mit license]",
    "cc-by-nc": "licensed under [cc by nc]",
    "cc-by-nc-sa": "licensed under [cc by nc sa]",
    "cc-by-sa": "licensed under [cc by sa]",
    "cc-by-4.0-deed": "this work is licensed under a creative commons [attribution 4 0] international license",
    "cc-by-sa-4.0-deed": "this work is licensed under a creative commons [attribution sharealike 4 0] international license",
    "cc-by-nc-4.0-deed": "this work is licensed under a creative commons [attribution noncommercial 4 0] international license",
    "cc0-dedication": "to the extent possible under law the author has [dedicated all copyright and related and neighboring rights] to this software to the public domain worldwide",
}
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Diagonals this near are one span; the share of a notice's words that a span must cover; and how much longer than it a span may be.
GAP, SHARE, STRETCH = 4, 0.6, 1.5


class Template:
    """A phrase (``exact``) or a notice: its words, gram length, and the numbers of the words that must stand."""

    def __init__(self, number: int, label: str, text: str, exact: bool):
        self.number, self.label, self.exact = number, label, exact
        self.words: list[str] = []
        self.must: set[int] = set()
        for i, part in enumerate(text.replace("]", "[").split("[")):
            own = [w.decode() for w in words_of(part)]
            if i % 2:
                self.must.update(range(len(self.words), len(self.words) + len(own)))
            self.words += own
        self.gram = min(PHRASE_GRAM if exact else NOTICE_GRAM, len(self.words))
        self.grams = [" ".join(self.words[i : i + self.gram]) for i in range(len(self.words) - self.gram + 1)]


def templates(phrases: dict[str, str], notices: dict[str, str]) -> list[Template]:
    """``phrases``: label by phrase; ``notices``: text by label. Those without words are left out."""
    rows = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in notices.items()]
    return [t for t in (Template(i, *r) for i, r in enumerate(rows)) if t.words]


def gram_table(spark: SparkSession, rows: list[Template]) -> DataFrame:
    """gram, template, at, label, exact, grams, words: a row for each template position. As large as the lists above."""
    flat = [(g, t.number, i, t.label, t.exact, len(t.grams), len(t.words)) for t in rows for i, g in enumerate(t.grams)]
    return spark.createDataFrame(flat, "gram string, template int, at int, label string, exact boolean, grams int, words int")


class Grams:
    """Finds a document's grams whose hash is some template gram's."""

    def __init__(self, rows: list[Template]):
        self.stretches = Stretches()
        self.hashes = {k: np.unique(np.concatenate([self._rolled(self._words(g.encode()), k) for t in rows if t.gram == k for g in t.grams])) for k in sorted({t.gram for t in rows})}

    def _words(self, raw: bytes) -> np.ndarray:
        starts, ends = self.stretches.read(raw)
        return self.stretches.hashes(starts, ends).view(np.uint64) if len(starts) else np.zeros(0, np.uint64)

    def _rolled(self, words: np.ndarray, k: int) -> np.ndarray:
        if len(words) < k:
            return np.zeros(0, np.int64)
        h = words[: len(words) - k + 1]
        for i in range(1, k):
            h = mixed(h * np.uint64(Stretches.BASE) + words[i : len(words) - k + 1 + i]).view(np.uint64)
        return h.view(np.int64)

    def found(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """How many words a text has, and the places and words of its grams, those of each length in order."""
        hashes, cuts, n = [], [], 0
        for raw in flat_chunks(text):
            own = self._words(raw)
            hashes.append(own)
            cuts.append((n, raw))
            n += len(own)
        if not n:
            return 0, [], []
        words = np.concatenate(hashes)
        at, grams = [], []
        parts: dict[int, list[bytes]] = {}
        for k, known in self.hashes.items():
            rolled = self._rolled(words, k)
            near = np.searchsorted(known, rolled)
            near[near == len(known)] = 0
            for i in np.flatnonzero(known[near] == rolled).tolist():
                at.append(i)
                grams.append(" ".join(self._word(cuts, parts, j) for j in range(i, i + k)))
        return n, at, grams

    def _word(self, cuts: list[tuple[int, bytes]], parts: dict[int, list[bytes]], i: int) -> str:
        c = len(cuts) - 1
        while cuts[c][0] > i:
            c -= 1
        if c not in parts:
            parts[c] = cuts[c][1].split()
        return parts[c][i - cuts[c][0]].decode("utf-8", "replace")


def verified(pairs: np.ndarray, template: Template) -> float:
    """The largest share of a template's words that grams cover which stand in its order within STRETCH of its length; 0 if words that must stand don't.

    ``pairs``: place in the document * 2**20 + place in the template, of each gram of a span.
    """
    pairs = np.sort(pairs)
    pos, at = pairs >> 20, pairs & ((1 << 20) - 1)
    limit, best, i = max(1, int(len(template.words) * STRETCH)), 0.0, 0
    while i < len(pos):
        j = int(np.searchsorted(pos, pos[i] + limit))
        covered = covering(pos[i:j].tolist(), at[i:j].tolist(), template.gram)
        if template.must <= covered:
            best = max(best, len(covered) / len(template.words))
        if j == len(pos):
            break
        i = max(i + 1, int(np.searchsorted(pos, pos[i] + max(1, limit // 4))))
    return best


def covering(pos: list[int], at: list[int], gram: int) -> set[int]:
    """The template's words that the longest chain of grams covers whose places rise in the document and in the template alike."""
    ends: list[int] = []  # the least last place in the template of chains of each length
    chain: list[tuple[int, int]] = []  # of each length, the gram it ends with, as number
    before: list[int] = []
    order = sorted(range(len(pos)), key=lambda i: (pos[i], -at[i]))
    for n, i in enumerate(order):
        k = bisect_left(ends, at[i])
        before.append(chain[k - 1][1] if k else -1)
        if k == len(ends):
            ends.append(at[i])
            chain.append((i, n))
        else:
            ends[k], chain[k] = at[i], (i, n)
    out: set[int] = set()
    n = chain[-1][1] if chain else -1
    while n >= 0:
        a = at[order[n]]
        out.update(range(a, a + gram))
        n = before[n]
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts all places of the phrases, first_word and last_word are the least and largest of their starts (null
    without any). score is the largest share of a standing template's words that its span covers, 0 to 1; a phrase has 1.
    Null and empty texts have no words. Repeated rows each get their row, an empty table gives an empty one, and other
    columns are not read. Very long texts are read in parts, and held as one number a word.
    """
    rows = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    by_number = {t.number: t for t in rows}
    table = F.broadcast(gram_table(docs.sparkSession, rows))  # as large as the lists
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(rows)
        for batch in batches:
            got = [grams.found(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("uid"), pa.array([n for n, *_ in got], pa.int64()), pa.array([a for _, a, _ in got], pa.list_(pa.int64())), pa.array([g for *_, g in got], pa.list_(pa.string()))], names=["k", "uid", "n_words", "pos", "gram"])

    @F.pandas_udf("double")
    def share_of(template: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([0.0 if p is None else verified(np.asarray(p, np.int64), by_number[int(t)]) for t, p in zip(template, pairs, strict=True)], dtype="float64")

    cut = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    found = cut.mapInArrow(run, f"k {kind}, uid bigint, n_words bigint, pos array<bigint>, gram array<string>")
    each = found.select("k", "uid", "n_words", F.explode_outer(F.arrays_zip("pos", "gram")).alias("g")).select("k", "uid", "n_words", "g.pos", "g.gram")
    # All that follows is grouped by the row's own number: one exchange, of a row for each document and each standing gram.
    own = ["label", "exact", "grams", "words"]
    votes = (
        each.join(table, "gram", "left").repartition("uid")
        .groupBy("k", "uid", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.collect_list(F.shiftleft("pos", 20) + F.col("at")).alias("pairs"), F.min("pos").alias("s"), F.max("pos").alias("e"), *[F.first(c).alias(c) for c in own])
    )
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.when(F.col("exact"), F.lit(0)).otherwise(F.lit(GAP))
    new = (F.col("diagonal") - F.lag("diagonal").over(along) > apart) | F.lag("diagonal").over(along).isNull()
    spans = (
        votes.withColumn("span", F.sum(new.cast("int")).over(along))
        .groupBy("k", "uid", "n_words", "template", "span")
        .agg(F.flatten(F.collect_list("pairs")).alias("pairs"), F.min("s").alias("s"), *[F.first(c).alias(c) for c in own])
    )
    # Grams of a notice that stands cover its words, so at least that share of its grams less the borders of gaps votes.
    places = F.size(F.array_distinct(F.transform("pairs", lambda p: p.bitwiseAND(F.lit((1 << 20) - 1)))))
    likely = ~F.col("exact") & (places * NOTICE_GRAM >= F.col("words") * SHARE)
    share = F.when(F.col("exact"), F.when(F.size("pairs") == F.col("grams"), 1.0)).otherwise(share_of("template", F.when(likely, F.col("pairs"))))
    judged = spans.withColumn("share", share).withColumn("stands", F.coalesce(F.col("share") >= SHARE, F.lit(False))).withColumn("base", F.col("stands") & F.col("exact"))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(F.col(which), F.col("label")))), ",")
    start = F.when(F.col("base"), F.col("s").cast("bigint"))
    return judged.groupBy("k", "uid", "n_words").agg(
        F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), joined("base").alias("base_labels"), joined("stands").alias("labels"),
        F.coalesce(F.max(F.when(F.col("stands"), F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("uid").withColumnRenamed("k", key)
