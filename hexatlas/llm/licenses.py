"""License scans: parts of a text compared with licence templates by Dice over word bigrams.

A text's parts are the whole text and each of its paragraphs (parted by blank lines) and lines.
Parts and templates are normalised to lower-case words. ``Dice = 2 |A and B| / (|A| + |B|)`` of
their bigram multisets cannot exceed ``2 min / (min + max)`` of the two sizes, so a part is
compared only with templates whose size allows the threshold; most parts have none or share no
bigram with any. Templates are few and come from the caller; each text is looked at on its own,
in one pass without a shuffle.

A notice inside a longer line is found by windows: at each place of the text's words where one of
a template's bigrams stands, as many bigrams as the template has (fewer at the end of the text).
A window of that size that begins otherwise is no more similar than the one that begins at its
first such bigram, so no embedded notice is lost. Each bigram enters and leaves a template's
window once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.llm.base import query, table

THRESHOLD = 0.8

# Short notices of public licences by which a text states its licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under the CC0 1.0 Universal public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[a-z0-9]+")


def normalised(text: str) -> list[str]:
    """Lower-case words of ASCII letters and digits, without what marks or line breaks part them."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    """Multiset of neighbouring word pairs; fewer than two words have none."""
    return Counter(zip(words, words[1:]))


class Templates:
    """Templates in the order of size, to be searched by size and by bigram."""

    def __init__(self, texts: dict[str, str], threshold: float):
        made = sorted((sum(b.values()), name, b) for name, t in texts.items() for b in [bigrams(normalised(t))])
        made = [m for m in made if m[0]]
        self.sizes, self.names, self.grams = [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]
        self.known = set().union(*self.grams) if made else set()
        self.first = {w for w, _ in self.known}
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, grams in enumerate(self.grams):
            for g in grams:
                self.holders[g].append(i)
        self.threshold = threshold
        # 2 min / (min + max) >= t  <=>  min / max >= t / (2 - t)
        self.bound = threshold / (2 - threshold)

    def candidates(self, size: int) -> range:
        """Templates whose size allows a Dice of the threshold with a part of ``size`` bigrams."""
        least, most = size * self.bound, size / self.bound
        return range(bisect_left(self.sizes, least - 1e-9), bisect_right(self.sizes, most + 1e-9))

    def best(self, part: str) -> tuple[float, str] | None:
        """The most similar template of a part and its Dice, if it reaches the threshold.

        Of equally similar templates the one of the least name is taken.
        """
        words = normalised(part)
        near = self.candidates(len(words) - 1)
        if len(words) < 2 or not near or self.first.isdisjoint(words):
            return None
        grams = bigrams(words)
        if self.known.isdisjoint(grams):
            return None
        found = []
        for i in near:
            common = sum(min(n, grams[g]) for g, n in self.grams[i].items() if g in grams)
            dice = 2 * common / (self.sizes[i] + len(words) - 1)
            if dice >= self.threshold:
                found.append((-dice, self.names[i]))
        return (-min(found)[0], min(found)[1]) if found else None

    def embedded(self, text: str) -> dict[int, tuple[float, int, str]]:
        """``-dice, -size, name`` of the most similar template at each place of a window that states one.

        Of equally similar templates the larger is taken, then the one of the least name.
        """
        words = normalised(text)
        if self.first.isdisjoint(words):
            return {}
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = defaultdict(list)
        for at, g in enumerate(zip(words, words[1:])):
            for i in self.holders.get(g, ()):
                hits[i].append((at, g))
        found: dict[int, tuple[float, int, str]] = {}
        for i, places in hits.items():
            # the threshold needs that share of a template's bigrams at least
            if len(places) < self.sizes[i] * self.bound - 1e-9:
                continue
            for at, dice in self._windows(i, places, len(words) - 1):
                stated = (-dice, -self.sizes[i], self.names[i])
                found[at] = min(found.get(at, stated), stated)
        return found

    def _windows(self, i: int, places: list[tuple[int, tuple[str, str]]], total: int) -> Iterator[tuple[int, float]]:
        """Place and Dice of the windows that begin at ``places`` (of the template's bigrams) and reach the threshold."""
        size, grams, inside, common, end = self.sizes[i], self.grams[i], Counter(), 0, 0
        for at, g in places:
            while end < len(places) and places[end][0] < at + size:
                entering = places[end][1]
                inside[entering] += 1
                common += inside[entering] <= grams[entering]
                end += 1
            dice = 2 * common / (size + min(size, total - at))
            if dice >= self.threshold:
                yield at, dice
            common -= inside[g] <= grams[g]
            inside[g] -= 1


def parts(text: str) -> Iterator[tuple[str, int, str]]:
    """Kind, number and text of each part; a part that is the whole of a larger one is left out."""
    yield "text", 0, text
    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    if len(paragraphs) > 1:
        yield from (("paragraph", i, p) for i, p in enumerate(paragraphs))
    lines = text.split("\n")
    if len(lines) > 1:
        yield from (("line", i, line) for i, line in enumerate(lines))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, part, n_parts, n_windows, licenses`` for every row of ``docs``.

    ``license`` is the template most similar to any part of the whole text (of equals the least
    name), and where no part reaches ``threshold`` that of the most similar window (of equals the
    larger, then the least name); null if none does. ``part`` is what it was found in, ``n_parts``
    how many parts state any licence, ``n_windows`` at how many places a window does, ``licenses``
    the distinct names of both in order. Null and empty texts have no parts with words. Repeated
    rows are scanned each; a null id is kept. Texts may be of any length.
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(texts, threshold)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                found = [(-m[0], m[1], kind) for kind, _, p in parts(text or "") if (m := known.best(p))]
                inside = known.embedded(text or "").values()
                top = min(found) if found else (None, None, None)
                if inside and not found:
                    dice, _, name = min(inside)
                    top = (dice, name, "window")
                out.append((doc_id, top[1], None if top[0] is None else -top[0], top[2], len(found), len(inside),
                            ",".join(sorted({f[1] for f in found} | {f[2] for f in inside}))))
            yield pd.DataFrame(out, columns=["doc_id", "license", "dice", "part", "n_parts", "n_windows", "licenses"]).astype(
                {"doc_id": "Int64", "dice": "Float64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, license string, dice double, part string, n_parts long, n_windows long, "
                           "licenses string")


def _sql() -> str:
    quoted = ",".join("('{}','{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())

    def grams(source: str, ids: str, text: str) -> str:
        return (f"SELECT {ids}, g, count(*) AS n FROM (SELECT {ids}, unnest(list_transform(range(1, len(w)), "
                f"lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT {ids}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w "
                f"FROM {source})) GROUP BY ALL")

    return rf"""
WITH t(name, body) AS (VALUES {quoted}),
tg AS ({grams('t', 'name', 'body')}), ts AS (SELECT name, sum(n) AS size FROM tg GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, 'text' AS kind, 0 AS i, text AS body FROM d
  UNION ALL SELECT r, 'paragraph', unnest(range(len(q))), unnest(q) FROM (SELECT r, regexp_split_to_array(text, '\n[ \t\r]*\n') AS q FROM d) WHERE len(q) > 1
  UNION ALL SELECT r, 'line', unnest(range(len(q))), unnest(q) FROM (SELECT r, string_split(text, chr(10)) AS q FROM d) WHERE len(q) > 1),
pg AS ({grams('p', 'r, kind, i', 'body')}), ps AS (SELECT r, kind, i, sum(n) AS size FROM pg GROUP BY ALL),
c AS (SELECT r, kind, i, name, sum(least(pg.n, tg.n)) AS common FROM pg JOIN tg USING (g) GROUP BY ALL),
m AS (SELECT r, kind, i, name, 2.0::DOUBLE * CAST(common AS DOUBLE) / (CAST(ps.size AS DOUBLE) + CAST(ts.size AS DOUBLE)) AS dice
  FROM c JOIN ps USING (r, kind, i) JOIN ts USING (name)),
b AS (SELECT r, kind, i, max(dice) AS dice, min_by(name, (-dice, name)) AS name FROM m WHERE dice >= {THRESHOLD} GROUP BY ALL),
o AS (SELECT r, min_by(name, (-dice, name, kind)) AS license, max(dice) AS dice, min_by(kind, (-dice, name, kind)) AS part,
  count(*) AS n_parts FROM b GROUP BY 1),
w AS (SELECT r, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM d),
wb AS (SELECT r, len(w) - 1 AS total, unnest(range(1, len(w))) AS s,
  unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
wt AS (SELECT r, total, s, g, name, n FROM wb JOIN tg USING (g)),
wc AS (SELECT a.r, a.name, a.s, a.total, z.g, least(count(*), z.n) AS n FROM wt a JOIN ts USING (name)
  JOIN wt z ON z.r = a.r AND z.name = a.name AND z.s BETWEEN a.s AND a.s + ts.size - 1 GROUP BY a.r, a.name, a.s, a.total, z.g, z.n),
wd AS (SELECT r, name, s, CAST(size AS BIGINT) AS size, 2.0::DOUBLE * CAST(sum(n) AS DOUBLE)
  / (CAST(size AS DOUBLE) + CAST(least(size, total - s + 1) AS DOUBLE)) AS dice FROM wc JOIN ts USING (name) GROUP BY r, name, s, total, size),
wm AS (SELECT r, s, min_by(name, (-dice, -size, name)) AS name, max(dice) AS dice, min_by(size, (-dice, -size, name)) AS size
  FROM wd WHERE dice >= {THRESHOLD} GROUP BY ALL),
wo AS (SELECT r, min_by(name, (-dice, -size, name)) AS license, max(dice) AS dice, count(*) AS n_windows FROM wm GROUP BY 1),
l AS (SELECT r, string_agg(name, ',' ORDER BY name) AS licenses FROM (SELECT r, name FROM b UNION SELECT r, name FROM wm) GROUP BY 1)
SELECT doc_id, coalesce(o.license, wo.license) AS license, coalesce(o.dice, wo.dice) AS dice,
  coalesce(part, CASE WHEN wo.r IS NOT NULL THEN 'window' END) AS part, CAST(coalesce(n_parts, 0) AS BIGINT) AS n_parts,
  CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN o USING (r) LEFT JOIN wo USING (r) LEFT JOIN l USING (r)"""


@query("op2_licenses", _sql())
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
