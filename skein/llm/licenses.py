"""License scans by diagonal voting.

The base labels are phrases found as consecutive words.  The method rolls k-gram
hashes over each text, joins them with the k-grams of license templates, and lets
each hit vote for the diagonal (text place - template place); neighbouring
diagonals are merged.  A merged run with ``VOTES`` of the template's k-grams is
verified word by word: the template's words that stand in the text on one of the
run's diagonals, over the template's words or the run's, whichever are more, must
reach ``COVER``.  Licenses that differ by a word ("Lesser", a version) lie on each
other: a run is dropped where one of another label covers over half of it better.

Templates are whole short licenses (MIT, BSD, ISC, zlib, Unlicense) and the notices
by which files name the long ones; a label has a version only where the words do.
License texts that are neither, such as the body of the GPL, get no method label.

Defined results: null texts count as empty; a text without hits has labels '' and
score 0; repeated rows are judged once and give repeated results; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import let, text_of
from .scratch import Scratch

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: License texts and notices as they stand in files; words are lower-cased when they are read.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
    permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
    WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
    FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
    DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
    THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met"""),
    ("bsd-2-clause", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
    COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
    THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
    ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
    including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
    agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
    OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
    License."""),
    ("apache-2.0", "licensed under the Apache License version 2 0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation"""),
    ("gpl-3.0-or-later", """under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
    License, or (at your option) any later version"""),
    ("gpl-2.0-or-later", """under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the
    License, or (at your option) any later version"""),
    ("gpl-3.0", "licensed under the GNU General Public License version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License version 2"),
    ("lgpl", """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
    Software Foundation"""),
    ("agpl", """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
    Software Foundation"""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
    with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("epl-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
    available at"""),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to"),
)
K = 3
#: Diagonals closer than this are one run: words inserted or dropped inside a notice.
MERGE = 3
#: Share of a template's k-grams that makes a run a candidate, and of its words that verifies it.
VOTES = 0.4
COVER = 0.8


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def license_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased.

    Splitting first is the same: the class of word characters, with A-Z put back,
    splits alike, and lower-casing ASCII words with ``lower`` changes A-Z only;
    words with other letters go through ``translate``.
    """
    raw = F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    return F.transform(raw, lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def base_places(words: Column) -> Column:
    """(label, start) of each place where a phrase stands."""
    firsts = sorted({p.split()[0] for p, _ in PHRASES})
    found = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda x: x["w"].isin(firsts))

    def check(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            parts = phrase.split()
            hit = reduce(lambda a, b: a & b, [F.coalesce(F.get(words, (x["i"] + k).cast("int")) == p, F.lit(False)) for k, p in enumerate(parts)])
            out = F.when(hit, F.lit(label)).otherwise(out)
        return F.struct(out.alias("label"), x["i"].alias("i"))

    return F.filter(F.transform(found, check), lambda x: x["label"].isNotNull())


def gram_hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def templates(spark) -> DataFrame:
    """(tid, label, tw) of the fixed templates."""
    rows = [(t, label, template_words(text)) for t, (label, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "tid int, label string, tw array<string>")


def template_grams(spark, k: int = K) -> DataFrame:
    """(gram, tid, tpos, n_grams) of the fixed templates: about a thousand rows."""
    df = templates(spark).withColumn("n_grams", F.size("tw") - k + 1)
    pos = df.select("tid", "tw", "n_grams", F.explode(F.sequence(F.lit(0), F.size("tw") - k)).alias("tpos"))
    return pos.select(gram_hash(F.col("tw"), F.col("tpos"), k).alias("gram"), "tid", "tpos", "n_grams")


def gram_hits(words: Column, known: Column, k: int = K) -> Column:
    """(pos, gram) of the text's k-grams that are in ``known``."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    rolled = F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]).alias("gram")))
    return F.filter(rolled, lambda h: known(h["gram"]))


def detect(hit: DataFrame, k: int = K, votes: float = VOTES, cover: float = COVER) -> DataFrame:
    """key, label, tid, start, end, cover of verified notices; ``hit`` is (key, words, hits), one row a key."""
    spark = hit.sparkSession
    each = hit.select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.gram")
    found = each.join(F.broadcast(template_grams(spark, k)), "gram").select("key", "tid", "n_grams", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diag")).distinct()
    voted = found.groupBy("key", "tid", "n_grams", "diag").agg(F.collect_set("tpos").alias("tposs"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    w = Window.partitionBy("key", "tid").orderBy("diag")
    runs = voted.withColumn("run", F.sum(F.when(F.col("diag") - F.lag("diag").over(w) <= MERGE, 0).otherwise(1)).over(w))
    merged = runs.groupBy("key", "tid", "n_grams", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))).alias("n_found"), F.min("start").alias("start"), (F.max("end") + k).alias("end"), F.array_sort(F.collect_list("diag")).alias("diags")
    )
    # two diagonals that lie far apart in the text may be neighbours by number; such a run is no one notice
    near = merged.filter((F.col("n_found") >= votes * F.col("n_grams") - 1e-9) & (F.col("end") - F.col("start") <= 2 * (F.col("n_grams") + k)))
    both = near.join(hit.select(F.col("key").alias("_key"), "words"), F.col("key") == F.col("_key")).join(F.broadcast(templates(spark)), "tid")
    same = F.filter(F.sequence(F.lit(0), F.size("tw") - 1), lambda t: F.exists("diags", lambda d: F.coalesce(F.get(F.col("words"), t + d) == F.get(F.col("tw"), t), F.lit(False))))
    ok = both.withColumn("cover", F.size(same) / F.greatest(F.size("tw"), F.col("end") - F.col("start"))).filter(F.col("cover") >= cover - 1e-9)
    ok = ok.select("key", "label", "tid", "start", "end", "cover")
    # at one place there are no more runs than templates, so those that overlap stand within this many by start
    around = Window.partitionBy("key").orderBy("start", "tid").rowsBetween(-3 * len(TEMPLATES), 3 * len(TEMPLATES))
    ok = ok.withColumn("others", F.collect_list(F.struct("label", "start", "end", "cover")).over(around))
    shared = lambda o: F.least(o["end"], F.col("end")) - F.greatest(o["start"], F.col("start"))
    better = F.exists("others", lambda o: (o["label"] != F.col("label")) & (o["cover"] > F.col("cover") + 1e-9) & (2 * shared(o) > F.col("end") - F.col("start")))
    return ok.filter(~better).drop("others")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base figures, labels with the method's, score.

    Texts are split into words once; only those with a k-gram of a template keep
    their words for the vote.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    text = text_of(text_col)
    grams = [r[0] for r in template_grams(spark).select("gram").distinct().collect()]

    def measured(ws: Column) -> Column:
        def both(places: Column, hits: Column) -> Column:
            return F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.size(places).cast("long").alias("n_base"),
                F.array_min(F.transform(places, lambda p: p["i"])).alias("first_word"),
                F.array_max(F.transform(places, lambda p: p["i"])).alias("last_word"),
                F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))).alias("base"),
                hits.alias("hits"),
                F.when(F.size(hits) > 0, ws).alias("words"),
            )

        return let(base_places(ws), lambda places: let(gram_hits(ws, lambda g: g.isin(grams)), lambda hits: both(places, hits)))

    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit(":"), text))
    base = scratch.write(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), let(license_words(text), measured).alias("m")).select("doc_id", "key", "m.*"))
    # a document whose text repeats is judged once: key holds id and text
    hit = base.filter(F.size("hits") > 0).select("key", "words", "hits").dropDuplicates(["key"])
    found = detect(scratch.write(hit)).groupBy("key").agg(F.collect_set("label").alias("extra"), F.max("cover").alias("cover"))
    found = scratch.write(found).withColumnRenamed("key", "_k")
    plain = base.drop("hits", "words")
    out = plain.join(found.hint("merge"), F.col("key") == F.col("_k"), "left")
    none = F.array().cast("array<string>")
    score = F.round(F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce("cover", F.lit(0.0))), 6)
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("extra", none)))), ",").alias("labels"),
        score.alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql() -> str:
    tmpl = ", ".join(f"({t}, '{label}', string_split('{' '.join(template_words(text))}', ' '))" for t, (label, text) in enumerate(TEMPLATES))
    phr = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
ph(p, label) AS (VALUES {phr}),
b AS (SELECT w.doc_id, w.i, ph.label FROM w JOIN ph ON w.w = ph.p[1] JOIN d ON d.doc_id = w.doc_id WHERE d.ws[w.i + 1 : w.i + len(ph.p)] = ph.p),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM b GROUP BY doc_id),
t(tid, label, tw) AS (VALUES {tmpl}),
tg AS (SELECT tid, label, len(tw) - {K - 1} AS n_grams, unnest(range(0, len(tw) - {K - 1})) AS tpos, tw FROM t),
tk AS (SELECT tid, label, n_grams, tpos, array_to_string(tw[tpos + 1 : tpos + {K}], ' ') AS gram FROM tg),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER k || ' ' || lead(w, 2) OVER k AS gram FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, tid, label, n_grams, i, tpos, i - tpos AS diag FROM g JOIN tk USING (gram)),
v AS (SELECT doc_id, tid, label, n_grams, diag, list(DISTINCT tpos) AS tp, min(i) AS s, max(i) AS e FROM h GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN diag - pd <= {MERGE} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS run
  FROM (SELECT *, lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS pd FROM v)),
m AS (SELECT doc_id, tid, label, n_grams, run, len(list_distinct(flatten(list(tp)))) AS found, list(diag) AS diags, min(s) AS s, max(e) + {K} AS e FROM r GROUP BY doc_id, tid, label, n_grams, run),
nr AS (SELECT *, row_number() OVER () AS rid FROM m WHERE found >= {VOTES} * n_grams - 1e-9 AND e - s <= 2 * (n_grams + {K})),
dt AS (SELECT rid, doc_id, tid, unnest(diags) AS diag FROM nr),
ok AS (SELECT DISTINCT dt.rid, p.tpos FROM dt JOIN (SELECT tid, unnest(tw) AS tword, generate_subscripts(tw, 1) - 1 AS tpos FROM t) p USING (tid)
  JOIN w ON w.doc_id = dt.doc_id AND w.i = p.tpos + dt.diag AND w.w = p.tword),
cn AS (SELECT rid, count(*) AS n FROM ok GROUP BY rid),
cv AS (SELECT nr.*, n / greatest(len(t.tw), e - s) AS cover FROM nr JOIN cn USING (rid) JOIN t ON t.tid = nr.tid WHERE n / greatest(len(t.tw), e - s) >= {COVER} - 1e-9),
bt AS (SELECT a.* FROM cv a WHERE NOT EXISTS (SELECT 1 FROM cv b WHERE b.doc_id = a.doc_id AND b.label <> a.label AND b.cover > a.cover + 1e-9 AND 2 * (least(a.e, b.e) - greatest(a.s, b.s)) > a.e - a.s)),
x AS (SELECT doc_id, list(DISTINCT label) AS extra, max(cover) AS cover FROM bt GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(extra, [])))), ','), '') AS labels,
  round(greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END, coalesce(cover, 0))::DOUBLE, 6) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN x USING (doc_id)
"""
