"""License scans with a positional index of rare licence words, in DataFrame functions only.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z are in lower case. A
template is a phrase or a passage of a licence, with a label, and for a passage the key phrases that it can't do without.

1. The document frequency of every word of the templates is counted over all documents. A template's keys are its ``KEYS`` words of
   the highest inverse document frequency, those aside whose frequency's logarithm is less than half of its rarest word's. The
   index has the postings of all keys: template and places in it.
2. Of each file, the keys it has are looked up, for each template the ``LOOKED`` rarest of them. Each posting gives the start that the
   template would have; starts on which ``AGREE`` keys agree (one, if the template has no more) are candidates.
3. A candidate's words are compared with the template's, place by place. The share of equal ones is its coverage, its key phrases
   have to stand at their places in whole. A phrase must be covered in whole to give its label, a passage to ``COVERED``. The
   greatest coverage of a candidate with its key phrases is the score.

Every whole place of a phrase has all its keys, so none is missed. A passage is found while of the keys that its file has two stand where they should; a start
before the file's first word is allowed, so a passage that lost its head counts with what is left. Index and templates have a fixed size, frequencies one
row for each of their words; nothing else is shuffled, and no candidates are capped.

Cases: a null or empty text has no words; repeated rows get equal results; ties between keys go to the first word in the
template; a very long text makes an array of its words; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import documents

#: What separates words, before A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (phrase, label) whose places are counted.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: (phrase, label) that the method adds.
MORE = [
    ("affero general public license", "agpl"),
    ("apache license", "apache"),
    ("artistic license", "artistic"),
    ("boost software license", "bsl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc by sa", "cc-by-sa"),
    ("cc0 1 0 universal", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("eclipse public license", "epl"),
    ("free and unencumbered software", "unlicense"),
    ("gnu free documentation license", "gfdl"),
    ("lesser general public license", "lgpl"),
    ("mit license", "mit"),
    ("mozilla public license", "mpl"),
    ("permission is hereby granted free of charge", "mit"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("redistribution and use in source and binary forms", "bsd"),
]
#: (passage, label, key phrases) of licence texts and the notices that they ask for, in words as above.
PASSAGES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
        ["permission is hereby granted free of charge", "deal in the software without restriction"],
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer",
        "bsd",
        ["redistribution and use in source and binary forms", "following conditions are met"],
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2.0",
        ["apache license version 2 0"],
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        "gpl-notice",
        ["free software", "terms of the gnu general public license"],
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
        "lgpl-notice",
        ["free software", "gnu lesser general public license"],
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl-2.0",
        ["mozilla public license v 2 0"],
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc",
        ["with or without fee", "this permission notice appear in all copies"],
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "unlicense",
        ["unencumbered software released into the public domain"],
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "zlib",
        ["as is without any express or implied warranty"],
    ),
    (
        "this work is licensed under a creative commons attribution 4 0 international license",
        "cc-by-4.0",
        ["creative commons attribution 4 0"],
    ),
]
KEYS, LOOKED, AGREE, COVERED = 8, 4, 2, 0.8

FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


class Template:
    """Words with a label; ``must`` has (first word, words) of each key phrase."""

    def __init__(self, phrase: str, label: str, base: bool = False, must=(), covered: float = 1.0):
        self.words, self.label, self.base, self.covered = phrase.split(), label, base, covered
        self.must = [next((i, len(w)) for i in range(len(self.words)) if self.words[i : i + len(w)] == w) for w in map(str.split, must)]

    def keys(self, df: dict[str, int], n: int) -> list[str]:
        """Rarest first, given document frequencies of ``n`` documents."""
        words = sorted(dict.fromkeys(self.words), key=lambda w: (df.get(w, 0), self.words.index(w)))[:KEYS]
        # log((n + 1) / (f + 1)) is half of the rarest word's at least.
        return [w for w in words if (n + 1) * (df.get(words[0], 0) + 1) >= (df.get(w, 0) + 1) ** 2] or words[:1]


def templates(base=BASE, more=MORE, passages=PASSAGES) -> list[Template]:
    return [*(Template(*t, base=True) for t in base), *(Template(*t) for t in more), *(Template(p, label, must=must, covered=COVERED) for p, label, must in passages)]


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _words(df: DataFrame, text: str, id_col: str, wanted: list[str]) -> DataFrame:
    """(id, w, lead, n_words, hits): the words with ``lead`` empty ones before them, and structs (pos, word) of ``wanted`` ones."""
    split = df.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS).alias("w"))
    lead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    trail = F.when((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == ""), 1).otherwise(0)
    split = split.select("*", lead.alias("lead"), (F.size("w") - lead - trail).cast("bigint").alias("n_words"))
    # lower() may map other characters to ASCII ones, so it only sorts out most words before the exact test.
    hit = lambda x, i: F.when(F.lower(x).isin(wanted) & _lower(x).isin(wanted), F.struct((i - F.col("lead")).alias("pos"), _lower(x).alias("word")))
    return split.withColumn("hits", F.array_compact(F.transform("w", hit)))


def frequencies(df: DataFrame, text: str, id_col: str, found: list[Template]) -> tuple[dict[str, int], int]:
    """The document frequency of each word of the templates, and the number of documents; the driver gets a row per word."""
    words = _words(df, text, id_col, sorted({w for t in found for w in t.words}))
    each = F.concat(F.array(F.lit("")), F.array_distinct(F.transform("hits", lambda h: h["word"])))  # the empty word stands for every document
    counted = {r["word"]: r["count"] for r in words.select(F.explode(each).alias("word")).groupBy("word").count().collect()}
    return counted, counted.pop("", 0)


def _literal(t: Template, keys: list[str]) -> Column:
    strings = lambda v: F.array(*map(F.lit, v))
    posting = lambda k: F.struct(F.lit(k).alias("word"), F.array(*(F.lit(i) for i, w in enumerate(t.words) if w == k)).alias("rel"))
    must = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("n")) for i, n in t.must)) if t.must else F.array().cast("array<struct<at:int,n:int>>")
    return F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), strings(t.words).alias("words"), strings(keys).alias("keys"), F.array(*map(posting, keys)).alias("postings"),
        F.lit(min(AGREE, len(keys))).alias("agree"), must.alias("must"), F.lit(float(t.covered)).alias("covered"),
    )


def scan(df: DataFrame, text: str = "text", id_col: str = "doc_id", found: list[Template] | None = None) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, and places (label, start, n, base, share) of each row."""
    found = found or templates()
    counted, n = frequencies(df, text, id_col, found)
    keys = [t.keys(counted, n) for t in found]
    index = F.array(*map(_literal, found, keys))
    words = _words(df, text, id_col, sorted({k for ks in keys for k in ks}))
    present = words.withColumn("present", F.array_distinct(F.transform("hits", lambda h: h["word"])))
    at = F.map_from_entries(F.transform("present", lambda k: F.struct(k, F.transform(F.filter("hits", lambda h: h["word"] == k), lambda h: h["pos"]))))
    # Templates with enough keys in the file, and where their postings say that they begin.
    known = F.filter(index, lambda t: F.size(F.array_intersect(t["keys"], F.col("present"))) >= t["agree"])

    def starts(t, at):
        looked = F.slice(F.filter(t["postings"], lambda p: F.array_contains("present", p["word"])), 1, LOOKED)
        of = lambda p: F.array_distinct(F.flatten(F.transform(F.element_at(at, p["word"]), lambda i: F.transform(p["rel"], lambda r: i - r))))
        return F.array_sort(F.flatten(F.transform(looked, of)))

    def once(value, f):
        """``f`` of a value that is computed once, though ``f`` names it in loops."""
        return F.transform(F.array(value), f)[0]

    def agreed(t, at):
        """Each key has a start once, so as many equal ones as keys agree on it."""
        return once(starts(t, at), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + t["agree"] - 1) == x)))

    def compared(t, start):
        first = start + F.col("lead")
        same = F.zip_with(t["words"], F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda x, j: F.coalesce(_lower(F.get("w", first + j)) == x, F.lit(False)))
        whole = F.forall(t["must"], lambda m: F.size(F.filter(F.slice(same, m["at"] + 1, m["n"]), lambda x: x)) == m["n"])
        share = F.size(F.filter(same, lambda x: x)) / F.size(t["words"])
        return F.struct(t["label"].alias("label"), start.alias("start"), F.size(t["words"]).alias("n"), t["base"].alias("base"), t["covered"].alias("covered"), F.when(whole, share).otherwise(0.0).alias("share"))

    candidates = once(at, lambda m: F.flatten(F.transform(known, lambda t: F.transform(agreed(t, m), lambda s: compared(t, s)))))
    looked = present.withColumn("found", candidates)
    placed = looked.withColumn("places", F.filter("found", lambda f: f["share"] >= f["covered"])).withColumn("base_places", F.filter("places", lambda p: p["base"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    begins = F.transform("base_places", lambda p: p["start"])
    return placed.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min(begins).cast("bigint").alias("first_word"),
        F.array_max(begins).cast("bigint").alias("last_word"),
        joined("base_places").alias("base_labels"),
        joined("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
        F.transform("places", lambda p: p.dropFields("covered")).alias("places"),
    )


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", *FIELDS)


QUERIES = {"op7_license": op7_license}


def _sql() -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    must = lambda t: ", ".join(f"{{'first': {i}, 'n': {n}}}" for i, n in t.must)
    row = lambda i, t: f"({i}, [{quoted(t.words)}], '{t.label}', {str(t.base).lower()}, [{must(t)}]::STRUCT(first INT, n INT)[], {t.covered}::DOUBLE)"
    rows = ",\n".join(row(i, t) for i, t in enumerate(templates()))
    return rf"""
WITH tpl AS (SELECT * FROM (VALUES {rows}) t(id, words, label, base, must, covered)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
vocabulary AS (SELECT id, word, min(j) AS first FROM (SELECT id, unnest(words) AS word, unnest(range(0, len(words))) AS j FROM tpl) GROUP BY id, word),
hits AS (SELECT r, i, w[i + 1] AS word FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM d) WHERE w[i + 1] IN (SELECT word FROM vocabulary)),
df AS (SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word),
ranked AS (SELECT id, word, f, first, row_number() OVER (PARTITION BY id ORDER BY f, first) AS o, min(f) OVER (PARTITION BY id) AS least FROM (SELECT id, word, first, coalesce(n, 0) AS f FROM vocabulary LEFT JOIN df USING (word))),
keys AS (SELECT id, word, o, count(*) OVER (PARTITION BY id) AS n_keys FROM ranked WHERE o <= {KEYS} AND (o = 1 OR (SELECT count(*) + 1 FROM d)::HUGEINT * (least + 1) >= (f + 1)::HUGEINT * (f + 1))),
post AS (SELECT id, word, o, n_keys, j FROM keys JOIN (SELECT id, unnest(words) AS word, unnest(range(0, len(words))) AS j FROM tpl) USING (id, word)),
looked AS (SELECT r, id, word FROM (SELECT r, id, word, row_number() OVER (PARTITION BY r, id ORDER BY o) AS p FROM (SELECT DISTINCT r, word FROM hits) JOIN keys USING (word)) WHERE p <= {LOOKED}),
starts AS (SELECT DISTINCT r, id, word, n_keys, i - j AS start FROM hits JOIN looked USING (r, word) JOIN post USING (id, word)),
cand AS (SELECT r, id, start FROM starts GROUP BY r, id, start, n_keys HAVING count(*) >= least({AGREE}, n_keys)),
same AS (SELECT r, label, base, start, must, covered, list_transform(range(1, len(words) + 1), lambda j: CASE WHEN start + j < 1 THEN false ELSE coalesce(w[start + j] = words[j], false) END) AS s FROM cand JOIN tpl USING (id) JOIN d USING (r)),
found AS (SELECT r, label, base, start, covered, CASE WHEN len(list_filter(must, lambda m: len(list_filter(s[m.first + 1:m.first + m.n], lambda x: x)) < m.n)) = 0 THEN len(list_filter(s, lambda x: x))::DOUBLE / len(s) ELSE 0 END AS share FROM same),
places AS (SELECT * FROM found WHERE share >= covered),
based AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places WHERE base GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels FROM places GROUP BY r),
scored AS (SELECT r, max(share) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN based USING (r) LEFT JOIN named USING (r) LEFT JOIN scored USING (r)
"""


ORACLE = {"op7_license": _sql()}
