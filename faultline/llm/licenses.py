"""License scans (2): a positional index of rare tokens.

How many documents have each word of the licence texts is counted over the
whole table; the rarest words of a text's key phrase are its anchors.  In each
document with an anchor, the anchors' positions less their places in the
licence text are intersected, which leaves the places where the text can start;
there the mandatory key phrase is verified word by word.  A verified phrase labels
the document; the share of the licence text's words that stand in place is its score.

Every step is an expression on one row: no shuffle but that of the counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words, the phrases all scans look for, and short public licence texts (label, text, key phrase).
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEXTS = [
    ("apache-2.0", "licensed under the apache license version 2.0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4.0", "cc by sa"),
    ("cc0", "cc0 1.0 universal public domain dedication", "cc0 1 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"      # of a text that isn't lower-cased yet
ANCHORS = 3


def _split(s: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", s)


def _templates() -> list[tuple[str, bool, list[str], list[str], int]]:
    """(label, is base, words, key phrase, place of the key phrase)."""
    out = [(label, True, _split(p), _split(p), 0) for label, p in BASE]
    for label, text, key in TEXTS:
        w, k = _split(text), _split(key)
        out.append((label, False, w, k, next(i for i in range(len(w)) if w[i:i + len(k)] == k)))
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Documents that have each word of the licence texts (a fixed list of words, so a bounded result)."""
    known = sorted({w for _, _, words, _, _ in _templates() for w in words})
    there = F.array_intersect(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                              F.array(*[F.lit(w) for w in known]))
    rows = docs.select(F.explode(there).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(known, 0) | {r["w"]: r["count"] for r in rows}


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, found)``.

    ``found`` lists (label, start, covered) of each text or phrase whose key phrase stands there, ``score`` is
    the best ``covered``, the share of the text's words in place (0 without one).  Words are lower-cased in A-Z only.
    Null and empty texts have no words, null places and empty labels.  Repeated
    rows and null ids are kept; other columns are not read; an empty table
    gives no rows.
    """
    count = word_counts(docs, text_col)
    plan = []                     # with the anchors: rarest words of the key phrase, and their places
    for label, base, words, key, at in _templates():
        rare = sorted(range(len(key)), key=lambda i: (count[key[i]], key[i], i))[:ANCHORS]
        plan.append((label, base, words, key, at, [(key[i], at + i) for i in rare]))
    anchors = sorted({w for *_, a in plan for w, _ in a})
    rarest = sorted({a[0][0] for *_, a in plan})
    some = f"(?i)(?<!{IN_WORD})(?:{'|'.join(rarest)})(?!{IN_WORD})"
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    x = x.select("id", F.regexp_extract_all("t", F.lit(IN_WORD + "+"), F.lit(0)).alias("raw"), F.col("t").rlike(some).alias("near"))
    low = f"transform(raw, r -> translate(r, '{UPPER}', '{LOWER}'))"
    x = x.select("id", F.size("raw").cast("long").alias("n_words"),
                 F.expr(f"CASE WHEN near THEN {low} ELSE cast(array() AS array<string>) END").alias("w"))
    hits = f"filter(transform(w, (v, i) -> named_struct('p', i, 'a', array_position({_array(anchors)}, v))), s -> s.a > 0)"
    x = x.select("id", "n_words", "w", F.expr(hits).alias("hits"))
    parts = []
    for label, base, words, key, at, own in plan:
        starts = [f"transform(filter(hits, s -> s.a = {anchors.index(w) + 1}), s -> s.p - {place})" for w, place in own]
        start = starts[0] if len(starts) == 1 else f"array_intersect({starts[0]}, {starts[1]})"
        for more in starts[2:]:
            start = f"array_intersect({start}, {more})"
        covered = " + ".join(f"CASE WHEN get(w, s + {i}) = '{v}' THEN 1 ELSE 0 END" for i, v in enumerate(words))
        parts.append(f"transform(filter({start}, s -> s + {at} >= 0 AND slice(w, greatest(s + {at + 1}, 1), {len(key)}) = {_array(key)}), "
                     f"s -> named_struct('label', '{label}', 'base', {str(base).lower()}, 'start', s, "
                     f"'covered', cast(({covered}) AS double) / {len(words)}))")
    found = f"concat({', '.join(parts)})"
    x = x.select("id", "n_words", F.expr(f"CASE WHEN size(hits) > 0 THEN {found} END").alias("found"))
    x = x.select("id", "n_words", F.expr(
        "coalesce(found, cast(array() AS array<struct<label:string,base:boolean,start:int,covered:double>>))").alias("found"))
    x = x.withColumn("b", F.expr("filter(found, f -> f.base)"))
    return x.select(
        F.col("id").alias(id_col), "n_words", F.size("b").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(b, f -> f.start)) AS bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(b, f -> f.start)) AS bigint)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(b, f -> f.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(found, f -> f.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(found, f -> f.covered)), 0D)").alias("score"),
        F.expr("transform(found, f -> named_struct('label', f.label, 'start', f.start, 'covered', f.covered))").alias("found"))


def sql() -> str:
    """The same on `documents` for DuckDB: every place is tried, without an index."""
    parts = []
    for label, base, words, key, at in _templates():
        there = " AND ".join(f"w[s + {at + i + 1}] = '{v}'" for i, v in enumerate(key))
        covered = " + ".join(f"CASE WHEN s + {i + 1} > 0 AND w[s + {i + 1}] = '{v}' THEN 1 ELSE 0 END" for i, v in enumerate(words))
        parts.append(f"SELECT doc, '{label}' AS label, {str(base).lower()} AS base, s, CAST({covered} AS DOUBLE) / {len(words)} AS covered "
                     f"FROM places WHERE s + {at} >= 0 AND {there}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
places AS (SELECT doc, w, unnest(range(-20, len(w))) AS s FROM d),
found AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM found GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0e0) AS score
FROM d LEFT JOIN g USING (doc)
"""
