"""Licence scan with a positional rare-token index.

Templates are short licence texts with mandatory key phrases. Their words make the index: word -> postings (template,
position). The corpus gives each indexed word its IDF, ln((rows + 1) / (rows with it + 1)). A file looks up the indexed words of
highest IDF that it holds (all of at least `min_idf`); these propose the templates that they stand in, and so do a template's
key phrases if all of them stand in the file word for word. For each proposed template all its words vote, with their IDF (LEAST
at least, so that licences that stand in many rows or in all, and those of tiny tables, are told too), for their place minus their
position in the template. The best relative position's votes over the template's whole IDF is the template's score; the file's score
is the best one, and a template whose key phrases stand in the file and whose score reaches `accept` gives its label.

Base phrases are found word for word beside that, and their labels are always given. All is DataFrame functions within a
row: the one exchange is the count of rows by indexed word, a few hundred words.

Nulls and edges: a null text has no words; it gets no labels and score 0. Ids are carried as they are, null ones too. Rows that
repeat an id or a text are rows of their own and count in the IDF. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, documents

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label, text, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
]
LEAST = 0.01  # weight of a word that stands in every row
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-casing all of a text moves no word's end and changes A-Z alike; only the Kelvin sign would become a letter
    of a-z, so such texts take the slower way."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.contains(text, F.lit("\u212a")), ascii_lower(text)).otherwise(F.lower(text))
    return F.filter(F.split(low, NOT_WORD, -1), lambda w: w != "")


def n_spaces(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))


def phrase_places(joined: Column, n_words: Column, phrase: str) -> Column:
    """struct(n, first, last) of a phrase in words joined by single spaces, with one at either end. The phrases cannot
    overlap themselves, so the pieces between them tell all."""
    pieces = F.split(joined, f"(?<= ){phrase}(?= )", -1)
    n = F.size(pieces) - 1
    last = n_words - (n_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())
    found = F.struct(n.cast("long").alias("n"), (n_spaces(F.element_at(pieces, 1)) - 1).cast("long").alias("first"), last.cast("long").alias("last"))
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), found).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))


def idf_of(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Of the indexed words alone (their number is fixed), over all rows."""
    indexed = F.array(*[F.lit(w) for w in vocabulary])
    held = rows.select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(indexed, "words"))).alias("w"))  # "" counts rows
    n = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


def best_votes(votes: Column, template: int) -> Column:
    """The largest sum of votes at one relative position; votes are sorted."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        s = F.when(v["d"] == a["d"], a["s"]).otherwise(0.0) + v["idf"]
        return F.struct(v["d"].alias("d"), s.alias("s"), F.greatest(a["best"], s).alias("best"))

    return F.aggregate(F.filter(votes, lambda v: v["t"] == template), start, step, lambda a: a["best"])


def votes_of(words: Column, vocabulary: list[str], templates: Column, postings: dict[str, list[Column]]) -> Column:
    """Sorted votes of the indexed words' places for the given templates."""
    index = F.create_map(*[x for w, places in postings.items() for x in (F.lit(w), F.array(*places))])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary))
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("d"), p["idf"].alias("idf")))))
    return F.array_sort(F.filter(votes, lambda v: F.array_contains(templates, v["t"])))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_idf: float = 1.5, accept: float = 0.6) -> DataFrame:
    """(id, n_words, base array<struct<n,first,last>> in the order of BASE, found array<string>, score)."""
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    words_in = [text.split() for _, text, _ in templates]
    vocabulary = sorted({w for words in words_in for w in words})
    idf = idf_of(rows, vocabulary)
    rare = sorted((w for w in vocabulary if idf[w] >= min_idf), key=lambda w: (-idf[w], w))
    weight = {w: max(LEAST, idf[w]) for w in vocabulary}
    n_words, joined = F.size("words"), F.col("joined")
    out = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    base = F.array(*[phrase_places(joined, n_words, p) for p in BASE])
    texts = lambda some: F.array(*[F.lit(w) for w in some]).cast("array<string>")

    def phrased(t: int) -> Column:
        ok = F.lit(True)
        for p in templates[t][2]:
            ok = ok & F.contains(joined, F.lit(f" {p} "))
        return ok

    out = out.withColumn("rare", F.array_intersect(texts(rare), "words"))
    out = out.withColumn("phrased", F.array_compact(F.array(*[F.when(phrased(t), F.lit(t)) for t in range(len(templates))])))
    proposed = [F.when(F.array_contains("phrased", F.lit(t)) | F.arrays_overlap("rare", texts(sorted({*words} & {*rare}))), F.lit(t)) for t, words in enumerate(words_in)]
    out = out.withColumn("proposed", F.when((F.size("rare") > 0) | (F.size("phrased") > 0), F.array_compact(F.array(*proposed))).otherwise(F.array().cast("array<int>")))
    places = {w: [F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(weight[w]).alias("idf")) for t, words in enumerate(words_in) for p, x in enumerate(words) if x == w] for w in vocabulary}
    votes = votes_of(F.col("words"), vocabulary, F.col("proposed"), places)
    out = out.withColumn("votes", F.when(F.size("proposed") > 0, votes).otherwise(F.array().cast("array<struct<t:int,d:int,idf:double>>")))
    share = lambda t: F.least(F.lit(1.0), best_votes(F.col("votes"), t) / F.lit(sum(weight[w] for w in words_in[t])))
    out = out.withColumn("scores", F.when(F.size("votes") > 0, F.array(*[share(t) for t in range(len(templates))])).otherwise(F.array(F.lit(0.0))))
    verified = [F.when(F.array_contains("phrased", F.lit(t)) & (F.get("scores", F.lit(t)) >= accept), F.lit(label)) for t, (label, _, _) in enumerate(templates)]
    return out.select("id", n_words.cast("long").alias("n_words"), base.alias("base"), F.array_compact(F.array(*verified)).alias("found"), F.array_max("scores").alias("score"))


def op2(spark, sf_dir: str) -> DataFrame:
    out = licences(documents(spark, sf_dir))
    base_labels = F.array_compact(F.array(*[F.when(F.get("base", F.lit(k))["n"] > 0, F.lit(label)) for k, label in enumerate(BASE.values())]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        F.col("id").cast("long").alias("doc_id"), "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, "found")).alias("labels"), F.round("score", 6).alias("score"),
    )


def sql(min_idf: float = 1.5, accept: float = 0.6) -> str:
    """The query in DuckDB's SQL."""
    quote = lambda x: "'" + x + "'"
    rows = lambda xs: ", ".join("(" + ", ".join(map(str, x)) + ")" for x in xs)
    az, pattern = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    base = rows((quote(p), len(p.split()), quote(label)) for p, label in BASE.items())
    words = rows((t, p, quote(w)) for t, (_, text, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split()))
    phrases = rows((t, quote(label), quote(p)) for t, (label, _, ps) in enumerate(TEMPLATES) for p in ps)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {az}), {pattern}) AS w FROM documents),
j AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
x AS (SELECT doc_id, unnest(w) AS w, unnest(generate_series(0, len(w) - 1)) AS i FROM d),
base(phrase, k, label) AS (VALUES {base}), tw(t, p, w) AS (VALUES {words}), ph(t, label, phrase) AS (VALUES {phrases}),
hit AS (SELECT x.doc_id, b.label, x.i FROM x JOIN base b ON x.w = string_split(b.phrase, ' ')[1] JOIN d ON d.doc_id = x.doc_id WHERE array_to_string(d.w[x.i + 1 : x.i + b.k], ' ') = b.phrase),
h AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY doc_id),
idf AS (SELECT v.w, ln(((SELECT count(*) FROM d) + 1.0e0) / (count(DISTINCT x.doc_id) + 1.0e0)) AS idf FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN x ON x.w = v.w GROUP BY v.w),
full_ AS (SELECT j.doc_id, ph.t, any_value(ph.label) AS label FROM j CROSS JOIN ph GROUP BY 1, 2 HAVING bool_and(contains(j.s, ' ' || ph.phrase || ' '))),
proposed AS (SELECT x.doc_id, tw.t FROM x JOIN idf ON idf.w = x.w JOIN tw ON tw.w = x.w WHERE idf.idf >= {min_idf} UNION SELECT doc_id, t FROM full_),
votes AS (SELECT x.doc_id, tw.t, x.i - tw.p AS g, sum(greatest({LEAST}e0, idf.idf)) AS s FROM x JOIN idf ON idf.w = x.w JOIN tw ON tw.w = x.w JOIN proposed o ON o.doc_id = x.doc_id AND o.t = tw.t GROUP BY 1, 2, 3),
whole AS (SELECT t, sum(greatest({LEAST}e0, idf)) AS s FROM tw JOIN idf ON idf.w = tw.w GROUP BY t),
score AS (SELECT v.doc_id, v.t, least(1.0e0, max(v.s / q.s)) AS s FROM votes v JOIN whole q ON q.t = v.t GROUP BY 1, 2),
found AS (SELECT c.doc_id, f.label FROM score c JOIN full_ f ON f.doc_id = c.doc_id AND f.t = c.t WHERE c.s >= {accept}),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hit UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT j.doc_id, CAST(j.n_words AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_base, CAST(h.a AS BIGINT) AS first_word, CAST(h.b AS BIGINT) AS last_word, coalesce(h.labels, '') AS base_labels,
coalesce(l.labels, '') AS labels, round(coalesce((SELECT max(s) FROM score c WHERE c.doc_id = j.doc_id), 0.0e0), 6) AS score
FROM j LEFT JOIN h ON h.doc_id = j.doc_id LEFT JOIN labels l ON l.doc_id = j.doc_id"""
