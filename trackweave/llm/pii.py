"""Personal data: base patterns, and terms of the corpus that give a protected entity away.

Base kinds (email, ip, card, phone) are found by regular expressions in whole texts; places come from the lengths of the
pieces between matches. The patterns are written so that they match what the plain ones match, in linear time.

Terms: a protected entity is the value of a valid base match (digits alone for card and phone, lower case for email). A
term is a run of at least three letters, lower-cased. Terms standing within `window` terms of an entity, between its
neighbouring matches of the same kind, co-occur with it. Over all rows of the corpus, PMI(e, t) = log2(N n_et / (n_e n_t))
and IC(e) = log2(N / n_e). PMI / IC(e) is the share of the entity's information that the term discloses (1: the term
stands in no row without it). Where it reaches `generalise_at` and at least `min_support` different texts show the
pair, the term is generalised in every row that holds the entity near it; from `remove_at` on it is removed. All its
places in that row count.

Everything is DataFrame functions. Matches and their neighbours are found once and written, without the texts; the corpus is
then read for the counts of those terms alone that enough texts show with an entity, and once more for the spans. Lists of
terms and of rows with disclosing terms are broadcast up to MOST_TERMS and MOST_ROWS; beyond that they are joined by a
shuffle, of partial counts and of the texts of rows that hold a match.

Nulls and edges: a null text counts as empty. Rows with null or repeated ids are told apart by their text's hash; rows
equal in both are equal in result and each is returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, plain

# Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ;
# [0-9]([\x20-]?[0-9])+ ; \+[0-9][\x20().0-9-]+[0-9]. A match starts at a run's start or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SPAN = "array<struct<start:int,end:int,value:string>>"
NOT_LETTERS = r"[^\p{L}]+"
MOST_TERMS = 200_000
MOST_ROWS = 50_000
PART = 32


def may_hold(kind: str, text: Column) -> Column:
    """False only if no valid match can be there; spares most texts the finer work."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){15}")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        d = digits(value)
        return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: Column) -> Column:
    """All leftmost matches with their places in code points."""
    m = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("p"), m.alias("m"))

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("pos"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])


def base_spans(kind: str, text: Column) -> Column:
    found = F.filter(located(text, F.lit(PATTERNS[kind])), lambda s: valid(kind, s["value"]))
    return F.when(may_hold(kind, text), found).otherwise(F.array().cast(SPAN))


def terms(piece: Column) -> Column:
    return F.filter(F.split(F.lower(piece), NOT_LETTERS, -1), lambda t: F.length(t) >= 3)


def entity(kind: str, value: Column) -> Column:
    norm = {"email": F.lower(value), "ip": value}.get(kind, digits(value))
    return F.concat(F.lit(f"{kind}:"), norm)


def neighbours(kind: str, text: Column, window: int) -> Column:
    """array<struct<entity, terms>> of the valid matches of a kind."""
    pattern = F.lit(PATTERNS[kind])
    m, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    around = F.arrays_zip(m.alias("m"), F.slice(pieces, F.lit(1), F.size(m)).alias("before"), F.slice(pieces, F.lit(2), F.size(m)).alias("after"))

    def near(x: Column) -> Column:
        words = F.concat(F.slice(F.reverse(terms(x["before"])), 1, window), F.slice(terms(x["after"]), 1, window))
        return F.struct(entity(kind, x["m"]).alias("entity"), words.alias("terms"))

    found = F.transform(F.filter(around, lambda x: valid(kind, x["m"])), near)
    return F.when(may_hold(kind, text), found).otherwise(F.array().cast("array<struct<entity:string,terms:array<string>>>"))


def counted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): rows that hold it, for the terms of `wanted` that any holds."""
    wanted = wanted.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_TERMS else wanted.hint("merge")
    held = rows.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return held.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing_terms(rows: DataFrame, window: int, generalise_at: float, remove_at: float, min_support: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, text) -> (id, h, entity, term) contexts, and (entity, term, disclosed, remove) above the threshold."""
    text = F.col("text")
    near = F.flatten(F.array(*[neighbours(k, text, window) for k in KINDS]))
    some = rows.where(F.greatest(*[may_hold(k, text) for k in KINDS])).select("id", F.xxhash64("text").alias("h"), near.alias("near"))
    some = materialise(some.where(F.size("near") > 0), "pii-near")
    entities = some.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    n_e = entities.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = F.flatten(F.transform("near", lambda x: F.transform(x["terms"], lambda t: F.struct(x["entity"].alias("entity"), t.alias("term")))))
    contexts = some.select("id", "h", F.explode(F.array_distinct(pairs)).alias("p")).select("id", "h", "p.entity", "p.term")
    joint = contexts.groupBy("entity", "term", "h").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("support")).where(F.col("support") >= min_support)
    # PMI / IC >= g  <=>  n_t <= n_et * (N / n_e) ** (1 - g). Terms whose count among the rows near entities, or among one row
    # in PART of all, is beyond that already are out before the whole corpus is counted: most frequent words.
    total = rows.count()
    n_near = contexts.select("id", "h", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    most = F.col("n_et") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1 - generalise_at)) * 1.001
    joint = joint.join(n_e, "entity").withColumn("most", most).join(n_near, "term").where(F.col("n_near") <= F.col("most"))
    joint = materialise(joint, "pii-joint")
    n_part = counted(rows.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), joint)
    joint = materialise(joint.join(n_part.withColumnRenamed("n_t", "n_part"), "term", "left").where("coalesce(n_part, 0) <= most"), "pii-joint")
    n_t = counted(rows, joint)
    told = joint.join(n_t, "term")
    pmi = F.log2(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    told = told.withColumn("disclosed", F.try_divide(pmi, F.log2(F.lit(float(max(1, total))) / F.col("n_e")))).where(F.col("disclosed") >= generalise_at)
    return contexts, told.select("entity", "term", "disclosed", (F.col("disclosed") >= remove_at).alias("remove"))


def overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def term_spans(text: Column, listed: Column, base: Column) -> Column:
    """All places of the listed terms (letters alone, so nothing needs escaping) outside the base spans."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(listed, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(listed) > 0, F.filter(located(text, pattern), lambda s: ~overlaps(base, s))).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 6, generalise_at: float = 0.6, remove_at: float = 0.9, min_support: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, email, ip, card, phone, term, removed, *keep): arrays of spans by kind; removed lists the terms whose
    places are to be removed rather than generalised."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))
    contexts, told = disclosing_terms(rows, window, generalise_at, remove_at, min_support)
    listed = contexts.join(told, ["entity", "term"]).groupBy("id", "h", "term").agg(F.max("remove").alias("remove"))
    listed = listed.groupBy("id", "h").agg(F.array_sort(F.collect_list("term")).alias("listed"), F.array_sort(F.collect_list(F.when(F.col("remove"), F.col("term")))).alias("removed"))
    listed = materialise(listed, "pii-listed").alias("l")
    text, none = F.col("f.text"), F.array().cast("array<string>")
    found = rows.select("*", *[base_spans(k, F.col("text")).alias(k) for k in KINDS]).withColumn("h", F.xxhash64("text"))
    own = ["id", "text", *KINDS, *(f"_{c}" for c in keep)]

    def joined(found: DataFrame, listed: DataFrame) -> DataFrame:
        out = found.alias("f").join(listed, F.col("f.id").eqNullSafe(F.col("l.id")) & (F.col("f.h") == F.col("l.h")), "left")
        spans = term_spans(text, F.coalesce("l.listed", none), F.concat(*KINDS))
        return out.select(*(F.col(f"f.{c}") for c in own), spans.alias("term"), F.coalesce("l.removed", none).alias("removed"))

    if listed.count() <= MOST_ROWS:
        return joined(found, F.broadcast(listed))
    holds = F.greatest(*[F.size(k) for k in KINDS]) > 0
    quiet = found.where(~holds).select(*own, F.array().cast(SPAN).alias("term"), none.alias("removed"))
    return quiet.unionAll(joined(found.where(holds), listed))


def sanitised(text: Column, removed: Column) -> Column:
    """The text with base spans and generalised terms replaced by labels, removed terms cut; of spans that overlap, the
    first one's label stands for all."""

    def labelled(spans: str, label: Callable[[Column], Column]) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))

    each = [labelled(k, lambda _, label=LABELS[k]: F.lit(label)) for k in KINDS]
    term = labelled("term", lambda s: F.when(F.array_contains(removed, F.lower(s["value"])), "").otherwise("[TERM]"))
    spans = F.array_sort(F.concat(*each, term))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), s["label"])).otherwise(a["out"])
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    end = lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, end)).otherwise(text)


def without_pii(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts (null stays null) and n_chars to match."""
    rows, names = plain(docs, ("doc_id", "text", "n_chars"))
    own = tuple(c for c in rows.columns if c != "text")
    out = scanned(rows, keep=(*own, "text"))
    clean = F.when(F.col("_text").isNotNull(), sanitised(F.col("text"), F.col("removed")))
    changed = out.withColumn("clean", clean).withColumn("differs", F.coalesce(F.col("clean") != F.col("_text"), F.lit(False)))
    n_chars = F.when(F.col("differs"), F.length("clean").cast("long")).otherwise(F.col("_n_chars")).alias("n_chars")
    return changed.select(*[{"text": F.col("clean").alias("text"), "n_chars": n_chars}.get(c, F.col(f"_{c}").alias(c)) for c in rows.columns]).toDF(*names)


def listing(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def op1(spark, sf_dir: str) -> DataFrame:
    out = scanned(documents(spark, sf_dir))
    base = F.concat(*[listing(k) for k in KINDS])
    return out.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, listing("term")), ",").alias("spans"), F.size("term").cast("long").alias("n_terms"),
    )


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sql(window: int = 6, generalise_at: float = 0.6, min_support: int = 3) -> str:
    """The query in DuckDB's SQL, for tables whose ids are unique."""
    places = "coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)"
    found = " UNION ALL ".join(f"SELECT doc_id, h, '{kind}' AS kind, {k} AS k, regexp_extract_all(x, '{re}') AS m, string_split_regex(x, '{re}') AS p FROM d" for k, (kind, re) in enumerate(PLAIN.items()))
    terms_of = lambda x: f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}]+'), lambda w: length(w) >= 3)"
    digit = "CAST(substr(dg, length(dg) - j + 1, 1) AS INT) * (1 + (j - 1) % 2)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, md5(coalesce(text, '')) AS h FROM documents),
f AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM ({found})),
s AS (SELECT doc_id, h, kind, k, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS dg, CAST({places} AS BIGINT) AS a, p[i] AS before, p[i+1] AS after FROM f),
base AS (SELECT *, a + length(v) AS b FROM s WHERE CASE kind WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda y: CAST(y AS DOUBLE))) <= 255
  WHEN 'card' THEN length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(generate_series(1, length(dg)), lambda j: {digit} - CASE WHEN {digit} > 9 THEN 9 ELSE 0 END)) % 10 = 0
  WHEN 'phone' THEN length(dg) BETWEEN 8 AND 15 ELSE true END),
e AS (SELECT doc_id, h, kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE dg END AS entity, list_concat({terms_of('before')}[-{window}:], {terms_of('after')}[1:{window}]) AS w FROM base),
near AS (SELECT DISTINCT doc_id, h, entity, term FROM (SELECT doc_id, h, entity, unnest(w) AS term FROM e)),
n_e AS (SELECT entity, count(DISTINCT doc_id) AS n FROM e GROUP BY 1),
joint AS (SELECT entity, term, count(*) AS n FROM near GROUP BY 1, 2 HAVING count(DISTINCT h) >= {min_support}),
n_t AS (SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({terms_of('x')})) AS term FROM d) GROUP BY 1),
told AS (SELECT j.entity, j.term FROM joint j JOIN n_e ON n_e.entity = j.entity JOIN n_t ON n_t.term = j.term, (SELECT count(*) AS n FROM d) c
  WHERE log2(j.n * CAST(c.n AS DOUBLE) / (n_e.n * n_t.n)) / nullif(log2(CAST(c.n AS DOUBLE) / n_e.n), 0) >= {generalise_at}),
listed AS (SELECT DISTINCT near.doc_id, near.term FROM near JOIN told ON told.entity = near.entity AND told.term = near.term),
r AS (SELECT doc_id, m, p, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(x, '\\p{{L}}+') AS m, string_split_regex(x, '\\p{{L}}+') AS p FROM d WHERE doc_id IN (SELECT doc_id FROM listed))),
runs AS (SELECT r.doc_id, CAST({places} AS BIGINT) AS a, m[i] AS v FROM r),
term AS (SELECT runs.doc_id, a, a + length(v) AS b FROM runs JOIN listed ON listed.doc_id = runs.doc_id AND listed.term = lower(v)
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = runs.doc_id AND base.a < runs.a + length(runs.v) AND runs.a < base.b)),
bs AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, count(*) FILTER (WHERE k = 3) AS n3,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS s FROM base GROUP BY 1),
ts AS (SELECT doc_id, count(*) AS n, string_agg('term:' || a || ':' || b, ',' ORDER BY a) AS s FROM term GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(bs.s, '')) AS base_sha256,
concat_ws(',', bs.s, ts.s) AS spans, coalesce(ts.n, 0) AS n_terms FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN ts ON ts.doc_id = d.doc_id"""
