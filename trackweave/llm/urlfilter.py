"""URL filter: a trie over reversed host labels and path segments, broadcast, longest match wins.

A rule is (verdict, host, path). It fits its host and all subdomains if the url's path starts with the rule's path as a
string. Of the rules that fit, the one with the longest host and path together wins; of equals, block wins, then the greater
text. Among the tails of a node those of each length are looked up at once, so flat lists of rules cost their lengths, not
their number. Rules may be a list or a table (verdict, host, path). The trie's size is checked before it is built: more than
`max_rules` rules, or `max_bytes` of their text, are joined instead, by host suffix and path prefix, with the same result. A rule
takes some 2.3 KB of a process in the trie, so the bounds keep it near 110 MB.

Nulls and edges: a null url or one without "://" has empty host and path and gets the default verdict. A null id stays; rows
that repeat are judged each; an empty table gives no rows and no rules give every url the default. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, table

MOST_RULES, MOST_RULE_BYTES = 50_000, 4 << 20
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
TO_LOWER = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((k for k, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(TO_LOWER), path[:stop]


class Trie:
    """Host labels from the right, then whole path segments, then what a rule's path leaves after its last slash."""

    def __init__(self, rules, max_rules: int = MOST_RULES):
        if len(rules) > max_rules:
            raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
        self.root: dict = {"labels": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(TO_LOWER).split(".")) if host else ():
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "tails": {}, "lengths": []}
            step = node["paths"]
            *whole, tail = path.split("/")
            for segment in whole:
                step = step["next"].setdefault(segment, {"next": {}, "tails": {}, "lengths": []})
            found = (len(host) + len(path), verdict == "block", host.translate(TO_LOWER) + path, verdict)
            step["tails"][tail] = max(step["tails"].get(tail, found), found)
            if len(tail) not in step["lengths"]:
                step["lengths"].append(len(tail))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        segments = path.split("/")
        node = self.root
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            step = node["paths"]
            for segment in segments if step else ():
                for n in step["lengths"]:
                    found = step["tails"].get(segment[:n]) if n <= len(segment) else None
                    if found is not None and (best is None or found > best):
                        best = found
                if (step := step["next"].get(segment)) is None:
                    break
            label = next(labels, None)
            node = node["labels"].get(label) if label is not None else None
        return (best[2], best[3]) if best else (None, None)


def split_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path) by the batch."""

    def run(batches):
        for batch in batches:
            out = [split_url(url) for url in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([x[k] for x in out], pa.string()) for k in range(2))], ["id", "host", "path"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, "id long, host string, path string")


def joined(pages: DataFrame, rules: DataFrame, default: str, id_col: str, url_col: str) -> DataFrame:
    """judged() for rules that are too many for a trie: different places (host, path) meet the rules on every host suffix and on
    the path prefixes whose lengths occur among the host's rules."""
    r = rules.select("verdict", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"))
    rank = F.struct((F.length("h") + F.length("p")).alias("n"), (F.col("verdict") == "block").alias("block"), F.concat("h", "p").alias("rule"), "verdict")
    r = r.groupBy("h", "p").agg(F.max(rank).alias("found"))
    lengths = r.select("h", F.length("p").alias("n")).distinct()
    urls = materialise(split_urls(pages, id_col, url_col), "urls")
    places = urls.select("host", "path").where("host <> '' or path <> ''").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = places.withColumn("h", F.explode(F.array_distinct(F.concat(ends, F.array(F.lit("")))))).join(lengths.hint("merge"), "h").where(F.length("path") >= F.col("n"))
    hit = tried.withColumn("p", F.substring("path", F.lit(1), F.col("n"))).join(r.hint("merge"), ["h", "p"]).groupBy("host", "path").agg(F.max("found").alias("found"))
    out = urls.join(hit.hint("merge"), ["host", "path"], "left")
    return out.select("id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def judged(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = MOST_RULES, max_bytes: int = MOST_RULE_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of pages."""
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        text = F.coalesce(F.octet_length("host"), F.lit(0)) + F.coalesce(F.octet_length("path"), F.lit(0))
        n, size = rules.agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).first()
        if n > max_rules or size > max_bytes:
            return joined(pages, rules, default, id_col, url_col)
        rules = [tuple(x or "" for x in r) for r in rules.select("verdict", "host", "path").collect()]
    elif len(rules) > max_rules or sum(len(h.encode()) + len(p.encode()) for _, h, p in rules) > max_bytes:
        return joined(pages, spark.createDataFrame(list(rules), "verdict string, host string, path string"), default, id_col, url_col)
    trie = spark.sparkContext.broadcast(Trie(list(rules), max_rules))

    def run(batches):
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = trie.value.match(host, path) if host or path else (None, None)
                out.append((host, path, rule, verdict or default))
            yield pa.record_batch([batch.column(0), *(pa.array([x[k] for x in out], pa.string()) for k in range(4))], ["id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string")


def op7(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
fits AS (SELECT p.page_id, arg_max(struct_pack(r := u.host || u.path, v := u.verdict), length(u.host || u.path)) AS best
         FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.best.r AS rule, coalesce(f.best.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""
