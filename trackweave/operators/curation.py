"""The curation language: text -> lines -> intervals -> edited tracks.

A block starts with `ID <main>`; lines `<tp>: <id> [Appear|Reappear]`, `<tp>: nan`, `<tp>: Disappear` and
`<tp>: Disappear in <id>` say, back in time, which raw track holds from that frame down. Blank lines are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(texts: DataFrame) -> DataFrame:
    """(cell_id, text) with whole texts -> (cell_id, line_no, text), blank lines left out."""
    out = texts.select("cell_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("text", F.trim("text"))
    return out.where("text <> ''")


def parse(texts: DataFrame) -> DataFrame:
    """(cell_id, line_no, main, tp, kind, target): main is the block's id; kind is start, id, none or merge."""
    words = F.split("text", r"\s+")
    second = F.get(words, F.lit(1))
    head = F.get(words, F.lit(0)) == "ID"
    rows = lines(texts).withColumn("main", F.when(head, second.try_cast("long")))
    rows = rows.withColumn("main", F.last("main", ignorenulls=True).over(Window.partitionBy("cell_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when(head, "start").when(second.rlike(r"^[0-9]+$"), "id").when((second == "Disappear") & (F.size(words) > 2), "merge").when(second.isin("Disappear", "nan"), "none").otherwise("same")
    target = F.when(second.rlike(r"^[0-9]+$"), second.try_cast("long")).when((second == "Disappear") & (F.size(words) > 2), F.element_at(words, -1).try_cast("long"))
    tp = F.when(~head, F.regexp_extract("text", r"^(\d+)\s*:", 1).try_cast("int"))
    return rows.select("cell_id", "line_no", "main", tp.alias("tp"), kind.alias("kind"), target.alias("target"))


def intervals(parsed: DataFrame, top_tp: int) -> DataFrame:
    """(cell_id, main, t_lo, t_hi, raw_id, merge_id): the ids that hold on t_lo < t <= t_hi. Frames must descend within a
    block; a block in which they do not raises. Empty intervals are left out, a line of unknown kind keeps the state."""
    w = Window.partitionBy("cell_id", "main").orderBy("line_no")
    rows = parsed.withColumn("t_hi", F.when(F.col("kind") == "start", top_tp).otherwise(F.col("tp")))
    rows = rows.withColumn("t_lo", F.lead("t_hi", 1, -1).over(w))
    rows = rows.withColumn("t_lo", F.when(F.col("t_lo") > F.col("t_hi"), F.raise_error(F.concat(F.lit("frames ascend in block "), F.col("main").cast("string")))).otherwise(F.col("t_lo")))
    state = F.when(F.col("kind") == "start", F.struct(F.col("main").alias("raw"), F.col("main").alias("merge"))).when(F.col("kind") != "same", F.struct(F.when(F.col("kind") == "id", F.col("target")).alias("raw"), F.when(F.col("kind") != "none", F.col("target")).alias("merge")))
    held = F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_s", held)
    return rows.where("t_lo < t_hi").select("cell_id", "main", "t_lo", "t_hi", F.col("_s.raw").alias("raw_id"), F.col("_s.merge").alias("merge_id"))


def numbered(edits: DataFrame, mains: list[int]) -> DataFrame:
    """Adds track_id: the place of the block's id in the caller's list, from 1; an unknown id raises."""
    place = F.array_position(F.array(*[F.lit(m).cast("long") for m in mains]), F.col("main"))
    unknown = F.raise_error(F.concat(F.lit("block id not in the list: "), F.col("main").cast("string"))).cast("long")
    return edits.withColumn("track_id", F.when(place > 0, place).otherwise(unknown))


def apply(edits: DataFrame, points: DataFrame, merged: bool = False) -> DataFrame:
    """(id, t, z, y, x) of the curated tracks; with merged=True tracks that disappear in another follow it. The edits are
    hand-made and few: Spark broadcasts them if they are below its limit and shuffles by raw id otherwise."""
    e = edits.select("track_id", "t_lo", "t_hi", F.col("merge_id" if merged else "raw_id").alias("_raw"))
    on = (points["id"] == e["_raw"]) & (points["t"] > e["t_lo"]) & (points["t"] <= e["t_hi"])
    return points.join(e, on).select(F.col("track_id").alias("id"), points["t"], "z", "y", "x")


def nucleus_text(texts: DataFrame) -> DataFrame:
    """The older format: lines `T: <n>` open a frame, `<spot>: <nucleus>` follow -> (cell_id, t, id, nuc_id)."""
    key, value = F.trim(F.split("text", ":").getItem(0)), F.trim(F.split("text", ":").getItem(1))
    rows = lines(texts).withColumns({"_k": key, "_v": value})
    t = F.last(F.when(F.col("_k") == "T", F.col("_v").try_cast("int")), ignorenulls=True).over(Window.partitionBy("cell_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("t", t).where("_k <> 'T'").select("cell_id", "t", F.col("_k").try_cast("long").alias("id"), F.col("_v").try_cast("long").alias("nuc_id"))


def nucleus_lines(rows: DataFrame) -> DataFrame:
    """Rows (cell_id, t, id, nuc_id) -> (cell_id, text) in that format; a missing nucleus is written as nan."""
    pair = F.concat_ws(": ", F.col("id").cast("string"), F.coalesce(F.col("nuc_id").cast("string"), F.lit("nan")))
    frame = rows.groupBy("cell_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", pair.alias("line")))), lambda s: s["line"]).alias("lines"))
    block = F.concat(F.lit("T: "), F.col("t").cast("string"), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    cells = frame.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("t", block.alias("block")))).alias("blocks"))
    return cells.select("cell_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("text"))
