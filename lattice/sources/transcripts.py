"""Subtitle files, chapter marks and the chunks of a video's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions.strings import clock_seconds
from lattice.operators.text import CHUNK_MOST, split_column

# The line of a cue, the length below which a cue is a snapshot, the share of snapshots below which all cues count, and limits of texts.
CUE = r"^(\d{2}:\d{2}:\d{2}\.\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}\.\d{3})"
SNAPSHOT, SNAPSHOT_SHARE = 0.05, 0.1
TRANSCRIPT_LEAST, DESCRIPTION_LEAST, DESCRIPTION_MOST, OPEN_END = 200, 50, 1500, 99999
_HEADERS = ("WEBVTT", "Kind:", "Language:")
_TAG = r"<[^>]+>"


def vtt_text(files: DataFrame, key: str = "video_id", vtt: str = "vtt") -> DataFrame:
    """key and text: the lines of all cues, without tags, each only where it first occurs."""
    lines = files.select(key, F.posexplode(F.split(vtt, r"\r?\n")).alias("no", "line")).withColumn("line", F.trim("line"))
    head = F.lit(False)
    for h in _HEADERS:
        head = head | F.startswith("line", F.lit(h))
    own = lines.where((F.col("line") != "") & ~head & ~F.contains("line", F.lit("-->"))).withColumn("line", F.trim(F.regexp_replace("line", _TAG, ""))).where(F.col("line") != "")
    first = own.groupBy(key, "line").agg(F.min("no").alias("no"))
    out = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ").alias("text"))
    return files.select(key).join(out, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def segments(files: DataFrame, key: str = "video_id", vtt: str = "vtt") -> DataFrame:
    """key, position, start (to a tenth) and text of the timed cues.

    Rolling captions repeat each line; their snapshot cues, of hardly any length, hold it once.
    Where a file has none, or under a tenth of its cues, all cues count. A cue that repeats the text before is dropped.
    """
    blocks = files.select(key, F.posexplode(F.split(F.replace(vtt, F.lit("\r\n"), F.lit("\n")), "\n\n")).alias("no", "block"))
    lines = F.transform(F.split(F.trim("block"), "\n"), lambda x: F.trim(x))
    at = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(CUE))), True).cast("int")
    cue = blocks.select(key, "no", lines.alias("l"), at.alias("at")).where(F.col("at") > 0)
    head = F.element_at("l", F.col("at"))
    body = F.filter(F.slice("l", F.col("at") + 1, F.greatest(F.size("l") - F.col("at"), F.lit(0))), lambda x: x != "")
    text = F.array_join(F.transform(body, lambda x: F.trim(F.regexp_replace(x, _TAG, ""))), " ")
    cue = cue.select(key, "no", clock_seconds(F.regexp_extract(head, CUE, 1)).alias("b"), clock_seconds(F.regexp_extract(head, CUE, 2)).alias("e"), text.alias("text"))
    cue = cue.withColumn("snap", (F.col("e") - F.col("b")) < SNAPSHOT).withColumn("one", F.lit(1))
    counted = _unrepeated(cue.where("snap"), key).groupBy(key).agg(F.count("*").alias("kept"))
    total = cue.groupBy(key).agg(F.count("*").alias("total"))
    use = total.join(counted, key, "left").select(key, (F.coalesce("kept", F.lit(0)) >= F.greatest(F.lit(1e-9), F.col("total") * SNAPSHOT_SHARE)).alias("snaps"))
    own = cue.join(use, key).where(~F.col("snaps") | F.col("snap"))
    w = Window.partitionBy(key).orderBy("no")
    return _unrepeated(own, key).select(key, (F.row_number().over(w) - 1).alias("position"), F.round("b", 1).alias("start"), "text")


def _unrepeated(cues: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("no")
    own = cues.where(F.col("text") != "").withColumn("prev", F.lag("text").over(w))
    return own.where(F.col("prev").isNull() | (F.col("prev") != F.col("text"))).drop("prev")


def chapters(videos: DataFrame, key: str = "video_id", description: str = "description") -> DataFrame:
    """key, position, title, start_time and start_seconds of the marks in a description; fewer than two are none."""
    pattern = r"(?m)^[^\S\n]*(\d{1,2}:\d{2}(?::\d{2})?)[^\S\n]+(.+)$"
    part = lambda k: F.regexp_extract_all(description, F.lit(pattern), k)
    both = videos.select(key, F.arrays_zip(part(1).alias("t"), part(2).alias("n")).alias("m")).where(F.size("m") >= 2)
    out = both.select(key, F.posexplode("m").alias("position", "x"))
    return out.select(key, "position", F.trim("x.n").alias("title"), F.col("x.t").alias("start_time"), clock_seconds(F.col("x.t")).cast("bigint").alias("start_seconds"))


def chapter_chunks(segs: DataFrame, marks: DataFrame, videos: DataFrame, key: str = "video_id", duration: str = "duration_seconds") -> DataFrame:
    """key, chunk_index, text, chapter, start_time, start_seconds: the segments of each chapter joined and cut to size.

    A segment belongs to the chapter that starts at it or last before it, and to none before the
    first; a video without chapters is one. A cut chunk starts with the segment that holds its first character.
    """
    nxt = Window.partitionBy(key).orderBy("start_seconds", "position")
    bounds = marks.join(videos.select(key, duration), key).select(
        key, F.col("position").alias("ch"), "title", "start_time", F.col("start_seconds").cast("double").alias("lo"), F.coalesce(F.lead("start_seconds").over(nxt).cast("double"), F.when(F.col(duration) > 0, F.col(duration).cast("double")), F.lit(float(OPEN_END))).alias("hi")
    )
    none = videos.join(marks.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("ch"), F.lit("").alias("title"), F.lit("0:00").alias("start_time"), F.lit(0.0).alias("lo"), F.coalesce(F.when(F.col(duration) > 0, F.col(duration).cast("double")), F.lit(float(OPEN_END))).alias("hi"))
    b = bounds.unionByName(none)
    own = segs.join(b, key).where((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    w = Window.partitionBy(key, "ch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("begin", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    merged = placed.groupBy(key, "ch", "title", "start_time").agg(F.array_sort(F.collect_list(F.struct("position", "begin", "start", "text"))).alias("s"))
    merged = merged.withColumn("whole", F.array_join(F.transform("s", lambda x: x["text"]), " "))
    parts = F.when(F.length("whole") <= CHUNK_MOST, F.array("whole")).otherwise(split_column(F.col("whole")))
    cut = merged.select(key, "ch", "title", "start_time", "s", F.posexplode(parts).alias("k", "text")).where(F.trim("text") != "").withColumn("text", F.trim("text"))
    before = Window.partitionBy(key, "ch").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("pos", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    holder = F.filter("s", lambda x: x["begin"] + F.length(x["text"]) + 1 > F.col("pos"))
    cut = cut.withColumn("start_seconds", F.coalesce(F.get(holder, F.lit(0))["start"], F.get("s", F.lit(0))["start"]))
    order = Window.partitionBy(key).orderBy("ch", "k")
    return cut.select(key, (F.row_number().over(order) - 1).cast("bigint").alias("chunk_index"), "text", F.col("title").alias("chapter"), "start_time", "start_seconds")


def proportional_chunks(transcripts: DataFrame, marks: DataFrame, videos: DataFrame, key: str = "video_id", duration: str = "duration_seconds") -> DataFrame:
    """The same without times: each chapter has the characters that its share of the time is of the text's."""
    t = transcripts.join(videos.select(key, duration), key).where((F.col(duration) > 0) & (F.coalesce("text", F.lit("")) != ""))
    w = Window.partitionBy(key).orderBy("start_seconds", "position")
    m = marks.withColumn("hi", F.lead("start_seconds").over(w)).join(t, key)
    n = F.length("text")
    place = lambda c: F.least(F.greatest((c / F.col(duration) * n).cast("int"), F.lit(0)), n)
    m = m.withColumn("b", place(F.col("start_seconds"))).withColumn("e", F.greatest(F.when(F.col("hi").isNull(), n).otherwise(place(F.col("hi"))), F.col("b")))
    section = F.trim(F.substr("text", F.col("b") + 1, F.col("e") - F.col("b")))
    m = m.select(key, "position", "title", "start_time", "start_seconds", section.alias("section")).where(F.col("section") != "")
    parts = F.when(F.length("section") <= CHUNK_MOST, F.array("section")).otherwise(split_column(F.col("section")))
    cut = m.select(key, "position", "title", "start_time", "start_seconds", F.posexplode(parts).alias("k", "text")).where(F.trim("text") != "")
    order = Window.partitionBy(key).orderBy("position", "k")
    return cut.select(key, (F.row_number().over(order) - 1).cast("bigint").alias("chunk_index"), F.trim("text").alias("text"), F.col("title").alias("chapter"), "start_time", F.col("start_seconds").cast("double").alias("start_seconds"))


def plain_chunks(transcripts: DataFrame, key: str = "video_id") -> DataFrame:
    out = transcripts.select(key, F.posexplode(split_column(F.col("text"))).alias("i", "text"))
    return out.select(key, F.col("i").cast("bigint").alias("chunk_index"), "text", F.lit("").alias("chapter"), F.lit("").alias("start_time"), F.lit(0.0).alias("start_seconds"))


def video_chunks(videos: DataFrame, key: str = "video_id") -> DataFrame:
    """All chunks of videos (key, vtt, description, duration_seconds): by timed segments, else in proportion, else plain; then the description.

    Videos with a transcript under TRANSCRIPT_LEAST characters have none.
    """
    text = vtt_text(videos, key).where(F.length("text") >= TRANSCRIPT_LEAST)
    own = videos.join(text.select(key), key, "left_semi")
    marks = chapters(own, key)
    timed = chapter_chunks(segments(own, key).join(own.where(F.col("duration_seconds") > 0).select(key), key, "left_semi"), marks, own, key)
    rest = text.join(timed.select(key).distinct(), key, "left_anti")
    shared = proportional_chunks(rest, marks, own, key)
    plain = plain_chunks(rest.join(shared.select(key).distinct(), key, "left_anti"), key)
    chunks = timed.unionByName(shared).unionByName(plain).withColumn("chunk_type", F.lit("transcript"))
    count = chunks.groupBy(key).agg(F.count("*").alias("chunk_index"))
    extra = own.where(F.length("description") > DESCRIPTION_LEAST).join(count, key).select(key, "chunk_index", F.substring("description", 1, DESCRIPTION_MOST).alias("text"), F.lit("").alias("chapter"), F.lit("").alias("start_time"), F.lit(0.0).alias("start_seconds"), F.lit("description").alias("chunk_type"))
    return chunks.unionByName(extra)


def sections(files: DataFrame, text: str = "text") -> DataFrame:
    """title and section of prepared notes: parts between rules of at least 200 characters that have a heading ``## N. Title``."""
    parts = files.select(F.explode(F.split(text, "\n---\n")).alias("s")).select(F.trim("s").alias("section")).where(F.length("section") >= TRANSCRIPT_LEAST)
    title = F.trim(F.regexp_extract("section", r"(?m)^##\s*\d+\.\s*(.+)", 1))
    return parts.select(title.alias("title"), "section").where(F.col("title") != "")


def id_of(prefix: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(prefix + ":"), key).cast("binary"))
