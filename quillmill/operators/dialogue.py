"""Subtitles and scripts of dialogues (key, turn, speaker, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import clock

HOST, GUEST = "【主持人】", "【讲解人】"


def speaker_label(speaker):
    return F.when(F.startswith(F.upper(F.coalesce(F.when(speaker != "", speaker), F.lit("A"))), F.lit("A")), HOST).otherwise(GUEST)


def timeline(turns: DataFrame) -> DataFrame:
    """(key, turn, number, start, stop, text): a cue lasts by its characters, a gap follows; blank turns keep their number."""
    order = Window.partitionBy("key").orderBy("turn")
    cues = turns.withColumns({"text": F.trim("text"), "number": F.row_number().over(order)}).filter("text <> ''")
    cues = cues.withColumn("span", F.greatest(F.lit(V.SHORTEST_CUE), F.least(F.lit(V.LONGEST_CUE), F.length("text") / V.CHARS_PER_SECOND)))
    stop = F.sum(F.col("span") + V.CUE_GAP).over(order.rowsBetween(Window.unboundedPreceding, 0)) - V.CUE_GAP
    return cues.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("span"))


def srt_blocks(turns: DataFrame) -> DataFrame:
    cues = timeline(turns)
    block = F.concat(F.col("number"), F.lit("\n"), clock(F.col("start")), F.lit(" --> "), clock(F.col("stop")), F.lit("\n"), speaker_label(F.col("speaker")), F.col("text"), F.lit("\n"))
    return cues.select("key", "turn", block.alias("block"))


def srt_files(turns: DataFrame) -> DataFrame:
    """(key, srt, seconds): the whole subtitle text; the length includes the last gap."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n")
    length = timeline(turns).groupBy("key").agg((F.max("stop") + V.CUE_GAP).alias("seconds"))
    return srt_blocks(turns).groupBy("key").agg(joined.alias("srt")).join(length, "key")


def scripts(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("**"), speaker_label(F.col("speaker")), F.lit("** "), F.trim("text"), F.lit("\n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return turns.groupBy("key").agg(F.array_join(listed, "\n").alias("script"))


def parse_script(lines: DataFrame) -> DataFrame:
    """Script lines (key, line_no, line) back to (key, line_no, speaker, text); a label may stand in bold."""
    label = F.regexp_extract(F.trim("line"), r"^(?:\*\*(【主持人】|【讲解人】)\*\*|(【主持人】|【讲解人】))", 0)
    found = lines.withColumn("label", label).filter("label <> ''")
    text = F.trim(F.substr(F.trim("line"), F.length("label") + 1))
    return found.select("key", "line_no", F.when(F.contains("label", F.lit(HOST)), "A").otherwise("B").alias("speaker"), text.alias("text"))
