"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

Every participant of a dialogue becomes the assistant of one view of it: that speaker's turns
are assistant turns and are learned from, the others' are turns of users that carry their
names and are masked. A view is given turn by turn, in rows with the turn's place, its
rendering and its mask, so that no dialogue, however long, is gathered into one row or task;
the renderings of a view, in the order of ``turn`` and ``part``, joined by nothing, are its
dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks around a turn's header and at its end, as in common chat templates.
START, END = "<|im_start|>", "<|im_end|>"


def rotated(turns: DataFrame) -> DataFrame:
    """Views of every dialogue of ``turns`` (conv_id, turn, role, text); role names the speaker.

    Gives, for each participant of a dialogue and each of its turns: conv_id, speaker (whose
    view it is), turn, part, role (``assistant`` or ``user``), name (of the user, null for
    the assistant), rendered, mask_start and mask_end. The mask is the half-open range of
    code points of ``rendered`` that is learned from: text and end mark of the assistant's
    turns, empty for users.

    A null role is a speaker named ``unknown``; role names are compared as they are, after
    white space around them is cut. A null text counts as empty. Turns of equal number (also
    null ones, which come first) keep the order of their speaker and text, and rows that
    repeat each other in full stay that many: ``part`` tells turns of one number apart where
    speaker or text differ, and ``copies`` counts repeated rows, which are rendered once for
    each copy. Rows without a conv_id belong to no dialogue and give no view. Other columns
    are not read.
    """
    name = F.when(F.trim("role") == "", "unknown").otherwise(F.coalesce(F.trim("role"), F.lit("unknown")))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("_by"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    )
    rows = rows.groupBy("conv_id", "turn", "_by", "_text").agg(F.count("*").alias("copies"))
    speakers = rows.select("conv_id", F.col("_by").alias("speaker")).distinct()
    views = rows.join(speakers, "conv_id")
    own = F.col("_by") == F.col("speaker")
    role = F.when(own, "assistant").otherwise("user")
    header = F.when(own, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), "_by", F.lit("\n")))
    body = F.concat("_text", F.lit(f"{END}\n"))
    begin = F.length(header)
    learned = F.when(own, F.length("_text") + len(END)).otherwise(0)
    return views.select(
        "conv_id",
        "speaker",
        "turn",
        F.concat("_by", F.lit(":"), F.md5("_text")).alias("part"),
        "copies",
        role.alias("role"),
        F.when(~own, F.col("_by")).alias("name"),
        F.concat(header, body).alias("rendered"),
        begin.alias("mask_start"),
        (begin + learned).alias("mask_end"),
    )


#: The same views in DuckDB.
ROTATED_SQL = """
WITH rows AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS by_name,
         coalesce(text, '') AS body, count(*) AS copies
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
speakers AS (SELECT DISTINCT conv_id, by_name AS speaker FROM rows),
views AS (
  SELECT r.*, s.speaker, r.by_name = s.speaker AS own,
         CASE WHEN r.by_name = s.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || r.by_name || chr(10) END AS header
  FROM rows r JOIN speakers s USING (conv_id))
SELECT conv_id, speaker, turn, by_name || ':' || md5(body) AS part, copies,
       CASE WHEN own THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN own THEN NULL ELSE by_name END AS name,
       header || body || '<|im_end|>' || chr(10) AS rendered,
       CAST(length(header) AS INTEGER) AS mask_start,
       CAST(length(header) + CASE WHEN own THEN length(body) + 10 ELSE 0 END AS INTEGER) AS mask_end
FROM views
"""
