"""Chat formatting: multi-party perspective rotation (DataFrame functions only).

For every participant (a speaker other than ``system``) the dialogue is rendered
with that speaker as the assistant, every other speaker as a named user, and
character spans of what the assistant says (the loss mask).  A long conversation
is rendered in chunks of ``TURNS`` turn numbers, so no task ever holds a whole
conversation; chunks in order concatenate to the whole rendering.

Template, one segment per turn::

    <|im_start|>assistant\\n{text}<|im_end|>\\n            the participant, masked in
    <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n   any other speaker
    <|im_start|>system\\n{text}<|im_end|>\\n               system turns

Spans cover the participant's text with its end marker, as ``start-end`` (end
exclusive, code points in the chunk) joined by commas.

Defined cases: a null speaker is the speaker ``unknown``; a null text is empty;
a null turn belongs to chunk -1; equal turns are ordered by speaker then text;
repeated rows are rendered again; null conversation ids form one conversation; a
conversation of system turns alone has no participant and gives no row.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role",
                 text: str = "text", chunk_turns: int = TURNS) -> DataFrame:
    """(conv, chunk, perspective, n_turns, n_own, rendered, mask_spans)."""
    rows = turns.select(
        turns[conv].alias("c"), turns[turn].alias("t"),
        F.coalesce(turns[speaker], F.lit("unknown")).alias("s"), F.coalesce(turns[text], F.lit("")).alias("x"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("t") / chunk_turns), F.lit(-1)).cast("long"))
    chunks = rows.groupBy("c", "chunk").agg(F.sort_array(F.collect_list(F.struct("t", "s", "x"))).alias("seq"))
    speakers = rows.where("s <> 'system'").select(F.col("c").alias("pc"), F.col("s").alias("perspective")).distinct()
    both = chunks.join(speakers, chunks["c"].eqNullSafe(speakers["pc"]))

    who = F.col("perspective")

    def head(m):
        return (F.when(m["s"] == who, F.lit(f"{OPEN}assistant\n"))
                .when(m["s"] == "system", F.lit(f"{OPEN}system\n"))
                .otherwise(F.concat(F.lit(f"{OPEN}user name="), m["s"], F.lit("\n"))))

    tail = F.lit(f"{CLOSE}\n")
    both = both.withColumn("segs", F.transform("seq", lambda m: F.struct(
        (m["s"] == who).alias("own"), F.length(head(m)).alias("h"),
        (F.length(m["x"]) + F.length(F.lit(CLOSE))).alias("b"),
        F.concat(head(m), m["x"], tail).alias("seg"))))
    # one pass keeps the offset and the spans so far
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    masked = F.aggregate("segs", start, lambda acc, g: F.struct(
        (acc["at"] + g["h"] + g["b"] + 1).alias("at"),
        F.when(g["own"], F.array_append(acc["spans"], F.concat_ws(
            "-", (acc["at"] + g["h"]).cast("string"), (acc["at"] + g["h"] + g["b"]).cast("string"))))
        .otherwise(acc["spans"]).alias("spans")))
    return both.select(
        F.col("c").alias(conv), "chunk", "perspective",
        F.size("segs").cast("long").alias("n_turns"),
        F.size(F.filter("segs", lambda g: g["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("segs", lambda g: g["seg"]), "").alias("rendered"),
        F.array_join(masked["spans"], ",").alias("mask_spans"))


ORACLE = f"""
WITH r AS (SELECT conv_id AS c, turn AS t, coalesce(role, 'unknown') AS s, coalesce(text, '') AS x,
                  coalesce(CAST(floor(turn / {TURNS}.0) AS BIGINT), -1) AS chunk FROM conversations),
p AS (SELECT DISTINCT c, s AS who FROM r WHERE s <> 'system'),
g AS (SELECT r.c, r.chunk, p.who, t, s, x, s = p.who AS own,
             CASE WHEN s = p.who THEN '{OPEN}assistant' WHEN s = 'system' THEN '{OPEN}system'
                  ELSE '{OPEN}user name=' || s END || chr(10) AS head
      FROM r JOIN p ON r.c IS NOT DISTINCT FROM p.c),
n AS (SELECT *, row_number() OVER (PARTITION BY c, chunk, who ORDER BY t NULLS FIRST, s, x) AS i FROM g),
o AS (SELECT *, coalesce(sum(length(head) + length(x) + {len(CLOSE) + 1}) OVER (
                PARTITION BY c, chunk, who ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + length(head) AS a FROM n)
SELECT c AS conv_id, chunk, who AS perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       string_agg(head || x || '{CLOSE}' || chr(10), '' ORDER BY i) AS rendered,
       coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(x) + {len(CLOSE)} AS BIGINT) AS VARCHAR),
                           ',' ORDER BY i) FILTER (WHERE own), '') AS mask_spans
FROM o GROUP BY c, chunk, who"""
