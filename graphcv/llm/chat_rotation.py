"""Multi-party perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns that a rendering is learnt from, and turns before them that it repeats as context, if a dialogue is longer.
WINDOW, CONTEXT = 512, 64


def _places(turns: DataFrame, span: int = 4096) -> DataFrame:
    """Distinct turns (conv_id, turn, role, said, copies) with `before`, how many turns of the dialogue stand before each.

    Exact without one large sort: turns are counted by ranges of `span` turn numbers, in a range by turn and tie (4096
    values at most), and only turns with one number and tie are ranked one by one.
    """
    known = F.col("turn").isNotNull().cast("int")  # no number stands first
    own = turns.select("*", known.alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("number")).withColumn("range", F.floor(F.col("number") / span).cast("long"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w, column: F.coalesce(F.sum(column).over(w), F.lit(0))
    ranges = own.groupBy("conv_id", "known", "range").agg(F.sum("copies").alias("n"))
    ranges = ranges.select("conv_id", "known", "range", before(upto("conv_id").orderBy("known", "range"), "n").alias("a"))
    ties = own.groupBy("conv_id", "known", "range", "number", "tie").agg(F.sum("copies").alias("n"))
    ties = ties.select("conv_id", "known", "number", "tie", before(upto("conv_id", "known", "range").orderBy("number", "tie"), "n").alias("b"))
    ranked = own.withColumn("c", before(upto("conv_id", "known", "number", "tie").orderBy("role", "said"), "copies"))
    met = ranked.join(ranges, ["conv_id", "known", "range"]).join(ties, ["conv_id", "known", "number", "tie"])
    return met.select("conv_id", "turn", "role", "said", "copies", (F.col("a") + F.col("b") + F.col("c")).alias("before"))


def _name(role: Column) -> Column:
    """A role as it is written into a mark: it can neither end the mark nor the line."""
    clean = F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.translate(clean, "\n\r", "  ")


def rotate_dialogues(conversations: DataFrame, window: int = WINDOW, context: int = CONTEXT) -> DataFrame:
    """For every speaker of every dialogue, the dialogue with that speaker as assistant and the others as named users.

    Input: conv_id, turn, role, text. Returns conv_id, part, speaker, n_turns, n_own (turns of the speaker), rendered, mask:
    the half-open code-point ranges of `rendered` to learn from (the speaker's texts with their end marks), as "from-to"
    joined by commas.

    A system turn stays a system turn in every rendering and is no speaker. A dialogue of up to `window` turns is
    rendered whole (part 0). Longer ones are cut into parts of as many turns, and each later part begins with the
    `context` turns before it, which are rendered but neither counted nor masked: every turn is learnt from once, and no
    group holds more than window + context turns. A part has a row for each speaker of its own turns.

    Turns stand in order of turn (nulls first), the first three digits of md5(role, line feed, text), role, text, so ties
    and repeated rows have a fixed place. A null role is "unknown", a null text empty; each row without conv_id is a
    dialogue of its own, equal rows included. "<|" in texts and roles becomes "< |", "|>" in roles "| >", and line breaks
    in roles become spaces, so neither can imitate marks. Empty tables give empty results; extra columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    tie = F.substring(F.md5(F.concat("role", F.lit("\n"), "said").cast("binary")), 1, 3)
    counted = turns.withColumn("tie", tie).groupBy("conv_id", "turn", "tie", "role", "said").agg(F.count("*").alias("copies"))
    placed = _places(counted.where("conv_id is not null"))
    each = placed.select("conv_id", "turn", "role", "said", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("place"), F.lit(0).cast("long").alias("alone"))
    part = F.floor(F.col("place") / window).cast("long")
    into = F.when((F.col("place") % window >= window - context) & F.lit(context > 0), F.array(part, part + 1)).otherwise(F.array(part))
    each = each.select("conv_id", "alone", "place", "role", "said", part.alias("home"), F.explode(into).alias("part"))
    alone = counted.where("conv_id is null").select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "turn", "role", "said")
    alone = alone.select("conv_id", F.xxhash64("turn", "role", "said", "copy").alias("alone"), F.lit(0).cast("long").alias("place"), "role", "said", F.lit(0).cast("long").alias("home"), F.lit(0).cast("long").alias("part"))
    joined = each.unionByName(alone).groupBy("conv_id", "alone", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "said", (F.col("home") == F.col("part")).alias("mine")))).alias("turns"))
    mine = F.filter("turns", lambda t: t["mine"])
    rotated = joined.withColumn("speaker", F.explode(F.array_except(F.array_distinct(F.transform(mine, lambda t: t["role"])), F.array(F.lit("system")))))
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).when(t["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _name(t["role"]), F.lit("|>\n")))
    said = rotated.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit("<|end|>\n")).alias("body"), (own(t) & t["mine"]).alias("own"))))
    state = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.array_append(s["spans"], F.concat((s["at"] + F.length(p["head"])).cast("string"), F.lit("-"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string")))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return said.select(
        "conv_id",
        "part",
        "speaker",
        F.size(F.filter("turns", lambda t: t["mine"])).cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(state["spans"], ",").alias("mask"),
    )


ORACLE = """
WITH u AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS said, row_number() OVER () AS r FROM conversations),
o AS (SELECT *, CASE WHEN conv_id IS NULL THEN r ELSE 0 END AS alone, row_number() OVER (
        PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN r ELSE 0 END
        ORDER BY turn NULLS FIRST, substr(md5(role || chr(10) || said), 1, 3), role, said) - 1 AS place FROM u),
t AS (SELECT conv_id, alone, place, role, said, place // 512 AS part, TRUE AS mine FROM o
      UNION ALL SELECT conv_id, alone, place, role, said, place // 512 + 1, FALSE FROM o WHERE place % 512 >= 448),
s AS (SELECT DISTINCT conv_id, alone, part, role AS speaker FROM t WHERE role <> 'system' AND mine),
r AS (
  SELECT t.*, s.speaker, t.role = s.speaker AND mine AS own,
         CASE WHEN t.role = s.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || translate(replace(replace(t.role, '<|', '< |'), '|>', '| >'), chr(10) || chr(13), '  ') || '|>' END || chr(10) AS head,
         t.said || '<|end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.alone = s.alone AND t.part = s.part),
c AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, alone, part, speaker ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT conv_id, part::BIGINT AS part, speaker, (count(*) FILTER (WHERE mine))::BIGINT AS n_turns, (count(*) FILTER (WHERE own))::BIGINT AS n_own,
       string_agg(head || body, '' ORDER BY place) AS rendered,
       string_agg((upto - length(body))::BIGINT::VARCHAR || '-' || upto::BIGINT::VARCHAR, ',' ORDER BY upto) FILTER (WHERE own) AS mask
FROM c GROUP BY conv_id, alone, part, speaker
"""
