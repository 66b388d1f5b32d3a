"""Chat formatting of preference pairs.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt;
what follows on either side is a completion with a mask: the stretches of code points, [start, end),
that a model is trained on, which are the assistant's turns with their end mark. A conversation is one
record, as it is one training example; records are numbered over all and paired by number, without a window
over a key, so a first turn that very many share is dealt out like any other.

Defined cases: a null role is "unknown", a null text is empty; turns that are equal in `turn` are ordered by
role and text; a null conv_id is a conversation of its own; identical conversations share all turns and
have empty completions; repeated turn rows are turns; one that has no partner comes back with a null
rejected side and an empty prompt; an empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table

OPEN, HEAD, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(HEAD))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """start:end of every trained turn in the rendering of `turns`, comma-joined."""

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(t["role"] == TRAINED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, begin, step, lambda s: F.array_join(s["spans"], ","))


def records(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) of rows (conv_id, turn, role, text)."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """`pairs` (with `chosen` and `rejected`, arrays of struct<role, text>) with prompt, completions and masks."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    shared = F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.size("chosen")), F.lit(0)).cast("int")
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side), F.lit(0)))
    out = pairs.withColumn("n_prompt_turns", F.when(F.col("rejected").isNull(), 0).otherwise(shared))
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    return out.select(
        *kept,
        "n_prompt_turns",
        _render(F.slice("chosen", 1, F.col("n_prompt_turns"))).alias("prompt"),
        _render(rest("chosen")).alias("chosen"),
        _mask(rest("chosen")).alias("chosen_mask"),
        _render(rest("rejected")).alias("rejected"),
        _mask(rest("rejected")).alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations that begin with the same turn, two by two in the order of their rendered text.

    Within a first turn, those that share more turns lie side by side. The first of two is `chosen`, with the smaller
    conv_id where the texts are equal; the odd one of a first turn has no partner, and no conversation is paired
    with one that begins otherwise. `pair_id` is the chosen one's number in the order of all.
    """
    first = F.sha2(_render(F.slice("turns", 1, 1)), 256)
    keyed = conversations.withColumn("_first", first).withColumn("_key", _render(F.col("turns")))
    placed = numbered(keyed, ["_first", "_key", "conv_id"], "chat-pairs", drop=("_key",))
    starts = placed.groupBy("_first").agg(F.min("row_no").alias("_start"))  # a row for each first turn
    sided = placed.join(starts, "_first").withColumn("side", (F.col("row_no") - F.col("_start")) % 2)
    sided = sided.select((F.col("row_no") - F.col("side")).alias("pair_id"), "side", F.struct("conv_id", "turns").alias("c"))
    pairs = sided.groupBy("pair_id").agg(
        F.max_by(F.when(F.col("side") == 0, F.col("c")), F.when(F.col("side") == 0, 1)).alias("a"),
        F.max_by(F.when(F.col("side") == 1, F.col("c")), F.when(F.col("side") == 1, 1)).alias("b"),
    )
    return pairs.select(
        "pair_id", F.col("a.conv_id").alias("chosen_id"), F.col("b.conv_id").alias("rejected_id"), F.col("a.turns").alias("chosen"), F.col("b.turns").alias("rejected")
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(pair_neighbours(records(table(spark, sf_dir, "conversations"))))


_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head FROM conversations),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS part FROM t),
c AS (SELECT conv_id, string_agg(part, '' ORDER BY k) AS key, sha256(max(part) FILTER (k = 1)) AS first, count(*) AS n FROM r GROUP BY conv_id),
o AS (SELECT conv_id, first, n, row_number() OVER (ORDER BY first, key, conv_id NULLS FIRST) - 1 AS row_no,
        row_number() OVER (PARTITION BY first ORDER BY key, conv_id NULLS FIRST) - 1 AS place FROM c),
p AS (SELECT a.row_no AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.n AS n, b.row_no AS b_no
      FROM o AS a LEFT JOIN o AS b ON b.row_no = a.row_no + 1 AND b.first = a.first WHERE a.place % 2 = 0),
d AS (SELECT pair_id, min(coalesce(x.k, y.k)) AS k FROM
        (SELECT pair_id, r.k, r.part FROM p JOIN r ON r.conv_id = p.chosen_id WHERE b_no IS NOT NULL) AS x
        FULL JOIN (SELECT pair_id, r.k, r.part FROM p JOIN r ON r.conv_id = p.rejected_id) AS y USING (pair_id, k)
      WHERE x.part IS DISTINCT FROM y.part GROUP BY pair_id),
q AS (SELECT p.*, CASE WHEN b_no IS NULL THEN 0 ELSE coalesce(d.k - 1, n) END AS shared FROM p LEFT JOIN d USING (pair_id)),
s AS (SELECT q.pair_id, 'a' AS side, r.k, r.role, r.part, length(r.part) AS len, length(head) AS h, r.k > shared AS later FROM q JOIN r ON r.conv_id = q.chosen_id
      UNION ALL SELECT q.pair_id, 'b', r.k, r.role, r.part, length(r.part), length(head), r.k > shared FROM q JOIN r ON r.conv_id = q.rejected_id),
f AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s WHERE later),
g AS (SELECT pair_id, side, string_agg(part, '' ORDER BY k) AS text,
        coalesce(string_agg(CAST(CAST(pos + h AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + len AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (role = 'assistant'), '') AS mask FROM f GROUP BY pair_id, side),
m AS (SELECT pair_id, string_agg(part, '' ORDER BY k) AS prompt FROM s WHERE NOT later AND side = 'a' GROUP BY pair_id)
SELECT q.pair_id, chosen_id, rejected_id, CAST(shared AS INTEGER) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce(a.text, '') AS chosen, coalesce(a.mask, '') AS chosen_mask,
  CASE WHEN b_no IS NOT NULL THEN coalesce(b.text, '') END AS rejected, CASE WHEN b_no IS NOT NULL THEN coalesce(b.mask, '') END AS rejected_mask
FROM q LEFT JOIN m USING (pair_id) LEFT JOIN g AS a ON a.pair_id = q.pair_id AND a.side = 'a' LEFT JOIN g AS b ON b.pair_id = q.pair_id AND b.side = 'b'
"""

QUERIES = {"op6_chat_formatting": op6_chat_formatting}
ORACLE_SQL = {"op6_chat_formatting": _SQL}
