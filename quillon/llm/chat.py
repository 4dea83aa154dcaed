"""Chat formatting by cumulative-snapshot collapse, in DataFrame operations only.

Loggers often store a conversation again after every turn. The rolling hash of a
conversation's first k turns is computed by a window; a conversation whose whole hash is a
proper prefix of another one is anti-joined away, and the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import Ordered
from .common import written


def _turn_hash(k: Column, part: int) -> Column:
    """60 bits of the SHA-256 of a turn and its place, as a decimal that sums without overflow."""
    # the role's length tells where it ends, whatever stands in it
    text = F.concat_ws("\x00", k.cast("string"), F.octet_length(_tagged("role")).cast("string"), _tagged("role"), _tagged("text"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1 + 15 * part, 15), 16, 10).cast("decimal(38,0)")


def _tagged(name: str) -> Column:
    """Tells null from empty."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(name)))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, n (turns of the conversation), h1, h2: the hash of the first k turns.

    The hash sums the turns' hashes, each taken with its place; so a running sum is the
    rolling hash of the prefix. 120 bits tell different prefixes apart. A conversation with very many turns is scanned by ranges of them.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").isNull().alias("none"), "turn", "role", "text", _tagged("role").alias("r"), _tagged("text").alias("t"))
    placed = Ordered(rows, ["conv_id"], ["none", "turn", "r", "t"]).running("k", F.lit(1), "sum", inclusive=True).rows()
    hashed = written(placed.select("conv_id", "k", _turn_hash(F.col("k"), 0).alias("t1"), _turn_hash(F.col("k"), 1).alias("t2")), "turn-hashes")
    sums = Ordered(hashed, ["conv_id"], ["k"]).running("h1", "t1", "sum", inclusive=True).running("h2", "t2", "sum", inclusive=True)
    return sums.running("next", "k", "last", reverse=True).rows().select("conv_id", "k", F.col("next").isNull().alias("last"), "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one starts with.

    Of equal conversations the one with the smallest conv_id stays; n_copies counts them.
    Prefixes are made distinct before they meet, so a first turn that many conversations
    share is one row.
    """
    p = written(prefixes(turns), "turn-prefixes")
    whole = p.where("last").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = p.where("not last").select("k", "h1", "h2").distinct()
    return whole.join(proper, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen conversations as one string each: ``<|role|>`` line, text line, for each turn."""
    one = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    kept = turns.select("conv_id", "turn", "role", "text").join(chosen.select("conv_id"), "conv_id", "left_semi")
    rows = kept.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("z"), "turn", _tagged("role").alias("r"), _tagged("text").alias("x"), one.alias("s")))).alias("a")
    )
    return rows.select("conv_id", F.array_join(F.transform("a", lambda t: t["s"]), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies, rendered.

    Turns are in the order of turn (null last), then role and text; repeated rows are turns
    of their own. Rows with a null conv_id belong to no conversation. A null role or text
    renders as empty but is not equal to an empty one.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    chosen = written(maximal(turns), "maximal")
    return chosen.join(render(turns, chosen), "conv_id")
