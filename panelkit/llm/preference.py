"""Preference formatting (operator 9): a shared prompt and two masked completions.

Conversations 2k and 2k + 1 are a pair, the even one chosen. The longest common
prefix of their turns is rendered once, as the prompt; what is left of each is its
completion. A completion is a list of segments, and only what the assistant says
(its text and the end mark after it) is to be trained on.

Texts cannot forge a turn: ``<|`` in a text becomes ``<||``, which opens no mark, since
no role begins with a bar; the signs of marks and line breaks in a role become underscores.

Defined results: turns are ordered by number, then role, then text, and repeated
turns stay; a NULL role reads unknown, a NULL text is empty; a conversation whose
partner is missing has a NULL completion on the other side and an empty prompt;
equal conversations share all turns and have empty completions; rows without a
conversation id belong to none and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED = "assistant"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def harmless(text: Column) -> Column:
    """A text without marks; replacing ``<||`` by ``<|`` gives the text back."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def role_name(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[<|>\r\n]", "_")


def pairs(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair_id`` with the ordered turns of the ``chosen`` and the ``rejected`` conversation."""
    said = F.struct(
        F.col(turn).alias("turn"), role_name(F.col(role)).alias("role"), harmless(F.col(text)).alias("text"))
    side = lambda odd: F.array_sort(F.collect_list(F.when(F.pmod(F.col(key), F.lit(2)) == odd, said)))
    found = turns.where(F.col(key).isNotNull()).groupBy(F.floor(F.col(key) / 2).cast("long").alias("pair_id")).agg(
        side(0).alias("chosen"), side(1).alias("rejected"))
    return found


def common_turns(a: Column, b: Column) -> Column:
    """Turns at the start that both have, by role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    return _let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False) - 1).otherwise(F.size(s)).cast("int"))


def opening(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(opening(t), t["text"], F.lit(END))), "")


def segments(turns: Column) -> Column:
    """(text, train) in their order: the opening of a turn, then what it says."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(opening(t).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == TRAINED).alias("train")),
    )))


def format_pairs(turns: DataFrame, **columns: str) -> DataFrame:
    """``pair_id``, ``n_common``, ``prompt``, and the segments of both completions. One shuffle, by pair."""
    both = pairs(turns, **columns).withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.when(F.size(c) > 0, segments(F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))))
    return both.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        rest(F.col("chosen")).alias("chosen"), rest(F.col("rejected")).alias("rejected"),
    )


def flattened(formatted: DataFrame) -> DataFrame:
    """Completions as text, and their masks as lengths: characters:1 to train on, characters:0 not to."""
    def text(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda s: s["text"]), ""))

    def mask(c: str) -> Column:
        runs = F.transform(c, lambda s: F.concat_ws(":", F.char_length(s["text"]), s["train"].cast("int")))
        return F.when(F.col(c).isNotNull(), F.array_join(runs, ","))

    return formatted.select(
        "pair_id", "n_common", "prompt", text("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"),
        text("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"),
    )
