"""Token lists kept as data: parsing, matching at any size, extending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import BOT_TOKENS
from trailmark.functions.text import ascii_fold, parse_token_list, sanitize_text, text, trim


def effective_tokens(saved: DataFrame, list_col: str = "bot_list") -> DataFrame:
    """Rows ``(keys..., pos, token)`` of each saved list, or the built-in tokens if it is blank."""
    own = parse_token_list(F.col(list_col))
    builtin = F.array(*[F.lit(t) for t in BOT_TOKENS])
    chosen = F.when(trim(text(F.col(list_col))) != "", own).otherwise(builtin)
    keys = [c for c in saved.columns if c != list_col]
    return saved.select(*keys, F.posexplode(chosen).alias("pos", "token"))


def bot_first_match(agents: DataFrame, bots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First token of ``bots(keys..., pos, token)`` found in each distinct ``keys..., user_agent``.

    With ``keys``, such as the site, every list meets its own agents only.

    Instead of comparing every agent with every token, each agent is cut into its substrings of
    the lengths that occur among the tokens, and those meet the tokens in an equality join. The
    work grows with the distinct agents and not with the length of the list. Agents without a
    match are absent. Only the distinct token lengths come to the driver, a handful of numbers.
    """
    folded = ascii_fold(F.col("token"))
    tokens = bots.select(*keys, "pos", "token", folded.alias("f"), F.length("token").alias("len"))
    lengths = [row[0] for row in tokens.filter("len > 0").select("len").distinct().collect()]
    distinct = agents.select(*keys, "user_agent").filter(F.col("user_agent") != "").distinct()
    ua = distinct.withColumn("ua", ascii_fold(F.col("user_agent")))
    none = F.array().cast("array<string>")

    def cut(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("ua") - n + 1)
        pieces = F.transform(starts, lambda i: F.substring(F.col("ua"), i, F.lit(n)))
        return F.when(F.length("ua") >= n, pieces).otherwise(none)

    cuts = F.flatten(F.array(none, *[cut(n) for n in lengths]))
    pieces = ua.select(*keys, "user_agent", F.explode(F.array_distinct(cuts)).alias("f"))
    hits = pieces.join(tokens.select(*keys, "f", "pos", "token"), [*keys, "f"])
    return hits.groupBy(*keys, "user_agent").agg(F.min_by("token", "pos").alias("token"))


def bot_list_add(
    saved: DataFrame, found: DataFrame, list_col: str = "bot_list", extend_defaults: bool = False
) -> DataFrame:
    """Append ``found(keys..., user_agent)`` to the saved lists unless already there, exactly.

    A list that was blank then holds the new agent alone and so replaces the built-in tokens;
    ``extend_defaults`` starts from the built-in tokens instead.
    """
    keys = [c for c in saved.columns if c != list_col]
    start = F.array(*[F.lit(t) for t in BOT_TOKENS]) if extend_defaults else F.array().cast("array<string>")
    blank = trim(text(F.col(list_col))) == ""
    # A line that reads "0" counts as empty here, unlike when the list is used.
    kept = F.filter(parse_token_list(F.col(list_col)), lambda line: line != "0")
    lines = F.when(blank, start).otherwise(kept)
    agent = sanitize_text(F.col("user_agent"))
    grown = F.when(
        (agent == "") | F.array_contains(lines, agent), lines
    ).otherwise(F.array_append(lines, agent))
    # Saved lists and agents have one row per key, so this is a plain lookup.
    return saved.join(found.select(*keys, "user_agent"), keys, "left").select(
        *keys, F.array_join(grown, "\n").alias(list_col)
    )
