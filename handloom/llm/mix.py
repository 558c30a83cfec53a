"""Mixing sources to target weights: weighted fair queueing.

The documents of a source are shuffled by hash, once for every time the source may be repeated, and queue up. A
document's virtual finish time is the source's tokens up to and including it, divided by the target weight. All queues
are served in order of finish time: a global order by ranges of it, cut off where the token budget is spent. While all
sources last, each has its target share of every prefix; one that runs out leaves its turns to the others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.llm.tokenise import token_counts
from handloom.operators.prefix import buckets, ranged, running_total
from handloom.runtime import materialise, sendable

SEED = 17


def clean_source(column):
    return F.lower(F.trim(column))


def sized_documents(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of documents whose source is in ``targets``."""
    wanted = targets.select(clean_source("source").alias("source")).filter("source is not null").distinct()
    named = docs.select(F.struct("doc_id", clean_source("source").alias("source")).alias("who"), "text")
    ours = named.join(wanted, F.col("who.source") == F.col("source"), "left_semi")
    return token_counts(ours, "who", "text", path).select("who.doc_id", "who.source", "n_tokens")


def _goals(targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats)``, each named source once: the greatest share and repeats it is given."""
    named = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    return named.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def schedule(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """``(doc_id, source, copy, n_tokens, served, finish)`` for every copy that may be used.

    ``served`` counts the source's tokens up to and with this copy, ``finish`` is that over the target share. With a
    ``budget``, rounds of a source that begin beyond it are not queued: its earlier rounds alone spend it. ``sized`` is
    read several times: pass it materialised.
    """
    goals = _goals(targets).filter("target_share > 0 and max_repeats > 0")
    supply = sized.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("supply"))
    rounds = F.col("max_repeats")
    if budget is not None:  # the rounds that begin within the budget
        rounds = F.least(rounds, F.floor(F.lit(budget) / F.nullif("supply", F.lit(0))) + 1)
    queues = materialise(goals.join(supply, "source").withColumn("rounds", rounds.cast("int")), "queues")
    copies = (
        sized.join(sendable(queues), "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        .withColumn("place", F.xxhash64(F.lit(SEED), "copy", "doc_id"))
    )
    slots = buckets(sized.count())
    slot = F.shiftrightunsigned("place", 65 - slots.bit_length()).cast("int") if slots > 1 else F.lit(0)
    # the sign bit counts as the highest bit here, so places are ordered as unsigned numbers
    order = [F.col("place").bitwiseXOR(F.lit(-(1 << 63))), F.col("doc_id")]
    queued = running_total(copies, ["source", "copy"], slot, order, "n_tokens", "ahead")
    served = F.col("copy") * F.col("supply") + F.col("ahead") + F.col("n_tokens")
    return queued.select(
        "doc_id", "source", "copy", "n_tokens", served.alias("served"), (served / F.col("target_share")).alias("finish")
    )


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """``(doc_id, source, copy, n_tokens, finish, starts_at)`` of the mix, ``starts_at`` being its place in tokens.

    The budget is by default the tokens of all documents of the sources in ``targets``; the last document fits whole.

    * null or other sources: left aside; null and empty texts: no tokens, they take a place but no room;
    * a share or a number of repeats that is null or not positive: that source is left out; a source that ``targets``
      names again: once, with the greatest share and repeats;
    * repeated doc_ids: documents of their own; equal finish times: by source, copy, then doc_id;
    * empty input: no row; further columns are not carried on.
    """
    if budget is None:
        budget = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    planned = materialise(schedule(sized, targets, budget), "schedule")
    order = [F.col(c) for c in ("finish", "source", "copy", "doc_id")]
    placed = running_total(ranged(planned, order), [], F.col("range"), order, "n_tokens", "starts_at").drop("range")
    return placed.filter(F.col("starts_at") + F.col("n_tokens") <= budget).drop("served")


def reached(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, tokens, goal, missed)``: what the mix took of each source against what the targets ask for.

    ``goal`` is the target share of all tokens, and the budget. A source misses it if its last copy is served and the
    tokens taken are still fewer. One that lasts is served until its finish times pass the budget, so it gets its goal
    but for the part of a document, and has copies left, or reaches the goal with its last.

    No source that falls short is cut by the budget: up to the virtual time that equals the budget, the sources take at
    most their shares of it. Where shares sum to more than 1, the budget is as much larger.
    """
    goals = materialise(_goals(targets), "goals")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    asked = goals.filter("target_share > 0 and max_repeats > 0").agg(F.coalesce(F.sum("target_share"), F.lit(0.0))).first()[0]
    mixed = mix(sized, targets, int(math.ceil(total * max(1.0, asked))))
    taken = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
    held = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    n, tokens, goal = F.coalesce("n", F.lit(0)), F.coalesce("tokens", F.lit(0)), F.col("target_share") * total
    spent = n >= F.coalesce("documents", F.lit(0)) * F.greatest("max_repeats", F.lit(0))
    return goals.join(held, "source", "left").join(taken, "source", "left").select(
        "source", "target_share", tokens.alias("tokens"), goal.alias("goal"), F.coalesce(spent & (tokens < goal), F.lit(False)).alias("missed")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, n_documents, tokens, share)`` of a mix; ``mixed`` is read twice."""
    total = mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    have = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    tokens = F.coalesce("t", F.lit(0))
    return _goals(targets).join(have, "source", "left").select(
        "source",
        "target_share",
        F.coalesce("n", F.lit(0)).alias("n_documents"),
        tokens.alias("tokens"),
        (tokens / F.lit(max(total, 1))).alias("share"),
    )
