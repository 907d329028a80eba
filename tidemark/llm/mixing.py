"""Mixing sources to target weights.

Quotas are dealt by the Sainte-Lague method: blocks of equally many tokens go one by one to the highest quotient ``weight / (2 * blocks + 1)``, first over a
plan's sources by target share, then over each source's shards by their tokens. Within a shard, texts are taken in a seeded
order until the shard's quota is met, each at most ``max_repeats`` times.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import TOKENIZERS, count_tokens
from tidemark.operators.ranking import hash_order
from tidemark.session import cut_lineage

BLOCKS = 1_000_000
PER_SHARD = 50_000


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients ``w / (2n + 1)``; ties go to the earlier entry; nobody gets more than its cap.

    All but a few seats are found at once from a divisor that deals too few; the rest go one by one.
    """
    caps = list(caps) if caps is not None else [seats] * len(weights)
    caps = [c if w > 0 else 0 for c, w in zip(caps, weights)]
    seats = min(seats, sum(caps))

    def dealt(divisor: float) -> list[int]:
        return [min(c, max(0, int(w / divisor + 0.5))) if w > 0 else 0 for w, c in zip(weights, caps)]

    low, high = 0.0, 4 * max([w for w in weights if w > 0], default=1.0)
    for _ in range(200):  # high deals too few
        middle = (low + high) / 2
        if middle in (low, high) or middle == 0:
            break
        low, high = (low, middle) if sum(dealt(middle)) <= seats else (middle, high)
    # step back a little, so that rounding in the divisor cannot have dealt a seat out of order
    out = [max(0, n - 2) for n in dealt(high)]
    heap = [(-w / (2 * n + 1), k) for k, (w, n, c) in enumerate(zip(weights, out, caps)) if n < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


def reachable_total(rows: Sequence[tuple[float, int]]) -> int:
    """The largest total at which every source that has texts can give its share: (share, most tokens it can give)."""
    fits = [int(most / share) for share, most in rows if share > 0 and most > 0]
    return min(fits, default=0)


def shard_quotas(batches):
    """A source's blocks dealt to its shards by their tokens: a source's list has a row per PER_SHARD of its texts, and stays with the executors."""
    import pandas as pd

    for batch in batches:
        for r in batch.itertuples():
            shards, held = [s["shard"] for s in r.shards], [s["held"] for s in r.shards]
            got = sainte_lague(held, int(r.blocks), [-(-t * r.max_repeats // r.block) for t in held])
            yield pd.DataFrame({"plan": r.plan, "source": r.source, "shard": shards, "quota": [min(g * r.block, t * r.max_repeats) for g, t in zip(got, held)], "held": held, "max_repeats": r.max_repeats})


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizers: str = TOKENIZERS, per_shard: int = PER_SHARD) -> DataFrame:
    """``plan, source, doc_id, tokens, copies``: the texts drawn for each plan and how often.

    Sources are compared without outer blanks and letter case; a null source belongs to no plan. A text found in several documents of a
    plan counts once, for the smallest ``doc_id``; empty and null texts are never drawn. ``total_tokens`` is each plan's size; if None, the largest total at
    which every source with texts reaches its share. A source that is absent or too small for its share gives what it has; its missing part is not given to
    others. Each shard's draw is within half a text of its quota.
    """
    spark = documents.sparkSession
    name = F.lower(F.trim(F.col("source")))
    wanted = targets.select("plan", name.alias("source"), "target_share", "max_repeats").filter("plan is not null and source is not null and target_share > 0 and max_repeats > 0")
    plans = [tuple(r) for r in wanted.collect()]  # a fixed, small table
    sized = cut_lineage(count_tokens(documents.filter("source is not null and doc_id is not null").withColumn("source", name), ["doc_id", "source"], tokenizers).filter("tokens > 0"))
    membership = F.broadcast(spark.createDataFrame([(p, s) for p, s, _, _ in plans], "plan string, source string"))
    first = sized.join(membership, "source").groupBy("plan", "text_key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("r")).select("plan", "text_key", "r.*")
    first = cut_lineage(first.withColumn("h", hash_order("text_key", seed=seed)))
    sizes = {(r[0], r[1]): (r[2], r[3]) for r in first.groupBy("plan", "source").agg(F.sum("tokens"), F.count("*")).collect()}  # a row per plan and source
    n_shards = {k: max(1, -(-n // per_shard)) for k, (_, n) in sizes.items()}
    shards = F.broadcast(spark.createDataFrame([(p, s, n) for (p, s), n in n_shards.items()], "plan string, source string, shards long"))
    sharded = first.join(shards, ["plan", "source"]).withColumn("shard", F.pmod("h", "shards"))
    dealt = []  # a row per plan and source: blocks, block size and cap
    for plan in sorted({p for p, *_ in plans}):
        rows = [(s, share, rep, sizes.get((plan, s), (0, 0))[0]) for p, s, share, rep in plans if p == plan]
        total = reachable_total([(share, t * rep) for _, share, rep, t in rows]) if total_tokens is None else total_tokens
        block = max(1, total // BLOCKS)
        for (source, _, rep, tokens), blocks in zip(rows, sainte_lague([share for _, share, _, _ in rows], total // block)):
            dealt.append((plan, source, min(blocks, tokens * rep // block), block, rep))
    dealt = F.broadcast(spark.createDataFrame(dealt, "plan string, source string, blocks long, block long, max_repeats long"))
    held = sharded.groupBy("plan", "source", "shard").agg(F.sum("tokens").alias("held"))
    lists = held.groupBy("plan", "source").agg(F.array_sort(F.collect_list(F.struct("shard", "held"))).alias("shards")).join(dealt, ["plan", "source"])
    quota = lists.mapInPandas(shard_quotas, "plan string, source string, shard long, quota long, held long, max_repeats long")
    upto = F.sum("tokens").over(Window.partitionBy("plan", "source", "shard").orderBy("h", "text_key").rowsBetween(Window.unboundedPreceding, 0))
    drawn = sharded.join(quota, ["plan", "source", "shard"]).withColumn("upto", upto)
    whole = F.floor(F.col("quota") / F.col("held"))
    rest = F.col("quota") - whole * F.col("held")
    more = (F.col("upto") - F.col("tokens") / 2 < rest) & (whole < F.col("max_repeats"))
    copies = (whole + F.when(more, 1).otherwise(0)).cast("long")
    return drawn.select("plan", "source", "doc_id", "tokens", copies.alias("copies")).filter("copies > 0")


def mix_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``plan, source, target_share, actual_share, tokens, n_texts, most_copies, max_repeats, reached``; reached: within one hundredth."""
    name = F.lower(F.trim(F.col("source")))
    want = targets.select("plan", name.alias("source"), "target_share", "max_repeats")
    got = drawn.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies"))
    rows = want.join(got, ["plan", "source"], "left").na.fill(0, ["tokens", "n_texts", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy("plan"))  # a row per source of a plan
    share = F.when(total > 0, F.col("tokens") / total).otherwise(0.0)
    rows = rows.withColumn("actual_share", share)
    return rows.select("plan", "source", "target_share", "actual_share", "tokens", "n_texts", "most_copies", "max_repeats", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01).alias("reached"))
