"""Shards of documents by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document starts in the shard of its id's hash; then, round by round,
the members of a group move towards the shard that has most of their neighbours, as far as the quota of that shard
allows. The state is not the documents but the cells (group, shard, documents), so a group of any size is at
most as many rows as there are shards. Documents without links don't vote; they fill up at the end.

Law: ``rows``. Shard sizes differ by one document at most: documents above a shard's quota, unlinked ones first,
take the free places of the others. Numbering is by hash buckets with counted offsets, never by a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .tables import stored

SHARDS = 8
ROUNDS = 4
#: Documents that one numbering window holds on average.
BUCKET_ROWS = 50_000


def _unit(*of: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _choose(values: list[int], of: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (of + 1).cast("int"))


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def admitted(wanted: list[list[float]], load: list[int], quotas: list[int]) -> list[list[float]]:
    """Which share of each wished flow (from, to) may move so that no shard ends above its quota (or above its load, where
    that is more already). What leaves a shard makes room in it; flows into a shard that is still too full shrink until all fit."""
    shards = range(len(load))
    flow = [row[:] for row in wanted]
    for _ in range(200):
        tight = True
        for t in shards:
            inflow = sum(flow[s][t] for s in shards)
            room = max(quotas[t], load[t]) - load[t] + sum(flow[t])
            if inflow > room * (1 + 1e-9):
                tight = False
                for s in shards:
                    flow[s][t] *= room / inflow
        if tight:
            break
    return [[flow[s][t] / wanted[s][t] if wanted[s][t] else 0.0 for t in shards] for s in shards]


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, label, n) after the rounds. A round's wishes are summed by shard (shards squared numbers); of a wished flow that may
    move in part, each small cell moves with that probability, told by a hash, and of a cell above a hundredth of its quota that share."""
    shards = len(quotas)
    for turn in range(rounds):
        best = cells.groupBy("g").agg(F.max_by("label", F.struct("n", F.xxhash64("g", "label", F.lit(turn)))).alias("target"))
        wishes = cells.join(best, "g")
        load, wanted = [0] * shards, [[0.0] * shards for _ in range(shards)]
        for row in wishes.groupBy("label", "target").agg(F.sum("n").alias("n")).collect():
            load[row.label] += row.n
            if row.label != row.target:
                wanted[row.label][row.target] += row.n
        if not any(map(sum, wanted)):
            break
        share = [x for row in admitted(wanted, load, quotas) for x in row]
        f = F.element_at(F.array(*[F.lit(x) for x in share]), (F.col("label") * shards + F.col("target") + 1).cast("int"))
        small = F.col("n") <= _choose([max(1, q // 100) for q in quotas], F.col("target"))
        moved = F.when(F.col("label") == F.col("target"), F.lit(0)).when(small, F.when(_unit("g", "label", F.lit(turn + 100)) < f, F.col("n")).otherwise(0)).otherwise(F.floor(F.col("n") * f))
        parts = wishes.withColumn("moved", moved.cast("long")).select("g", F.explode(F.array(
            F.struct(F.col("target").alias("label"), F.col("moved").alias("n")),
            F.struct(F.col("label"), (F.col("n") - F.col("moved")).alias("n")),
        )).alias("c")).select("g", "c.label", "c.n").where("n > 0")
        cells = stored(parts.groupBy("g", "label").agg(F.sum("n").alias("n")))
    return cells


def numbered(rows: DataFrame, label: str, rank: str, total: int, order: list[str]) -> DataFrame:
    """Adds ``place``: gapless from 0 within ``label``, lower ``rank`` first. Buckets of about BUCKET_ROWS rows are counted, and each
    row's place is its bucket's offset plus its place there."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)))
    keys = [label, rank, "_b"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(label).orderBy(rank, "_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("_k", inside).join(offsets, keys).withColumn("place", F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked, one row per input row.

    A null text has size 1, the CRC of nothing and no links; empty texts are equal texts like others. Repeated rows
    and null ids are rows like others. Other columns are ignored; an empty table gives no rows."""
    base = stored(docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(1), F.col(text))).alias("g"),
    ))
    base = base.withColumn("start", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int"))
    total = base.count()
    quotas = _quotas(total, shards)
    cells = base.where("g is not null").groupBy("g", F.col("start").alias("label")).agg(F.count("*").alias("n"))
    several = cells.groupBy("g").agg(F.sum("n").alias("m")).where("m > 1").drop("m")
    cells = propagate(stored(cells.join(several, "g", "left_semi")), quotas, rounds)
    upto = F.expr("transform(cut, (x, i) -> struct(x.label as label, aggregate(slice(cut, 1, i + 1), 0L, (a, y) -> a + y.n) as upto))")
    plan = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("cut"), F.sum("n").alias("m")).select("g", "m", upto.alias("cut"))
    placed = base.join(plan, "g", "left")
    drawn = F.element_at(F.filter("cut", lambda c: c["upto"] > _unit(F.col("doc_id"), F.lit(3)) * F.col("m")), 1)["label"]
    placed = stored(placed.select("doc_id", "size", "text_crc32", F.col("m").isNotNull().alias("linked"), F.coalesce(drawn, F.col("start")).alias("label")))

    have = [0] * shards
    for row in placed.groupBy("label").count().collect():
        have[row.label] = row["count"]
    over, free = [0], [0]
    for s in range(shards):
        over.append(over[-1] + max(0, have[s] - quotas[s]))
        free.append(free[-1] + max(0, quotas[s] - have[s]))
    ranked = numbered(placed.withColumn("_rank", (~F.col("linked")).cast("int")), "label", "_rank", total, ["doc_id", "text_crc32"])
    spare = F.col("place") - _choose(quotas, F.col("label")) + _choose(over[:-1], F.col("label"))
    new_shard, new_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        here = (spare >= free[s]) & (spare < free[s + 1])
        new_shard = F.when(here, F.lit(s)).otherwise(new_shard)
        new_slot = F.when(here, spare - free[s] + have[s]).otherwise(new_slot)
    stays = F.col("place") < _choose(quotas, F.col("label"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(stays, F.col("label")).otherwise(new_shard).cast("int").alias("shard"),
        F.when(stays, F.col("place")).otherwise(new_slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked",
    )
