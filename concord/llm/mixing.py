"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words.  A source whose target
passes its size takes everything once and fits the rest of its budget; the others
fit all of it.  Most of a budget is dealt over the lengths in proportion to their
words; the last ``DP_WORDS`` or so go through a bounded-knapsack dynamic programme
over reachable sums, which finds how many documents of each length to take so that
the budget is met exactly or by the nearest sum below.  The documents of a length are
then chosen by a seeded hash of their id and text.

Targets come from rounds of one small aggregate each: sources that reach their stop
are set to it and the rest is shared again by weight.

Defined cases: null texts have no words; a null source is one source, the last;
texts without words take nothing; repeated rows and ids count each; documents of one
length that tie by hash have the same id and text; an empty table gives an empty mix; a
text of any length is counted whole where it is read; extra columns are kept, whatever
their names, and never weighed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.llm.store import materialize

#: Weights of the sources in their order, repeating; words to take as a share of all; most takes of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
DP_WORDS = 1 << 16
SEED = 20_117
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reachable(sizes: np.ndarray, counts: np.ndarray, budget: int) -> dict[int, int]:
    """How many of each size sum up to ``budget``, or to the largest reachable sum below it.

    Bits of an integer are the sums reached so far; counts are split into powers of
    two, and each sum remembers the part that reached it first.
    """
    if budget <= 0:
        return {}
    bits, mask = 1, (1 << (budget + 1)) - 1
    via = np.full(budget + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []
    for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
        left, step = min(count, budget // size if size else 0), 1
        while left > 0:
            k = min(step, left)
            new = (bits << (size * k)) & mask & ~bits
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                at = np.flatnonzero(raw)
                places = (at[:, None] * 8 + np.arange(8))[np.unpackbits(raw[at], bitorder="little").reshape(-1, 8).astype(bool)]
                via[places] = len(parts)
                bits |= new
            parts.append((size, k))
            left, step = left - k, step * 2
            if bits >> budget & 1:
                break
        if bits >> budget & 1:
            break
    taken: dict[int, int] = {}
    at = bits.bit_length() - 1
    while at:
        size, k = parts[via[at]]
        taken[size] = taken.get(size, 0) + k
        at -= size * k
    return taken


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """Documents to take of each size, at most its count, whose words come nearest below ``budget``."""
    order = np.argsort(-sizes, kind="stable")
    sizes, counts = sizes[order], counts[order]
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    budget = min(budget, total)
    dealt = budget - min(budget, dp_words)
    if dealt and total:
        owed = 0.0
        for i in range(len(sizes)):
            if sizes[i]:
                owed += dealt / total * float(sizes[i] * counts[i])
                take[i] = min(counts[i], int(owed // sizes[i]))
                owed -= float(take[i] * sizes[i])
    rest = budget - int((take * sizes).sum())
    for i in range(len(sizes)):  # documents longer than the programme's sums, and what would make those too large, by length
        room = rest if sizes[i] > dp_words else rest - dp_words
        if sizes[i] and room >= sizes[i]:
            k = min(counts[i] - take[i], room // sizes[i])
            take[i] += k
            rest -= int(k * sizes[i])
    fits = sizes <= rest
    rest = min(rest, int((sizes * (counts - take))[fits].sum()))
    # few of each length are needed for the rest, and varied lengths first make every sum reachable soon
    for size, k in reachable(sizes[fits], (counts - take)[fits], rest).items():
        take[np.flatnonzero(sizes == size)[0]] += k
    out = np.zeros(len(sizes), np.int64)
    out[order] = take
    return out


def ranked_sources(totals: DataFrame) -> DataFrame:
    """Totals with a column ``at``: position by code point, null last; ranked by ranges, never in one task."""
    ranged = totals.withColumn("missing", F.col("source").isNull()).repartitionByRange("missing", "source").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("part").count().collect()):  # a row for each range
        offsets.append((part, before))
        before += n
    spark = totals.sparkSession
    dealt = ranged.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
    return dealt.withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("missing", "source")) - 1).drop("missing", "part", "before")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    rows = materialize(ranked_sources(totals).withColumn("weight", weight), "weighted")
    stop = F.col("source_size") * F.lit(float(most))
    whole = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # a level is words for each unit of weight; it only rises, and stops when no more sources do
        full = F.col("weight") * F.lit(level) >= stop
        fixed, open_weight = rows.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (whole - (fixed or 0.0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(F.col("weight") * F.lit(level), stop).alias("target"))


def plans(counts: DataFrame, goal: DataFrame, dp_words: int = DP_WORDS) -> DataFrame:
    """(source, size, n, source_size, target, base, extra): takes of every document of a length, and of how many once more."""
    lengths = counts.groupBy("source").agg(F.collect_list(F.struct("size", "n")).alias("lengths")).join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    schema = "source string, size long, n long, source_size long, target double, base long, extra long"

    def fit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array([x["size"] for x in row["lengths"]], np.int64)
                n = np.array([x["n"] for x in row["lengths"]], np.int64)
                order = np.argsort(sizes)
                sizes, n = sizes[order], n[order]
                base = int(row["target"] // row["source_size"]) if row["source_size"] else 0
                extra = fit_budget(sizes, n, int(round(row["target"] - base * row["source_size"])), dp_words)
                k = len(sizes)
                columns = [pa.array([row["source"]] * k, pa.string()), pa.array(sizes), pa.array(n), pa.array([row["source_size"]] * k, pa.int64()), pa.array([row["target"]] * k, pa.float64()), pa.array([base] * k, pa.int64()), pa.array(extra)]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "size", "n", "source_size", "target", "base", "extra"])

    return lengths.select("source", "lengths", "source_size", "target").mapInArrow(fit, schema)


def order_hash(seed: int) -> Column:
    """What orders the documents of a length: a hash of id and text, null apart from empty."""
    return F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.lit(seed))


def row_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def pieces_of(n: Column) -> Column:
    """Pieces in which a length's documents are ranked, about sqrt(n), so no length is ranked in one task."""
    return F.greatest(F.ceil(F.sqrt(n)), F.lit(1))


def planned(own: DataFrame, weights: tuple, share: float, most: float, dp_words: int) -> DataFrame:
    """(key, size, n, source_size, target, base, extra) of each source and length."""
    counts = materialize(own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(totals, weights, share, most).withColumnRenamed("source", "goal_source")
    plan = materialize(plans(counts, goal, dp_words), "plan")
    return plan.select(row_key().alias("key"), "size", "n", "source_size", "target", "base", "extra")


def sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """Id, source, size and hash of each row."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_hash(seed).alias("h"), *more)


def near(plan: DataFrame) -> DataFrame:
    """A plan, to be broadcast while it has few rows."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan


def ranked(own: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``own`` with their plan, their piece and ``more``, whether they are taken once more than ``base``."""
    hashed = own.withColumn("key", row_key()).join(near(plan), ["key", "size"]).withColumn("piece", F.pmod(F.col("h"), pieces_of(F.col("n"))))
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    some = hashed.where(split)
    sums = some.groupBy("key", "size", "piece").agg(F.count(F.lit(1)).alias("m"))
    before = sums.select("key", "size", "piece", (F.sum("m").over(W.partitionBy("key", "size").orderBy("piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")).alias("before"))
    rank = F.row_number().over(W.partitionBy("key", "size", "piece").orderBy("h", "doc_id"))
    chosen = some.join(before, ["key", "size", "piece"]).withColumn("more", (F.col("before") + rank <= F.col("extra")).cast("long")).drop("before")
    return chosen.unionByName(hashed.where(~split).withColumn("more", (F.col("extra") > 0).cast("long")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, dp_words: int = DP_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row."""
    own = materialize(sized(docs, seed), "sized")
    copies = F.col("base") + F.col("more")
    return ranked(own, planned(own, weights, share, most, dp_words)).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, dp_words: int = DP_WORDS) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (``copies_2`` and so on where documents have that column).

    Of a length's documents those up to a place in the order of their hashes are taken,
    so each row needs only its plan: no text is shuffled.  Rows that are equal in all
    columns but maps become one row with all their copies.
    """
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row_hash = F.xxhash64(*columns, *[c.isNull() for c in columns])
    own = materialize(sized(docs, seed, row_hash.alias("row_hash")), "sized")
    plan = planned(own, weights, share, most, dp_words)
    taken = ranked(own, plan)
    last = taken.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")) & (F.col("more") > 0)).groupBy("key", "size").agg(F.max(F.struct("piece", "h")).alias("last"))
    plan = materialize(plan.join(last, ["key", "size"], "left"), "cuts")
    repeated = materialize(own.groupBy("h", "row_hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated")
    packed = docs.select(order_hash(seed).alias("h"), row_hash.alias("row_hash"), row_key().alias("key"), word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    more = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("extra") <= 0, 0).otherwise((F.struct(F.pmod(F.col("h"), pieces_of(F.col("n"))).alias("piece"), "h") <= F.col("last")).cast("int"))
    kept = packed.join(near(plan), ["key", "size"]).select("h", "row_hash", "row", (F.col("base") + more).alias("copies"))
    if not repeated.isEmpty():
        side = near(repeated.select("h", "row_hash"))
        sums = taken.join(side, ["h", "row_hash"], "left_semi").groupBy("h", "row_hash").agg(F.sum(F.col("base") + F.col("more")).alias("copies"))
        once = kept.join(side, ["h", "row_hash"], "left_semi").drop("copies").dropDuplicates(["h", "row_hash"]).join(sums, ["h", "row_hash"])
        kept = kept.join(side, ["h", "row_hash"], "left_anti").unionByName(once)
    name, k = "copies", 2
    while name in docs.columns:
        name, k = f"copies_{k}", k + 1
    return kept.where("copies > 0").select("row.*", F.col("copies").alias(name))
