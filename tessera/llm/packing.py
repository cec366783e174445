"""Mixture-controlled packing of texts into containers of fixed capacity.

Each source has a queue and a target share. Deficit round robin works on two levels:

* Over partitions (packs of about ``PACK`` items): by a prefix sum over its items, in hash order, a source gives each
  pack its target share of the pack's size; what the last item overshoots is carried to the next
  pack and begins its deficits. So a hot source is spread over all packs, and every pack has the target mixture.
* Inside a pack, container after container: each credits every queue with its share of the
  capacity; the queue with the largest deficit opens it with its longest item that it may give, and the rest is filled
  with the items, or pairs of items, that leave the least space, by queues in order of deficit. No queue may get more than one
  capacity beyond what it was due, unless nothing else fits; what it gets more or less is carried to the next container.

Hence, as long as all queues have items, a source gets in any window of w containers at most
(1 + what it was short of before) capacities more than its share of w.
Badly filled containers are taken apart again and packed together in a second
round, at the rates that use up what each source still has.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.corpus import before
from tessera.session import Scratch

#: Items of a pack, which one task holds in memory.
PACK = 20_000
#: Containers of a window in reports.
WINDOW = 10
#: Containers filled less than this go to the second round.
GOOD = 0.995
#: Items of a queue tried as the second of a container, for a third that leaves no space; queues they are taken from; sizes tried for a queue that may give one.
TRIES, NEEDIEST, STEPS = 48, 4, 8
#: Share of all sources without a target where targets leave nothing.
REST = 0.001


def items(df: DataFrame, key: str, text: str, source: str, capacity: int) -> DataFrame:
    """(row_no, piece_no, size, queue): pieces of up to capacity characters (code points).

    A text is whole unless longer; then it is cut into full pieces and a rest.
    Null and blank texts (white space only) give none. A queue is =source; that of a null source is empty.
    """
    filled = F.col(text).isNotNull() & F.regexp_like(F.col(text), F.lit(r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"))
    queue = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.where(filled).select(F.col(key).cast("long").alias("row_no"), F.length(text).alias("all"), queue.alias("queue"))
    rows = rows.select("row_no", "queue", "all", F.explode(F.sequence(F.lit(0), F.expr(f"int((all - 1) div {capacity})"))).alias("piece_no"))
    return rows.select("row_no", "piece_no", F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("int").alias("size"), "queue")


def pack(sizes: list[int], queues: list, shares: dict, carried: dict, capacity: int) -> list[int]:
    """Container number of each item, from 0. Sizes are 1 to capacity; carried are the deficits to begin with."""
    stock: dict[object, dict[int, list[int]]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stock.setdefault(queues[i], {}).setdefault(sizes[i], []).append(i)
    names = sorted(stock)
    lengths = {q: sorted(stock[q]) for q in names}
    everywhere: list[int] = sorted(set(sizes))
    holders: dict[int, set] = {}
    for q, by in stock.items():
        for n in by:
            holders.setdefault(n, set()).add(q)
    deficit = {q: carried.get(q, 0.0) for q in names}
    place = {q: k for k, q in enumerate(names)}
    out = [0] * len(sizes)
    left, container = len(sizes), 0

    def take(q, n: int) -> None:
        nonlocal left
        line = stock[q][n]
        out[line.pop()] = container
        left -= 1
        deficit[q] -= n
        if not line:
            del stock[q][n]
            own = lengths[q]
            del own[bisect_right(own, n) - 1]
            holders[n].discard(q)
            if not holders[n]:
                del everywhere[bisect_right(everywhere, n) - 1]
        if not lengths[q]:
            del lengths[q]

    def neediest(n: int, due: bool):
        """The queue with the largest deficit that has an item of n and, if due, may give it."""
        q = max(holders[n], key=lambda q: (deficit[q], -place[q]))
        return q if not due or n <= deficit[q] + capacity else None

    def partner(rest: int, q, n: int) -> int:
        """The longest item up to rest, besides one of n from q, that a queue may give; 0 for none."""
        j = bisect_right(everywhere, rest) - 1
        for at in range(j, max(-1, j - STEPS), -1):
            size = everywhere[at]
            if size == n and len(holders[n]) == 1 and len(stock[q][n]) == 1:
                continue  # there is but one such item
            if neediest(size, True) is not None:
                return size
        return 0

    while left:
        active = sum(shares.get(q, 0.0) for q in lengths)
        for q in lengths:
            deficit[q] += capacity * (shares.get(q, 0.0) / active if active else 1 / len(lengths))
        space = capacity
        q = max(lengths, key=lambda x: (deficit[x], -place[x]))
        n = lengths[q][max(0, bisect_right(lengths[q], deficit[q] + capacity) - 1)]
        take(q, n)
        space -= n
        while space and everywhere and everywhere[0] <= space:
            order = sorted(lengths, key=lambda x: (-deficit[x], place[x]))
            # of each queue the longest item that fits and that it may give; then the pair that leaves least, its first item from the neediest queues
            best = (space, None, 0)
            for q in order:
                own = lengths[q]
                k = bisect_right(own, min(space, deficit[q] + capacity)) - 1
                if k >= 0 and space - own[k] < best[0]:
                    best = (space - own[k], q, own[k])
                    if not best[0]:
                        break
            if best[0]:
                for q in order[:NEEDIEST]:
                    own = lengths[q]
                    top = bisect_right(own, min(space, deficit[q] + capacity))
                    for k in range(top - 1, max(-1, top - 1 - TRIES), -1):
                        rest = space - own[k]
                        waste = rest - partner(rest, q, own[k])
                        if waste < best[0]:
                            best = (waste, q, own[k])
                            if not waste:
                                break
                    if not best[0]:
                        break
            if best[1] is None:  # only queues that had their due are left for so little space
                n = everywhere[bisect_right(everywhere, space) - 1]
                best = (space - n, neediest(n, False), n)
            take(*best[1:])
            space -= best[2]
        container += 1
    return out


def shares_of(totals: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """(queue, total, share) of totals(queue, total): the targets, or else the shares of the totals.

    Sources without a target share what the targets leave, at least REST, by their totals; all shares are then scaled to sum up to 1.
    """
    if not targets:
        return totals.withColumn("share", F.col("total") / F.lit(float(totals.agg(F.sum("total")).first()[0] or 1)))
    given = F.lit(None).cast("double")
    for name, share in targets.items():
        given = F.when(F.col("queue") == ("" if name is None else f"={name}"), float(share)).otherwise(given)
    marked = totals.withColumn("given", F.when(given > 0, given))
    used, rest = marked.agg(F.coalesce(F.sum("given"), F.lit(0.0)), F.sum(F.when(F.col("given").isNull(), F.col("total")))).first()
    left = max(1 - used, REST) if rest else 0.0
    return marked.select("queue", "total", (F.coalesce("given", F.lit(left) * F.col("total") / F.lit(float(rest or 1))) / F.lit(used + left or 1.0)).alias("share"))


def dealt(rows: DataFrame, targets: dict[str | None, float] | None, scratch: Scratch) -> DataFrame:
    """rows(row_no, piece_no, size, queue) with pack, share (of the queue) and late: what the pack is given of the queue less than it is due, from the prefix sum of the queue.

    Of the queue's items beyond the share of all packs, a pack of its own for each pack's size.
    """
    rows = scratch.keep(before(rows.withColumn("o", F.sha1(F.concat_ws(":", "row_no", "piece_no"))), ["queue"], "o", "size").drop("o"), "prefix")
    count, whole = rows.agg(F.count("*"), F.sum("size")).first()
    packs = max(1, round(count / PACK))
    size = (whole or 1) / packs
    quota = F.col("share") * size
    over = F.col("before") - quota * packs
    # a queue's own total may miss its quota by rounding only
    own = F.least(F.floor(F.col("before") / quota), F.lit(packs))
    number = F.when(over < 1, F.least(own, F.lit(packs - 1))).otherwise(packs + F.floor(over / size)).cast("int")
    totals = rows.groupBy("queue").agg(F.sum("size").alias("total"))
    given = rows.join(shares_of(totals, targets), "queue").withColumn("pack", number)
    late = F.when(F.col("pack") < packs, F.col("pack") * quota - F.col("before")).otherwise(0.0)
    return given.select("row_no", "piece_no", "size", "queue", "pack", "share", late.alias("late"))


SCHEMA = "row_no long, piece_no int, size int, queue string, pack int, container int, fill int"


def packed(df: DataFrame, key: str, text: str, source: str, capacity: int = 6000, targets: dict[str | None, float] | None = None) -> DataFrame:
    """(row_no, piece_no, size, queue, container): every piece once; containers are numbered from 0 without gaps.

    targets: the share of each source in every window, by default its share of all texts; a source that has run out has none any more.
    Rows that repeat a key are packed as items of their own. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "packing")

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("row_no", "ascending"), ("piece_no", "ascending")])
        sizes, queues = part.column("size").to_pylist(), part.column("queue").to_pylist()
        shares = dict(zip(queues, part.column("share").to_pylist()))
        carried: dict[str, float] = {}
        for q, late in zip(queues, part.column("late").to_pylist()):  # the largest is that of the pack's first item
            carried[q] = max(carried.get(q, late), late)
        where = pack(sizes, queues, shares, carried, capacity)
        fill = [0] * (max(where, default=-1) + 1)
        for n, c in zip(sizes, where):
            fill[c] += n
        part = part.select(["row_no", "piece_no", "size", "queue", "pack"])
        return part.append_column("container", pa.array(where, pa.int32())).append_column("fill", pa.array([fill[c] for c in where], pa.int32()))

    def a_round(rows: DataFrame, name: str, targets: dict[str | None, float] | None) -> DataFrame:
        return scratch.keep(dealt(rows, targets, Scratch(scratch.spark, "dealt")).groupBy("pack").applyInArrow(run, SCHEMA), name)

    first = a_round(items(df, key, text, source, capacity), "first", targets)
    good = F.col("fill") >= int(GOOD * capacity)
    second = a_round(first.where(~good).select("row_no", "piece_no", "size", "queue"), "second", None)
    both = scratch.keep(first.where(good).withColumn("round", F.lit(1)).union(second.withColumn("round", F.lit(2))), "both")
    numbers = both.select("round", "pack", "container").distinct()
    counts = numbers.groupBy("round", "pack").agg(F.count("*").alias("n"))  # one row for each pack
    offsets = counts.select("round", "pack", (F.sum("n").over(Window.orderBy("round", "pack")) - F.col("n")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("round", "pack").orderBy("container")) - 1
    numbers = numbers.withColumn("place", place).join(offsets, ["round", "pack"]).select("round", "pack", "container", (F.col("offset") + F.col("place")).alias("number"))
    return both.join(numbers, ["round", "pack", "container"]).select("row_no", "piece_no", "size", "queue", F.col("number").cast("long").alias("container"))


def drifts(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, queue, share, target, drift) for the containers of packed: a source's share of each window beside its share of all."""
    targets = shares_of(found.groupBy("queue").agg(F.sum("size").alias("total")), None).select("queue", F.col("share").alias("target"))
    marked = found.select(F.expr(f"container div {window}").alias("window"), "queue", "size")
    last = marked.agg(F.max("window")).first()[0]
    sums = marked.groupBy("window").agg(F.sum("size").alias("all"))
    own = marked.groupBy("window", "queue").agg(F.sum("size").alias("n"))
    every = targets.select("queue", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last if last is not None else 0).cast("long"))).alias("window")).join(sums, "window")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("all")
    return every.join(own, ["window", "queue"], "left").select("window", "queue", share.alias("share"), "target", F.abs(share - F.col("target")).alias("drift"))
