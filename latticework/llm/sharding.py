"""Sharding by minimax contiguous partition.

The ordered atomic groups are the texts, by their MD5: equal texts are one group and never split. The smallest shard capacity that a greedy
pass over the group sizes can meet is found by binary search, and the line of groups is cut there. A group above the capacity, such as a
third of all rows with one text, is a shard of its own; so the search goes on below the size of such a group, and the other shards are as
even as without it. Of the cuts that keep within the capacity those next to an even split of what is left are taken.

The search runs over one bounded row, of cells: runs of neighbouring groups whose digests begin alike. A search over cells tells where the
true cuts can lie, whatever the groups inside are: between the cuts of the capacity found and those of one less by the largest cell. Only
cells there are divided, sixteenfold by each further digit, and the search is done again, until every cell in which a cut can lie holds a
single group. So the capacity and the cuts are those of the groups themselves, while the row's length depends on the number of shards.

Slots come from counts per (cell, salt): a cell with many rows, such as thousands of copies, is salted by its own count and by row.

Defined cases: a null text has no bytes and size 1, and groups with the empty text; repeated rows each get a slot; a null doc_id is
placed like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import stored

#: Cells for each shard that the first search has at least, and the digits by which a cell is divided.
CELLS_PER_SHARD, FINER = 512, 2
#: A cell of several groups that holds more than this share of a shard is divided before cuts are looked for.
LARGE_SHARE = 1 / 64
#: Rows of a salted cell that one task should get.
ROWS_PER_SALT = 500


def measured(docs: DataFrame) -> DataFrame:
    """row (a number of each row), doc_id, size, text_crc32 and dig, the group, of each row. To be stored before row is used."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("dig"),
    )


def first_digits(shards: int) -> int:
    digits = 1
    while 16**digits < CELLS_PER_SHARD * shards:
        digits += 1
    return digits


def cell_of(dig: Column, digits: int, divided: list[list[str]]) -> Column:
    """The cell of a digest: its first digits, and FINER more for each level at which its cell has been divided."""
    cell = F.substring(dig, 1, digits + FINER * len(divided))
    for level in reversed(range(len(divided))):
        short = F.substring(dig, 1, digits + FINER * level)
        cell = F.when(short.isin(divided[level]), cell).otherwise(short)
    return cell


# ---- searches over one row of arrays: cells in order, with sizes and several (whether a cell holds more than one group) ------------


def smallest_capacity(shards: int) -> str:
    """SQL for the least capacity with which a greedy pass over sizes needs at most so many shards; a larger group fills a shard."""
    middle = "(acc.lo + (acc.hi - acc.lo) div 2)"
    needed = (
        "aggregate(sizes, named_struct('used', 0L, 'n', 1L), "
        f"(a, x) -> if(a.used + least(x, {middle}) <= {middle}, named_struct('used', a.used + least(x, {middle}), 'n', a.n), named_struct('used', least(x, {middle}), 'n', a.n + 1L)), a -> a.n)"
    )
    return (
        "aggregate(sequence(1, 63), named_struct('lo', least(total, 1L), 'hi', total), "
        f"(acc, i) -> if(acc.lo >= acc.hi, acc, if({needed} <= {shards}L, named_struct('lo', acc.lo, 'hi', {middle}), named_struct('lo', {middle} + 1L, 'hi', acc.hi))), acc -> acc.hi)"
    )


def cut_cells(capacity: int, after: bool) -> str:
    """SQL for the cells, by number from 0, in which a greedy pass goes beyond the capacity. after: the next shard begins behind that cell, else with it."""
    x = f"least(x, {capacity}L)"
    begun = "0L" if after else x
    return (
        "aggregate(sizes, named_struct('used', 0L, 'i', 0, 'cuts', cast(array() as array<int>)), "
        f"(a, x) -> if(a.used + {x} <= {capacity}L, named_struct('used', a.used + {x}, 'i', a.i + 1, 'cuts', a.cuts), "
        f"named_struct('used', {begun}, 'i', a.i + 1, 'cuts', array_append(a.cuts, a.i))), a -> a.cuts)"
    )


def cut_points(line: DataFrame, shards: int, capacity: int) -> list[int]:
    """The totals at which the first shards - 1 shards end.

    line is one row: through (0 and the running totals of all cells, none counted above the capacity) and total. Each step's few numbers go
    into the next as literals; as columns Spark would work them out again inside the loops.
    """
    earliest = f"reverse(aggregate(sequence(1, {shards - 1}), array(total), (a, k) -> array_append(a, array_min(filter(through, x -> x >= element_at(a, -1) - {capacity}L)))))"
    floors = ", ".join(f"{x}L" for x in line.select(F.expr(earliest)).first()[0])
    # Each cut is the feasible one next to an even split of what is left, behind the cut before if there is any such.
    nearest = (
        f"aggregate(sequence(1, {shards - 1}), array(0L), (a, k) -> array_append(a, "
        f"aggregate(filter(through, x -> x >= element_at(array({floors}), k) and x >= element_at(a, -1) and x - element_at(a, -1) <= {capacity}L), cast(null as bigint), "
        "(b, x) -> if(b is null or b = element_at(a, -1) or "
        f"abs((x - element_at(a, -1)) * ({shards + 1} - k) - (total - element_at(a, -1))) < abs((b - element_at(a, -1)) * ({shards + 1} - k) - (total - element_at(a, -1))), x, b))))"
    )
    return line.select(F.expr(nearest)).first()[0][1:]


def _to_divide(line: DataFrame, shards: int, capacity: int) -> list[str]:
    """The cells of several groups in which the capacity, or a cut at it, may not be that of the groups yet."""
    several = "transform(filter(parts, p -> p.several and {}), p -> p.cell)"
    large = line.select(F.expr(several.format(f"p.size > total * {LARGE_SHARE} / {shards}"))).first()[0]
    if large:
        return large
    most = line.select(F.expr("coalesce(array_max(transform(filter(parts, p -> p.several), p -> p.size)), 0L)")).first()[0]
    low = line.select(F.expr(cut_cells(max(1, capacity - most), False))).first()[0]
    high = line.select(F.expr(cut_cells(capacity, True))).first()[0]
    ends = high + [1 << 30] * len(low)
    spans = [(a, b) for a, b in zip(low, ends, strict=False)][: shards - 1]
    near = " or ".join(f"p.i between {a} and {b}" for a, b in spans)
    return line.select(F.expr(several.format(f"({near})"))).first()[0] if spans else []


def searched(rows: DataFrame, shards: int) -> tuple[DataFrame, int, int, Column]:
    """The cells (cell, cell_size, cell_rows), stored, the smallest capacity, the largest cell and the expression of a row's cell."""
    digits, divided = first_digits(shards), []
    while True:
        cell = cell_of(F.col("dig"), digits, divided)
        cells = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_rows"), (F.min("dig") < F.max("dig")).alias("several"))
        cells = stored(cells, "shard-cells")
        parts = F.array_sort(F.collect_list(F.struct("cell", F.col("cell_size").alias("size"), "several")))  # bounded by the shards
        line = cells.agg(parts.alias("parts"), F.coalesce(F.sum("cell_size"), F.lit(0)).alias("total"))
        line = line.select(F.expr("transform(parts, (p, i) -> named_struct('cell', p.cell, 'size', p.size, 'several', p.several, 'i', i))").alias("parts"), "total")
        line = stored(line.withColumn("sizes", F.transform("parts", lambda p: p["size"])), "shard-line")
        capacity, largest = line.select(F.expr(smallest_capacity(shards)), F.coalesce(F.array_max("sizes"), F.lit(0))).first()
        more = _to_divide(line, shards, capacity)
        if not more:
            return cells, capacity, largest, cell
        for name in more:
            level = (len(name) - digits) // FINER
            divided += [[] for _ in range(level + 1 - len(divided))]
            divided[level].append(name)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the capacity found, one row per row of docs."""
    rows = stored(measured(docs), "shard-rows")
    cells, capacity, largest, cell = searched(rows, shards)
    in_order = Window.orderBy("cell")  # cells, not rows
    counted = F.sum(F.least("cell_size", F.lit(capacity))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    cells = stored(cells.withColumn("cell_through", counted), "shard-through")
    line = cells.agg(F.concat(F.array(F.lit(0).cast("long")), F.array_sort(F.collect_list("cell_through"))).alias("through"), F.coalesce(F.max("cell_through"), F.lit(0)).alias("total"))
    ends = cut_points(stored(line, "shard-ends"), shards, capacity)
    placed = cells.select(
        "cell",
        "cell_rows",
        sum(((F.col("cell_through") > e).cast("int") for e in ends), F.lit(0)).alias("shard"),
        F.greatest(F.lit(1), F.ceil(F.col("cell_rows") / ROWS_PER_SALT)).alias("salts"),
    )
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(placed.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(ahead), F.lit(0))).drop("cell_rows"), "shard-cuts")
    salted = rows.withColumn("cell", cell).join(F.broadcast(placed), "cell").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))  # bounded by the shards
    counts = salted.groupBy("cell", "salt", "cell_start").agg(F.count("*").alias("n"))
    below = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell", "salt", (F.col("cell_start") + F.coalesce(F.sum("n").over(below), F.lit(0))).alias("start"))
    inside = Window.partitionBy("cell", "salt").orderBy("doc_id", "text_crc32", "size", "row")
    return salted.join(starts, ["cell", "salt"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(inside) - 1).alias("slot"), F.lit(max(capacity, largest)).alias("capacity")
    )
