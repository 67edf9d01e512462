"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks of `block_rows`; the schedule gives every slot one block. All sources flow side
by side at rates in proportion to their weights, together one block a slot, each until it has run out: block i of a
source of weight w (a share of all weights) flows from time i / w to (i + 1) / w while all sources last, and later blocks
sooner as others have run out. A block is released at the slot in which its flow begins and due before the slot in which
its flow has ended; earliest deadline first then never misses a deadline, whatever the weights, so that after any number
of slots each source has had less than one block more or less than its share.

Releases and deadlines are columns. Earliest deadline first is one fold over frames of 63 slots, whose free slots are the
bits of a long: of the blocks that are there, by deadline, each takes the first free slot from its release on. Blocks are
MOST_BLOCKS in number at most (about; each source has one at least), so the fold's row is bounded. Rows are not sorted
together and their texts are not touched.

All rows are kept. Null sources are a source of their own. Repeated rows are rows. Extra columns are not read, or pass
through. An empty table gives no rows. A source without a weight, or with none above zero, has LEAST_WEIGHT of the sum
of the others', and so follows when those have run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import written

#: Rows of a block at least, and blocks at most, about: what the order of blocks is found for.
BLOCK_ROWS, MOST_BLOCKS = 64, 1 << 20
#: Rows that are numbered together: a source of any size is dealt to as many tasks as it fills.
GROUP_ROWS = 4096
#: Default targets: shares of characters to this power, which lifts small sources.
TEMPERATURE = 0.7
#: Tables of one row a source are broadcast up to so many rows, after a count; else they are joined by shuffle.
FEW_SOURCES = 50_000
LEAST_WEIGHT = 1e-12
#: Slots of a frame, and blocks of a source whose slots go together in one row of the plan.
FRAME, RUN = 63, 1024
#: The plan is broadcast up to so many blocks (8 bytes each), after a count.
FEW_BLOCKS = 2 << 20


def tempered_weights(sizes: DataFrame, power: float = TEMPERATURE) -> DataFrame:
    """(source, weight) from (source, rows, chars)."""
    return sizes.select("source", F.pow(F.col("chars").cast("double"), F.lit(power)).alias("weight"))


def shares(sizes: DataFrame, weights: DataFrame, block_rows: int) -> DataFrame:
    """(source, rows, share, blocks): one row a source of sizes; the shares add up to 1."""
    every = Window.partitionBy(F.lit(0))  # one row a source
    named = weights.select(F.col("source").alias("__s"), F.when(F.col("weight") > 0, F.col("weight").cast("double")).alias("weight"))
    given = sizes.join(named, sizes["source"].eqNullSafe(named["__s"]), "left")
    least = F.coalesce(F.sum("weight").over(every), F.lit(1.0)) * LEAST_WEIGHT
    given = given.withColumn("weight", F.coalesce("weight", least))
    share = F.col("weight") / F.sum("weight").over(every)
    return given.select("source", "rows", share.alias("share"), F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks"))


def windows(shares: DataFrame) -> DataFrame:
    """(source, number, block, release, due): the window of each block; number is the source's place, by name.

    With V the time at which every source of weight 1 has had V blocks, a source ends at V = blocks / share, and the slots
    served until V are the blocks of the sources that have ended and V times the shares of the others."""
    every = Window.orderBy(F.col("source").isNotNull(), "source")  # one row a source
    ended = F.col("blocks") / F.col("share")
    named = shares.where("blocks > 0").select("source", "blocks", "share", ended.alias("v"), (F.row_number().over(every) - 1).alias("number"))
    by_end = Window.orderBy("v", "number")
    done = F.sum("blocks").over(by_end.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.coalesce(F.sum("share").over(by_end.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    marks = named.select("v", "share", done.alias("done"), left.alias("left")).agg(F.sort_array(F.collect_list(F.struct("v", "done", "left"))).alias("marks"), F.sum("share").alias("all"))
    # The last mark at or before V, by halving; -1 where none is.
    low = "aggregate(sequence(1, 40), named_struct('a', -1L, 'b', CAST(size(marks) AS BIGINT)), (s, k) -> IF(s.b - s.a > 1, IF(marks[(s.a + s.b) DIV 2].v <= {0}, named_struct('a', (s.a + s.b) DIV 2, 'b', s.b), named_struct('a', s.a, 'b', (s.a + s.b) DIV 2)), s)).a"
    time = "transform(array({0}), x -> IF(x < 0, {1} * all, marks[x].done + {1} * marks[x].left))[0]"
    blocks = named.select("source", "number", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(F.broadcast(marks))  # one row
    begin, end = "block / share", "(block + 1) / share"
    timed = blocks.select("source", "number", "block", F.expr(time.format(low.format(begin), begin)).alias("t0"), F.expr(time.format(low.format(end), end)).alias("t1"))
    # Times are moved by a rounding error's size, so that whole ones count as such.
    near = lambda c: F.col(c) * 1e-13 + 1e-9
    return timed.select("source", "number", "block", F.floor(F.col("t0") + near("t0")).alias("release"), F.ceil(F.col("t1") - near("t1")).alias("due"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, run, slots): the slots of a source's blocks RUN * run and following; all slots are 0, 1, 2 and so on.

    A block is a code: its place by deadline (then source), above 31 bits of its release. A frame's codes are sorted with
    those that earlier frames left, and take slots in this order."""
    blocks = windows(shares)
    sorted_ = blocks.agg(F.sort_array(F.collect_list(F.struct("due", "number", "block", "release", "source"))).alias("all"))
    placed = written(sorted_.select(F.posexplode("all").alias("p", "x")).select("p", "x.source", "x.block", "x.release"), "windows")
    code = F.shiftleft(F.col("p").cast("long"), 31).bitwiseOR(F.col("release"))
    frames = placed.groupBy(F.floor(F.col("release") / FRAME).alias("f")).agg(F.sort_array(F.collect_list(code)).alias("codes"))
    one = frames.agg(F.map_from_entries(F.collect_list(F.struct("f", "codes"))).alias("of"), F.sum(F.size("codes")).cast("long").alias("total")).where("total > 0")
    none = "CAST(array() AS ARRAY<BIGINT>)"
    got = "CAST(array() AS ARRAY<STRUCT<slot: INT, code: BIGINT>>)"
    free = f"s.free & shiftleft(-1L, CAST(greatest((c & 2147483647L) - f * {FRAME}, 0L) AS INT))"
    take = "named_struct('free', s.free ^ (m & -m), 'got', concat(s.got, array(named_struct('slot', CAST(bit_count((m & -m) - 1L) AS INT), 'code', c))))"
    # Slots of the frame that the schedule has, as bits.
    whole = f"shiftrightunsigned({(1 << FRAME) - 1}L, CAST({FRAME} - least({FRAME}L, total - f * {FRAME}) AS INT))"
    dealt = f"aggregate(here, named_struct('free', {whole}, 'got', {got}), (s, c) -> IF(s.free = 0L, s, transform(array({free}), m -> IF(m = 0L, s, {take}))[0])).got"
    after = "named_struct('left', array_except(here, transform(g, x -> x.code)), 'out', concat(st.out, array(transform(array_sort(g), x -> x.code))))"
    step = f"transform(array(array_sort(concat(st.left, coalesce(of[f], {none})))), here -> transform(array({dealt}), g -> {after})[0])[0]"
    start = f"named_struct('left', {none}, 'out', CAST(array() AS ARRAY<ARRAY<BIGINT>>))"
    folded = one.select(F.expr(f"aggregate(sequence(0L, (total - 1) DIV {FRAME}L), {start}, (st, f) -> {step}).out").alias("frames"))
    apart = folded.select(F.posexplode("frames").alias("f", "frame")).select("f", F.posexplode("frame").alias("i", "code"))
    slots = apart.select(F.shiftright("code", 31).cast("int").alias("p"), (F.col("f").cast("long") * FRAME + F.col("i")).alias("slot"))
    by_run = placed.join(slots, "p").groupBy("source", F.floor(F.col("block") / RUN).alias("run"))
    return by_run.agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # a source's slots rise with its blocks


def _beside(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of a table of one row a source; the table is broadcast where its count allows it."""
    right = table.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(right) if small else right, rows["source"].eqNullSafe(right["__s"])).drop("__s")


def number_in_source(rows: DataFrame, sizes: DataFrame, small: bool, order: list[Column]) -> DataFrame:
    """Adds `__n`, the row's number within its source, from 0.

    A source's rows are dealt by hash into groups of about GROUP_ROWS; windows number the rows inside groups, and a
    running count over the groups, one row each, gives their bases."""
    dealt = _beside(rows, sizes.select("source", F.col("rows").alias("__rows")), small)
    dealt = dealt.withColumn("__g", F.pmod(F.xxhash64(*order), F.ceil(F.col("__rows") / GROUP_ROWS))).drop("__rows")
    groups = dealt.groupBy("source", "__g").agg(F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select(F.col("source").alias("__s"), F.col("__g").alias("__h"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__base"))
    numbered = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("source", "__g").orderBy(*order)) - 1)
    on = numbered["source"].eqNullSafe(bases["__s"]) & (numbered["__g"] == bases["__h"])
    return numbered.join(bases, on).withColumn("__n", F.col("__i") + F.col("__base")).drop("__s", "__h", "__g", "__i", "__base")


def placed(rows: DataFrame, docs: DataFrame, order: list[Column], weights: DataFrame | None, block_rows: int | None) -> DataFrame:
    """rows (with a source) and their block, slot, place and weight."""
    lengths = F.coalesce(F.char_length("text"), F.lit(0)) + 1
    sizes = written(docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum(lengths.cast("long")).alias("chars")), "sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    small, block_rows = n <= FEW_SOURCES, block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    weights = tempered_weights(sizes) if weights is None else weights
    targets = written(shares(sizes, weights, block_rows), "shares")
    plan = written(schedule(targets), "schedule")
    few = (targets.agg(F.sum("blocks")).first()[0] or 0) <= FEW_BLOCKS
    at = _beside(number_in_source(rows, sizes, small, order), targets.select("source", F.col("share").alias("weight")), small)
    at = at.withColumn("block", F.floor(F.col("__n") / block_rows).cast("long")).withColumn("__run", F.floor(F.col("block") / RUN))
    runs = plan.select(F.col("source").alias("__s"), F.col("run").alias("__r"), "slots")
    at = at.join(F.broadcast(runs) if few else runs, at["source"].eqNullSafe(runs["__s"]) & (at["__run"] == runs["__r"]))
    at = at.withColumn("slot", F.get("slots", (F.col("block") % RUN).cast("int")))
    return at.withColumn("place", (F.col("__n") % block_rows).cast("long")).drop("__n", "__run", "__s", "__r", "slots")


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, block, slot, place (in its block), weight (its source's target share).

    (slot, place) is the mixed order, without ties. weights: (source, weight), tempered sizes by default."""
    light = docs.select("doc_id", "source", F.xxhash64("text").alias("__t"))
    out = placed(light, docs, [F.col("doc_id"), F.col("__t")], weights, block_rows)
    return out.select("doc_id", "source", "block", "slot", "place", "weight")


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """All rows and columns of docs in mixed order, which is the order of its partitions and so of files written of it."""
    columns = docs.columns
    whole = docs.select("source", F.xxhash64("doc_id", "text").alias("__t"), F.col("doc_id").alias("__id"), F.struct(*columns).alias("__row"))
    out = placed(whole, docs, [F.col("__id"), F.col("__t")], weights, block_rows)
    return out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("__row.*")
