"""Permutation and bootstrap bands with hash-ordered, reproducible draws.

The order of a simulation is the order of a key of its own for every trade: a cubic polynomial,
modulo a prime, of a number that the trade's identity gives, with coefficients from seed and
simulation. Trades are held in blocks of bounded size. A run of one block has all its simulations
on it. A larger run is dealt into random blocks anew for each chunk of simulations; a simulation
then orders the blocks and the trades of each by its keys.

A run of up to HELD trades goes to a few tasks, each of which holds it and deals its blocks itself:
a task has a range of trade indices with all simulations, so paths never leave it. A still larger run
is dealt by a shuffle. A block's sum and highest prefix are enough to say where the next ones start,
so its blocks are walked apart, and no task holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: The prime of the keys, trades in a block, simulations that share a deal, indices in a slice of bands.
PRIME, BLOCK, CHUNK, SLICE = 2**31 - 1, 1 << 16, 25, 1024
#: Trades of a run that one task may hold: about 40 bytes each while they are dealt.
HELD = 1 << 25
#: Tasks that share the held runs, for each core.
TASKS = 2
#: Partitions of dealt trades for each shuffle partition: the deals hold every trade once for each chunk.
SPREAD = 8
BANDS = (5, 25, 50, 75, 95)


def coefficients(*names) -> list[int]:
    """Four coefficients below the prime, from the md5 of the names."""
    text = hashlib.md5("|".join(map(str, names)).encode()).hexdigest()
    return [int(text[i : i + 8], 16) % PRIME for i in (0, 8, 16, 24)]


def keys_of(numbers: np.ndarray, names: tuple) -> np.ndarray:
    """The polynomial's value for each of ``numbers`` (below the prime)."""
    a, b, c, d = coefficients(*names)
    numbers = numbers.astype(np.int64)
    keys = a * numbers
    # In place: new arrays for the steps take longer than the steps.
    for x in (b, c):
        keys += x
        keys %= PRIME
        keys *= numbers
    keys += d
    keys %= PRIME
    return keys


def _marked(trades: DataFrame, capital: Column, trade_key: list[str], by: list[str]) -> DataFrame:
    """Trades as by, pnl, capital, mark, rest: the halves of the md5 of their identity."""
    text = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in trade_key]).cast("binary"))
    half = [F.conv(F.substring(text, i, 16), 16, -10).cast("bigint") for i in (1, 17)]
    return trades.select(*by, F.col("pnl_net").alias("pnl"), capital.cast("double").alias("capital"), half[0].alias("mark"), half[1].alias("rest"))


def _by_size(rows: DataFrame, units: Column, by: list[str], held: int) -> tuple[DataFrame, DataFrame | None]:
    """Trades of runs that a task may hold, once for each task of their run (with part, parts); trades of larger runs.

    ``units``: into how many parts the work on a run of ``n`` trades can be cut. Runs get tasks by their size.
    """
    c, spark = F.col, rows.sparkSession
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    share = F.ceil(c("n") * (TASKS * spark.sparkContext.defaultParallelism) / (total or 1))
    small = sizes.where(c("n") <= held).select(*by, F.greatest(F.lit(1), F.least(units, share)).cast("int").alias("parts"))
    shared = rows.join(small, by).withColumn("part", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
    shared = shared.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), *by, "part")
    return shared, rows.join(sizes.where(c("n") > held), by, "left_semi") if (most or 0) > held else None


def _dealt(trades: DataFrame, capital: Column, sims: int, seed: int, trade_key: list[str], by: list[str], block: int, chunk: int) -> DataFrame:
    """Trades once for each chunk of simulations, dealt by their block there: by, chunk, block, n_blocks, capital, mark, rest, pnl.

    ``mark`` and ``rest`` are the halves of the trade's md5. Trades stay rows, which Spark sorts and
    spills, until a task reads one block of them.
    """
    return _dealt_rows(_marked(trades, capital, trade_key, by), sims, seed, by, block, chunk)


def _dealt_rows(rows: DataFrame, sims: int, seed: int, by: list[str], block: int, chunk: int) -> DataFrame:
    c = F.col
    chunks = -(-sims // chunk)
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    rows = rows.join(sizes, by).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    values = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in coefficients(seed, "deal", g)]) for g in range(chunks)])
    a, b, cc, d = (F.get(F.get(values, c("chunk")), F.lit(i)) for i in range(4))
    k = F.shiftrightunsigned("mark", 32) % PRIME
    dealt = (((a * k + b) % PRIME * k + cc) % PRIME * k + d) % PRIME
    rows = rows.withColumn("block", F.floor(dealt * c("n_blocks") / PRIME).cast("int"))
    parts = SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by, "chunk", "block")


def _in_order(mark: np.ndarray, rest: np.ndarray, pnl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and P&L of trades in the order of their md5."""
    first, rest = mark.view(np.uint64), rest.view(np.uint64)
    order = np.lexsort((pnl, rest, first))
    return ((first[order] >> np.uint64(32)) % np.uint64(PRIME)).astype(np.int32), pnl[order]


def _running(numbers: np.ndarray, pnl: np.ndarray, names: tuple) -> np.ndarray:
    """Running P&L in the order of the keys of ``names``."""
    # Key and place in one number: equal keys keep the order of their md5.
    order = keys_of(numbers, names)
    order <<= 32
    order |= np.arange(len(order))
    order.sort()
    order &= 0xFFFFFFFF
    return np.cumsum(pnl[order])


class _Held:
    """One run's trades in a task, and the blocks of one chunk of simulations after another."""

    def __init__(self, batches: Iterator[pa.RecordBatch], seed: int, block: int):
        columns = []
        for batch in (b for b in batches if b.num_rows):
            self.capital, self.parts = (batch.column(n)[0].as_py() for n in ("capital", "parts"))
            # Copies, so that the batch with its other columns can go.
            columns.append([batch.column(n).to_numpy(zero_copy_only=False).copy() for n in ("mark", "rest", "pnl")])
        self.numbers, self.pnl = _in_order(*map(np.concatenate, zip(*columns)))
        self.seed, self.n_blocks = seed, -(-len(self.pnl) // block)

    def deal(self, number: int) -> None:
        """Deal the blocks of chunk ``number``."""
        mine = np.zeros(len(self.pnl), np.uint8)
        if self.n_blocks > 1:
            keys = keys_of(self.numbers, (self.seed, "deal", number))
            keys *= self.n_blocks
            keys //= PRIME
            mine = keys.astype(np.min_scalar_type(self.n_blocks))
        order = np.argsort(mine, kind="stable")
        self.sizes = np.bincount(mine, minlength=self.n_blocks)
        self.sums = np.bincount(mine, weights=self.pnl, minlength=self.n_blocks)
        cuts = np.cumsum(self.sizes)[:-1]
        self.blocks = list(zip(np.split(self.numbers[order], cuts), np.split(self.pnl[order], cuts)))

    def order(self, sim: int) -> np.ndarray:
        """The blocks in the simulation's order."""
        return np.argsort(keys_of(np.arange(1, self.n_blocks + 1), (self.seed, sim)), kind="stable")

    def running(self, block: int, sim: int) -> np.ndarray:
        return _running(*self.blocks[block], (self.seed, sim))


def _walks(block: pa.Table, number: int, sims: int, seed: int, chunk: int) -> Iterator[tuple]:
    """(sim, running P&L in the simulation's order) of one block for the simulations of chunk ``number``."""
    numbers, pnl = _in_order(*[block.column(n).to_numpy() for n in ("mark", "rest", "pnl")])
    for sim in range(number * chunk, min(sims, (number + 1) * chunk)):
        yield sim, _running(numbers, pnl, (seed, sim))


def _carried(blocks: DataFrame, sims: int, seed: int, by: list[str], chunk: int) -> DataFrame:
    """What comes before each block of a run of several: by, chunk, block, sim, start (equity), peak, at (trades)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    c = F.col
    schema = T.StructType(
        [*[blocks.schema[k] for k in by], T.StructField("chunk", T.IntegerType()), T.StructField("block", T.IntegerType())]
        + [T.StructField("sim", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType())]
        + [T.StructField(x, T.DoubleType()) for x in ("sum", "high", "capital")]
    )
    arrow = to_arrow_schema(schema)

    def summed(key: tuple, block: pa.Table) -> pa.Table:
        out, at = [], dict(zip([*by, "chunk", "block"], (k.as_py() for k in key)))
        if block.column("n_blocks")[0].as_py() > 1:
            capital = block.column("capital")[0].as_py()
            for sim, walk in _walks(block, at["chunk"], sims, seed, chunk):
                place = int(keys_of(np.array([at["block"] + 1]), (seed, sim))[0])
                out.append(at | {"sim": sim, "place": place, "n": len(walk), "sum": float(walk[-1]), "high": float(walk.max()), "capital": capital})
        return pa.Table.from_pylist(out, schema=arrow)

    several = blocks.groupBy(*by, "chunk", "block").applyInArrow(summed, schema)
    before = Window.partitionBy(*by, "sim").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    several = several.withColumn("start", c("capital") + F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    several = several.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    several = several.withColumn("peak", F.greatest(c("capital"), F.coalesce(F.max(c("start") + c("high")).over(before), c("capital"))))
    return several.select(*by, "chunk", "block", "sim", "start", "peak", "at")


def _walked(blocks: DataFrame, sims: int, seed: int, by: list[str], chunk: int, emit, schema: T.StructType) -> DataFrame:
    """``emit(sim, first trade index, equity, peak, capital)`` gives the columns behind ``by`` for every simulated block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def walk(key: tuple, block: pa.Table, carry: pa.Table) -> pa.Table:
        capital = block.column("capital")[0].as_py()
        before = {x["sim"]: x for x in carry.select(["sim", "start", "peak", "at"]).to_pylist()}
        out = []
        for sim, run in _walks(block, key[len(by)].as_py(), sims, seed, chunk):
            prior = before.get(sim, {"start": capital, "peak": capital, "at": 0})
            equity = prior["start"] + run
            peak = np.maximum(prior["peak"], np.maximum.accumulate(equity))
            columns = emit(sim, prior["at"], equity, peak, capital)
            out.append(pa.RecordBatch.from_arrays([*[pa.repeat(k, len(columns[0])) for k in key[: len(by)]], *columns], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    keys = [*by, "chunk", "block"]
    return blocks.groupBy(*keys).cogroup(_carried(blocks, sims, seed, by, chunk).groupBy(*keys)).applyInArrow(walk, schema)


def _schema(trades: DataFrame, by: list[str], **kinds: T.DataType) -> T.StructType:
    return T.StructType([*[trades.schema[k] for k in by], *[T.StructField(n, k) for n, k in kinds.items()]])


def shuffle_bands(
    trades: DataFrame, capital: Column, sims: int, seed: int, trade_key: list[str], by=("run_id",), block: int = BLOCK, chunk: int = CHUNK, held: int = HELD
) -> DataFrame:
    """p5, p25, p50, p75, p95 of equity per trade index over all simulations: by, trade_index, p5 ...

    ``trade_key`` identifies a trade within its run. A task that holds its run takes ranges of as many
    indices as a block has. Of larger runs the simulations meet in slices of the index.
    """
    by = list(by)
    rows = cut_lineage(_marked(trades, capital, trade_key, by))
    ranks = {f"p{p}": int(np.floor(p / 100 * (sims - 1) + 0.5)) for p in BANDS}
    shared, larger = _by_size(rows, F.ceil(F.col("n") / block), by, held)
    done = _held_bands(shared, by, sims, seed, block, chunk, ranks)
    return done if larger is None else done.unionByName(_dealt_bands(larger, by, sims, seed, block, chunk, ranks))


def _held_bands(shared: DataFrame, by: list[str], sims: int, seed: int, block: int, chunk: int, ranks: dict[str, int]) -> DataFrame:
    """Bands of held runs: a group has every ``parts``-th range of indices, and one range of all simulations at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(shared, by, trade_index=T.LongType(), **dict.fromkeys(ranks, T.DoubleType()))
    arrow = to_arrow_schema(schema)

    def bands(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Held(batches, seed, block)
        n = len(run.pnl)
        for first in range(key[-1].as_py() * block, n, run.parts * block):
            end = min(n, first + block)
            grid = np.empty((sims, end - first))
            for sim in range(sims):
                if sim % chunk == 0:
                    run.deal(sim // chunk)
                order = run.order(sim)
                ends = np.cumsum(run.sizes[order])
                begins = ends - run.sizes[order]
                before = np.cumsum(np.append(0.0, run.sums[order]))
                for i in np.flatnonzero((ends > first) & (begins < end)):
                    low, high = max(first, begins[i]), min(end, ends[i])
                    walk = run.running(order[i], sim)[low - begins[i] : high - begins[i]]
                    grid[sim, low - first : high - first] = run.capital + before[i] + walk
            for at in range(0, end - first, SLICE):
                best = _in_rank(grid[:, at : at + SLICE], ranks)
                index = pa.array(np.arange(first + at, first + at + len(best[0])))
                yield pa.RecordBatch.from_arrays([*[pa.repeat(k, len(index)) for k in key[:-1]], index, *map(pa.array, best)], schema=arrow)

    return shared.groupBy(*by, "part").applyInArrow(bands, schema)


def _in_rank(grid: np.ndarray, ranks: dict[str, int]) -> list[np.ndarray]:
    """For each column, its values of the given ranks."""
    # One column's values side by side: sorting them there takes less than selecting them apart.
    ordered = np.sort(np.ascontiguousarray(grid.T), axis=1)
    return [ordered[:, k].copy() for k in ranks.values()]


def _dealt_bands(rows: DataFrame, by: list[str], sims: int, seed: int, block: int, chunk: int, ranks: dict[str, int]) -> DataFrame:
    """Bands of runs that no task holds; their paths are shuffled."""
    trades = _dealt_rows(rows, sims, seed, by, block, chunk)
    schema = _schema(trades, by, slice=T.LongType(), sim=T.IntegerType(), offset=T.IntegerType(), values=T.ArrayType(T.DoubleType()))

    def sliced(sim, first, equity, peak, capital):
        numbers = np.arange(first // SLICE, (first + len(equity) - 1) // SLICE + 1)
        starts = np.maximum(numbers * SLICE, first)
        offsets = pa.array(np.append(starts - first, len(equity)).astype(np.int32))
        values = pa.ListArray.from_arrays(offsets, pa.array(equity))
        return [pa.array(numbers), pa.repeat(pa.scalar(sim, pa.int32()), len(numbers)), pa.array((starts % SLICE).astype(np.int32)), values]

    paths = _walked(trades, sims, seed, by, chunk, sliced, schema)
    return _ranked(paths, by, sims, ranks, "trade_index")


def _ranked(paths: DataFrame, by: list[str], sims: int, ranks: dict[str, int], index: str) -> DataFrame:
    """For each index, the values of the given ranks (from 0) among all simulations.

    ``paths``: by, slice, sim, offset, values. A group is one slice: SLICE values
    for each simulation, however large the run.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _schema(paths, by, **{index: T.LongType()}, **dict.fromkeys(ranks, T.DoubleType()))
    arrow = to_arrow_schema(out)

    def ranked(key: tuple, slices: pa.Table) -> pa.Table:
        grid, width = np.empty((sims, SLICE)), 0
        for batch in slices.select(["sim", "offset", "values"]).to_batches():
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
            for r, (sim, offset) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                size = ends[r + 1] - ends[r]
                grid[sim, offset : offset + size] = flat[ends[r] : ends[r + 1]]
                width = max(width, offset + size)
        first = key[-1].as_py() * SLICE
        columns = [pa.array(np.arange(first, first + width)), *map(pa.array, _in_rank(grid[:, :width], ranks))]
        return pa.Table.from_arrays([*[pa.repeat(k, width) for k in key[:-1]], *columns], schema=arrow)

    return paths.groupBy(*by, "slice").applyInArrow(ranked, out)


def _held_ends(shared: DataFrame, by: list[str], sims: int, seed: int, block: int, chunk: int) -> DataFrame:
    """Final equity and drawdown of every simulation of held runs; a group has every ``parts``-th chunk of simulations."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(shared, by, sim=T.IntegerType(), final=T.DoubleType(), mdd=T.DoubleType(), capital=T.DoubleType(), n_trades=T.LongType())
    arrow = to_arrow_schema(schema)

    def ends(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, keys = _Held(batches, seed, block), [k.as_py() for k in key[:-1]]
        for number in range(key[-1].as_py(), -(-sims // chunk), run.parts):
            run.deal(number)
            out = []
            for sim in range(number * chunk, min(sims, (number + 1) * chunk)):
                final, top, mdd = run.capital, run.capital, 0.0
                for i in run.order(sim):
                    if not run.sizes[i]:
                        continue
                    equity = final + run.running(i, sim)
                    peak = np.maximum(top, np.maximum.accumulate(equity))
                    mdd = np.maximum(mdd, _drops(equity, peak).max())
                    final, top = equity[-1], peak[-1]
                out.append([*keys, sim, float(final), float(mdd), run.capital, len(run.pnl)])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), arrow.types)], schema=arrow)

    return shared.groupBy(*by, "part").applyInArrow(ends, schema)


def _drops(equity: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """Distance from the peak in percent; nothing where the peak is not above zero."""
    drops = np.divide(peak - equity, peak, out=np.zeros_like(equity), where=peak > 0)
    drops *= 100
    return drops


def _dealt_ends(rows: DataFrame, by: list[str], sims: int, seed: int, block: int, chunk: int) -> DataFrame:
    """Final equity and drawdown of every simulation of runs that no task holds, block by block."""
    schema = _schema(
        rows, by, sim=T.IntegerType(), last=T.LongType(), final=T.DoubleType(), mdd=T.DoubleType(), capital=T.DoubleType()
    )

    def reduced(sim, first, equity, peak, capital):
        row = [(sim, pa.int32()), (first + len(equity) - 1, pa.int64()), (float(equity[-1]), pa.float64()), (float(_drops(equity, peak).max()), pa.float64()), (capital, pa.float64())]
        return [pa.array([value], kind) for value, kind in row]

    parts = _walked(_dealt_rows(rows, sims, seed, by, block, chunk), sims, seed, by, chunk, reduced, schema)
    return parts.groupBy(*by, "sim").agg(
        F.max_by("final", "last").alias("final"), F.max("mdd").alias("mdd"), F.max("capital").alias("capital"), (F.max("last") + 1).alias("n_trades")
    )


def shuffle_summary(
    trades: DataFrame, runs: DataFrame, capital: Column, sims: int, seed: int, trade_key: list[str], by=("run_id",), block: int = BLOCK, chunk: int = CHUNK, held: int = HELD
) -> DataFrame:
    """Final equity and drawdown percentiles and loss odds per run; runs without trades get
    their capital and zeros. Simulations are reduced where they are walked."""
    c, by = F.col, list(by)
    rows = cut_lineage(_marked(trades, capital, trade_key, by))
    shared, larger = _by_size(rows, F.lit(-(-sims // chunk)), by, held)
    ended = _held_ends(shared, by, sims, seed, block, chunk)
    if larger is not None:
        ended = ended.unionByName(_dealt_ends(larger, by, sims, seed, block, chunk))
    w = Window.partitionBy(*by)
    ranked = (
        cut_lineage(ended).withColumn("_rf", F.row_number().over(w.orderBy("final", "sim")))
        .withColumn("_rm", F.row_number().over(w.orderBy("mdd", "sim")))
        .withColumn("_n", F.count(F.lit(1)).over(w))
    )

    def at(rank: str, value: str, p: float) -> Column:
        slot = F.floor(F.lit(p / 100.0) * (c("_n") - 1) + 0.5) + 1
        return F.max(F.when(c(rank) == slot, c(value)))

    n = F.count(F.lit(1))
    done = ranked.groupBy(*by).agg(
        *[at("_rf", "final", p).alias(f"p{p}") for p in BANDS],
        *[at("_rm", "mdd", p).alias(f"mdd_p{p}") for p in (50, 95)],
        (F.count_if(c("final") > c("capital")) / n).alias("prob_positive_return"),
        (F.count_if(c("mdd") > 10) / n).alias("prob_mdd_gt_10pct"),
        (F.count_if(c("mdd") > 20) / n).alias("prob_mdd_gt_20pct"),
        n.alias("n_simulations"), F.max("n_trades").alias("n_trades"),
    )
    j = runs.select(*by, "capital").join(done, by, "left")
    return j.select(
        *by,
        *[F.coalesce(f"p{p}", "capital").alias(f"final_p{p}") for p in BANDS],
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("mdd_p50", "mdd_p95", "prob_positive_return", "prob_mdd_gt_10pct", "prob_mdd_gt_20pct")],
        F.coalesce("n_simulations", F.lit(0)).alias("n_simulations"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
    )


def bootstrap_bands(series: DataFrame, start: Column, paths: int, seed: int, by=("run_id",), chunk: int = CHUNK) -> DataFrame:
    """p5, p50, p95 per step of compounded paths whose returns are drawn with replacement.

    ``series`` has (by, date, daily_return): one row per day, so a path is as long as the
    calendar and a run's returns are one array. Step 0 is the start; each later step draws return
    number md5(seed | path | step) mod n. A return of -100% or worse ends the path at zero.
    """
    c, by = F.col, list(by)
    known = series.where(c("daily_return").isNotNull()).select(*by, start.cast("double").alias("start"), F.struct("date", c("daily_return").alias("r")).alias("at"))
    runs = known.groupBy(*by).agg(F.max("start").alias("start"), F.transform(F.array_sort(F.collect_list("at")), lambda x: x["r"]).alias("returns"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-paths // chunk) - 1))).alias("chunk")
    runs = runs.select(*by, "start", "returns", chunks).repartition(*by, "chunk")
    schema = _schema(series, by, slice=T.LongType(), sim=T.IntegerType(), offset=T.IntegerType(), values=T.ArrayType(T.DoubleType()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for r in range(batch.num_rows):
                first, number = (batch.column(names.index(n))[r].as_py() for n in ("start", "chunk"))
                returns = batch.column(names.index("returns"))[r].values.to_numpy(zero_copy_only=False)
                keys, n, out = {k: batch.column(names.index(k))[r].as_py() for k in by}, len(returns), []
                for path in range(number * chunk, min(paths, (number + 1) * chunk)):
                    head = f"{seed}|{path}|".encode()
                    pick = [int(hashlib.md5(head + b"%d" % (i + 1)).hexdigest()[:8], 16) % n for i in range(n)]
                    drawn = returns[pick]
                    alive = np.cumsum(drawn <= -1) == 0
                    growth = np.exp(np.cumsum(np.log(np.where(drawn > -1, 1 + drawn, 1.0))))
                    equity = np.concatenate(([first], first * np.where(alive, growth, 0.0)))
                    out += [keys | {"slice": at // SLICE, "sim": path, "offset": 0, "values": equity[at : at + SLICE]} for at in range(0, n + 1, SLICE)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ranks = {f"p{p}": int(p / 100 * (paths - 1)) for p in (5, 50, 95)}
    return _ranked(runs.mapInArrow(walk, schema), by, paths, ranks, "step")
