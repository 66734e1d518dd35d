"""What the training-data operators share: words, shared scratch tables, streamed groups, components."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; a word is a maximal run of anything else.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a missing identifier where rows are put in order: after all others.
LAST_ID = 2**63 - 1


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session without one gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="veridoc-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _made:
        made.append(path)
    trim(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Scratch tables of the operators under way, innermost last.
_made: list[list[str]] = []


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes the scratch tables that a finished operator wrote and its result doesn't read."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _made.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            own = _made.pop()
        read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
        remove_tables(out.sparkSession, [p for p in own if p.rsplit("/", 1)[-1] not in read])
        return out

    return run


def columns_of(docs: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Names of columns but for those that give way to a result's, whatever their case."""
    return [c for c in docs.columns if c.lower() not in without]


def col(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(names: list[str]) -> Column:
    """The columns of these names as one struct `row`, so that none can clash with an operator's own."""
    return F.struct(*[col(c).alias(c) for c in names]).alias("row")


def field(name: str) -> Column:
    """A column out of the struct `row`."""
    return F.col("row").getField(name).alias(name)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop shuffle files of finished steps: it goes by the driver's garbage collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Give heap back once over half of what the driver may have is taken.

    Plans of many small steps leave far more garbage than they hold; the virtual machine makes the heap larger rather
    than collect it, up to its limit, and only a full collection makes it smaller again.
    """
    runtime = spark.sparkContext._jvm.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        release(spark)


#: Keys that hold more than one in so many of all rows are joined where the rows lie.
HOT = 1024


def join_spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose column n says how many rows have the key.

    At most HOT keys can hold more than one in HOT of the rows counted by n; those are broadcast, so that none of
    them meets its rows in one task, and the others are joined by a shuffle. n is dropped.
    """
    share = (table.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(table.where(F.col("n") > share).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") <= share).drop("n"), key)
    both = rows.join(hot, key)
    return both.select(*cold.columns).union(cold)


def stream_groups(df: DataFrame, keys: list[str], fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Call fn(table) on runs of whole groups of `keys`, as pyarrow tables sorted by the keys.

    One shuffle and one sort; a task holds one run of Arrow batches and at most one unfinished group, so groups
    that aren't bounded have to be split by the caller.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            same = None
            for k, v in zip(keys, last, strict=True):
                hit = pc.equal(batch.column(k), v)
                same = hit if same is None else pc.and_(same, hit)
            rest = pc.sum(same).as_py()
            if rest == batch.num_rows:
                continue
            table = pa.Table.from_batches(held)
            cut = table.num_rows - rest
            held = table.slice(cut).combine_chunks().to_batches()
            yield from fn(table.slice(0, cut).combine_chunks())
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks())

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


#: Edges up to which a round of components is one task's work: a few longs each.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) of every node named in edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps over long columns; every round is a minimum per node, combined
    before the shuffle, and a join, so a hub's neighbours never meet in one list. Each round is written to the
    shared folder. A round over at most `few` edges is one task without a shuffle: dealt out, it would leave the driver
    with plans, stages and tasks by the hundred for next to no work. Self loops are allowed and name their node.
    """
    cur = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    loops = cur.where("u = v").select(F.col("u").alias("node"))
    alone = cur.count() <= few
    cur = cur.where("u <> v")

    def near(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if alone else df

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.hint("merge") if alone else right, "u")

    before = None
    for _ in range(rounds):
        both = near(cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = met(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = met(large, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(near(small.union(low.select("u", F.col("m").alias("v")))).where("u <> v").select("v", "u").distinct())
        now = tuple(near(cur).agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            break
        before, alone = now, now[0] <= few
    else:
        raise RuntimeError("components did not settle")
    named = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return named.union(roots).union(loops.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
