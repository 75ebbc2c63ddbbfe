"""Shared helpers: scratch tables in the cluster's shared folder, hashes, filters, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every character that ends a word: space and \t \n \v \f \r. bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8; none for null."""
    return text.encode().split() if text else []


def hash64(data: bytes) -> int:
    """A signed 64-bit hash, as Spark's long holds it."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >= 1 << 63 else h


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, without a Python integer for each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes, from hashes of parts whose lengths are powers of two."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, mix(h + np.uint64(n)), 1
    while True:
        if n & size:
            piece = part[done : done + m]
            out = piece if out is None else joined_hash(out, piece)
            done += size
        if done == n:
            return out
        part = joined_hash(part[: len(part) - size], part[size:])
        size *= 2


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one of our own.

    A folder of our own is on this machine, so only a local master may use one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="voxlake-")
            spark.sparkContext.setCheckpointDir(base)
            atexit.register(drop_path, spark, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/voxlake-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder by Hadoop's file system; a session that has ended leaves it to the cluster's cleaner."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "t", *, texts: bool = False) -> DataFrame:
    """Write once to the shared folder and read again: cuts the lineage, survives lost executors.

    texts: whole texts go to Python on the way, in smaller batches than the session's.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with few_rows_a_batch(spark) if texts else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the scratch tables of materialize() that nothing will read again."""
    for df in frames:
        drop_path(df.sparkSession, df._scratch)


# ---------------------------------------------------------------- Arrow


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows from row tuples."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole documents travel in smaller Arrow batches than Spark's 10,000 rows for the jobs run inside; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(it: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a stream of batches: what Python objects are made of at a time stays small."""
    for b in it:
        for s in range(0, b.num_rows, size):
            yield b.slice(s, size)


def map_rows(df: DataFrame, each: Callable[..., Iterator[tuple]], ddl: str) -> DataFrame:
    """each(*values of one row) yields output rows; Arrow batches in and out."""

    schema = arrow_schema(ddl)

    def run(it):
        def rows():
            for b in pieces(it):
                for values in zip(*(c.to_pylist() for c in b.columns)):
                    yield from each(*values)

        yield from batches_of(rows(), schema)

    return df.mapInArrow(run, ddl)


def groups_of(it: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal keys in a stream of batches sorted by `key`; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for s, e in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[s] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        yield last, pa.Table.from_batches(held)


def by_groups(df: DataFrame, each: Callable[[object, pa.Table], Iterator[tuple]], ddl: str, key: str = "key") -> DataFrame:
    """each(key, rows) for every group of an integer key; groups are bounded by what built the key."""

    schema = arrow_schema(ddl)

    def run(it):
        yield from batches_of((r for k, t in groups_of(it, key) for r in each(k, t)), schema)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, ddl)


# ---------------------------------------------------------------- filters

#: Bits of a filter a key, and the least and the most bits of one: 2^27 bits are 16 MB, whatever the input's size.
BITS_A_KEY, LEAST_BITS, MOST_BITS, PROBES = 32, 1 << 20, 1 << 27, 4


def _places(h, mask):
    """The bits of a 64-bit hash: steps of its upper half from its lower one."""
    return [(h + i * (h >> 32)) & mask for i in range(PROBES)]


def bit_filter(df: DataFrame, col: str) -> bytes:
    """A Bloom filter over a column of 64-bit hashes, sized by the number of its rows (df should be a scratch table).

    It saves shuffling rows that can't match: two of 10,000 others pass. From four million keys on it is as large as it
    gets and lets more rows pass; the exact join behind it decides at every size.
    """
    bits = 1 << max(LEAST_BITS, min(MOST_BITS, BITS_A_KEY * df.count())).bit_length() - 1
    step = F.call_function("shiftright", F.col(col), F.lit(32))
    low = F.col(col).bitwiseAND(F.lit(bits - 1))
    at = F.explode(F.array(*[(low + F.lit(i).cast("long") * step).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]))
    word, bit = (F.col("at") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    held = df.select(at.alias("at")).select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)  # one row a word: 2^21 at most
    words[held.column("w").to_numpy()] = held.column("b").to_numpy()
    return words.tobytes()


def in_filter(bits: np.ndarray, h: int) -> bool:
    """Whether a hash may be among those of bit_filter()."""
    return all((int(bits[at >> 6]) >> (at & 63)) & 1 for at in _places(h, len(bits) * 64 - 1))


def in_filter_all(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """in_filter() for an array of signed hashes."""
    out = np.ones(len(h), bool)
    for at in _places(h, np.int64(len(bits) * 64 - 1)):
        out &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return out


# ---------------------------------------------------------------- connected components


#: Edges whose forest one task finds at a time.
EDGES = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, tops): the ends of some edges, and the least node that these edges connect each to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while ((p := top[x]) != (q := top[y])).any():
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (up := top[top]).tolist() != top.tolist():
            top = up
    return nodes, nodes[top]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Contraction in rounds, whose rows are the edges still open and not all edges again.

    Each task first replaces every EDGES of its edges by stars around their least nodes. If the edges left are no more than
    that, this is all. Else every node goes to a neighbour or stays (the least by a hash that differs by round, which
    leaves a constant share of the nodes whatever the graph's shape), and edges between the nodes that are left are the next
    round's. A round is an aggregate (combined before its shuffle) and joins that AQE may split.
    """
    left = edges if hasattr(edges, "_scratch") and (a, b) == ("a", "b") else materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    own, steps, schema = left is not edges, [], arrow_schema("node long, top long")
    while True:
        n = left.count()
        whole = n <= EDGES

        def reduced(it, most=EDGES, whole=whole):
            held, rows = [], 0

            def out():
                nodes, tops = stars(*(np.concatenate([np.asarray(x[k]) for x in held]) for k in (0, 1)))
                keep = slice(None) if whole else nodes != tops
                return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(tops[keep])], schema=schema)

            for batch in it:
                ends = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                differ = ends[0] != ends[1]
                held.append([x[differ] for x in ends])
                rows += len(held[-1][0])
                if rows >= most and not whole:
                    yield out()
                    held, rows = [], 0
            if rows:
                yield out()

        forest = materialize(left.select("a", "b").coalesce(max(1, -(-n // EDGES))).mapInArrow(reduced, "node long, top long"), "stars")
        if own:
            release(left)
        if whole:
            steps.append(forest)
            break
        # Both directions of a row at once: a union would compute the edges twice.
        turned = F.explode(F.array(F.struct("node", F.col("top").alias("other")), F.struct(F.col("top").alias("node"), F.col("node").alias("other")))).alias("e")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), c.alias("node"))  # noqa: E731, B023
        near = forest.select(turned).select("e.*").groupBy("node").agg(F.min(order(F.col("other"))).alias("o"))
        to = materialize(near.select("node", F.least("o", order(F.col("node")))["node"].alias("top")), "tops")
        steps.append(to)
        of = lambda c: to.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))  # noqa: E731, B023
        met = forest.join(of("na"), F.col("node") == F.col("na")).join(of("nb"), F.col("top") == F.col("nb"))
        left, own = materialize(met.select(F.col("top_na").alias("a"), F.col("top_nb").alias("b")).where("a <> b"), "edges"), True
        release(forest)
    out = steps[0].withColumnRenamed("top", "comp")
    out._scratch = steps[0]._scratch
    if len(steps) > 1:
        for step in steps[1:]:
            out = out.join(step.withColumnRenamed("node", "at"), F.col("comp") == F.col("at"), "left").select("node", F.coalesce("top", "comp").alias("comp"))
        named = materialize(out, "named")
        least = materialize(named.groupBy("comp").agg(F.min("node").alias("least")), "least")
        out = materialize(named.join(least, "comp").select("node", F.col("least").alias("comp")), "labels")
        release(named, least, *steps)
    return out
