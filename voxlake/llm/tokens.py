"""Token counts by a separator scan of flat token files.

A flat file is a run of little-endian token numbers, each document ended by a
separator, with no index. The scan cuts files into blocks of fixed size, each
read by one task; a block reports where separators stand, found by a vectorised
comparison. A prefix scan over blocks (the last separator and the number of
separators before each) then stitches documents that cross blocks.

Files are read by Arrow's file systems from the shared folder (a mounted path,
hdfs:// or an object store); only the driver lists them. A writer that tokenises
a documents table is included: every task writes a file of its own name, and only
files named in the committed table are scanned, so a task that runs twice is harmless.

Defined results: null and empty texts are documents of 0 tokens; tokens after the
last separator form an unterminated document; an empty file has no documents;
very long texts are tokenised whole and their separators found block by block;
documents of equal length or id are told apart by their ordinal in a file; a separator in a text's own tokens can't occur (the separator isn't in the
tokenizer's vocabulary of ordinary text).
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, map_rows, materialize, new_path, pieces

BLOCK_TOKENS = 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the word pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def read_vocabulary(vocabulary: str = VOCABULARY) -> bytes:
    """A ranks file, read on the driver; tasks get its bytes, so executors need no copy."""
    with open(vocabulary, "rb") as f:
        return f.read()


def encoding(ranks_file: bytes | None = None, pattern: str = PATTERN):
    """A public byte-level BPE from the bytes of its ranks file; ordinary text only."""
    import tiktoken

    lines = (read_vocabulary() if ranks_file is None else ranks_file).splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """Write one flat file a partition under `path`; returns the table (file, ordinal, doc_id) of what each holds."""
    ddl = "file string, n_bytes long, ordinal long, doc_id long"
    schema = arrow_schema(ddl)
    ranks = read_vocabulary(vocabulary)

    def run(it):
        enc, held = encoding(ranks), []
        target = f"{path}/{uuid.uuid4().hex}.bin"
        store, at = opened(target)
        out, size = None, 0
        for b in pieces(it):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at)
                ids = np.asarray([*(enc.encode_ordinary(text) if text else ()), eod], np.dtype(dtype))
                out.write(ids.tobytes())
                size += ids.nbytes
                held.append(doc_id)
        if out is not None:
            out.close()
            yield from batches_of(((target, size, n, d) for n, d in enumerate(held)), schema)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl), "token-index")


def list_token_files(spark, path: str) -> DataFrame:
    """(file, n_bytes) of the .bin files under a folder, listed on the driver by Hadoop's file system."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    rows = []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().endswith(".bin"):
            rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, "file string, n_bytes long")


def scan_separators(files: DataFrame, *, eod: int = EOD, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document of the files."""
    width = np.dtype(dtype).itemsize
    tokens = (F.col("n_bytes") / width).cast("long")
    blocks = files.select("file", tokens.alias("total")).where("total > 0").select("file", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens))).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))
    ddl = "file string, block long, total long, seps array<long>"

    def each(file, total, block):
        store, at = opened(file)
        start = block * block_tokens
        with store.open_input_file(at) as f:
            f.seek(start * width)
            data = f.read(min(block_tokens, total - start) * width)
        yield file, block, total, (np.flatnonzero(np.frombuffer(data, np.dtype(dtype)) == eod) + start).tolist()

    found = materialize(map_rows(blocks, each, ddl), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("file", "block", F.size("seps").alias("n"), F.array_max("seps").alias("last"))
    scan = slim.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")).alias("prev"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = found.where(F.size("seps") > 0).join(scan, ["file", "block"]).select("file", F.posexplode("seps").alias("i", "sep"), "seps", "prev", "first")
    start = F.when(F.col("i") == 0, F.col("prev")).otherwise(F.element_at("seps", F.greatest(F.col("i"), F.lit(1)))) + 1
    ended = inner.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("sep") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = slim.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).cast("long").alias("start")).join(files.select("file", tokens.alias("total")), "file")
    rest = tail.where("total > start").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(rest)


def count_tokens(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens): documents tokenised into flat files, counted by scanning them."""
    path = new_path(docs.sparkSession, "flat")
    index = write_token_files(docs, path, **options)
    files = index.select("file", "n_bytes").distinct()
    return scan_separators(files).join(index, ["file", "ordinal"]).select("doc_id", "n_tokens")

