"""Token ids of documents: the encoder, fixed-length sequences in a keyed global order, and shards of a fixed stride."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import batched, dropped, scratch, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids by the tokenizer file. Texts in Latin letters alone take the rank file's encoder, which gives the same ids faster.

    The two are only told apart by rare scripts, where their Unicode tables may differ, and by strings of special tokens.
    """

    def __init__(self, path: str, rank_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rare = re.compile("[^\t\n\r -~¡-¬®-ſ]|<\\|").search

    def encode(self, text: str) -> list[int]:
        if self.rare(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


@lru_cache(1)
def encoder(path: str = TOKENIZER, rank_path: str = RANKS) -> Encoder:
    return Encoder(path, rank_path)


#: Tokens of a sequence, and what closes a document.
SEQUENCE, END = 1024, 50256
#: A record of a shard: the first token's doc_id, the tokens that count, ids; then a line feed from the text sink.
RECORD = np.dtype([("doc_id", "<i8"), ("length", "<u2"), ("ids", "<u2", (SEQUENCE,)), ("end", "u1")])
SHARD_ROWS = 4096
FEISTEL_ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 by ``key``: a balanced network over the next even number of bits, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(FEISTEL_ROUNDS):
            with np.errstate(over="ignore"):
                x = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (x ^ x >> np.uint64(29)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


#: Tasks that shards are dealt to at most; beyond it a task writes several shards that follow one another.
MOST_TASKS = 50_000
#: Tokens that are kept together between encoding and cutting, and how hard they are compressed, there and on the way to their shards.
BLOCK_TOKENS, BLOCK_LEVEL, PIECE_LEVEL = 128 * SEQUENCE, 9, 3
_PIECE = pa.schema([("slot", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_BLOCK = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("file", pa.string()), ("start", pa.int64()), ("before", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_starts", pa.binary()), ("ids", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the file and the place in it where the part that a row comes from starts; null for what isn't a plain scan of files."""
    where = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    try:
        plan = docs.select(*where)._jdf.queryExecution().analyzed().toString()
    except AnalysisException:
        plan = None
    if plan is None or re.search(r"\b(Repartition|Join|Aggregate|Window|Sort|Union|Sample|Limit|Generate|Rebalance)", plan):
        where = (F.lit(None).cast("string"), F.lit(None).cast("long"))
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", where[0].alias("file"), where[1].alias("start"))


def token_blocks(docs: DataFrame) -> DataFrame:
    """The ids of all documents, each closed by END, in blocks of BLOCK_TOKENS: part (the task's number), run, file and start, before (tokens of the run before the
    block), tokens, doc_ids and doc_starts (of what is in the block, the first one from 0 on), ids (compressed).

    A run is what a task reads from one part of a file, one after another; its last block may be shorter.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, run, here = encoder().encode, TaskContext.get().partitionId(), -1, ()
        squeeze = zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress
        before, ids, doc_ids, doc_starts = 0, np.zeros(0, "<u2"), np.zeros(0, "<i8"), np.zeros(0, "<i8")

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal before, ids, doc_ids, doc_starts
            while len(ids) >= BLOCK_TOKENS or last and len(ids):
                n = min(len(ids), BLOCK_TOKENS)
                inside = int(np.searchsorted(doc_starts, n))
                row = (part, run, *here, before, n, doc_ids[:inside].tobytes(), np.maximum(doc_starts[:inside], 0).astype("<i8").tobytes(), squeeze(ids[:n]))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)
                first = int(np.searchsorted(doc_starts, n, side="right")) - 1  # the document that goes on
                before, ids, doc_ids, doc_starts = before + n, ids[n:], doc_ids[first:], doc_starts[first:] - n

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                names, texts, files, starts = (c.to_pylist() for c in batch.slice(k, 200).columns)
                at = 0
                while at < len(texts):
                    if (files[at], starts[at]) != here:
                        yield from blocks(True)
                        run, here, before, doc_ids, doc_starts = run + 1, (files[at], starts[at]), 0, doc_ids[:0], doc_starts[:0]
                    end = at
                    while end < len(texts) and (files[end], starts[end]) == here:
                        end += 1
                    lists = [ids_of(t or "") for t in texts[at:end]]
                    ends = np.cumsum([len(ids), *(len(x) + 1 for x in lists)])
                    more = np.empty(ends[-1], "<u2")
                    more[: len(ids)] = ids
                    for a, x in zip(ends.tolist(), lists):
                        more[a : a + len(x)] = x
                    more[ends[1:] - 1] = END
                    ids, doc_ids, doc_starts = more, np.append(doc_ids, np.array([-1 if d is None else d for d in names[at:end]], "<i8")), np.append(doc_starts, ends[:-1])
                    yield from blocks(False)
                    at = end
        yield from blocks(True)

    return _texts(docs).mapInArrow(encode, "part int, run int, file string, start long, before long, tokens long, doc_ids binary, doc_starts binary, ids binary")


def write_training_order(docs: DataFrame, path: str, key: int = 2024, shard_rows: int = SHARD_ROWS) -> None:
    """Write the documents of ``docs``, each closed by END, one after another in sequences of SEQUENCE tokens and these in a keyed global order, as shards of ``shard_rows`` under ``path``.

    Each task encodes what it reads and writes the ids, compressed, in blocks. Sums over files and places in them then say where in the
    whole stream of tokens each run of a task starts, a few numbers a task: so the stream, its sequences and their numbers 0 to n - 1
    are the same however files are split. (Rows that aren't a plain scan of files are in the order of their tasks.) Blocks are cut at the ends of
    sequences, and a sequence that begins in one block and ends in another meets in its shard. The permutation of 0 to n - 1
    gives each sequence its slot, and slot // shard_rows and slot % shard_rows are its shard and its row there, of
    RECORD.itemsize bytes each. All shards but the last are full. The blocks are deleted in the end.
    """
    blocks = written(token_blocks(docs), "tokens")
    before = Window.orderBy("file", "start", "part", "run").rowsBetween(Window.unboundedPreceding, -1)  # a few rows a task
    runs = blocks.groupBy("file", "start", "part", "run").agg(F.sum("tokens").alias("tokens")).withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    found = runs.select("part", "run", "first", "tokens").collect()
    n = -(-sum(r["tokens"] for r in found) // SEQUENCE)
    firsts = {(r["part"], r["run"]): r["first"] for r in found}
    shards = max(1, -(-n // shard_rows))
    tasks = min(shards, MOST_TASKS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=PIECE_LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, run, before, size, *data in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, doc_starts, ids = np.frombuffer(data[0], "<i8"), np.frombuffer(data[1], "<i8"), memoryview(expand(data[2]))
                at = firsts[part, run] + before
                ends = np.arange(SEQUENCE - at % SEQUENCE, size, SEQUENCE)
                starts, ends = np.append(0, ends), np.append(ends, size)
                out = [
                    pa.array(feistel((at + starts) // SEQUENCE, n, key)), pa.array(((at + starts) % SEQUENCE).astype(np.int32)), pa.array(doc_ids[np.searchsorted(doc_starts, starts, side="right") - 1]),
                    pa.array([squeeze(ids[2 * a : 2 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=_PIECE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records from pieces in order."""
        expand, slot, owner, parts, full = zstandard.ZstdDecompressor().decompress, None, 0, [], 2 * SEQUENCE
        done: tuple[list, list] = ([], [])

        def close() -> None:
            ids = b"".join(parts)
            done[0].append(slot)
            done[1].append(struct.pack("<qH", owner, len(ids) // 2) + ids.ljust(full, b"\0"))

        for batch in batches:
            for now, at, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                if now != slot:
                    if slot is not None:
                        close()
                    slot, parts = now, []
                if at == 0:
                    owner = doc_id
                parts.append(expand(data))
                if len(done[0]) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.binary())], names=["slot", "record"])
                    done = ([], [])
        if slot is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.binary())], names=["slot", "record"])

    pieces = batched(blocks.select("part", "run", "before", "tokens", "doc_ids", "doc_starts", "ids")).mapInArrow(place, "slot long, at int, doc_id long, ids binary")
    shard = F.floor(F.col("slot") / shard_rows)
    dealt = pieces.repartitionById(tasks, F.floor(shard / -(-shards // tasks)).cast("int")).sortWithinPartitions("slot", "at")  # compressed till here
    records = dealt.mapInArrow(join, "slot long, record binary").withColumn("shard", shard)
    records.sortWithinPartitions("shard", "slot").select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").text(path)
    dropped(blocks)


def read_training_order(spark: SparkSession, path: str) -> DataFrame:
    """position, doc_id, length, ids (bytes of the ids that count) from the shards under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    full = files.where(shard == 0).select(F.expr(f"length div {RECORD.itemsize}").alias("rows")).first()
    stride = full["rows"] if full else 0  # all shards but the last have as many rows
    schema = pa.schema([("position", pa.int64()), ("doc_id", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = np.frombuffer(content.as_buffer(), RECORD)
                for k in range(0, len(records), 500):
                    some = records[k : k + 500]
                    yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(k, k + len(some))), pa.array(some["doc_id"].copy()), pa.array(some["length"].astype("i8")), pa.array([x["ids"][: x["length"]].tobytes() for x in some], pa.binary())], schema=schema)

    return files.select((shard * stride).alias("start"), "content").mapInArrow(run, "position long, doc_id long, length long, ids binary")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in training order, written as shards and read back: position, doc_id (of the document that
    the first token is of), length, ids_crc32.

    Null and empty texts are END alone. A null doc_id is -1 in a record. Repeated rows are kept each. An empty table gives
    no shards and no rows.
    """
    path = scratch(spark, "training-order")
    write_training_order(table(spark, sf_dir, "documents"), path)
    return read_training_order(spark, path).select("position", "doc_id", "length", F.crc32("ids").alias("ids_crc32"))
