"""Spelling variants: words of a corpus that are one edit apart, found by walking tries, and the form that each stands for."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batched, scratch, shuffle_partitions, table, written

#: Runs of letters, all of one byte in Latin-1, which is how tries hold them.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")
#: One of so many pairs of document and run loses a letter.
DROPS = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has this many times the word's count.
FORM_FACTOR = 5
#: Code points of a text that are cut into runs at once; different words that a task holds before it puts them out.
SLICE, HELD = 1 << 20, 200_000
#: A shard ends after so many words or letters. Shards of this many bytes in all are broadcast at once, and others after them.
SHARD_WORDS, SHARD_LETTERS, BUNDLE_BYTES = 20_000, 1 << 20, 32 << 20
#: Rows of a file of words with their forms or roots.
FILE_WORDS = 500_000


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` that end between runs."""
    at = 0
    while at < len(text):
        end = NO_RUN.search(text, min(at + size, len(text)))
        end = end.end() if end else len(text)
        yield text[at:end]
        at = end


def text_words(doc_id: str, text: bytes, least: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """Words of one text in UTF-8, of ``least`` letters or more, with counts. A run that DROPS singles out is without one of its letters."""
    runs: Counter[str] = Counter()
    for piece in slices(text.lower().decode()):  # bytes.lower() is for A-Z alone
        runs.update(RUN.findall(piece))
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROPS == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= least:
            yield run, n


def counted_words(docs: DataFrame) -> DataFrame:
    """word and n over all whole texts, of words that occur often enough. Tasks add up before anything is shuffled."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                for word, n in text_words(doc_id.as_py(), text.as_py()):
                    held[word] += n
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    return batched(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def trie(words: list[bytes], counts: list[int]) -> bytes:
    """A trie of sorted different words in one string of bytes. Nodes are numbered level by level, so children stand together.

    After two counts, of nodes and words: each node's letter, its first child (the next node's first child ends them), the
    number of the word that ends there, from 1, or 0, and the words' counts.
    """
    letters, first, ends = bytearray(1), [], []
    queue, at = [(0, len(words), 0)], 0
    while at < len(queue):
        low, high, depth = queue[at]
        at += 1
        first.append(len(letters))
        ends.append(0)
        if low < high and len(words[low]) == depth:
            low += 1
            ends[-1] = low
        while low < high:
            letter, start = words[low][depth], low
            low = bisect_left(words, letter + 1, low, high, key=lambda w: w[depth])
            letters.append(letter)
            queue.append((start, low, depth + 1))
    first.append(len(letters))
    pad = bytes(-len(letters) % 8)
    return np.array([len(letters), len(words)], "<u8").tobytes() + np.array(counts, "<i8").tobytes() + letters + pad + np.array(first + ends, "<u4").tobytes()


class Trie:
    """A trie() as it is read: nothing is copied but the letters."""

    def __init__(self, data: bytes) -> None:
        nodes, words = np.frombuffer(data, "<u8", 2).tolist()
        view = memoryview(data)
        at = 16 + 8 * words
        self.counts = view[16:at].cast("q")
        self.letters = data[at : at + nodes]
        at += nodes + -nodes % 8
        self.first = view[at : at + 4 * nodes + 4].cast("I")
        self.ends = view[at + 4 * nodes + 4 : at + 8 * nodes + 4].cast("I")

    def near(self, word: bytes) -> Iterator[tuple[bytes, int]]:
        """Words one edit away, each once, with counts.

        The automaton's states are (letters read, edits): the walk goes depth-first down the path of the word itself, where
        no edit is used, and from each node there takes every edit that leads to another word; after it only one way is
        left. Of the edits with the same result it takes one: of a run of equal letters the last goes, and a letter comes
        after its equals.
        """
        letters, first, find, n = self.letters, self.first, self.letters.find, len(word)

        def rest(node: int, i: int) -> int:
            while i < n:
                node = find(word[i], first[node], first[node + 1])
                if node < 0:
                    return 0
                i += 1
            return self.ends[node]

        node = 0
        for i in range(n + 1):
            low, high = first[node], first[node + 1]
            here = word[i] if i < n else -1
            if i < n and (i + 1 == n or word[i + 1] != here) and (k := rest(node, i + 1)):
                yield word[:i] + word[i + 1 :], self.counts[k - 1]
            for child in range(low, high):
                if (letter := letters[child]) == here:
                    continue
                if k := rest(child, i):
                    yield word[:i] + bytes([letter]) + word[i:], self.counts[k - 1]
                if i < n and (k := rest(child, i + 1)):
                    yield word[:i] + bytes([letter]) + word[i + 1 :], self.counts[k - 1]
            if i == n or (node := find(here, low, high)) < 0:
                return


def shards(words: DataFrame, n: int) -> DataFrame:
    """part, shard, bytes and trie: the ``n`` rows of ``words`` (word, n) in sorted ranges, in tries of bounded size."""
    ranged = words.select("word", "n").repartitionByRange(max(1, -(-n // SHARD_WORDS)), "word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size, number, part = [], [], 0, 0, 0
        row = lambda data: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "bytes": pa.array([len(data)], pa.int64()), "trie": pa.array([data], pa.binary())})
        for batch in batches:
            for word, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(word.encode("latin-1"))
                counts.append(n)
                size += len(word)
                if len(held) >= SHARD_WORDS or size >= SHARD_LETTERS:
                    yield row(trie(held, counts))
                    held, counts, size, number = [], [], 0, number + 1
        if held:
            yield row(trie(held, counts))

    return ranged.mapInArrow(run, "part int, shard int, bytes long, trie binary")


def neighbours(words: DataFrame, n: int) -> DataFrame:
    """word, n_near, best_n and best: how many of the ``n`` rows of ``words`` (word, n) are one edit away, and the most frequent of them, the smallest of equals.

    Tries are broadcast in bundles of BUNDLE_BYTES (one trie at least), whatever the vocabulary's size: each bundle is a pass over all
    words, whose results are written and then added up. The driver holds one bundle at a time.
    """
    spark = words.sparkSession
    tries = written(shards(words, n), "tries")
    bundles, size = [[]], 0
    for r in tries.select("part", "shard", "bytes").orderBy("part", "shard").toLocalIterator():
        if bundles[-1] and size + r.bytes > BUNDLE_BYTES:
            bundles.append([])
            size = 0
        bundles[-1].append((r.part, r.shard))
        size += r.bytes
    tasks = words.select("word").repartition(max(shuffle_partitions(spark), -(-n // SHARD_WORDS)), "word")
    schema = "word string, n_near long, best_n long, best string"
    path = scratch(spark, "near")
    for bundle in bundles:
        low, high = (F.struct(F.lit(p).alias("part"), F.lit(s).alias("shard")) for p, s in (bundle[0], bundle[-1])) if bundle else (F.lit(None), F.lit(None))
        data = [bytes(r.trie) for r in tries.where(F.struct("part", "shard").between(low, high)).orderBy("part", "shard").select("trie").collect()] if bundle else []
        sent = spark.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            opened = [Trie(x) for x in sent.value]
            for batch in batches:
                rows = []
                for word in batch.column(0).to_pylist():
                    near = [x for t in opened for x in t.near(word.encode("latin-1"))]
                    best, most = min(near, key=lambda x: (-x[1], x[0]), default=(None, None))
                    rows.append((word, len(near), most, best and best.decode("latin-1")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        tasks.mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, most: int, files: int = 1) -> DataFrame:
    """word and root for each row of ``forms`` (word, form): forms are followed to the last, twice as far in each round.

    Counts rise by FORM_FACTOR from link to link, from LEAST_COUNT up to ``most``, which bounds the links and so the rounds.
    """
    now = forms.select("word", F.col("form").alias("root"))
    links = 1
    while LEAST_COUNT * FORM_FACTOR**links < most:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")).coalesce(files), "roots")
        links *= 2
    return now


def variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n. See op13_spelling_variants for odd rows."""
    words = written(counted_words(docs), "words")
    n, most = words.agg(F.count("*"), F.max("n")).first()
    files = max(1, -(-n // FILE_WORDS))
    near = words.join(neighbours(words, n), "word")
    is_form = F.col("best_n") >= FORM_FACTOR * F.col("n")
    near = written(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")).coalesce(files), "forms")
    last = roots(near.where("form is not null"), most or 0, files)
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: no words. A null doc_id counts as '' in the hash. Repeated rows count each time. Long texts are cut into runs
    slice by slice, and very long words are shards of their own. Of equally frequent near words the smallest is the form. No words: no rows. Other
    columns are ignored."""
    return variants(table(spark, sf_dir, "documents"))
