"""Documents as chunks: cleaning, splitting, sections, search by words and by vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import provenance
from .markup import page_lists
from .windows import over

#: The splitter's frozen rules: characters of a chunk and of an overlap, separators from the best to the last.
SIZE, OVERLAP, SEPARATORS = 400, 50, ("\n\n", "\n", "。", ". ", " ", "")


def normalise(text: Column) -> Column:
    """Runs of blanks to one, no blanks at line ends, at most one empty line in a row, trimmed."""
    t = F.regexp_replace(text, r"[ \t\x0B\f　]+", " ")
    t = F.regexp_replace(t, r" *\r?\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def quality_ratio(text: Column) -> Column:
    """Share of letters, digits, usual marks and white space among all characters; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\s]", "")), F.length(text))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the best separator there is, then at the next for what is too long,
    and joined again up to the size, each chunk beginning with whole pieces of the last one's end up to the overlap."""

    def cut(part: str, seps: Sequence[str]) -> list[str]:
        if len(part) <= size:
            return [part]
        sep = next((s for s in seps if s in part), "")
        if not sep:
            return [part[i : i + size] for i in range(0, len(part), size)]
        bits = part.split(sep)
        bits = [b + sep for b in bits[:-1]] + bits[-1:]
        rest = seps[list(seps).index(sep) + 1 :]
        return [y for b in bits if b for y in cut(b, rest)]

    chunks: list[str] = []
    held: list[str] = []
    for piece in cut(text, separators):
        if held and sum(map(len, held)) + len(piece) > size:
            chunks.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    if held:
        chunks.append("".join(held))
    return [c for x in chunks if (c := x.strip())]


def chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, chunk_text; nothing for null or blank texts."""
    out = docs.select(key, F.lit(0).alias("chunk_index"), F.lit("").alias("chunk_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_text(t or "", size, overlap) for t in batch.column(1).to_pylist()]
            which = [i for i, p in enumerate(parts) for _ in p]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array([i for p in parts for i in range(len(p))], pa.int32()), pa.array([c for p in parts for c in p], pa.string())], names=out.names)

    return docs.select(key, text).mapInArrow(run, out)


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """key, chunk_index, chunk_text: windows of ``size`` characters, each ``size - overlap`` after the last; no Python."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1))
    return docs.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk_index")).select(key, "chunk_index", F.substring("_t", F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk_text"))


def sections(chunk_rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """The last section header (group 1 of ``pattern``) that a chunk of the document up to this one has."""
    found = F.nullif(F.regexp_extract("chunk_text", pattern, 1), F.lit(""))
    return chunk_rows.withColumn("section", F.last(found, ignorenulls=True).over(over([key], ["chunk_index"], (Window.unboundedPreceding, 0))))


def section_filter(rows: DataFrame, key: str, skipped: Sequence[str], share: float, shortened: Sequence[str]) -> DataFrame:
    """No chunks of ``skipped`` sections; of ``shortened`` ones the first share, one at least."""
    w = over([key, "section"])
    x = rows.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(over([key, "section"], ["chunk_index"]))})
    keep = ~F.coalesce(F.col("section").isin(*skipped), F.lit(False)) & (~F.coalesce(F.col("section").isin(*shortened), F.lit(False)) | (F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))))
    return x.where(keep).drop("_n", "_i")


def reconstruct(rows: DataFrame, key: str) -> DataFrame:
    """The chunks of a document in order, end to end: overlaps stay doubled."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"]), "").alias("text"), F.count("*").alias("n_chunks"))


def theme_hits(rows: DataFrame, key: str, text: str, all_of: Sequence[str]) -> DataFrame:
    """Keys with a row that matches every pattern: how many rows, and the longest of them."""
    held = F.lit(True)
    for p in all_of:
        held = held & F.col(text).rlike(p)
    return rows.where(held).groupBy(key).agg(F.count("*").alias("hits"), F.max(F.length(text)).alias("longest"))


def mentions(rows: DataFrame, text: str, names: DataFrame, word: str, name: str) -> DataFrame:
    """rows with ``name`` for each of ``names`` (a dimension table) whose ``word`` the lower-cased text contains: the list of
    names goes along as one row, and each text is looked through where it is."""
    all_ = names.agg(F.collect_list(F.struct(F.col(word).alias("word"), F.col(name).alias("name"))).alias("_names"))
    x = rows.withColumn("_lower", F.lower(text)).crossJoin(F.broadcast(all_))
    return x.withColumn(name, F.explode(F.filter("_names", lambda k: F.contains(F.col("_lower"), k["word"]))["name"])).drop("_lower", "_names")


def hybrid(keyword: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """Both kinds of hits by key, with hit_type; those of both come first, then by distance and hits."""
    order = F.when(F.col("hit_type") == "BOTH", 0).when(F.col("hit_type") == "VECTOR_ONLY", 1).otherwise(2)
    return provenance(keyword, vector, [key], ("BOTH", "KEYWORD_ONLY", "VECTOR_ONLY")).withColumn("type_order", order)


def theme_evolution(counts: DataFrame, key: str, period: str, n: str) -> DataFrame:
    """prior, mid and recent counts of a theme, and the signals that they give."""
    x = counts.groupBy(key).pivot(period, ["prior", "mid", "recent"]).agg(F.sum(n)).na.fill(0, ["prior", "mid", "recent"])
    c = F.col
    signals = {"new": (c("prior") == 0) & (c("mid") == 0) & (c("recent") > 0), "rising": (c("recent") > c("mid")) & (c("mid") >= c("prior")) & (c("mid") > 0), "fading": (c("recent") < c("mid")) & (c("mid") > 0), "revived": (c("prior") > 0) & (c("mid") == 0) & (c("recent") > 0)}
    return x.withColumn("signals", F.concat_ws("+", *(F.when(v, F.lit(k)) for k, v in signals.items())))


def page_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, list, item, text: the items of all lists of a page in order, however they are written or nested."""
    return page_lists(pages, key, html).select(key, "list", "item", "text")
