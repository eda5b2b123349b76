"""Evaluation passages inside a training corpus.

The evaluation items are cut into windows of n normalised words; their set is broadcast and every document is scanned
once. A window is compared word by word, so a hit is exact. Beyond a stated size the set is not broadcast, but
a bitmap of fixed size of its windows' hashes is; only the windows of documents that hit it are joined to the set by hash, and
hits are verified word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamgraph.runtime import broadcast_if, cut, free_name

#: Consecutive words that make a leak, by the item's language; other languages count as 'en'.
WINDOWS = {"en": 10, "zh": 24}
#: Characters of evaluation text up to which the windows are broadcast (a window set of some 100 MB at most).
BROADCAST_CHARS = 1_000_000
#: Bits of the bitmap of window hashes, as a power of two, and those of a part of it.
BITS, PART_BITS = 28, 16

SPANS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def _words():
    import regex

    return regex.compile(r"\p{Han}|[\p{L}\p{N}--\p{Han}]+", regex.V1)


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters or digits in lower case, each Han character by itself."""
    return _words().findall(text.lower()) if text else []


class WindowSet:
    """Windows of all items, held as tuples of word numbers."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], sizes: dict[str, int]):
        self.vocabulary: dict[str, int] = {}
        self.windows: dict[tuple[int, ...], list[int]] = {}
        self.sizes = sorted(set(sizes.values()))
        for item_id, text, lang in items:
            n = sizes.get(language(lang), sizes["en"])
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(len(numbers) - n + 1):
                held = self.windows.setdefault(tuple(numbers[i : i + n]), [])
                if item_id not in held:
                    held.append(item_id)

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, first word, word after the last)`` of every run of overlapping hit windows, in order."""
        get = self.vocabulary.get
        numbers = [get(w, -1) for w in words(text)]
        open_: dict[int, list[int]] = {}
        done: list[tuple[int, int, int]] = []
        start, end = 0, len(numbers)
        least = self.sizes[0]
        while start < end:
            if numbers[start] < 0:
                start += 1
                continue
            stop = start
            while stop < end and numbers[stop] >= 0:
                stop += 1
            if stop - start >= least:
                for n in self.sizes:
                    for i in range(start, stop - n + 1):
                        for item in self.windows.get(tuple(numbers[i : i + n]), ()):
                            span = open_.get(item)
                            if span and i <= span[1]:
                                span[1] = max(span[1], i + n)
                            else:
                                if span:
                                    done.append((item, *span))
                                open_[item] = [i, i + n]
            start = stop
        return sorted(done + [(item, *span) for item, span in open_.items()], key=lambda x: (x[1], x[0]))

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, start, end)`` in characters of the text."""
        found = self.hits(text)
        if not found:
            return []
        lower = text.lower()
        if len(lower) != len(text):  # a few letters grow in lower case
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at = [m.span() for m in _words().finditer(lower)]
        last = len(at)
        return [(item, at[min(a, last - 1)][0], at[min(b, last) - 1][1]) for item, a, b in found]


def language(lang: str | None) -> str:
    """The main part of a language tag, in lower case; '' for null."""
    return (lang or "").replace("_", "-").split("-")[0].strip().lower()


def _over_documents(docs: DataFrame, items: DataFrame, work: Callable, schema: T.StructType, every: bool, sizes: dict[str, int], broadcast_chars: int, text_col: str) -> DataFrame:
    """``work(batch, spans of each row's text)`` over the documents; only those with a hit, or every one."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text", "lang").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).head().n
    at = docs.columns.index(text_col)
    if chars <= broadcast_chars:
        held = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in items.collect()], sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from work(b, [held.value.spans(t) for t in b.column(at).to_pylist()])

        return docs.mapInArrow(run, schema)
    # equal texts have equal leaks, so texts are told apart by their hashes and ids may repeat or be null
    k1, k2, own = (free_name(docs, c) for c in ("_k1", "_k2", "_items"))
    keyed = docs.withColumns({k1: F.xxhash64(text_col), k2: F.xxhash64(text_col, F.lit(5))})
    pairs = _joined_pairs(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text_col).alias("text")), items, sizes)
    found = pairs.join(items, "item_id").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_list(F.struct("item_id", "text", "lang")).alias(own))  # bounded by the text
    both = keyed.join(found, [k1, k2], "left" if every else "inner").select(*docs.columns, own)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column(b.num_columns - 1).to_pylist()
            spans = [WindowSet([(x["item_id"], x["text"], x["lang"]) for x in s], sizes).spans(t) if s else [] for s, t in zip(some, b.column(at).to_pylist())]
            yield from work(b.select(range(b.num_columns - 1)), spans)

    return both.mapInArrow(run_joined, schema)


def leaked_spans(docs: DataFrame, items: DataFrame, sizes: dict[str, int] = WINDOWS, broadcast_chars: int = BROADCAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)`` of the documents that hold a window of an item, spans in characters, in reading order.

    items: ``(item_id, text, lang)``. Null and empty texts on either side, and items shorter than a window, give no hit.
    A repeated document row gives a row each, and so does one without an id; a repeated item counts once.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(b: pa.RecordBatch, spans: list) -> Iterator[pa.RecordBatch]:
        hit = [i for i, s in enumerate(spans) if s]
        rows = [[{"item_id": x, "start": a, "end": e} for x, a, e in spans[i]] for i in hit]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64())), pa.array(rows, kind)], names=[id_col, "spans"])

    return _over_documents(docs.select(id_col, text_col), items, work, schema, False, sizes, broadcast_chars, text_col)


def _hashes(numbers: list[int], n: int) -> np.ndarray:
    """64-bit hashes of the windows of n words, made of the words' hashes: a rolling polynomial with wrap-around."""
    if len(numbers) < n:
        return np.empty(0, dtype=np.int64)
    w = np.array(numbers, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(w) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _word_hashes(text: str | None) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(w) for w in words(text)]


def _joined_pairs(docs: DataFrame, items: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(k1, k2, item_id)`` of texts and items that share the hash of a window; for evaluation sets too large to broadcast."""
    spark = docs.sparkSession
    lang = F.lower(F.trim(F.split(F.regexp_replace(F.coalesce("lang", F.lit("")), "_", "-"), "-")[0]))
    size = F.lit(sizes["en"])
    for name, n in sizes.items():
        size = F.when(lang == name, n).otherwise(size)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text, n in zip(*(c.to_pylist() for c in b.columns)):
                h = np.unique(_hashes(_word_hashes(text), n))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.int64()), pa.array([n] * len(h), pa.int32()), pa.array(h)], names=["item_id", "n", "h"])

    ours = cut(items.select("item_id", "text", size.alias("n")).mapInArrow(of_items, "item_id bigint, n int, h bigint"))
    place = F.shiftrightunsigned("h", 64 - BITS)

    def bitmap(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART_BITS, dtype=np.uint8)
        bits[t["place"].to_numpy() & ((1 << PART_BITS) - 1)] = 1
        return pa.table({"part": t["part"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    placed = ours.select(place.alias("place")).distinct().withColumn("part", F.shiftright("place", PART_BITS).cast("int"))
    parts = placed.groupBy("part").applyInArrow(bitmap, "part int, bits binary").collect()  # BITS / 8 bytes at most
    whole = np.zeros((1 << BITS - PART_BITS, 1 << PART_BITS - 3), dtype=np.uint8)
    for r in parts:
        whole[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    held = spark.sparkContext.broadcast(whole.reshape(-1))
    all_sizes = sorted(set(sizes.values()))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            for i, text in enumerate(b.column(2).to_pylist()):
                numbers = _word_hashes(text)
                for n in all_sizes:
                    h = np.unique(_hashes(numbers, n))
                    at = h.view(np.uint64) >> np.uint64(64 - BITS)
                    h = h[(bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                    if len(h):
                        rows = b.select([0, 1]).take(pa.array([i] * len(h), pa.int64()))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([n] * len(h), pa.int32()), pa.array(h)], names=["k1", "k2", "n", "h"])

    hits = docs.select("k1", "k2", "text").mapInArrow(of_documents, "k1 bigint, k2 bigint, n int, h bigint").distinct()
    return hits.join(broadcast_if(ours, ours.count()), ["n", "h"]).select("k1", "k2", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Distinct ``(item_id, id_col)``: which items leaked into which document."""
    id_col = options.get("id_col", "doc_id")
    spans = leaked_spans(docs, items, **options)
    return spans.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).alias("item_id"), id_col).distinct()


def without_leaks(docs: DataFrame, items: DataFrame, whole_documents: bool = False, sizes: dict[str, int] = WINDOWS, broadcast_chars: int = BROADCAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without leaked passages: the passages are cut out, or their documents dropped.

    All other columns and rows stay as they are, repeated rows and those without an id too; each row is judged by its own text.
    """
    columns, at = docs.columns, docs.columns.index(text_col)

    def work(b: pa.RecordBatch, spans: list) -> Iterator[pa.RecordBatch]:
        if whole_documents:
            yield b.filter(pa.array([not s for s in spans], pa.bool_()))
            return
        texts = [t if not s else _without(t, s) for t, s in zip(b.column(at).to_pylist(), spans)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=columns)

    return _over_documents(docs, items, work, docs.schema, True, sizes, broadcast_chars, text_col)


def _without(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, settled = [], 0
    for _, a, b in spans:
        out.append(text[settled : max(a, settled)])
        settled = max(settled, b)
    return "".join(out) + text[settled:]
