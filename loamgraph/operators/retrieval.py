"""BM25 over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loamgraph.functions.text import terms
from loamgraph.runtime import free_name


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, per_document: bool = False) -> DataFrame:
    """BM25 of queries over documents.

    docs: ``(doc_id, text)``; queries: ``(query, q_text)``, few. Gives ``(query, score)``, the sum over all documents and distinct
    terms of the query, or ``(query, doc_id, score)`` per document. Documents are cut up once: each leaves its length and its counts of
    the queries' terms in one row, which everything else is made of. Queries without a term in the corpus have no row.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms("q_text"))).alias("term"))
    wanted = asked.select("term").distinct().withColumn("hit", F.col("term"))
    words = docs.select("doc_id", F.explode_outer(terms("text")).alias("term")).join(F.broadcast(wanted), "term", "left")
    counted = words.groupBy("doc_id", "hit").agg(F.count("term").alias("n"))
    hits = F.filter(F.collect_list(F.struct(F.col("hit").alias("term"), F.col("n").alias("tf"))), lambda x: x["term"].isNotNull())
    each = counted.groupBy("doc_id").agg(F.sum("n").alias("len"), hits.alias("hits"))
    size = each.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = each.select("doc_id", "len", F.inline("hits"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # as many terms as the queries have, so their documents are not shuffled by them
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(size)).select("doc_id", "term", weight.alias("w")).join(F.broadcast(asked), "term")
    return scored.groupBy("query", *(["doc_id"] if per_document else [])).agg(F.sum("w").alias("score"))


def bm25_within(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``queries`` with ``bm25`` in place of ``q_text``: the score of each over the documents of its own group, 0 without a term in them.

    docs: ``(grp, text)``; queries: ``(grp, q_text)`` and whatever else. The score is the sum over the group's documents. Groups are
    short lists, of which a task has whole ones at once: texts are sent by group and cut up where they are counted, so no term is shuffled.
    """
    keep = [c for c in queries.columns if c != "q_text"]
    doc, words = free_name(queries, "_doc"), free_name(queries, "_words")
    asked = queries.select(*keep, F.lit(False).alias(doc), F.col("q_text").alias(words))
    both = asked.unionByName(docs.where(F.col("grp").isNotNull()).select("grp", F.lit(True).alias(doc), F.col("text").alias(words)), allowMissingColumns=True)
    rows = both.repartition("grp").sortWithinPartitions("grp").select(*keep, doc, terms(words).alias(words))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in queries.schema if f.name != "q_text"], T.StructField("bm25", T.DoubleType())])

    def of_groups(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = ~t[doc].to_numpy()
        score = _group_scores(t["grp"].combine_chunks(), ~asks, t[words].combine_chunks(), k1, b)
        yield from t.select(keep).append_column("bm25", pa.array(score)).filter(pa.array(asks)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            code = _codes(t["grp"].combine_chunks())
            whole = int(np.searchsorted(code, code[-1]))  # the last group may go on in the next batch
            rest = t.slice(whole)
            if whole:
                yield from of_groups(t.slice(0, whole))
        if rest is not None:
            yield from of_groups(rest)

    return rows.mapInArrow(run, schema)


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each distinct value (null is one), in order of their first row."""
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def _group_scores(grp: pa.Array, doc: np.ndarray, words: pa.ListArray, k1: float, b: float) -> np.ndarray:
    """BM25 of the rows that are no ``doc`` over those of their group that are; 0 for the others."""
    group, size = _codes(grp), words.value_lengths().to_numpy().astype(np.int64)
    row, term = np.repeat(np.arange(len(size)), size), _codes(words.flatten())
    most = int(term.max(initial=0)) + 1
    each, tf = np.unique(row * most + term, return_counts=True)  # a row's distinct terms
    row, term = each // most, each % most
    key, of_doc = group[row] * most + term, doc[row]
    n_docs = np.bincount(group, weights=doc)
    mean = np.bincount(group, weights=size * doc) / np.maximum(n_docs, 1)
    held, at, df = np.unique(key[of_doc], return_inverse=True, return_counts=True)
    score = np.zeros(len(size))
    if not len(held):
        return score
    n, r = tf[of_doc], row[of_doc]
    parts = np.bincount(at, weights=n * (k1 + 1) / (n + k1 * (1 - b + b * size[r] / mean[group[r]])))
    weight = np.log(1 + (n_docs[held // most] - df + 0.5) / (df + 0.5)) * parts
    key, row = key[~of_doc], row[~of_doc]
    at = np.minimum(np.searchsorted(held, key), len(held) - 1)
    hit = held[at] == key
    return score + np.bincount(row[hit], weights=weight[at[hit]], minlength=len(size))
