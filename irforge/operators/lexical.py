"""Lexical statistics and retrieval: postings, TF-IDF (A5-A7, T1, T7) and BM25.

Term frequencies are computed inside each document row (sort + run lengths), so building postings
needs no shuffle; corpus statistics are partial aggregations.  BM25 scores blocks of documents where they
lie, with per-term maxima that let queries pass blocks by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irforge.functions.text import py_split, term_frequencies, word_tokens
from irforge.operators.common import bounded_broadcast, topk_per_group
from irforge.session import materialize

# Fixed values of the reference's TF-IDF and first-stage search.
TFIDF_MAX_FEATURES = 120000
BM25_K1 = 0.9
BM25_B = 0.4


def with_term_frequencies(df: DataFrame, text_col: str, out_col: str = "tfs", bigrams: bool = False,
                          len_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = array<struct<term, tf>> of the lower-cased word tokens (plus bigrams)."""
    out = df.withColumn("__toks", word_tokens(F.col(text_col)))
    if bigrams:
        # bigram i joins kept tokens i and i+1 (column reference, so the regex runs once per row)
        t = F.col("__toks")
        m = F.greatest(F.size(t) - 1, F.lit(0))
        out = out.withColumn("__toks", F.concat(t, F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m),
                                                              lambda a, b2: F.concat_ws(" ", a, b2))))
    # sort_array: native comparator (array_sort would call an interpreted lambda per comparison)
    out = out.withColumn("__sorted", F.sort_array(F.col("__toks"))).drop("__toks")
    if len_col:
        out = out.withColumn(len_col, F.size("__sorted").cast("long"))
    return out.withColumn(out_col, term_frequencies(F.col("__sorted"))).drop("__sorted")


def explode_tfs(df: DataFrame, keep: list[str], col: str = "tfs") -> DataFrame:
    """Rows (keep..., term, tf) of a term-frequency array.

    ``inline_outer`` + a null filter on purpose: a plain ``inline`` makes the optimizer infer a
    ``size(tfs) > 0`` filter and push it below the projection, where it would re-run the whole
    tokenizer inside every lambda call.
    """
    return df.select(*keep, F.inline_outer(col)).where(F.col("term").isNotNull())


def postings(docs: DataFrame, text_col: str = "doctext", id_col: str = "docid", bigrams: bool = False) -> DataFrame:
    """(docid, term, tf, dl): one row per distinct term of a document; dl = token count."""
    t = with_term_frequencies(docs.select(id_col, text_col), text_col, bigrams=bigrams, len_col="dl")
    return explode_tfs(t, [id_col, "dl"])


def term_stats(post: DataFrame, id_col: str = "docid") -> DataFrame:
    """(term, cf, df): corpus term count and document frequency (map-side combined)."""
    return post.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def vocabulary(stats: DataFrame, max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """The ``max_features`` terms with the highest corpus count, ties by term ascending.

    Avoids a global sort of all terms: a histogram of counts (one row per distinct count) finds the
    cut-off count; only the terms tied exactly at the cut-off are ordered.
    """
    hist = stats.groupBy("cf").agg(F.count(F.lit(1)).alias("n_terms"))
    w = Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (hist.withColumn("cum", F.sum("n_terms").over(w))
               .where(F.col("cum") >= max_features).orderBy(F.desc("cf")).limit(1).collect())
    if not cut:  # fewer terms than the limit: keep all
        return stats
    c_star, cum, n_at = cut[0]["cf"], cut[0]["cum"], cut[0]["n_terms"]
    need = max_features - (cum - n_at)
    above = stats.where(F.col("cf") > c_star)
    tie = (stats.where(F.col("cf") == c_star)
                .withColumn("__r", F.row_number().over(Window.partitionBy("cf").orderBy("term")))
                .where(F.col("__r") <= need).drop("__r"))
    return above.unionByName(tie)


def tfidf(docs: DataFrame, text_col: str = "doctext", id_col: str = "docid",
          max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """A5: (docid, term, tf, idf, w) with unigrams+bigrams, smooth idf ln((1+n)/(1+df))+1, L2 rows.

    The per-document term-count arrays are built in one tokenising pass and written (the index);
    corpus statistics and weights then read the index.  A document's weights are scaled where it lies, so its postings are
    not shuffled; documents that share an id are scaled together, by sums that are sent out for these ids alone.
    """
    base, idf = _index(docs, text_col, id_col, max_features)
    spark = docs.sparkSession
    shared = materialize(base.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col))
    schema = f"{id_col} {base.schema[id_col].dataType.simpleString()}, term string, tf long, idf double, raw double, square double"
    scaled = lambda rows: rows.withColumn("w", F.col("raw") / F.sqrt("square")).select(id_col, "term", "tf", "idf", "w")
    sent = spark.sparkContext.broadcast(_Vocabulary.of(idf.toArrow()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, WEIGHED_DOCS):
                yield vocabulary.weighed(batch.slice(at, WEIGHED_DOCS), schema)

    if shared.isEmpty():
        return scaled(base.mapInArrow(weigh, schema))
    shared = bounded_broadcast(shared.withColumnRenamed(id_col, "_id"))
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    alone = scaled(base.join(shared, same, "left_anti").mapInArrow(weigh, schema))
    together = base.join(shared, same, "left_semi").mapInArrow(weigh, schema)
    return alone.unionByName(scaled(together.withColumn("square", F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))))


def tfidf_by_id(docs: DataFrame, text_col: str = "doctext", id_col: str = "docid", max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """A5 with the rows of an id in one partition, for what depends on the layout (the random starts of Q5): all postings are shuffled."""
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return _weighted(docs, text_col, id_col, max_features).withColumn("w", F.col("raw") / norm).select(id_col, "term", "tf", "idf", "w")


@dataclass
class _Vocabulary:
    """Terms, in one array, and their idf."""
    terms: pa.Array
    idf: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Vocabulary:
        return cls(rows["term"].combine_chunks(), rows["idf"].to_numpy())

    def weighed(self, docs: pa.RecordBatch, schema: str) -> pa.RecordBatch:
        """One row for each known term of the documents (id, tfs), with the sum of squares of its document."""
        row, number, tf = _term_hits(docs.column(1), self.terms)
        idf = self.idf[number]
        raw = tf * idf
        square = np.bincount(row, weights=raw * raw, minlength=docs.num_rows)[row]
        columns = [docs.column(0).take(pa.array(row)), self.terms.take(pa.array(number)), pa.array(tf.astype(np.int64)), pa.array(idf), pa.array(raw), pa.array(square)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])


def _index(docs: DataFrame, text_col: str, id_col: str, max_features: int) -> tuple[DataFrame, DataFrame]:
    """The written term counts (docid, tfs) and the vocabulary (term, idf)."""
    base = materialize(with_term_frequencies(docs.select(id_col, text_col), text_col, bigrams=True)
                       .select(id_col, "tfs"))
    n_docs = base.count()
    stats = materialize(term_stats(explode_tfs(base, [id_col]), id_col))
    vocab = vocabulary(stats, max_features)
    return base, vocab.select("term", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _weighted(docs: DataFrame, text_col: str, id_col: str, max_features: int) -> DataFrame:
    """(docid, tf, term, idf, raw) of the vocabulary's terms, before rows are scaled to length 1; a document's rows lie in one partition."""
    base, idf = _index(docs, text_col, id_col, max_features)
    # vocabulary size is bounded by max_features: a broadcast with a proven bound
    return (explode_tfs(base, [id_col])
            .join(F.broadcast(idf), "term")
            .withColumn("raw", F.col("tf") * F.col("idf")))


def tfidf_density(docs: DataFrame, text_col: str = "doctext", id_col: str = "docid",
                  max_features: int = TFIDF_MAX_FEATURES, weights: DataFrame | None = None) -> DataFrame:
    """Per document Σ tf-idf weight / max(1, whitespace token count); empty rows give 0.

    Without ``weights`` the sum and the row's length are added up where the document lies: one row of a document is
    shuffled, not its postings."""
    if weights is not None:
        sums = weights.groupBy(id_col).agg(F.sum("w").alias("wsum"))
    else:
        raw = _weighted(docs, text_col, id_col, max_features)
        sums = raw.groupBy(id_col).agg((F.sum("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")))).alias("wsum"))
    lens = docs.select(id_col, F.greatest(F.size(py_split(F.col(text_col))), F.lit(1)).alias("n_tok"))
    return (lens.join(sums, id_col, "left")
                .select(id_col, (F.coalesce(F.col("wsum"), F.lit(0.0)) / F.col("n_tok")).alias("density")))


def lexical_redundancy(docs: DataFrame, text_col: str = "doctext", id_col: str = "docid") -> DataFrame:
    """1 - distinct lower-cased tokens / max(1, tokens), min-max scaled over the corpus."""
    toks = py_split(F.lower(F.col(text_col)))
    raw = docs.select(id_col, (1.0 - F.size(F.array_distinct(toks)) / F.greatest(F.size(toks), F.lit(1))).alias("ni_raw"))
    lo, hi = raw.agg(F.min("ni_raw"), F.max("ni_raw")).first()
    lo, hi = (lo or 0.0), (hi or 0.0)
    return raw.select(id_col, "ni_raw", ((F.col("ni_raw") - F.lit(lo)) / F.lit(max(1e-8, hi - lo))).alias("ni"))


def top_terms(weights: DataFrame, n: int = 10, id_col: str = "docid", max_words: int | None = None) -> DataFrame:
    """The ``n`` heaviest terms per document (ties by term), optionally only terms of <= max_words."""
    w = weights
    if max_words is not None:
        w = w.where(F.size(F.split(F.col("term"), " ")) <= max_words)
    win = Window.partitionBy(id_col).orderBy(F.desc("w"), F.asc("term"))
    return w.withColumn("term_rank", F.row_number().over(win)).where(F.col("term_rank") <= n)


def field_index(docs: DataFrame, fields: list[str], id_col: str = "docid") -> DataFrame:
    """One tokenising pass over the documents: (docid, dl_<f>, tfs_<f>) for every field, checkpointed.

    This is the inverted index of the collection in array form; postings are its exploded view.
    """
    out = docs.select(id_col, *fields)
    for f in fields:
        out = with_term_frequencies(out, f, out_col=f"tfs_{f}", len_col=f"dl_{f}").drop(f)
    return materialize(out)


#: Documents that are weighed together.
WEIGHED_DOCS = 512
#: Documents that are scored together, and query terms of a broadcast slice of the query set.
BLOCK_DOCS = 4096
QUERY_TERMS = 500_000


@dataclass
class QuerySlice:
    """Part of the query set: its distinct terms and the postings (query, term, repeats) over them."""
    qids: list[str]
    terms: pa.Array
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> QuerySlice:
        qid, term = rows["qid"].combine_chunks().dictionary_encode(), rows["term"].combine_chunks().dictionary_encode()
        order = np.argsort(qid.indices.to_numpy(), kind="stable")
        return cls(qid.dictionary.to_pylist(), term.dictionary, qid.indices.to_numpy()[order], term.indices.to_numpy()[order],
                   rows["qtf"].to_numpy()[order].astype(np.float64))


def _term_hits(tfs: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, tf) of the terms in question, from a column of term-frequency arrays."""
    values = tfs.flatten()
    number = pc.index_in(values.field(0), value_set=terms)
    hit = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(tfs)), pc.fill_null(pc.list_value_length(tfs), 0).to_numpy(zero_copy_only=False))
    at = pa.array(hit)
    return row[hit], number.take(at).to_numpy(), values.field(1).take(at).to_numpy().astype(np.float64)


def document_frequencies(index: DataFrame, fields: list[str], sent) -> dict[str, np.ndarray]:
    """How many documents hold each term of the broadcast slice, by field; a task hands on one row for each term it met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value.terms
        total = np.zeros((len(fields), len(terms)), dtype=np.int64)
        for b in batches:
            for f in range(len(fields)):
                total[f] += np.bincount(_term_hits(b.column(f), terms)[1], minlength=len(terms))
        f, t = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(t), pa.array(total[f, t])], names=["f", "t", "df"])

    out = {f: np.zeros(len(sent.value.terms)) for f in fields}
    rows = index.select(*[f"tfs_{f}" for f in fields]).mapInArrow(count, "f long, t long, df long").groupBy("f", "t").agg(F.sum("df").alias("df"))
    for r in rows.toLocalIterator():
        out[fields[r.f]][r.t] = r.df
    return out


class TopScores:
    """The k best documents of every query so far, by rounded score and then id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.best: list[list[tuple[float, str, float]]] = [[] for _ in range(n_queries)]
        self.least = np.full(n_queries, -np.inf)

    def add(self, q: int, score: np.ndarray, rows: np.ndarray, ids: pa.Array) -> None:
        rounded = np.round(score, 6)
        if len(rows) > self.k:
            keep = rounded >= np.partition(rounded, -self.k)[-self.k]
            rows, score, rounded = rows[keep], score[keep], rounded[keep]
        keep = rounded >= self.least[q]
        new = zip((-rounded[keep]).tolist(), ids.take(pa.array(rows[keep])).to_pylist(), score[keep].tolist())
        self.best[q] = sorted([*self.best[q], *new])[:self.k]
        if len(self.best[q]) == self.k:
            self.least[q] = -self.best[q][-1][0]


def block_scores(index: DataFrame, sent, weights: list[tuple[str, np.ndarray, float]], k: int, k1: float, b: float, id_col: str) -> DataFrame:
    """(qid, id, score): the k best documents of each query in each partition, with block maxima.

    A block of documents is scored in place.  The greatest contribution of each term in the block bounds
    what a query can reach there; queries that cannot reach their k-th best score so far pass the block by.
    """
    fields = [f for f, _, _ in weights]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs = sent.value
        n_queries, n_terms = len(qs.qids), len(qs.terms)
        bounds = np.searchsorted(qs.query, np.arange(n_queries + 1))
        top = TopScores(n_queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                row, term, value, most = [], [], [], np.zeros(n_terms)
                for i, (_, idf, avg) in enumerate(weights):
                    r, t, tf = _term_hits(part.column(1 + 2 * i), qs.terms)
                    dl = part.column(2 + 2 * i).to_numpy(zero_copy_only=False).astype(np.float64)
                    v = idf[t] * tf / (tf + k1 * (1.0 - b + b * dl[r] / avg))
                    highest = np.zeros(n_terms)
                    np.maximum.at(highest, t, v)
                    most += highest
                    row.append(r)
                    term.append(t)
                    value.append(v)
                term = np.concatenate(term)
                order = np.argsort(term, kind="stable")
                row, value = np.concatenate(row)[order], np.concatenate(value)[order]
                begin = np.searchsorted(term[order], np.arange(n_terms + 1))
                reach = np.bincount(qs.query, weights=most[qs.term] * qs.times, minlength=n_queries)
                # scores are compared after rounding, so the bound gets a margin of as much
                for q in np.flatnonzero((reach > 0) & (reach >= top.least - 1e-5)).tolist():
                    own = [(t, w) for t, w in zip(qs.term[bounds[q]:bounds[q + 1]].tolist(), qs.times[bounds[q]:bounds[q + 1]].tolist()) if begin[t] < begin[t + 1]]
                    rows = np.concatenate([row[begin[t]:begin[t + 1]] for t, _ in own])
                    points = np.concatenate([value[begin[t]:begin[t + 1]] * w for t, w in own])
                    found, place = np.unique(rows, return_inverse=True)
                    top.add(q, np.bincount(place, weights=points), found, part.column(0))
        out = [(qs.qids[q], d, s) for q, best in enumerate(top.best) for _, d, s in best]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))], names=["qid", id_col, "score"])

    columns = [c for f in fields for c in (f"tfs_{f}", f"dl_{f}")]
    return index.select(F.col(id_col).cast("string").alias(id_col), *columns).mapInArrow(score, f"qid string, {id_col} string, score double")


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float] | None = None, k: int = 100,
         k1: float = BM25_K1, b: float = BM25_B, id_col: str = "docid", index: DataFrame | None = None) -> DataFrame:
    """BM25 top-``k`` run (qid, docid, score, rank) summed over weighted fields.

    Per field: idf = ln(1 + (N - df + 0.5)/(df + 0.5)), term score = idf * tf / (tf + k1 (1 - b + b dl/avgdl)),
    N and avgdl over documents with a non-empty field; repeated query terms count repeatedly.  Ids are unique and not null.

    The query set goes out in slices of at most ``QUERY_TERMS`` terms (one pass over the index each); documents
    are scored where they lie, and only the k best of each query and partition are shuffled.
    """
    fields = fields or {"doctext": 1.0}
    spark = queries.sparkSession
    q = with_term_frequencies(queries.select("qid", "query"), "query", out_col="qtfs")
    qterms = materialize(explode_tfs(q, ["qid"], "qtfs").withColumnRenamed("tf", "qtf"))
    idx = index if index is not None else field_index(docs, list(fields), id_col)
    stats = idx.agg(*[x for f in fields for x in (F.count(F.when(F.col(f"dl_{f}") > 0, 1)).alias(f"n_{f}"),
                                                    F.avg(F.when(F.col(f"dl_{f}") > 0, F.col(f"dl_{f}"))).alias(f"avg_{f}"))]).first()
    live = [f for f in fields if stats[f"n_{f}"]]
    n_terms = qterms.count()
    run = spark.createDataFrame([], f"qid string, {id_col} string, score double")
    if not live or not n_terms:
        return run.withColumn("rank", F.lit(None).cast("bigint"))
    slices = -(-n_terms // QUERY_TERMS)
    for i in range(slices):
        part = QuerySlice.of(qterms.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == i).select(F.col("qid").cast("string"), "term", "qtf").toArrow())
        if not part.qids:
            continue
        sent = spark.sparkContext.broadcast(part)
        df = document_frequencies(idx, live, sent)
        weights = [(f, fields[f] * np.log(1.0 + (stats[f"n_{f}"] - df[f] + 0.5) / (df[f] + 0.5)), float(stats[f"avg_{f}"])) for f in live]
        run = run.unionByName(materialize(block_scores(idx, sent, weights, k, k1, b, id_col)))
        sent.destroy()
    return topk_per_group(run.withColumn("score", F.round("score", 6)), ["qid"], [F.desc("score"), F.asc(id_col)], k, split_col=id_col)
