"""TF-IDF with a capped vocabulary: smooth idf, unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST_TERMS = 200_000
MARKER = ""  # no token is empty, so this stands for the document itself


def usable(tokens: Column) -> Column:
    """The tokens, or null when there are none; the expression is evaluated once."""
    return F.get(F.transform(F.array(tokens), lambda t: F.when(F.size(t) > 0, t)), F.lit(0))


def entries(docs: DataFrame) -> DataFrame:
    """(id, term) for every token of (id, tokens), and one marker row per document.

    Documents without tokens (null) have no row. The marker carries the number of documents through
    the same pass, and exploding an expression keeps Spark from adding a filter that would compute
    the tokens a second time.
    """
    return docs.select("id", F.explode(F.concat(F.array(F.lit(MARKER)), F.col("tokens"))).alias("term"))


def _counts(docs: DataFrame) -> DataFrame:
    """(id, term, tf). Equal words of a document are added up before they are shuffled."""
    return entries(docs).groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit_tfidf(docs: DataFrame, max_features: int = 1000, min_df: int = 2, max_df: float = 0.95, distinct: bool = True) -> DataFrame:
    """Vocabulary (term, tf, df, n_docs, idf, idx) of (id, tokens).

    Terms in fewer than ``min_df`` documents or in more than a ``max_df`` share are left out; of the
    rest the ``max_features`` most frequent stay, ties by term. ``idx`` follows the terms' order.
    With ``distinct`` no token repeats inside a document, and term and document frequency are one.
    """
    if distinct:
        terms = entries(docs).groupBy("term").agg(F.count("*").alias("df")).withColumn("tf", F.col("df"))
    else:
        terms = _counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    # Both sides rest on the same exchange, so the documents are read once. For that the marker must
    # not be filtered out by a condition on the term alone, which Spark would push below the exchange.
    total = terms.agg(F.max(F.when(F.col("term") == MARKER, F.col("df"))).alias("n_docs"))
    most = F.when(F.col("term") == MARKER, F.lit(-1.0)).otherwise(F.col("n_docs") * F.lit(max_df))
    usable_terms = terms.crossJoin(F.broadcast(total)).filter((F.col("df") >= min_df) & (F.col("df") <= most))  # one row
    kept = usable_terms.orderBy(F.col("tf").desc(), F.col("term")).limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    by_term = Window.orderBy("term")  # over at most max_features rows
    return kept.select(
        "term", "tf", "df", "n_docs", idf.alias("idf"), (F.row_number().over(by_term) - 1).alias("idx")
    )


def vocabulary_side(terms: DataFrame, max_features: int) -> DataFrame:
    """The vocabulary as a join side: replicated while its row limit proves it small."""
    return F.broadcast(terms) if max_features <= MAX_BROADCAST_TERMS else terms


def tfidf_vectors(docs: DataFrame, terms: DataFrame, max_features: int = 1000, distinct: bool = True) -> DataFrame:
    """Sparse unit vectors (id, idx, weight), arrays in idx order, of the documents with any term.

    The vocabulary has at most ``max_features`` rows, so it is sent to the documents and not the other
    way round; a document's vector has no more entries than that either.
    """
    vocabulary = vocabulary_side(terms.select("term", "idf", "idx"), max_features)
    counts = entries(docs).withColumn("tf", F.lit(1)) if distinct else _counts(docs)
    raw = counts.join(vocabulary, "term").select("id", F.struct("idx", (F.col("tf") * F.col("idf")).alias("w")).alias("e"))
    # The length is a sum beside the list: as an expression over the list it would be computed for each entry.
    length = F.sqrt(F.sum(F.col("e.w") * F.col("e.w")))
    packed = raw.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("e"), length.alias("_len"))
    return packed.select(
        "id",
        F.transform("e", lambda x: x["idx"]).alias("idx"),
        F.transform("e", lambda x: x["w"] / F.col("_len")).alias("weight"),
    )


def long_form(vectors: DataFrame, terms: DataFrame, max_features: int = 1000) -> DataFrame:
    """One row per (id, term, weight)."""
    flat = vectors.select("id", F.explode(F.arrays_zip("idx", "weight")).alias("e")).select("id", "e.idx", "e.weight")
    return flat.join(vocabulary_side(terms.select("idx", "term"), max_features), "idx").select("id", "term", "weight")


def distinctive_terms(terms: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` terms with the highest idf."""
    return terms.orderBy(F.col("idf").desc(), F.col("term")).limit(n).select("term", "idf")
