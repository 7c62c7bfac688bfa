"""Record features: fitted ranges, hashed categories, scaled numbers, and the terms of the title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.functions.money import parse_price
from waxworks.functions.numeric import (
    VOCABULARY, grade_index, grade_one_hot, hash_index, hash_slots, min_max, scale_year, want_ratio,
)
from waxworks.functions.text import raw_title, title_words
from waxworks.operators.tfidf import fit_tfidf, tfidf_vectors, usable

CONDITION_COLUMNS = (
    "is_poor", "is_fair", "is_good", "is_good_plus",
    "is_very_good", "is_very_good_plus", "is_near_mint", "is_mint",
)
CATEGORY_COLUMNS = ("artist_idx", "label_idx", "genre_1", "genre_2", "genre_3", "style_1", "style_2", "style_3")
NUMBER_COLUMNS = ("wants_n", "haves_n", "ratio_n", "price_n", "year_n")
DENSE_COLUMNS = CATEGORY_COLUMNS + NUMBER_COLUMNS + CONDITION_COLUMNS

# Terms of the title block.
TITLE_TERMS = 1000

# Year range when no record has a year.
DEFAULT_YEARS = (1950, 2025)


def _numbers():
    wants = F.coalesce(F.col("wants"), F.lit(0)).cast("double")
    haves = F.coalesce(F.col("haves"), F.lit(0)).cast("double")
    return {
        "wants": wants,
        "haves": haves,
        "ratio": want_ratio(wants, haves),
        "price": parse_price(F.col("record_price")),
    }


def fit_features(df: DataFrame) -> DataFrame:
    """One row with the range of every number, in one pass.

    ``df`` has wants, haves, record_price, year.
    """
    aggs = [F.count("*").alias("n_rows")]
    for name, value in _numbers().items():
        aggs += [F.min(value).alias(f"{name}_lo"), F.max(value).alias(f"{name}_hi")]
    low, high = DEFAULT_YEARS
    aggs += [
        F.coalesce(F.min("year"), F.lit(low)).alias("year_lo"),
        F.coalesce(F.max("year"), F.lit(high)).alias("year_hi"),
    ]
    return df.agg(*aggs)


def transform_features(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """The 21 dense features of each record, in a fixed order, next to its own columns."""
    graded = df.withColumn("_grade", grade_index(F.col("media_condition")))
    wide = graded.crossJoin(F.broadcast(fitted))  # ``fitted`` is one row
    categories = [
        hash_index(F.col("artist"), VOCABULARY["artist"]),
        hash_index(F.col("label"), VOCABULARY["label"]),
        *hash_slots(F.col("genres"), VOCABULARY["genre"]),
        *hash_slots(F.col("styles"), VOCABULARY["style"]),
    ]
    scaled = [min_max(v, F.col(f"{n}_lo"), F.col(f"{n}_hi")) for n, v in _numbers().items()]
    year = scale_year(F.col("year"), F.col("year_lo"), F.col("year_hi"))
    values = [*categories, *scaled, year, *grade_one_hot(F.col("_grade"))]
    return wide.select(*df.columns, *[v.alias(n) for n, v in zip(DENSE_COLUMNS, values)])


def title_documents(df: DataFrame, auction_title: str | None = None) -> DataFrame:
    """(id, tokens) of each record's title: made from artist, title, label and year, or an auction's own.

    Where the column ``auction_title`` has a text, that is the title; records without one have theirs made.
    """
    made = raw_title(*[F.col(n) for n in ("artist", "title", "label", "year")])
    title = made if auction_title is None else F.coalesce(F.nullif(F.col(auction_title), F.lit("")), made)
    return df.select("id", usable(title_words(title)).alias("tokens"))


def fit_titles(df: DataFrame, max_features: int = TITLE_TERMS, auction_title: str | None = None) -> DataFrame:
    """The vocabulary of the records' titles."""
    return fit_tfidf(title_documents(df, auction_title), max_features)


def with_titles(df: DataFrame, terms: DataFrame, auction_title: str | None = None, max_features: int = TITLE_TERMS) -> DataFrame:
    """Add the title block: ``title_idx`` (places in the vocabulary, in order) and ``title_weight`` (unit length).

    The block is sparse; a title without known terms has empty arrays.
    """
    vectors = tfidf_vectors(title_documents(df, auction_title), terms, max_features)
    vectors = vectors.select("id", F.col("idx").alias("title_idx"), F.col("weight").alias("title_weight"))
    joined = df.join(vectors, "id", "left")
    none = {"title_idx": "array<int>", "title_weight": "array<double>"}
    return joined.withColumns({n: F.coalesce(F.col(n), F.array().cast(t)) for n, t in none.items()})


def with_vector(df: DataFrame) -> DataFrame:
    """Add ``features``, the dense features as one array."""
    return df.withColumn("features", F.array(*[F.col(n).cast("double") for n in DENSE_COLUMNS]))
