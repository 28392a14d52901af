"""Vector scalars as native expressions, and the default hash embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ws_to_space

# --- fixed values -----------------------------------------------------------
# Default embedding dimension per model id (local provider); unknown -> 384.
MODEL_DIMENSIONS = {
    "Xenova/all-MiniLM-L6-v2": 384,
    "Xenova/all-mpnet-base-v2": 768,
    "Xenova/bge-small-en-v1.5": 384,
    "Xenova/bge-m3": 1024,
}
DEFAULT_DIMENSION_BY_PROVIDER = {"local": 384, "huggingface": 1024, "gemini": 768}
# Dimension of the built-in feature-hash embedder.
HASH_DIM = 64
# -----------------------------------------------------------------------------


_registered: dict[str, int] = {f"hash-{HASH_DIM}": HASH_DIM}


def register_model(model: str, dimension: int) -> None:
    """Name a further model's dimension (on the driver, where plans are made)."""
    _registered[model] = dimension


def known_models() -> dict[str, int]:
    return MODEL_DIMENSIONS | _registered


def dimension_of(model: str, provider: str = "local") -> int:
    """The registered dimension of a model; of an unknown one, its provider's default."""
    return known_models().get(model) or DEFAULT_DIMENSION_BY_PROVIDER[provider]


def as_double_vector(c: Column) -> Column:
    return c.cast("array<double>")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; a zero vector is returned unchanged."""
    n = l2_norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


# leading-number grammar of JavaScript's parseFloat
_PARSE_FLOAT = r"^\s*([+-]?(?:Infinity|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))"


def parse_float(c: Column) -> Column:
    """parseFloat: the longest leading number, NaN when there is none."""
    num = F.regexp_extract(c, _PARSE_FLOAT, 1)
    return F.when(num == "", F.lit(float("nan"))).otherwise(num.cast("double"))


def decode_vector_text(c: Column) -> Column:
    """JSON array text -> array<double>; if it is not JSON, drop the first
    '[' and first ']' and parseFloat every comma-separated piece."""
    as_json = F.from_json(c, "array<double>")
    stripped = F.regexp_replace(F.regexp_replace(c, r"^([^\[]*)\[", "$1"), r"^([^\]]*)\]", "$1")
    parsed = F.transform(F.split(stripped, ","), parse_float)
    return F.when(c.isNull(), F.lit(None).cast("array<double>")).otherwise(F.coalesce(as_json, parsed))


def unwrap_vector(nested: Column) -> Column:
    """[[...]] -> first inner vector; an empty answer gives null (reject)."""
    return F.when(F.size(nested) > 0, F.element_at(nested, 1))


def unwrap_or_reject(df: DataFrame, col: str, out: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Provider answers as nested vectors -> (rows with a vector, rejected
    rows with a reason) instead of failing the job."""
    v = df.withColumn(out, unwrap_vector(F.col(col)))
    ok = v.where(F.col(out).isNotNull() & (F.size(out) > 0))
    bad = v.where(F.col(out).isNull() | (F.size(out) <= 0)).withColumn(
        "reason", F.lit("Invalid embedding format: empty result"))
    return ok, bad


def hash_embed_expr(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM,
                    out_col: str = "embedding") -> DataFrame:
    """Deterministic feature-hash embedding of whole texts.

    token = whitespace-separated word of lower(clean_text(text));
    bucket = (first 8 hex digits of md5(token)) mod dim; sign = +1 when the
    9th hex digit is even, else -1; vector = signed bucket counts, L2-normalised.

    Plan: explode tokens (codegen'd Generate) -> partial/final sum per
    (document, bucket) -> one small map per document (<= dim entries) ->
    dense array. Only <= dim rows per document and partition cross the
    shuffles; no per-token higher-order function runs.
    """
    # whitespace -> ' ' by a char map, split on the single space (no regex),
    # drop empty pieces; explode_outer keeps documents without any token
    words = F.array_remove(F.split(F.lower(ws_to_space(F.col(text_col))), " ", -1), "")
    toks = (df.select(F.col(id_col).alias("__id"), F.explode_outer(words).alias("__t"))
            .select("__id", F.md5(F.coalesce("__t", F.lit(""))).alias("__h"), F.length("__t").alias("__n"))
            .select("__id",
                    F.pmod(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
                    .alias("__b"),
                    F.when(F.coalesce(F.col("__n"), F.lit(0)) == 0, F.lit(0))
                    .when(F.conv(F.substring("__h", 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1))
                    .otherwise(F.lit(-1)).alias("__s")))
    per_bucket = toks.groupBy("__id", "__b").agg(F.sum("__s").alias("__v"))
    per_doc = per_bucket.groupBy("__id").agg(
        F.map_from_entries(F.collect_list(F.struct("__b", "__v"))).alias("__m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.element_at(F.col("__m"), i), F.lit(0)).cast("double"))
    return (per_doc.select(F.col("__id").alias(id_col), dense.alias("__raw"))
            .select(id_col, l2_normalize(F.col("__raw")).alias(out_col)))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM,
               out_col: str = "embedding", keep: list[str] | tuple = ()) -> DataFrame:
    """Same embedding as ``hash_embed_expr``, computed row-locally in Arrow batches: no token
    rows are shuffled. ``keep`` columns ride along (no join back to the input)."""
    from ..operators.embedding import HashEmbedder, embed
    return embed(df, id_col, text_col, HashEmbedder(dim), out_col, keep)
