"""Shard routing and error classification as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Shards that receive writes (the primary shard 0 is excluded), sorted.
WRITE_SHARDS = (1, 2)
# Message fragments that mark a connection error (shard becomes inactive).
CONNECTION_ERROR_PATTERNS = ("ECONNREFUSED", "ENOTFOUND", "terminating connection",
                             "Connection terminated unexpectedly")
# Provider error families, first match wins, in this order.
ERROR_FAMILIES = (
    ("auth", ("401", "Invalid token")),
    ("not_found", ("404",)),
    ("model_loading", ("503", "loading", "currently loading")),
    ("rate_limit", ("429", "rate limit")),
)
# Display names of commentary editions; unknown ids display as themselves.
TAFSIR_NAMES = {
    "en-tafisr-ibn-kathir": "Ibn Kathir",
    "en-tafsir-maariful-quran": "Maariful Quran",
    "en-tafsir-qurtubi": "Qurtubi",
    "en-tafsir-tablighi": "Tablighi",
    "en-tafsir-jalalayn": "Jalalayn",
}
SUPPORTED_TAFSIRS = ("en-tafisr-ibn-kathir", "en-tafsir-ibn-abbas")
# Scripture editions: (id, display name); language is arabic for ids 'ara-*'.
EDITIONS = (
    ("eng-sahih", "Sahih International"),
    ("eng-yusufali", "Yusuf Ali"),
    ("eng-pickthall", "Pickthall"),
    ("eng-shakir", "Shakir"),
    ("ara-quranuthmani", "Arabic Uthmani Script"),
)
# -----------------------------------------------------------------------------


def shard_route(id_col: Column, shards=WRITE_SHARDS) -> Column:
    """abs(id) % len(shards) indexes the sorted list of eligible shards."""
    if not shards:
        raise ValueError("no eligible shards configured")
    ordered = sorted(shards)
    return F.element_at(F.array(*[F.lit(s) for s in ordered]),
                        (F.abs(id_col) % F.lit(len(ordered))).cast("int") + 1)


def is_connection_error(msg: Column) -> Column:
    cond = F.lit(False)
    for p in CONNECTION_ERROR_PATTERNS:
        cond = cond | msg.contains(p)
    return F.coalesce(cond, F.lit(False))


def classify_error(msg: Column) -> Column:
    """connection / auth / not_found / model_loading / rate_limit / other;
    null message -> null."""
    out = F.when(msg.isNull(), F.lit(None).cast("string")).when(is_connection_error(msg), "connection")
    for fam, pats in ERROR_FAMILIES:
        cond = F.lit(False)
        for p in pats:
            cond = cond | msg.contains(p)
        out = out.when(cond, fam)
    return out.otherwise("other")


def edition_language(edition_id: Column) -> Column:
    return F.when(edition_id.startswith("ara-"), "arabic").otherwise("english")
