"""DuckDB twins of the scalar expressions in ``qanat.functions`` (for oracles)."""

from __future__ import annotations

from ..functions import text as T

WS = T.JS_WHITESPACE
WS_INNER = WS[1:-1]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def js_trim(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def clean_text(e: str) -> str:
    return f"regexp_replace({js_trim(e)}, {lit(WS + '+')}, ' ', 'g')"


def slugify(e: str) -> str:
    s = e
    for a, b in T.SLUG_WORDS:
        s = f"replace({s}, {lit(a)}, {lit(b)})"
    s = f"translate({s}, {lit(T.SLUG_FOLD_FROM)}, {lit(T.SLUG_FOLD_TO)})"
    s = f"regexp_replace({s}, {lit('[^A-Za-z0-9' + WS_INNER + ']')}, '', 'g')"
    s = js_trim(s)
    s = f"regexp_replace({s}, {lit(WS + '+')}, '-', 'g')"
    return f"lower({s})"


def snippet(e: str, n: int = 200) -> str:
    head = f"split_part({e}, '</p>', 1)"
    nop = (f"(CASE WHEN instr({head}, '<p>') > 0 THEN substring({head}, 1, instr({head}, '<p>') - 1)"
           f" || substring({head}, instr({head}, '<p>') + 3) ELSE {head} END)")
    return f"(CASE WHEN length({nop}) > {n} THEN substring({nop}, 1, {n}) || '...' ELSE {nop} END)"


def classify_source(e: str) -> str:
    return (f"(CASE WHEN starts_with({e}, 'Hadith') THEN 'Hadith' "
            f"WHEN starts_with({e}, 'Tafsir') THEN 'Tafsir' ELSE 'Qur''an' END)")


def map_lookup(e: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {e} {whens} ELSE {e} END)"


def shard_route(e: str, shards=(1, 2)) -> str:
    arr = "[" + ", ".join(str(s) for s in shards) + "]"
    return f"{arr}[abs({e}) % {len(shards)} + 1]"


def hash_embed_ctes(src: str, id_col: str, text_expr: str, name: str, dim: int = 64) -> str:
    """CTEs ``{name}_tok``, ``{name}_sum``, ``{name}`` (id, embedding) -- the
    DuckDB twin of ``qanat.functions.vectors.hash_embed``."""
    sums = ", ".join(f"sum(CASE WHEN b = {i} THEN s ELSE 0 END) AS v{i}" for i in range(dim))
    sq = " + ".join(f"v{i} * v{i}" for i in range(dim))
    arr = ", ".join(f"CASE WHEN nrm = 0 THEN CAST(v{i} AS DOUBLE) ELSE v{i} / nrm END" for i in range(dim))
    return f"""{name}_tok AS (
  SELECT {id_col} AS id, unnest(string_split(lower({clean_text(text_expr)}), ' ')) AS t FROM {src}),
{name}_code AS (
  SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS INTEGER) AS b,
         CASE WHEN length(t) = 0 THEN 0 WHEN ('0x' || substr(md5(t), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS s
  FROM {name}_tok),
{name}_sum AS (SELECT id, {sums} FROM {name}_code GROUP BY id),
{name} AS (SELECT id, [{arr}] AS embedding FROM (SELECT *, sqrt({sq}) AS nrm FROM {name}_sum))"""
