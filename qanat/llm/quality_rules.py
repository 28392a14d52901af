"""Quality rules: a threshold table compiled into one Spark projection.

Everything is row-local and built in: no user function, no shuffle. A rule is
a row (name, metric, least, most); the table compiles into one boolean per rule
and their conjunction. Repeated 5-word windows are found by sorting the hashes
of a text's own windows, so a text of n words costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: words of a window that must not come twice
WINDOW = 5

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "on", "was", "are", "by",
              "this", "from", "as", "at", "an", "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que",
              "qui", "dans", "pour", "par", "sur", "pas", "au", "est", "il", "elle", "der", "die", "das", "und", "den",
              "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "el",
              "los", "las", "y", "del", "se", "por", "con", "para", "una", "su", "al", "lo", "como"]


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: metric bounds beyond the base rule; a metric without words or lines is 0 and passes its ``most``
RULES = (
    Rule("words", "n_words", least=10),
    Rule("word_length", "mean_word_chars", least=2, most=16),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.3),
    Rule("repeated_words", "repeat_ratio", most=0.2),
    Rule("upper_case", "upper_ratio", most=0.5),
    Rule("bullets", "bullet_ratio", most=0.9),
    Rule("ellipses", "ellipsis_ratio", most=0.3),
)


def _repeat_words(order: Column) -> Column:
    """Words in windows that come twice or more; ``order`` holds (hash, place) sorted."""
    same = lambda i, x: F.coalesce(F.get(order, i)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(order, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["i"]))
    gaps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    total = let(places, lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(F.size(order) > 0, total).otherwise(F.lit(0).cast("long"))


def _gram_hashes(hashes: Column) -> Column:
    gram = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), gram)).otherwise(F.array().cast("array<bigint>"))


def _counts(words: Column, lines: Column, order: Column, n_symbols: Column) -> Column:
    upper = lambda w: F.length(F.regexp_replace(w, r"[^\p{Lu}]+", ""))
    lower = lambda w: F.length(F.regexp_replace(w, r"[^\p{Ll}]+", ""))
    bare = lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?]++$", ""))
    size = lambda x: F.size(x).cast("long")
    return F.struct(
        size(words).alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), n_symbols.alias("n_symbols"),
        size(lines).alias("n_lines"), (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
        size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*+[-*•]"))).alias("n_bullets"),
        size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipses"),
        size(F.filter(words, lambda w: (upper(w) >= 2) & (lower(w) == 0))).alias("n_upper"),
        size(F.filter(words, lambda w: bare(w).isin(STOP_WORDS))).alias("n_stop"), _repeat_words(order).alias("n_repeat_words"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and ratios of each row's whole text (null: no words).

    All counts are one expression whose intermediate arrays are bound by ``let``:
    a filter on a result that the optimizer moves below the projection then still
    costs one evaluation a row, not one for every word.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long")
    parts = F.struct(F.array_remove(F.split("text", SPACE), "").alias("words"), lines.alias("lines"), symbols.alias("n_symbols"))
    order = lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(
        F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    counts = let(parts, lambda p: let(F.transform(p["words"], lambda w: F.xxhash64(w)), lambda h: let(_gram_hashes(h), lambda g: let(
        order(g), lambda o: _counts(p["words"], p["lines"], o, p["n_symbols"])))))
    got = id_text(docs, id_col, text_col).select("doc_id", counts.alias("m")).select("doc_id", "m.*")
    per_word = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))
    per_line = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n_lines"), F.lit(0)), F.lit(0.0))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_word("word_chars").alias("mean_word_chars"), per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_stop").alias("stop_ratio"), per_word("n_upper").alias("upper_ratio"),
        per_word("n_repeat_words").alias("repeat_ratio"), per_line("n_dup_lines").alias("dup_line_ratio"),
        per_line("n_bullets").alias("bullet_ratio"), per_line("n_ellipses").alias("ellipsis_ratio"))


def compiled(rules: tuple[Rule, ...]) -> list[Column]:
    """One boolean column per rule: true where the row stays within the bounds."""
    out = []
    for r in rules:
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (F.col(r.metric) >= F.lit(r.least))
        if r.most is not None:
            ok = ok & (F.col(r.metric) <= F.lit(r.most))
        out.append(ok.alias(f"ok_{r.name}"))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, one ok_<rule> column per rule and ``kept`` for each row.

    ``base_failed``: fewer than 10 words, or over 20 in 100 words inside repeated
    windows. ``kept`` is false then, and else the conjunction of the rules. A
    null or empty text has no words and fails. Repeated rows stay repeated.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    checks = compiled(rules)
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"ok_{r.name}")
    return (measures(docs, id_col, text_col).select("*", failed.alias("base_failed"), *checks)
            .withColumn("kept", kept))


def contract(docs: DataFrame) -> DataFrame:
    """The digest columns, then the rules' verdicts."""
    got = quality_rules(docs)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return got.select(*base, *[c for c in got.columns if c.startswith("ok_")])
