"""String scalars as native Spark expressions (JVM-side, codegen-friendly).

Every function maps Column -> Column; no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace as JavaScript's \s defines it (used by trim / \s+ in the
# reference's text handling), written as a Java/RE2 character class.
JS_WHITESPACE = (
    r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# The same set as plain characters (for translate / btrim).
JS_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# Query instruction prefix of the local embedding provider.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
# Placeholders written into every formatted source item.
SOURCE_URL_PLACEHOLDER = "#"
SOURCE_AUDIO_PLACEHOLDER = "#"
# Slug contract (our own fold table; the reference delegates to a library).
# Multi-character replacements, applied in this order:
SLUG_WORDS = [("&", "and"), ("%", "percent"), ("$", "dollar"), ("ß", "ss"),
              ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("-", " ")]
# Single-character accent folds:
SLUG_FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
SLUG_FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# -----------------------------------------------------------------------------


_WS_NOT_SPACE = JS_WHITESPACE_CHARS.replace(" ", "")


def js_trim(c: Column) -> Column:
    """String.prototype.trim: strips JS whitespace at both ends."""
    return F.btrim(c, F.lit(JS_WHITESPACE_CHARS))


def ws_to_space(c: Column) -> Column:
    """Every JS whitespace character -> ' ' (a char map, no regex)."""
    return F.translate(c, _WS_NOT_SPACE, " " * len(_WS_NOT_SPACE))


def clean_text(c: Column) -> Column:
    """trim, then every run of whitespace -> one space (same result as
    mapping whitespace to ' ', collapsing spaces, trimming spaces)."""
    return F.btrim(F.regexp_replace(ws_to_space(c), " {2,}", " "), F.lit(" "))


def instruct_query(c: Column) -> Column:
    return F.concat(F.lit(QUERY_INSTRUCTION), c)


def slugify(c: Column) -> Column:
    """lower + strict slug: symbol words, accent fold, keep [A-Za-z0-9 ws],
    trim, whitespace runs -> '-', lower-case."""
    s = c
    for src, dst in SLUG_WORDS:
        s = F.replace(s, F.lit(src), F.lit(dst))
    s = F.translate(s, SLUG_FOLD_FROM, SLUG_FOLD_TO)
    s = F.regexp_replace(s, f"[^A-Za-z0-9\\t\\n\\x{{0B}}\\f\\r \\x{{A0}}\\x{{1680}}"
                            f"\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}"
                            f"\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]", "")
    s = js_trim(s)
    s = F.regexp_replace(s, f"{JS_WHITESPACE}+", "-")
    return F.lower(s)


def answer_snippet(c: Column, max_len: int = 200) -> Column:
    """Text before the first '</p>', first '<p>' removed, cut at max_len + '...'."""
    head = F.substring_index(c, "</p>", 1)
    pos = F.instr(head, "<p>")
    no_p = F.when(pos > 0, F.concat(head.substr(F.lit(1), pos - 1),
                                     head.substr(pos + 3, F.lit(2147483647)))
                  ).otherwise(head)
    return F.when(F.length(no_p) > max_len,
                  F.concat(no_p.substr(F.lit(1), F.lit(max_len)), F.lit("..."))
                  ).otherwise(no_p)


def capitalize(c: Column) -> Column:
    """First character upper-cased, rest untouched (not initcap)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.lit(2147483647)))


def falsy_default(c: Column, default) -> Column:
    """JavaScript ``x || default``: null and '' both take the default."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def falsy_number_default(c: Column, default) -> Column:
    return F.coalesce(F.nullif(c, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def map_lookup(c: Column, mapping: dict[str, str]) -> Column:
    """Constant-map lookup, falling back to the key itself."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), c), c)


def cite_verse(surah_name: Column, surah: Column, verse: Column) -> Column:
    return F.concat(F.lit("Quran "), surah_name, F.lit(" "), surah.cast("string"), F.lit(":"), verse.cast("string"))


def cite_book(book: Column) -> Column:
    return F.concat(F.lit("Hadith ("), book, F.lit(")"))


def cite_commentary(name: Column, surah: Column, ayah: Column) -> Column:
    return F.concat(F.lit("Tafsir "), name, F.lit(" - Surah "), surah.cast("string"), F.lit(":"), ayah.cast("string"))


def cite_numbered(title: Column, number: Column) -> Column:
    """Title and number, trimmed where there is no number."""
    return js_trim(F.concat(title, F.lit(" "), F.coalesce(number, F.lit(""))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def context_line(source: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source: "), source, F.lit("] "), text)


def classify_source(citation: Column) -> Column:
    """Hadith / Tafsir by prefix, everything else Qur'an."""
    return (F.when(citation.startswith("Hadith"), F.lit("Hadith"))
            .when(citation.startswith("Tafsir"), F.lit("Tafsir"))
            .otherwise(F.lit("Qur'an")))


def first_token(c: Column) -> Column:
    return F.split(c, " ", -1).getItem(0)
