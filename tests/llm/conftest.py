import pytest

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split()


def texts():
    """Edge cases first: null, empty, blank, letterless, one word, very long word and text, personal data, junk."""
    prose = [" ".join(WORDS[(i * 7 + j * j) % len(WORDS)] + ("." if j % 9 == 8 else "") for j in range(30 + i)) for i in range(8)]
    return [
        None, "", "  \n\t ", "12 34 !!", "Word", "x" * 5000, "1" * 3000 + " " + "a@" * 400 + "b.c", ("lorem ipsum dolor " * 4000).strip(),
        f"before {PASSAGE} after", f"BEFORE, {PASSAGE.upper()}!", "seven eight nine ten",
        "mail a.b@c-d.org or x@y or 1.2.3.4.5, 256.1.1.1 +1 (555) 010-9999 card 4111 1111 1111 1111 and 4111111111111112",
        "4111111111111111 5500005555555559 next", "Übergrößenträger straße né à 中文 字 😀 é́ don't 'tis I'll ''s x's's",
        "the the the the the the the the the the", "a b c d e\na b c d e\na b c d e", "SE!! CIÓN!! ***### | | |", "tab\tand\x0bvt\x0cff\rcr\nlf   end ",
        "<s>special</s> <|endoftext|> ▁mark ▁▁ two", "01.002.0255.4 +12345678 +123456789012345678 " + "9" * 16, *prose, prose[0], prose[1] + " extra", prose[2].upper()]


#: names that operators might use themselves
CLASH = ["fp", "k1", "K2", "base", "candidates", "words", "kept", "score", "h", "n", "root", "spans", "component_id"]


@pytest.fixture(scope="session")
def rows():
    t = texts()
    out = [(i, x) for i, x in enumerate(t)]
    out += [(None, None), (None, t[20]), (5, t[21]), (5, t[21]), (8, t[8])]  # null ids, equal ids, repeated rows
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    data = [(d, t, ["en", "fr", None][i % 3], None, None if t is None else len(t), *["z"] * len(CLASH)) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(4)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
