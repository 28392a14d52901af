"""Answer assembly over tables of questions (Q-1..Q-4, H5, A1, T1 pieces).

Questions and documents are both DataFrames; retrieval is the blocked
cosine top-k join, everything after it is per-question aggregation on the
question key (one shuffle), and the save is the keyed upsert fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, fs_delete, scratch_path
from . import embedding as E
from . import merge as M
from . import topk as K

# --- fixed values -----------------------------------------------------------
NO_CONTEXT_ANSWER = "<p>I don't know the answer to that question based on the available sources.</p>"
NO_CONTEXT_SNIPPET = "I don't know the answer to that question..."
NO_CONTEXT_STREAM_MESSAGE = "I don't know the answer based on available sources."
THINKING_MESSAGE = "Searching for relevant sources..."
STREAM_ERROR_MESSAGE = "Failed to process question"
SYSTEM_SOURCE = "System"
UNCATEGORIZED = "Uncategorized"
_PROMPT_HEAD = """You are a knowledgeable Islamic Scholar Assistant.
    
    YOUR KNOWLEDGE BASE:
    You have been provided with specific excerpts from the Quran, Hadith, {kinds} and Seerah (Biography).

    INSTRUCTIONS:
    1. **Prioritize Explicit Text:** If the answer is found directly in the provided [Context], cite it as [Source: ...].
    2. **Synthesize Facts:** If the user asks a factual question (e.g., "How many wives?", "When was the Battle of Badr?"), look for "Seerah" or "Historical Consensus" in the provided context.
    3. **Handle Gaps Gracefully:** - If the context contains related hadith but NOT the exact answer (e.g., mention of a wife, but not the total number), DO NOT guess.
       - Instead, state: "The specific sources provided generally discuss [Topic found in context], but do not explicitly state [Missing Detail]."
    4. **Tone:** Respectful, precise, and academic.

    CONTEXT provided for this question:
    """
PROMPT_HEAD_BATCH = _PROMPT_HEAD.replace("{kinds}", "Tasfir")
PROMPT_HEAD_STREAM = _PROMPT_HEAD.replace("{kinds}", "Tasir")
# -----------------------------------------------------------------------------


DEFAULT_EMBEDDER = E.HashEmbedder()


def embed_questions(questions: DataFrame, id_col: str = "question_id", text_col: str = "question",
                    embedder: E.Embedder = DEFAULT_EMBEDDER) -> DataFrame:
    """Query side: clean, add the instruction prefix, embed."""
    q = questions.select(id_col, T.instruct_query(T.clean_text(F.col(text_col))).alias("__q"))
    return E.embed(q, id_col, "__q", embedder)


def index_vectors(corpus: DataFrame, embedder: E.Embedder = DEFAULT_EMBEDDER) -> DataFrame:
    """Document side of the index: (id, embedding)."""
    return E.embed(corpus.select("id", "text"), "id", "text", embedder)


def index_corpus(corpus: DataFrame, embedder: E.Embedder = DEFAULT_EMBEDDER, root: str | None = None) -> K.VectorIndex:
    """The index of the documents. Their vectors are written first: a build reads them several times, and
    each text is to be embedded once."""
    spark = corpus.sparkSession
    path = scratch_path(spark, "index-vectors")
    index_vectors(corpus, embedder).write.parquet(path)
    index = K.build_index(spark.read.schema("id long, embedding array<double>").parquet(path), "id", "embedding", root, dim=embedder.dimension)
    fs_delete(spark, path)
    return index


def retrieve(questions: DataFrame, corpus: DataFrame, k: int, doc_vectors: DataFrame | K.VectorIndex | None = None,
             embedder: E.Embedder = DEFAULT_EMBEDDER, nprobe: int | None = None) -> DataFrame:
    """(question_id, rank, id, score, source, text, type) -- top-k documents
    per question; hits without a document row are dropped after the cut.
    ``doc_vectors`` is a prebuilt index (or the vectors of one), made with the same
    ``embedder``; built when absent. Exact, or among ``nprobe`` cells of the index."""
    qv = embed_questions(questions, embedder=embedder)
    index = doc_vectors
    if not isinstance(index, K.VectorIndex):
        index = index_corpus(corpus, embedder) if index is None else K.build_index(index, "id", "embedding", dim=embedder.dimension)
    hits = K.search(qv, index, k, q_id="question_id", q_vec="embedding", nprobe=nprobe, n_queries=questions.count())
    meta = corpus.select("id", "source", "text", "type")
    return (hits.join(meta, hits.did == meta.id, "inner")
            .select(F.col("qid").alias("question_id"), "rank", "id", "score", "source", "text", "type"))


def majority_category(hits: DataFrame, key: str = "question_id") -> DataFrame:
    """Most frequent first word of the sources; ties go to the word whose
    first appearance is latest (strict '>' reduce seeded with the default)."""
    h = hits.select(key, "rank", T.first_token(F.col("source")).alias("name"))
    cnt = h.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"))
    return cnt.groupBy(key).agg(F.max_by("name", F.struct("n", "first_rank")).alias("category"))


def source_item(source, text):
    return F.struct(source.alias("citation"), T.classify_source(source).alias("type"), text.alias("text"),
                    F.lit(T.SOURCE_URL_PLACEHOLDER).alias("url"), F.lit("").alias("arabic"),
                    F.lit("").alias("transliteration"), F.lit(T.SOURCE_AUDIO_PLACEHOLDER).alias("audioUrl"))


def per_question(hits: DataFrame, key: str = "question_id") -> DataFrame:
    """One row per question with contexts in rank order: sources array,
    context lines, primary source, best text."""
    ranked = F.array_sort(F.collect_list(F.struct(
        "rank", source_item(F.col("source"), F.col("text")).alias("item"),
        T.context_line(F.col("source"), F.col("text")).alias("line"),
        T.first_token(F.col("source")).alias("name"))))
    # majority category from the (k-bounded) ranked list in the same pass:
    # max of (count, first position, name) -- ties go to the later first
    # appearance, like the strict '>' reduce of the reference
    names = F.transform("__r", lambda x: x["name"])
    votes = F.transform(names, lambda n: F.struct(
        F.size(F.filter(names, lambda m: m == n)).alias("n"),
        F.array_position(names, n).alias("first"), n.alias("name")))
    return (hits.groupBy(key).agg(ranked.alias("__r"),
                                  F.min_by("source", "rank").alias("primary_source"),
                                  F.min_by("text", "rank").alias("best_text"))
            .select(key, F.transform("__r", lambda x: x["item"]).alias("sources"),
                    F.transform("__r", lambda x: x["line"]).alias("contexts"),
                    "primary_source", "best_text", F.array_max(votes)["name"].alias("category")))


def build_prompt(question, contexts, stream: bool = False):
    head = PROMPT_HEAD_STREAM if stream else PROMPT_HEAD_BATCH
    system = F.concat(F.lit(head), F.array_join(contexts, "\n\n"), F.lit("\n\n    Question: "), question)
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(
        F.lit("Source "), (i + 1).cast("string"), F.lit(": "), c)), "\n\n")
    return F.concat(system, F.lit("\n\nHere are the sources:\n\n"), numbered, F.lit("\n\n\nQuestion: "), question)


def batch_ask(questions: DataFrame, corpus: DataFrame, generated: DataFrame | None = None, k: int = 3,
              doc_vectors: DataFrame | K.VectorIndex | None = None, categories: DataFrame | None = None,
              embedder: E.Embedder = DEFAULT_EMBEDDER) -> DataFrame:
    """Answer records for a table of questions.

    ``generated`` is an optional input table (slug, answer) of model output;
    without it the extractive default is the best-ranked context in <p>.
    Questions with no context get the fixed answer, source 'System',
    category 'Uncategorized' and an empty sources array. With a
    ``categories`` table (slug, name) the category goes through
    find-or-create: an existing slug keeps its stored name.
    """
    q = questions.select("question_id", "question", T.slugify(F.col("question")).alias("slug"))
    hits = retrieve(q.select("question_id", "question"), corpus, k, doc_vectors, embedder)
    per = per_question(hits)
    if categories is not None:
        cats = categories.select(F.col("slug").alias("__cs"), F.col("name").alias("__cn"))
        per = (per.withColumn("__cs", T.slugify(F.col("category"))).join(cats, "__cs", "left")
               .withColumn("category", F.coalesce("__cn", "category")).drop("__cs", "__cn"))
    j = q.join(per, "question_id", "left")
    if generated is not None:
        j = j.join(generated.select("slug", F.col("answer").alias("__gen")), "slug", "left")
        gen = F.col("__gen")
    else:
        gen = F.lit(None).cast("string")
    has = F.col("primary_source").isNotNull()
    answer = F.when(~has, F.lit(NO_CONTEXT_ANSWER)).otherwise(
        F.coalesce(gen, F.concat(F.lit("<p>"), F.col("best_text"), F.lit("</p>"))))
    empty_sources = F.array().cast(per.schema["sources"].dataType)
    return j.select(
        "question_id", "question", "slug", answer.alias("answer"),
        F.when(has, T.answer_snippet(answer)).otherwise(F.lit(NO_CONTEXT_SNIPPET)).alias("answer_snippet"),
        F.when(has, F.col("primary_source")).otherwise(F.lit(SYSTEM_SOURCE)).alias("source"),
        F.when(has, F.col("category")).otherwise(F.lit(UNCATEGORIZED)).alias("category"),
        F.coalesce(F.col("sources"), empty_sources).alias("sources"))


def ask_and_save(questions: DataFrame, corpus: DataFrame, answers: DataFrame, categories: DataFrame, as_of,
                 generated: DataFrame | None = None, k: int = 3, doc_vectors: DataFrame | K.VectorIndex | None = None,
                 embedder: E.Embedder = DEFAULT_EMBEDDER) -> tuple[DataFrame, DataFrame]:
    """(answers, categories) after a batch: each answer's category is found by its slug, whose
    stored name stands, or created under the name of the first question that needs it;
    then the answers are upserted by slug. Questions without context create no category.
    Answered once: both results read the checkpointed batch."""
    asked = cut_lineage(batch_ask(questions, corpus, generated, k, doc_vectors, embedder=embedder))
    wanted = asked.where(F.col("source") != SYSTEM_SOURCE).select(
        T.slugify(F.col("category")).alias("slug"), F.col("category").alias("name"), F.col("question_id").alias("seq"))
    stored = M.find_or_create(categories, wanted, "slug", "name", "seq")
    names = stored.select(F.col("slug").alias("__s"), F.col("name").alias("__n"))
    named = (asked.withColumn("__s", F.when(F.col("source") != SYSTEM_SOURCE, T.slugify(F.col("category")))).join(names, "__s", "left")
             .withColumn("category", F.coalesce("__n", "category")).drop("__s", "__n"))
    return save_answers(answers, named, as_of), stored


def save_answers(existing: DataFrame, asked: DataFrame, as_of) -> DataFrame:
    """Answer upsert on slug: the last question per slug wins; timestamps
    of an existing answer are never touched."""
    inc = asked.select("slug", "question", "answer", "answer_snippet", "source", "category",
                       F.to_json("sources").alias("sources_json"), F.col("question_id").alias("seq"))
    return M.upsert(existing, inc, ["slug"], ["question", "answer", "answer_snippet", "source", "category",
                                               "sources_json"], as_of, seq="seq", touch_updated=False)
