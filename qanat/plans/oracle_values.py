"""Fixed values as the oracles expect them.

Written out a second time on purpose, apart from the constants that the operators use: a
wrong value on either side then fails its comparison.
"""

# --- fixed values -----------------------------------------------------------
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
NO_CONTEXT_ANSWER = "<p>I don't know the answer to that question based on the available sources.</p>"
NO_CONTEXT_SNIPPET = "I don't know the answer to that question..."
NO_CONTEXT_STREAM_MESSAGE = "I don't know the answer based on available sources."
THINKING_MESSAGE = "Searching for relevant sources..."
PROMPT_HEAD = """You are a knowledgeable Islamic Scholar Assistant.
    
    YOUR KNOWLEDGE BASE:
    You have been provided with specific excerpts from the Quran, Hadith, Tasfir and Seerah (Biography).

    INSTRUCTIONS:
    1. **Prioritize Explicit Text:** If the answer is found directly in the provided [Context], cite it as [Source: ...].
    2. **Synthesize Facts:** If the user asks a factual question (e.g., "How many wives?", "When was the Battle of Badr?"), look for "Seerah" or "Historical Consensus" in the provided context.
    3. **Handle Gaps Gracefully:** - If the context contains related hadith but NOT the exact answer (e.g., mention of a wife, but not the total number), DO NOT guess.
       - Instead, state: "The specific sources provided generally discuss [Topic found in context], but do not explicitly state [Missing Detail]."
    4. **Tone:** Respectful, precise, and academic.

    CONTEXT provided for this question:
    """
CONNECTION_ERRORS = ["ECONNREFUSED", "ENOTFOUND", "terminating connection", "Connection terminated unexpectedly"]
ERROR_FAMILIES = [("auth", ["401", "Invalid token"]), ("not_found", ["404"]), ("model_loading", ["503", "loading", "currently loading"]),
                  ("rate_limit", ["429", "rate limit"])]
TAFSIR_NAMES = {
    "en-tafisr-ibn-kathir": "Ibn Kathir",
    "en-tafsir-maariful-quran": "Maariful Quran",
    "en-tafsir-qurtubi": "Qurtubi",
    "en-tafsir-tablighi": "Tablighi",
    "en-tafsir-jalalayn": "Jalalayn",
}
TAFSIRS = ["en-tafisr-ibn-kathir", "en-tafsir-ibn-abbas"]
# -----------------------------------------------------------------------------
