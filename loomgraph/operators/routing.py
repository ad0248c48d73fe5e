"""Which way a question takes: predicates, intents, routes and anchors (RNK-2, 8..10, 12, 14, 15, 17, INT-5, INT-6, RTE-1, RTE-2, RTE-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import queries as U
from ..functions.queries import holds_any, words
from ..functions.text import tokens

# Terms of the domain (those of two letters count as whole words only), and markers of other topics.
DOMAIN_TERMS = (
    "ai", "a.i", "ml", "aiml", "ai/ml", "ai-ml", "machine learning", "deep learning", "neural", "model", "agent", "agents", "agentic", "llm", "language model", "transformer", "attention",
    "bert", "gpt", "rag", "rags", "retrieval", "lora", "fine-tun", "finetun", "embedding", "vector", "knowledge graph", "dataset", "training", "inference", "nlp",
    "computer vision", "comp vision", "cnn", "rnn", "gradient", "optimizer", "reinforcement", "supervised", "unsupervised", "peft", "parameter-efficient",
    "pretrain", "pre-train", "token", "encoder", "decoder", "multi-head", "self-attention", "vision", "image recognition", "object detection",
    "framework", "frameworks", "pytorch", "tensorflow", "hugging face", "huggingface", "langchain", "llamaindex", "openai", "anthropic", "diffusion", "stable diffusion",
    "classification", "regression", "clustering", "generative", "foundation model", "representation", "representations", "latent space", "manifold", "generalization", "gru", "lstm",
)
OFF_TOPIC = (
    "weather", "temperature outside", "stock price", "recipe", "cook", "football", "soccer", "cricket score", "who won", "joke", "horoscope",
    "astronomy", "astrophysics", "constellation", "planet jupiter", "britney spears", "celebrity gossip", "super bowl", "world cup",
    "batman", "superman", "harry potter", "sourdough", "calorie", "calories", "wine pairing", "my ex", "pyramids", "ancient egypt",
    "relativity", "physics", "chemistry", "biology", "photosynthesis", "shakespeare", "world war", "history", "literature",
)
# What a question is expanded by for a vector search.
EXPANSIONS = {
    "domain": "machine learning artificial intelligence deep learning",
    "agents": "autonomous agents multi-agent systems tool use planning decision making language models reinforcement learning",
    "retrieval": "retrieval augmented generation dense retrieval documents",
    "vision": "computer vision image recognition convolutional neural networks",
    "language": "natural language processing text transformers language models",
}
# The broad subjects that a beginner names, and how a beginner asks.
FIELDS = ("ai", r"a\.?i\.?", "ml", "aiml", "ai/?ml", "machine learning", "deep learning")
BEGIN = ("start learning", "getting started", "how do i start", "how to start")
PROGRAMME = ("syllabus", "curriculum", "roadmap", "path")
FIELD_CUES = (*FIELDS, "data science", "neural", "llm", "transformer")
# Words of teaching and of theory, and of orders to produce or install something.
THEORY_WORDS = (
    "theoretical", "theory", "curriculum", "prerequisites?", "foundational", "upstream", "downstream", "stepping stones", "learning path", "map the path", "mathematical definition", "strict(?:ly)? mathematical",
    "exactly as (?:it is )?described", r"according to the (?:\w+ )?(?:paper|text|library)", "as detailed in the library", "conceptually connect", "define the", "rank decomposition", "self-?attention", "masked language",
    "covariance matrix", "orthonormal", "gaussian distribution", "marginal probability", "maximum likelihood", "queries?,? keys?,? and values?",
)
ORDER_VERBS = ("write", "generate", "provide", "give me", "draft", "compose", "outline", "create")
ORDER_THINGS = (
    "script", "code", "dockerfile", "scraper", "function", "program", "query", "pseudo-?code", "email", "essay", "letter", "homework", "draft", "schema", "config", "tutorial", "commands?",
)
SHELLS, SET_UP = ("bash", "shell", "python", "cypher", "git"), ("install", "deploy", "integrate", "configure", "set ?up")
OTHER_ORDERS = ("ci/?cd", "commands? to (?:start|run|launch|deploy|train)", "dockerfile", "docker compose", "docker container", "pip install", "apt-get", "training loop", "web scraper", "step[- ]by[- ]step tutorial")
CREATIVE = ("audio", "emotional", "story", "poem", "song", "fiction", "novel", "creative", "play")
THEORY_NOUNS = ("matrix", "matrices", "attention", "transformer", "gradient", "regression", "classification", "neural", "probability", "chain rule")
STYLE = ("using gen ?z slang", "gen ?z slang", "using slang", "in slang", "(?:a )?bunch of emojis", "lots of emojis", "use emojis", "with emojis", "explain like i'?m 5", "eli5", r"in the style of \w+", "as a pirate", r"talk like a \w+")
LEADS = ("hi", "hello", "hey", "yo", "sup", "howdy", "good (?:morning|afternoon|evening)", "well", "anyway", "anyhow", "so", "btw", "by the way", "how are you", "how'?s it going")
# Words that make a question technical, whatever else it says.
TECHNICAL = (
    *FIELDS, "data science", "neural", "network", "llm", "transformer", "attention", "backprop", "gradient", "optimizer", "lora", "rag", "bert", "gpt", "encoder", "decoder", "embedding", "token", "logit", "latent",
    "regression", "classification", "supervised", "unsupervised", "reinforcement", "policy", "reward", "agent", "environment", "state", "action", "observation", "loss", "cost", "function", "activation", "softmax",
    "batch", "epoch", "learning rate", "momentum", "weight", "bias", "layer", "convolution", "pooling", "filter", "kernel", "matrix", "matrices", "jacobian", "covariance", "probability", r"fine-?tun\w*",
)
BLOCKING = ("implementation", "out_of_domain", "entity_trivia", "meta")


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def has_domain_terms(c: Column) -> Column:
    """RNK-14."""
    q = _low(c)
    return holds_any(q, tuple(t for t in DOMAIN_TERMS if len(t) > 2)) | q.rlike(words(*[t for t in DOMAIN_TERMS if len(t) <= 2]))


def is_offtopic(c: Column) -> Column:
    """RNK-15."""
    return holds_any(c, OFF_TOPIC)


def is_onboarding(c: Column) -> Column:
    """RNK-12: a wish to begin with the whole field, not with one concept; never without a cue of the field."""
    q = F.trim(_low(c))
    learn = words("learn(?:ing)?") + r"(?:\s+about)?\s+" + words(*FIELDS)
    starts = q.rlike(words(*BEGIN)) | q.rlike(learn) | q.rlike(words(*FIELDS) + r"\s+" + words(*PROGRAMME)) | q.rlike(words(*PROGRAMME[:3]) + r"\s+(?:for\s+)?" + words(*FIELDS))
    return (q != "") & ~U.is_identity(q) & starts & (q.rlike(words(*FIELD_CUES)) | has_domain_terms(q))


def is_chitchat(c: Column) -> Column:
    """RNK-13, but a beginner's question is none."""
    return U.is_chitchat(c) & ~is_onboarding(c)


def is_domain_query(c: Column) -> Column:
    """RNK-17."""
    return ~is_chitchat(c) & ~is_offtopic(c) & has_domain_terms(c)


def is_technical(c: Column) -> Column:
    return _low(c).rlike(words(*TECHNICAL))


def expand(c: Column) -> Column:
    """RNK-2: a question with words that help a vector search; a blank one as it is."""
    q = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(q)
    rules = {
        "domain": has_domain_terms(low) | (~is_chitchat(low) & holds_any(low, U.LEARNING)), "agents": low.rlike(words("agents?")), "retrieval": F.contains(low, F.lit("rag")) | F.contains(low, F.lit("retrieval")),
        "vision": low.rlike(r"\bcomp(?:uter)?\s*vision\b") | low.rlike(words("cv")), "language": low.rlike(words("nlp")) | F.contains(low, F.lit("natural language")),
    }
    extra = F.concat_ws(" ", *[F.when(rule, F.lit(EXPANSIONS[k])) for k, rule in rules.items()])
    return F.when((q == "") | (extra == ""), q).otherwise(F.concat(q, F.lit(" | "), extra))


def without_small_talk(c: Column) -> Column:
    """RTE-7: a question without greetings and lead-ins before it."""
    q = F.trim(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(q, r"(?i)^(?:\s*" + words(*LEADS) + r"[\s,?!]*)+", ""))


def is_small_talk(c: Column) -> Column:
    """RTE-7: nothing technical is left when greetings and lead-ins are gone."""
    return ~is_technical(without_small_talk(c))


def without_style(c: Column) -> Column:
    """RTE-7: a question without wishes for tone and style; the question itself if nothing else is in it."""
    q = F.trim(F.coalesce(c, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, "(?i)" + words(*STYLE), " "), r"\s+", " "), r"^[ ,.?!]+|[ ,.?!]+$", "")
    return F.when(~F.lower(q).rlike(words(*STYLE)), q).otherwise(F.coalesce(F.nullif(rest, F.lit("")), q))


def is_theory(c: Column) -> Column:
    return _low(c).rlike(words(*THEORY_WORDS))


def is_order(c: Column) -> Column:
    """An order to write, run or install something; but not a creative piece on a theoretical subject."""
    q = _low(c)
    order = (
        q.rlike(words(*ORDER_VERBS) + ".{0,50}" + words(*ORDER_THINGS)) | q.rlike(words(*SHELLS) + r"\s+" + words("script", "code", "commands?")) | q.rlike(words(*OTHER_ORDERS))
        | q.rlike(words("how do i", "how can i", "how to", "help me") + r"\s+" + words(*SET_UP))
    )
    return order & ~(q.rlike(words(*CREATIVE)) & q.rlike(words(*THEORY_NOUNS)))


def structural_intent(q: Column, scored: Column) -> Column:
    """INT-5: the scored intent, but words of theory rescue from a block, an order is an implementation request, and without an order
    there is no implementation request; a question on matrices is no film."""
    theory, order = is_theory(without_style(q)), is_order(q)
    blocked = scored.isin("implementation", "entity_trivia", "out_of_domain")
    math = _low(q).rlike(words("matrix")) & _low(q).rlike(words("linear algebra", "covariance", r"eigen\w*", "determinant", "rank", "decomposition", "definition", "formula", "tensor", "what is a matrix")) & ~_low(q).rlike(words("movie", "film", "plot", "cinema"))
    return (
        F.when(theory & ~order & blocked, "theory").when(order & ~theory, "implementation").when((scored == "implementation") & ~order, "theory")
        .when((scored == "out_of_domain") & math, "theory").otherwise(scored)
    )


def block_reason(intent: Column, score: Column, least: float = 0.22) -> Column:
    """INT-6: the reason for which an intent blocks, or null. The blocking intents block at any score."""
    reasons = {"implementation": "implementation_request", "entity_trivia": "not_in_corpus", "out_of_domain": "out_of_scope", "meta": "meta_refused"}
    m = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    return F.when((score >= least) | intent.isin(*BLOCKING), F.try_element_at(m, intent))


def routes(q: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """RTE-1 and RTE-2: (key, route, block_reason) of each question; the first rule that fits. `named`: keys of questions that name a concept.

    Own data, chit-chat, orders, identity, beginners, the library's routes, small talk, other topics, a named concept, a domain question, a wish to
    learn, the rest. Afterwards a refusal of a domain question becomes a miss.
    """
    c = F.col(text)
    low = _low(c)
    j = q.select(key, text).join(named.select(key).distinct().withColumn("__m", F.lit(True)), key, "left").withColumn("__m", F.coalesce("__m", F.lit(False)))
    library = U.library_intent(c)
    r = (
        F.when(holds_any(low, ("my dataset", "my data")), "out_of_scope").when(is_chitchat(c) & ~is_technical(c), "general_chat")
        .when(library.isNull() & is_order(c) & ~is_theory(c), "out_of_scope").when(U.is_identity(c), "identity").when(is_onboarding(c), "onboarding").when(library.isNotNull(), library)
        .when(is_small_talk(c) & ~F.col("__m") & ~has_domain_terms(c) & ~holds_any(c, U.LEARNING), "small_talk").when(is_offtopic(c) & ~F.col("__m"), "out_of_scope")
        .when(F.col("__m"), "graph_strong").when(has_domain_terms(c), "graph_soft").when(holds_any(c, U.LEARNING), "low_similarity_reject").otherwise("general_chat")
    )
    reason = F.when(library.isNull() & is_order(c) & ~is_theory(c), "implementation_request").otherwise("out_of_scope")
    j = j.select(key, r.alias("route"), reason.alias("why"), is_domain_query(c).alias("domain"))
    soft = (F.col("route") == "out_of_scope") & (F.col("why") == "out_of_scope") & F.col("domain")
    route = F.when(soft, "low_similarity_reject").otherwise(F.col("route"))
    return j.select(key, route.alias("route"), F.when(route == "out_of_scope", F.col("why")).alias("block_reason"))


def surface_hits(ranked: DataFrame) -> DataFrame:
    """RNK-9 and RNK-10: (query_id, surface, strong) over the best five concepts of each question: whether one is hit by its surface, and whether the
    graph holds strong evidence (thresholds of alias, core bonus and lexical fit)."""
    hit = (F.col("alias_boost") >= 0.12) | (F.col("core_bonus") >= 0.30) | (F.col("lexical") >= 0.45)
    strong = (F.col("alias_boost") >= 0.26) | (F.col("core_bonus") >= 0.35) | (F.col("lexical") >= 0.60)
    return ranked.groupBy("query_id").agg(F.bool_or(hit).alias("surface"), F.bool_or(strong).alias("strong"))


def soft_anchors(ranked: DataFrame) -> DataFrame:
    """RNK-8: (query_id, id, score): of the ranked concepts of each question (query_id, q, id, name, lexical, alias_boost, core_bonus, blended) the one that
    fits best as a soft anchor; names with the question's words count, and short names if the question is one short word."""
    low = F.lower("q")
    ws = U.query_words(low)
    label = F.replace(F.lower("name"), F.lit("-"), F.lit(" "))
    hit = F.when(F.exists(ws, lambda w: (F.length(w) >= 3) & F.contains(label, w)), 0.22).otherwise(0.0)
    core = F.regexp_replace(F.regexp_replace(low, r"^(what is|what's|whats|explain|tell me about)\s+", ""), r"^[ ?!.]+|[ ?!.]+$", "")
    n = F.size(tokens(F.col("name")))
    short = F.when((F.length(core) <= 6) & core.rlike("^[a-z]+$"), F.when(n <= 3, 0.15).when(n >= 6, -0.20).otherwise(0.0)).otherwise(0.0)
    score = 0.68 * F.col("lexical") + hit + 0.55 * (F.col("core_bonus") + F.col("alias_boost")) + short + 0.05 * F.col("blended")
    s = ranked.withColumn("score", F.round(score, 6))
    return s.groupBy("query_id").agg(F.max_by(F.struct("id", "score"), F.struct(F.col("score"), F.col("blended"), F.col("id"))).alias("b")).select("query_id", "b.id", "b.score")
