"""Fixed values that must equal the reference's for identical results.

Kept together, as plain text, in the reference's order.
"""

# --- fixed values: question cleaning -------------------------------------------------------
# Phrases after which a generated question is cut, applied in this order.
QUESTION_STOP_PHRASES = [
    "In each of these examples", "In each example,", "Explanation:", "Example 1:", "Example 2:",
    "In this example", "Note:", "In the above examples", "Note that in each example",
    "In the first three examples", "In the first example", "Answer:",
    "By analyzing the provided documents", "Note that the examples", "In both examples",
    "In each case", "Note that the relevant queries", "In each of the examples",
]

# Successive cut points for raw generator output (after removing the prompt), in this order.
LLM_OUTPUT_CUTS = [
    "Example 5:",
    "In each of these examples, the AI model is trained on a large corpus of text data,",
    "Answer:",
    "\n",
    "?",
]

# --- fixed values: prompts -----------------------------------------------------------------
FEWSHOT_INSTRUCTION = (
    "You are a search query generator for document retrieval. Given a passage P and three human-written examples <P,Q>, "
    "write ONE specific, answerable, entity-rich query Q for the new passage. "
    "Do not copy phrases. Prefer 'how/why/under what conditions/compare'. 10–20 words. Single sentence.\n\n"
)
FEWSHOT_EXAMPLE_FORMAT = "Example {i}:\nPassage: {passage}\nQuery: {query}"
FEWSHOT_TAIL = "\n\nNow generate a query for the following passage:\nPassage: {passage}\nQuery:"
# Padding exemplar used when fewer than 3 lexical clusters exist.
PAD_EXEMPLAR = (
    "The study investigates the impact of a treatment on a population using a randomized design.",
    "How does the treatment affect the outcome compared to control?",
)
# Question templates built from a passage's heaviest terms.
QUESTION_TWO_TERMS = "How does {t0} relate to {t1} in this passage?"
QUESTION_ONE_TERM = "What is {t0} in this passage?"
QUESTION_NO_TERM = "How does the described effect occur and under what conditions?"
# Pairwise reranker input.
RERANK_SUFFIX = "Relevant:"
RERANK_TRUE, RERANK_FALSE = "true", "false"

# --- fixed values: length filters ------------------------------------------------------------
# Minimum document length (characters) by dataset for sampling; others use DEFAULT_MIN_CHARS.
SAMPLING_MIN_CHARS = {"signal1m": 3, "hotpotqa": 150, "quora": 15, "climate-fever": 3}
DEFAULT_MIN_CHARS = 300
# K selection applies these first and then the default minimum to every dataset.
KSELECT_MIN_CHARS = {"signal1m": 3, "hotpotqa": 150}

# --- fixed values: sampling and clustering ---------------------------------------------------
SAMPLING_SEEDS = [35, 745, 10, 6534, 2]
SSE_K_LIST = [5, 10, 50, 100, 500, 1000, 5000, 10000]
KMEANS_ITERATIONS = 100
SOFTMAX_TEMPERATURE = 1.0
KNEE_SENSITIVITY = 0.01

# --- fixed values: policy defaults -----------------------------------------------------------
INIT_WEIGHTS = [0.25, 0.25, 0.25, 0.25]
ETA = 0.30
Z_TEMP = 1.3
W_FLOOR = 0.05
ENTROPY = 0.10
LAMBDA_HARD = 0.80
HARD_WARMUP_RATIO = 0.30
BASELINE_BETA = 0.05
CRITIC_LR = 0.02
N_CANDS = 5
DEDUP_THRESHOLD = 0.90
DEDUP_CLIP = (0.88, 0.95)
DEDUP_QUANTILE = 0.75
R1_TAU = 18.0
K_TARGET = 0.7
SIM_THRESHOLD = 0.58
SNIPPET_WINDOW = 70
SNIPPET_TERMS = 10
SINGLETON_CENTRALITY = 0.85
NUM_POS_TO_NEG = 4
TRUNCATE_TOKENS = 512
EXEMPLAR_CHARS = 600
ANSWER_FALLBACK_CHARS = 200
