"""Values that have to be exactly these for results to agree. Fixed values."""

from __future__ import annotations

LETTERS = ("A", "B", "C", "D", "E")

# Fixed value: text that stands in for a missing field.
NO_ANSWER = "There is no correct answer"

# Fixed value: instruction in front of every retrieval query.
SEARCH_INSTRUCTION = "Represent this sentence for searching relevant passages: "

# Question openings that select the lexical query rule.
OPENING_WHAT = "What is"
OPENING_STATEMENTS = "Which of the following statements"
OPENING_FOLLOWING = "Which of the following is"

# Stop words of the lexical stage, before apostrophes and hyphens go.
STOP_WORDS_RAW = """
each you the use used where themselves nor it's how don't just your
about himself with weren't hers wouldn't more its were his their then
been myself re not ours will needn which here hadn it our there
than most couldn't both some for up couldn that'll she's over this
now until these few haven of wouldn into too to very shan before
the they between doesn't are was out we me after has isn't have
such should yourselves or during herself doing in shouldn't won't when
do through she having him haven't against itself that did theirs can
those own so and who you've yourself her he only what ourselves
again had you'd is other why while from them if above does whom
yours but being wasn't be
"""
STOP_WORDS = tuple(
    sorted({w.lower().replace("'", "").replace("-", "") for w in STOP_WORDS_RAW.split()})
)

# Fixed value: a run of word characters that may hold "/", "." and "-" inside, or one of
# five single signs. Written without look-around so that Java and RE2 read it alike. Word
# characters are letters, numbers and "_"; combining marks are not among them.
TOKEN_PATTERN = (
    r"[\p{L}\p{N}_](?:[\p{L}\p{N}_/.-]*[\p{L}\p{N}_])?|!|/|\?|\"|'"
)

# Sizes of the two retrieval stages.
DENSE_K = 15
DENSE_KEEP = 14
NPROBE = 30
LEXICAL_K = 10
ENCODE_BATCH = 620_000

# Token budgets of the pair builder, and rows per training batch.
TRAIN_TOKENS = 1280
EVAL_TOKENS = 384
BATCH_ROWS = 2

# Category tree roots per label with label weights, and what to leave out.
LABEL_WEIGHTS = {"S": 1.0, "T": 1.25, "E": 1.0, "M": 1.0}
LABEL_ROOTS = {
    "S": (
        "Category:Applied_sciences", "Category:Biotechnology", "Category:Biology",
        "Category:Natural_history",
    ),
    "T": (
        "Category:Technology_strategy", "Category:Technical_specifications",
        "Category:Technology_assessment", "Category:Technology_hazards",
        "Category:Technology_systems", "Category:Hypothetical_technology",
        "Category:Mobile_technology", "Category:Obsolete_technologies",
        "Category:Philosophy_of_technology", "Category:Real-time_technology",
        "Category:Software", "Category:Technology_development", "Category:Computing",
        "Category:Artificial_objects", "Category:Technological_change",
        "Category:Technical_communication", "Category:Technological_comparisons",
    ),
    "E": (
        "Category:Engineering_disciplines", "Category:Engineering_concepts",
        "Category:Industrial_equipment", "Category:Manufacturing",
    ),
    "M": ("Category:Fields_of_mathematics", "Category:Physical_sciences"),
}
EXCLUDED_CATEGORIES = (
    "Category:Technology", "Category:Mathematics", "Category:Works about technology",
    "Category:Technology evangelism", "Category:Artificial objects",
    "Category:Fictional physical scientists",
)

# Keys of a generated question record.
OPTION_KEYS = ("option_1", "option_2", "option_3", "option_4", "option_5")
RECORD_KEYS = ("question", *OPTION_KEYS, "answer")
RECORDS_PER_REPLY = 5
MAX_ATTEMPTS = 3
LEAD_SENTENCES = 7

# Messages that ask for questions about one text.
TEXT_DELIMITER = "####"
GENERATION_REQUEST = f"""
You will be provided with TEXT from wikipedia. \
The TEXT will be delimited with {TEXT_DELIMITER} characters.
Output a python list of 5 dict objects, where each object is \
a multiple choice question whom answers should be in \
the given TEXT and that has 5 choices each and has the following format:
    'question': <question on the TEXT>
    'option_1': <question answer option>
    'option_2': <question answer option>
    'option_3': <question answer option>
    'option_4': <question answer option>
    'option_5': <question answer option>
    'answer': <answer option key label>

You should tell me which one of your proposed options is right \
by assigning the corresponding option's key label in the 'answer' field.

The question, the answer and question answer options should be broad, \
challenging, long, detailed and based on the TEXT provided.

Only output the list of objects, with nothing else.
"""

# Fixed value: prompt that asks for one of the five letters.
SCORING_PROMPT = """Answer the following multiple choice question by giving the most \
appropriate response. Answer should be one among [A, B, C, D, E]
Question: {prompt}\n
A) {a}\n
B) {b}\n
C) {c}\n
D) {d}\n
E) {e}\n

Answer:"""

# Question difficulty limit and sizes of the split.
HARD_LIMIT = 0.6
VALIDATION_ROWS = 200
LEVERAGE_TRAIN = 74.0
LEVERAGE_VALIDATION = 11.25
FOLD_SEED = 42
