"""Texts, word lists and labels that results depend on."""

# File name endings that are read.
EXTENSIONS = [".txt", ".pdf", ".docx", ".json"]

# Words that make a statement more than a read.
FORBIDDEN_WORDS = (
    "alter", "analyze", "attach", "call", "checkpoint", "cluster", "comment", "copy", "create", "deallocate", "delete",
    "detach", "discard", "do", "drop", "execute", "explain", "grant", "insert", "into", "listen", "load", "lock", "merge",
    "notify", "prepare", "reassign", "refresh", "reindex", "release", "reset", "revoke", "savepoint", "security", "set",
    "show", "truncate", "unlisten", "update", "vacuum", "write",
)

# Messages of the upload report.
UPLOADED = "Successfully uploaded and processed %d files"
NOTHING_UPLOADED = "No processable content found in uploaded files"

# Reasons the guard gives.
NOT_ASCII = "SQL must contain only ASCII characters"
TOO_LONG = "SQL is too long (max {} chars)"
EMPTY = "SQL is empty"
MANY_STATEMENTS = "Multiple statements are not allowed (semicolon detected)"
NOT_READ_ONLY = "Only read-only SELECT queries are allowed"
NOT_SELECT = "Only SELECT queries are allowed"

# What a database error class is called towards the caller.
ERROR_LABELS = {
    "OperationalError": "Database connection error",
    "InterfaceError": "Database interface error",
    "ProgrammingError": "Invalid query syntax",
    "DataError": "Invalid data format",
    "IntegrityError": "Data integrity error",
    "QueryCanceled": "Query timed out or was canceled",
    "ConnectionTimeout": "Database connection timed out",
}
DEFAULT_ERROR_LABEL = "Database operation failed"

# The question prompt, around context and question.
PROMPT_HEAD = (
    "以下のコンテキスト情報のみを使って質問に回答してください。コンテキストに答えがない場合は「情報が見つかりませんでした」と回答してください。\n"
    "回答は直接的に、簡潔に記述してください。思考過程や計画は出力しないでください。\n\nコンテキスト:\n"
)
PROMPT_QUESTION = "\n\n質問: "
PROMPT_TAIL = "\n\n回答:"
NO_DOCUMENTS = "No relevant documents found in the knowledge base."

# Answers to questions that are not answered, by status; the last one is for a failed model.
REFUSALS = {
    "rate_limited": "Rate limit exceeded. Please try again in %s seconds.",
    "validation_failed": "Invalid question format. Please provide a text question.",
    "question_too_long": "Question too long. Maximum 2000 characters allowed.",
    "question_too_short": "Question too short. Please provide more details (minimum 3 characters).",
    "internal_error": "Error processing query. Please try again later.",
}

# The translation prompts, before and after the input.
TRANSLATE_JA_EN = (
    "# Role\nJapanese to English translator\n\n# Task\nTranslate {Input Text} into English.\n\n# Input Text\n"
)
TRANSLATE_EN_JA = (
    "# Role\nEnglish to Japanese translator\n\n# Task\nTranslate {Input Text} into Japanese.\n\n# Input Text\n"
)
TRANSLATE_TAIL = "\n\n# Output Format\n<translated sentences>\n"

# Our own wording for the two mail tasks; a job passes its own table of templates to replace it.
PROOFREAD_HEAD = (
    "# Role\nProofreader of English business mail\n\n# Task\nCorrect the draft below: grammar, spelling, natural "
    "wording, polite tone, clarity. Keep its meaning.\n\n# Draft\n```\n"
)
PROOFREAD_TAIL = "\n```\n# Output\nScores from 1 to 10 for each point, the corrected mail, the list of changes.\n"
REPLY_HEAD = "# Role\nWriter of polite English business replies\n\n# Received mail\n```\n"
REPLY_MIDDLE = "\n```\n# Points to answer\n```\n"
REPLY_TAIL = "\n```\n# Output\nThe body of the reply, without a signature.\n"

TASK_TEMPLATES = [
    ("translate_ja_en", TRANSLATE_JA_EN, None, TRANSLATE_TAIL),
    ("translate_en_ja", TRANSLATE_EN_JA, None, TRANSLATE_TAIL),
    ("proofread", PROOFREAD_HEAD, None, PROOFREAD_TAIL),
    ("reply", REPLY_HEAD, REPLY_MIDDLE, REPLY_TAIL),
]

# Our own four documents for an empty collection.
SEED_DOCUMENTS = [
    ("A retrieval library lets an application look up passages before it answers.", "retrieval_intro.txt",
     "introduction"),
    ("Answers improve when the passages nearest to a question are put in front of the model.", "grounding.txt",
     "explanation"),
    ("A vector index keeps one list of numbers per passage and returns the nearest ones.", "vector_index.txt",
     "technical"),
    ("A collection keeps passages, their numbers and their metadata in one table.", "collection.txt", "database"),
]
