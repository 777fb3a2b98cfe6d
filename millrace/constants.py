"""Results depend on every one of them, so they are kept together and plain."""

# --- fixed values: file suffix -> language -------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript",
    ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".r": "r", ".lua": "lua",
    ".cs": "csharp", ".fs": "fsharp", ".hs": "haskell", ".ex": "elixir", ".exs": "elixir",
    ".clj": "clojure", ".tf": "terraform", ".yaml": "yaml", ".yml": "yaml",
}

# --- fixed values: default path exclusions (plain substrings, not globs) --------------------
EXCLUDED_SUBSTRINGS = (
    "node_modules", ".git", "__pycache__", "*.min.js", "dist", "build", "vendor", ".venv", "venv",
)

# --- fixed values: comment syntax per language ----------------------------------------------
HASH_LINE = r"#.*$"
SLASH_LINE = r"//.*$"
DASH_LINE = r"--.*$"
SLASH_BLOCK = ("/*", "*/")
DOUBLE_DOCSTRING = ('"""', '"""')
SINGLE_DOCSTRING = ("'''", "'''")
COMMENT_SYNTAX = {
    "python": (HASH_LINE, DOUBLE_DOCSTRING, SINGLE_DOCSTRING),
    "javascript": (SLASH_LINE, SLASH_BLOCK),
    "typescript": (SLASH_LINE, SLASH_BLOCK),
    "java": (SLASH_LINE, SLASH_BLOCK),
    "cpp": (SLASH_LINE, SLASH_BLOCK),
    "c": (SLASH_LINE, SLASH_BLOCK),
    "go": (SLASH_LINE, SLASH_BLOCK),
    "rust": (SLASH_LINE, SLASH_BLOCK),
    "ruby": (HASH_LINE,),
    "shell": (HASH_LINE,),
    "sql": (DASH_LINE, SLASH_BLOCK),
}

# --- fixed values: sample and prompt texts ---------------------------------------------------
INSTRUCTION_HEADER = "### Language: {language}\n### Task: Complete the following code\n### Code:\n"
INSTRUCTION_FOOTER = "\n### End"
EXPLAIN_LEAD = "This code"
EXPLAIN_TEMPLATE = "### Code:\n{code}\n### Explanation:\nThis code"
SAMPLE_TEMPLATES = {
    "completion": "{code}",
    "instruction": INSTRUCTION_HEADER + "{code}" + INSTRUCTION_FOOTER,
    "fim": "<fim_prefix>{prefix}<fim_suffix>{suffix}<fim_middle>",
    "docstring": "### Code:\n{code}\n### Docstring:\n{docstring}",
    "explain": EXPLAIN_TEMPLATE,
}
COMPLETION_STOPS = ("### End",)

# --- fixed values: request limits, (column, lowest, highest) ---------------------------------
GENERATE_LIMITS = (
    ("max_new_tokens", 1, 4096),
    ("temperature", 0.0, 2.0),
    ("top_p", 0.0, 1.0),
    ("top_k", 1, 200),
    ("repetition_penalty", 1.0, 2.0),
)
COMPLETE_LIMITS = (("max_new_tokens", 1, 2048), ("temperature", 0.0, 2.0))

# --- fixed values: numbers -------------------------------------------------------------------
TOKENS_PER_WORD = 1.3
FILE_MIN_WORDS = 20
CHUNK_MIN_WORDS = 10
MERGE_KEY_CHARS = 100
PROMPT_MAX_TOKENS = 1800
IGNORED_LABEL = -100

# --- fixed values: patterns -------------------------------------------------------------------
# Java spells classes differently: WS is Python's white space, WORD its word characters; (?d) lets only \n end a line.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
USE_STRICT = ('"use strict";?\\n?', "'use strict';?\\n?")
MAIN_BLOCK = rf"(?d)if __name__ == ['\"]__main__['\"]:?\n(?:[{WS}]++.*+\n?+)*+"
# What follows a | takes in text that can hold no further match, so that it is not searched again:
# after a header without its colon or brace, or an arrow without a semicolon, nothing is closed.
PYTHON_DEF = rf"(?dm)(def[{WS}]+[{WORD}]+[^:]*+:(?:\n(?>[ \t]+.+|[{WS}]*$))*+)|def[{WS}]+[{WORD}]+[^:]*+\z"
JS_FUNCTION = (
    rf"((?:async[{WS}]+)?function[{WS}]+[{WORD}]+[^{{]*+\{{(?:[^{{}}]++|\{{[^{{}}]*+\}})*+\}})"
    rf"|(?:async[{WS}]+)?function[{WS}]+[{WORD}]+[^{{]*+(?:\{{|\z)"
)
JS_ARROW = (
    rf"(const[{WS}]+[{WORD}]+[{WS}]*=[{WS}]*(?:async[{WS}]+)?"
    rf"(?:\([^)]*\)|[{WORD}]+)[{WS}]*=>[^;]++;)"
    rf"|const[{WS}]+[{WORD}]+[{WS}]*=[{WS}]*(?:async[{WS}]+)?(?:\([^)]*\)|[{WORD}]+)[{WS}]*=>[^;]*+\z"
)
