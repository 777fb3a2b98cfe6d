"""The same results in DuckDB SQL, stated on their own: plain patterns, global row numbers."""

from __future__ import annotations

from checks.adapters import cte

WS = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INLINE = r"\t\x0b-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
BREAKS = r"\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}"

# --- fixed values, stated here once more so that the library's own are checked -----------------
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".r": "r",
    ".lua": "lua", ".cs": "csharp", ".fs": "fsharp", ".hs": "haskell", ".ex": "elixir", ".exs": "elixir", ".clj": "clojure",
    ".tf": "terraform", ".yaml": "yaml", ".yml": "yaml",
}
EXCLUDED_SUBSTRINGS = ("node_modules", ".git", "__pycache__", "*.min.js", "dist", "build", "vendor", ".venv", "venv")
COMMENT_SYNTAX = {
    "python": ("#.*$", ('"""', '"""'), ("'''", "'''")),
    "javascript": ("//.*$", ("/*", "*/")),
    "typescript": ("//.*$", ("/*", "*/")),
    "java": ("//.*$", ("/*", "*/")),
    "cpp": ("//.*$", ("/*", "*/")),
    "c": ("//.*$", ("/*", "*/")),
    "go": ("//.*$", ("/*", "*/")),
    "rust": ("//.*$", ("/*", "*/")),
    "ruby": ("#.*$",),
    "shell": ("#.*$",),
    "sql": ("--.*$", ("/*", "*/")),
}

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nl(text: str) -> str:
    """A SQL string with line feeds."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# ---- shared steps ----------------------------------------------------------------------------

LANGS = ", ".join(f"({quoted(e)}, {quoted(v)})" for e, v in LANGUAGE_BY_EXTENSION.items())
DOCS = cte("code_docs")
EXTENSION = r"lower(regexp_extract(split_part(rel_path, '/', -1), '^.+(\.[^.]+)$', 1))"
DECODED = r"regexp_replace(content, '\r\n?', chr(10), 'g')"
EXCLUDED = " OR ".join(f"contains(rel_path, {quoted(p)})" for p in EXCLUDED_SUBSTRINGS)


def lines(text: str) -> str:
    return (f"length(regexp_replace({text}, '[^{BREAKS}]', '', 'g')) + "
            f"CASE WHEN {text} = '' OR regexp_matches({text}, '[{BREAKS}]\\z') THEN 0 ELSE 1 END")


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[{WORD}]+'))"


def normalized(text: str) -> str:
    step = rf"regexp_replace({text}, '[{INLINE}]+(\n|\z)', '\1', 'g')"
    step = rf"regexp_replace({step}, '\n{{4,}}', repeat(chr(10), 3), 'g')"
    return rf"regexp_replace({step}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def unboiled(text: str) -> str:
    strict = rf"""regexp_replace(regexp_replace({text}, '"use strict";?\n?', '', 'g'), '''use strict'';?\n?', '', 'g')"""
    main = rf"""regexp_replace({text}, 'if __name__ == [''"]__main__[''"]:?\n([{WS}]+.*\n?)*', '', 'g')"""
    return (f"CASE WHEN language IN ('javascript', 'typescript') THEN {strict} "
            f"WHEN language = 'python' THEN {main} ELSE {text} END")


FILES = f"""{DOCS},
langs(extension, language) AS (VALUES {LANGS}),
known AS (SELECT d.doc_id, d.repo, d.rel_path, d.content AS raw, {DECODED} AS content, language
          FROM code_docs d JOIN langs ON langs.extension = {EXTENSION})"""

SCANNED = f"""{FILES},
scanned AS (SELECT doc_id, repo, rel_path, {EXTENSION} AS extension, language, content,
              round_even(octet_length(encode(raw)) / 1024.0::DOUBLE, 3) AS size_kb, {lines('content')} AS line_count,
              sha256(content) AS content_hash
            FROM known
            WHERE NOT ({EXCLUDED}) AND octet_length(encode(raw)) / 1024.0::DOUBLE <= 500 AND {lines('content')} >= 5),
kept AS (SELECT * FROM scanned QUALIFY row_number() OVER (PARTITION BY repo, content_hash ORDER BY rel_path) = 1)"""

HEADER = "'### Language: ' || language || chr(10) || '### Task: Complete the following code' || chr(10) || '### Code:' || chr(10)"
FOOTER = "chr(10) || '### End'"

CHUNKS = f"""{FILES},
norm AS (SELECT doc_id, repo, rel_path, language, {normalized('content')} AS content FROM known),
clean AS (SELECT doc_id, repo, rel_path, language, {unboiled('content')} AS content FROM norm),
good AS (SELECT * FROM clean WHERE {words('content')} >= 20),
cut AS (SELECT doc_id, repo, rel_path, language, i AS chunk_idx, substring(content, i * 896 + 1, 1024) AS chunk
        FROM good, LATERAL (SELECT unnest(range(0, (length(content) + 895) // 896)) AS i)),
samples AS (SELECT doc_id, repo, rel_path, language, chunk_idx, length(chunk) AS chunk_size,
              round(len(regexp_extract_all(chunk, '[^{WS}]+')) * 1.3::DOUBLE, 6) AS token_estimate,
              {HEADER} || chunk || {FOOTER} AS text,
              sha256(concat_ws(':', repo, rel_path, chunk_idx)) AS id,
              concat_ws('/', repo, language, replace(replace(rel_path, '/', '_'), chr(92), '_')) AS source_file
            FROM cut WHERE {words('chunk')} >= 10)"""


def split_of(source: str, key: str) -> str:
    """CTEs placed, split over ``source``."""
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS place, count(*) OVER () AS n FROM {source}),
split AS (SELECT *, CASE WHEN place < floor(n * 0.9::DOUBLE) THEN 'train'
                         WHEN place < floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'validation' ELSE 'test' END AS split
          FROM placed)"""


DOC_KEY = "sha256(concat_ws(':', '42', doc_id, rel_path))"
SAMPLE_KEY = "sha256(concat_ws(':', '42', id, text))"
ID_SPLIT = f"{CHUNKS}, {split_of('samples', chr(39).join(['sha256(concat_ws(', ':', ', ', '42', ', id))']))}"
TEXT_SPLIT = f"{CHUNKS}, {split_of('samples', SAMPLE_KEY)}"
OLD = "doc_id IN (SELECT doc_id FROM labels)"

PIECES = f"regexp_extract_all(text, '[{WORD}]+|[^{WORD}{WS}]')"
VOCAB = f"""tokens AS (SELECT doc_id, unnest({PIECES}) AS token, unnest(range(1, len({PIECES}) + 1)) AS pos FROM documents),
vocab AS (SELECT token, count(*) AS n, 3 * (row_number() OVER (ORDER BY count(*) DESC, token) + 1) AS token_id FROM tokens
          GROUP BY token ORDER BY n DESC, token LIMIT 32768)"""


def ids_of(source: str, keys: str, column: str, limit: int) -> str:
    """CTE encoded: keys, ids (text joined by commas), tokens; rows without a token included."""
    pieces = PIECES.replace("text", column, 1)
    return f"""piece AS (SELECT {keys}, unnest({pieces}) AS token, unnest(range(1, len({pieces}) + 1)) AS pos FROM {source}),
encoded AS (SELECT {keys}, coalesce(string_agg(coalesce(token_id, 0)::VARCHAR, ',' ORDER BY pos), '') AS ids, count(pos) AS tokens
            FROM (SELECT {keys} FROM {source}) LEFT JOIN (SELECT * FROM piece WHERE pos <= {limit}) USING ({keys})
            LEFT JOIN vocab USING (token) GROUP BY {keys})"""


def sql(name: str, text: str) -> None:
    SQL[name] = text


# ---- scans, sources, sinks -------------------------------------------------------------------

sql("scan_code_tree", f"""WITH {SCANNED}
SELECT repo, rel_path, extension, language, size_kb, line_count::INTEGER AS line_count, content_hash FROM scanned""")

sql("read_code_tree", SQL["scan_code_tree"])
sql("decode_text", r"""SELECT doc_id, 'a' || chr(65533) || 'b' || chr(65533) || 'c'
  || regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10) || chr(10) || 'z' AS text FROM documents""")

SAFE = "replace(replace(rel_path, '/', '_'), chr(92), '_')"
sql("write_raw_store", f"""WITH {SCANNED}
SELECT repo, language, {SAFE} AS safe_name, rel_path, content_hash AS digest FROM kept""")
sql("scan_raw_store", f"""WITH {SCANNED}
SELECT repo, rel_path, line_count::INTEGER AS line_count, content_hash AS digest FROM kept""")
sql("write_split_jsonl", f"""WITH {ID_SPLIT}
SELECT split, count(*) AS samples, sum(length(text))::BIGINT AS chars FROM split GROUP BY split""")
sql("read_samples_jsonl", f"""WITH {CHUNKS}
SELECT id, language, chunk_idx::INTEGER AS chunk_idx, sha256(text) AS digest FROM samples""")
sql("load_split_dataset", f"""WITH {ID_SPLIT}
SELECT split, count(*) AS samples FROM split GROUP BY split""")
COUNTS = """SELECT language, (SELECT count(*) FROM samples s WHERE s.language = k.language) AS samples
            FROM (SELECT DISTINCT language FROM known) k"""
JSON = "'{' || string_agg('\"' || language || '\":' || samples, ',' ORDER BY language) || '}'"
sql("write_metadata", f"""WITH {TEXT_SPLIT}
SELECT 'v1' AS version, count(*) AS total_samples, count(*) FILTER (split = 'train') AS train_samples,
  count(*) FILTER (split = 'validation') AS val_samples, count(*) FILTER (split = 'test') AS test_samples,
  (SELECT {JSON} FROM ({COUNTS})) AS languages FROM split""")
REPO_NAME = rf"regexp_replace(split_part(rtrim(url, '/'), '/', -1), '[^{WORD}\-]', '_', 'g')"
sql("catalog_tables", f"""WITH {cte('repos_in', 'runs_in', 'versions_in')}, {FILES}
SELECT 'repositories' AS table_name, id::VARCHAR AS key, concat_ws('|', id, {REPO_NAME}, 'main', 'pending', 0, 0) AS defaults FROM repos_in
UNION ALL SELECT 'code_file_catalog', rel_path, concat_ws('|', rel_path, 0, 'false') FROM known
UNION ALL SELECT 'training_runs', id::VARCHAR, concat_ws('|', id, 'pending', 0, 0) FROM runs_in
UNION ALL SELECT 'dataset_versions', id::VARCHAR, concat_ws('|', id, 0, 0, 0, 0) FROM versions_in""")
sql("read_trainer_state", f"""WITH {cte('checkpoints_in')},
best AS (SELECT run_id, step FROM checkpoints_in WHERE loss IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loss, step) = 1)
SELECT c.run_id::VARCHAR AS run_id, c.step, coalesce(c.loss, 9.5) AS loss, b.step IS NOT NULL AS is_best
FROM checkpoints_in c LEFT JOIN best b ON b.run_id = c.run_id AND b.step = c.step""")

# ---- projections, filters --------------------------------------------------------------------

sql("file_extension", f"WITH {DOCS} SELECT doc_id, rel_path, {EXTENSION} AS extension FROM code_docs")
sql("detect_language", f"""WITH {DOCS}, langs(extension, language) AS (VALUES {LANGS})
SELECT doc_id, rel_path, language FROM code_docs LEFT JOIN langs ON langs.extension = {EXTENSION}""")
sql("exclude_paths", f"WITH {DOCS} SELECT doc_id, rel_path FROM code_docs WHERE NOT ({EXCLUDED})")
sql("filter_extension", f"""WITH {DOCS}, langs(extension, language) AS (VALUES {LANGS})
SELECT doc_id, rel_path FROM code_docs WHERE {EXTENSION} IN (SELECT extension FROM langs)""")
sql("filter_size", f"""WITH {DOCS}, sized AS (SELECT doc_id, rel_path, octet_length(encode(content))::BIGINT AS bytes FROM code_docs)
SELECT * FROM sized WHERE bytes <= 8192""")
sql("filter_min_lines", f"""WITH {DOCS}, counted AS (SELECT doc_id, rel_path, {lines(DECODED)} AS line_count FROM code_docs)
SELECT doc_id, rel_path, line_count::BIGINT AS line_count FROM counted WHERE line_count >= 5""")
sql("content_hash", f"WITH {DOCS} SELECT doc_id, rel_path, sha256({DECODED}) AS content_hash FROM code_docs")
sql("file_metrics", f"""WITH {FILES}
SELECT repo, rel_path, {EXTENSION} AS extension, round_even(octet_length(encode(raw)) / 1024.0::DOUBLE, 3) AS size_kb,
  ({lines('content')})::BIGINT AS line_count FROM known""")
sql("repo_name", f"WITH {cte('repos_in')} SELECT id, {REPO_NAME} AS name FROM repos_in")
sql("safe_name", f"WITH {DOCS} SELECT doc_id, {SAFE} AS safe_name FROM code_docs")
sql("is_meaningful", f"""WITH {DOCS}
SELECT doc_id, rel_path, {words('content')} >= 20 AS file_ok, {words('content')} >= 10 AS chunk_ok FROM code_docs""")


def broken(limits) -> str:
    cases = ", ".join(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}' END" for c, lo, hi in limits)
    return f"concat_ws(',', {cases})"


FULL = broken([("max_new_tokens", 1, 4096), ("temperature", 0, 2), ("top_p", 0, 1), ("top_k", 1, 200), ("repetition_penalty", 1, 2)])
SHORT = broken([("max_new_tokens", 1, 2048), ("temperature", 0, 2)])
sql("validate_requests", f"""WITH {cte('requests_in')}
SELECT conv_id, turn, {FULL} = '' AS valid, {FULL} AS violations, {SHORT} AS complete_violations FROM requests_in""")
ODDS = {"max_new_tokens": 5, "temperature": 7, "top_p": 4, "top_k": 3, "repetition_penalty": 6, "do_sample": 8}
SPARSE = f"""{cte('requests_in')},
sparse AS (SELECT conv_id, turn, prompt, {', '.join(f'CASE WHEN (conv_id + turn) % {n} <> 0 THEN {c} END AS {c}' for c, n in ODDS.items())} FROM requests_in),
filled AS (SELECT conv_id, turn, coalesce(nullif(max_new_tokens, 0), 512) AS max_new_tokens, coalesce(nullif(temperature, 0), 0.7::DOUBLE) AS temperature,
  coalesce(top_p, 0.95::DOUBLE) AS top_p, coalesce(top_k, 50) AS top_k, coalesce(repetition_penalty, 1.1::DOUBLE) AS repetition_penalty,
  coalesce(do_sample, true) AS do_sample FROM sparse)"""
sql("request_defaults", f"WITH {SPARSE} SELECT * FROM filled")
sql("sampling_params", f"""WITH {SPARSE}
SELECT conv_id, turn, CASE WHEN do_sample THEN temperature ELSE 1 END AS temperature, CASE WHEN do_sample THEN top_p ELSE 1 END AS top_p,
  CASE WHEN do_sample THEN top_k ELSE 50 END AS top_k, do_sample FROM filled""")

# ---- joins -----------------------------------------------------------------------------------

sql("new_catalog_rows", f"""WITH {FILES}
SELECT repo AS repository_id, rel_path AS file_path, language, sha256(content) AS content_hash, false AS is_processed
FROM known""")
FRESH = f"""SELECT doc_id, rel_path, chunk_idx::INTEGER AS chunk_idx, sha256(text) AS digest FROM samples
WHERE text NOT IN (SELECT text FROM samples WHERE {OLD})"""
sql("incremental_anti_join", f"WITH {CHUNKS} {FRESH}")
sql("upsert_repositories", f"""WITH {cte('repos_in')}, {SCANNED},
counts AS (SELECT repo, count(*) AS files, sum(line_count) AS lines, round(sum(size_kb::DECIMAL(18,3))::DOUBLE, 3) AS size_kb FROM scanned GROUP BY repo),
results AS (SELECT coalesce(r.url, 'https://example.com/new/' || repo) AS url, repo, files, lines, size_kb,
              CASE WHEN regexp_extract(repo, '([0-9]+)', 1)::BIGINT % 5 = 3 THEN 'not reachable' END AS error
            FROM counts LEFT JOIN repos_in r ON r.id = regexp_extract(repo, '([0-9]+)', 1)::BIGINT)
SELECT url, coalesce({REPO_NAME.replace('url', 'e.url')}, n.repo) AS name, 'main' AS branch,
  CASE WHEN n.repo IS NULL THEN e.status WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN n.repo IS NOT NULL AND error IS NULL THEN files ELSE 0 END::BIGINT AS files_count,
  CASE WHEN n.repo IS NOT NULL AND error IS NULL THEN lines ELSE 0 END::BIGINT AS total_lines,
  CASE WHEN n.repo IS NOT NULL AND error IS NULL THEN n.size_kb ELSE 0 END AS size_kb,
  CASE WHEN n.repo IS NOT NULL AND error IS NULL THEN n.repo END AS local_path, error AS error_message
FROM repos_in e FULL JOIN results n USING (url)""")
sql("bucketed_repositories", SQL["upsert_repositories"])
sql("language_lookup_join", f"""WITH {FILES} SELECT doc_id, rel_path, language FROM known""")

# ---- aggregations ----------------------------------------------------------------------------

sql("dedupe_content", f"WITH {SCANNED} SELECT repo, rel_path, content_hash FROM kept")
SUMMARY = "count(*) AS files, sum(line_count)::BIGINT AS lines, round(sum(size_kb::DECIMAL(18,3))::DOUBLE, 3) AS size_kb"
sql("repo_summary", f"WITH {SCANNED} SELECT repo, {SUMMARY} FROM kept GROUP BY repo")
sql("language_counts", f"WITH {CHUNKS} {COUNTS}")
sql("split_counts", f"""WITH {DOCS}, {split_of('code_docs', DOC_KEY)}
SELECT count(*) AS total_samples, count(*) FILTER (split = 'train') AS train_samples,
  count(*) FILTER (split = 'validation') AS validation_samples, count(*) FILTER (split = 'test') AS test_samples FROM split""")
sql("token_stats", f"""WITH head AS (SELECT len({PIECES}) AS t FROM documents)
SELECT round(avg(t), 6) AS mean, max(t)::BIGINT AS max, min(t)::BIGINT AS min, sum(t)::BIGINT AS total_tokens, count(*) AS samples FROM head""")
sql("generation_throughput", f"""WITH {cte('generations_in')},
t AS (SELECT lang, count(*) AS requests, sum(tokens_generated)::BIGINT AS tokens, sum(elapsed) AS seconds
      FROM generations_in JOIN documents ON doc_id = conv_id GROUP BY lang)
SELECT lang, requests, tokens, round(seconds, 3) AS seconds, round_even(tokens / nullif(seconds, 0), 2) AS tokens_per_second FROM t""")
sql("repo_catalog_summary", f"""WITH {cte('repos_in')}
SELECT status, count(*) AS repositories, 0::BIGINT AS files, 0::BIGINT AS lines, 0::DOUBLE AS size_kb FROM repos_in GROUP BY status""")

# ---- ordered selections ----------------------------------------------------------------------

sql("exact_split", f"WITH {DOCS}, {split_of('code_docs', DOC_KEY)} SELECT doc_id, rel_path, split FROM split")
sql("latest_dataset", f"""WITH {cte('versions_in')},
newest AS (SELECT * FROM versions_in ORDER BY created_at DESC, id DESC LIMIT 1),
folder AS (SELECT 'folder/' || version AS path FROM versions_in ORDER BY created_at DESC, path LIMIT 1)
SELECT CASE WHEN path_exists = 1 THEN 'dataset/' || version ELSE (SELECT path FROM folder) END AS path FROM newest""")
sql("last_loss", "SELECT event_id, CASE WHEN event_type = 'error' THEN value ELSE value / 2 END AS loss FROM events")
sql("best_checkpoint", f"""WITH {cte('checkpoints_in')},
rec AS (SELECT user_id, min(event_id) AS step FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT run_id, c.step, loss FROM checkpoints_in c LEFT JOIN rec ON rec.user_id = run_id AND rec.step = c.step
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY rec.step IS NULL, loss IS NULL, loss, CASE WHEN loss IS NULL THEN -c.step ELSE c.step END) = 1""")
sql("checkpoint_retention", f"""WITH {cte('checkpoints_in')}
SELECT run_id, step FROM checkpoints_in QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) > 3""")

# ---- listings --------------------------------------------------------------------------------


def iso(ts: str) -> str:
    return (f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


sql("list_repositories", f"""WITH {cte('repos_in')}
SELECT id::VARCHAR AS id, url || repeat('/x', 20) AS url, left(url || repeat('/x', 20), 60) AS short_url, {REPO_NAME} AS name, 'main' AS branch, status,
  0::BIGINT AS files_count, {iso('created_at')} AS created_at FROM repos_in""")
sql("list_datasets", f"""WITH {cte('versions_in')}
SELECT id::VARCHAR AS id, version, 'dataset/' || version AS path, total_samples, NULL::VARCHAR AS languages, {iso('created_at')} AS created_at
FROM versions_in""")
sql("list_training_runs", f"""WITH {cte('runs_in')}
SELECT id::VARCHAR AS id, name, status, base_model, left(base_model, 40) AS short_model, output_path,
  CASE WHEN output_path IS NULL OR output_path = '' THEN '-' ELSE output_path END AS shown_path, total_samples,
  {iso('created_at')} AS created_at FROM runs_in""")
sql("list_checkpoints", f"WITH {cte('checkpoints_in')} SELECT * FROM checkpoints_in ORDER BY run_id, step")
sql("shuffle", f"""WITH {DOCS}, r AS (SELECT doc_id, rel_path, row_number() OVER (ORDER BY {DOC_KEY}) - 1 AS rank FROM code_docs)
SELECT doc_id, rel_path, rank, rank AS shuffled_at FROM r""")
sql("union_incremental", f"""WITH {CHUNKS}
SELECT doc_id, rel_path, chunk_idx::INTEGER AS chunk_idx, sha256(text) AS digest FROM samples WHERE {OLD} UNION ALL {FRESH}""")

# ---- scalar text -----------------------------------------------------------------------------


def uncommented(text: str, language: str, docstrings: bool) -> str:
    out = text
    for i, rule in enumerate(COMMENT_SYNTAX[language]):
        if language == "python" and docstrings and i:
            break
        if isinstance(rule, str):
            pattern = "(?m)" + rule
        else:
            pattern = rule[0].replace("*", r"\*") + r"[\s\S]*?" + rule[1].replace("*", r"\*")
        out = f"regexp_replace({out}, {quoted(pattern)}, '', 'g')"
    return out


def comment_cases(text: str, docstrings: bool) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {uncommented(text, name, docstrings)}" for name in COMMENT_SYNTAX)
    return f"CASE language {cases} ELSE {text} END"


DOCSTRING = """('\"\"\"doc' || chr(10) || 'string\"\"\"' || chr(10) || content)"""
sql("remove_comments", f"""WITH {FILES}
SELECT doc_id, rel_path, sha256({comment_cases('content', True)}) AS digest, sha256({comment_cases(DOCSTRING, False)}) AS digest_all FROM known""")
sql("normalize_whitespace", f"WITH {DOCS} SELECT doc_id, rel_path, sha256({normalized('content')}) AS digest FROM code_docs")
sql("remove_boilerplate", f"WITH {FILES} SELECT doc_id, rel_path, sha256({unboiled('content')}) AS digest FROM known")
sql("chunk_chars", f"""WITH {DOCS},
cut AS (SELECT doc_id, rel_path, i AS chunk_idx, substring(content, i * 896 + 1, 1024) AS chunk
        FROM code_docs, LATERAL (SELECT unnest(range(0, (length(content) + 895) // 896)) AS i))
SELECT doc_id, rel_path, chunk_idx, length(chunk)::BIGINT AS chars, sha256(chunk) AS digest FROM cut
WHERE regexp_matches(chunk, '[^{WS}]')""")
sql("chunk_lines", f"""WITH {DOCS}, split AS (SELECT doc_id, rel_path, string_split(content, chr(10)) AS ls FROM code_docs),
cut AS (SELECT doc_id, rel_path, i AS chunk_idx, array_to_string(ls[i * 6 + 1 : i * 6 + 8], chr(10)) AS chunk
        FROM split, LATERAL (SELECT unnest(range(0, (len(ls) + 5) // 6)) AS i))
SELECT doc_id, rel_path, chunk_idx, sha256(chunk) AS digest FROM cut WHERE regexp_matches(chunk, '[^{WS}]')""")
TRIM = rf"regexp_replace(code, '^[{WS}]+|[{WS}]+\z', '', 'g')"
PY_DEF = rf"(?m)(def[{WS}]+[{WORD}]+[^:]*:(?:\n(?:[ \t]+.+|[{WS}]*$))*)"
sql("extract_functions_python", f"""WITH {FILES},
found AS (SELECT doc_id, rel_path, regexp_extract_all(content, {quoted(PY_DEF)}, 1) AS fns FROM known WHERE language = 'python'),
each_fn AS (SELECT doc_id, rel_path, unnest(fns) AS code, unnest(range(0, len(fns))) AS fn_idx FROM found)
SELECT doc_id, rel_path, fn_idx, regexp_extract(code, '^def[{WS}]+([{WORD}]+)', 1) AS name, sha256({TRIM}) AS digest FROM each_fn""")
JS_FN = rf"((?:async[{WS}]+)?function[{WS}]+[{WORD}]+[^{{]*\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})"
JS_ARROW = rf"(const[{WS}]+[{WORD}]+[{WS}]*=[{WS}]*(?:async[{WS}]+)?(?:\([^)]*\)|[{WORD}]+)[{WS}]*=>[^;]+;)"
sql("extract_functions_js", f"""WITH {FILES},
found AS (SELECT doc_id, rel_path, list_concat(regexp_extract_all(content, {quoted(JS_FN)}, 1), regexp_extract_all(content, {quoted(JS_ARROW)}, 1)) AS fns
          FROM known WHERE language IN ('javascript', 'typescript')),
each_fn AS (SELECT doc_id, rel_path, unnest(fns) AS code, unnest(range(0, len(fns))) AS fn_idx FROM found)
SELECT doc_id, rel_path, fn_idx, 'anonymous' AS name, sha256({TRIM}) AS digest FROM each_fn""")
INSTRUCTION = f"{HEADER} || content || {FOOTER}"
sql("format_sample", f"""WITH {FILES}
SELECT doc_id, rel_path, sha256(content) AS completion, sha256({INSTRUCTION}) AS instruction,
  sha256('<fim_prefix>' || left(content, length(content) // 2) || '<fim_suffix>' || substring(content, length(content) // 2 + 1) || '<fim_middle>') AS fim,
  sha256(content) AS fim_bare,
  sha256({nl('### Code:' + chr(10))} || content || {nl(chr(10) + '### Docstring:' + chr(10))} || rel_path) AS docstring,
  sha256({nl('### Code:' + chr(10))} || content || {nl(chr(10) + '### Explanation:' + chr(10) + 'This code')}) AS explain,
  sha256({INSTRUCTION}) AS unknown FROM known""")
sql("token_estimate", f"""WITH {DOCS}
SELECT doc_id, rel_path, round(len(regexp_extract_all(content, '[^{WS}]+')) * 1.3::DOUBLE, 6) AS token_estimate,
  length(content)::BIGINT AS chunk_size FROM code_docs""")
sql("instruction_wrap", f"""WITH {FILES}
SELECT doc_id, rel_path, language, sha256({INSTRUCTION}) AS digest
FROM (SELECT doc_id, rel_path, CASE WHEN doc_id % 5 <> 0 THEN language ELSE 'code' END AS language,
        CASE WHEN doc_id % 3 <> 0 THEN reverse(content) ELSE content END AS content FROM known)""")
sql("completion_prompt", f"""WITH {cte('requests_in')}
SELECT conv_id, turn, {HEADER.replace('|| language ||', "|| 'python' ||")} || prompt AS prompt FROM requests_in""")
sql("explain_prompt", f"""WITH {cte('requests_in')}
SELECT conv_id, turn, {nl('### Code:' + chr(10))} || prompt || {nl(chr(10) + '### Explanation:' + chr(10) + 'This code')} AS prompt FROM requests_in""")


def cut_at(text: str, stop: str) -> str:
    return f"CASE WHEN contains({text}, {quoted(stop)}) THEN left({text}, strpos({text}, {quoted(stop)}) - 1) ELSE {text} END"


sql("cut_stop_sequences", f"""WITH {cte('generations_in')},
a AS (SELECT *, {cut_at('raw_text', '.')} AS t1 FROM generations_in), b AS (SELECT *, {cut_at('t1', 'e')} AS t2 FROM a)
SELECT conv_id, turn, {cut_at('raw_text', '### End')} AS generated_text, {cut_at('t2', '### End')} AS several,
  tokens_generated::BIGINT AS tokens_generated FROM b""")
sql("explain_postprocess", f"""WITH {cte('generations_in')}
SELECT conv_id, turn, 'python' AS language, 'This code' || raw_text AS generated_text FROM generations_in""")
sql("languages_json", f"WITH {CHUNKS} SELECT {JSON} AS languages FROM ({COUNTS})")
sql("run_metrics_json", """SELECT event_id AS id, value AS eval_loss, NULL::DOUBLE AS missing, props::JSON ->> '$.k' AS k,
  NULL::VARCHAR AS absent FROM events""")
sql("run_metrics_variant", """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN value END AS eval_loss, CASE WHEN event_id % 5 = 1 THEN value END AS nested_loss,
  CASE WHEN event_id % 5 = 2 THEN value END AS note, CASE WHEN event_id % 5 = 1 THEN event_id::DOUBLE END AS first_step,
  CASE WHEN event_id % 5 = 2 THEN event_type END AS shown FROM events""")
sql("iso_timestamps", f"SELECT event_id, {iso('ts')} AS ts FROM events")
sql("sample_ids", f"""WITH {CHUNKS}
SELECT id, source_file, chunk_idx, left(sha256(concat_ws(':', id, source_file)), 8) AS version FROM samples""")

# ---- tokens ----------------------------------------------------------------------------------

sql("build_vocabulary", f"WITH {VOCAB} SELECT token, n, token_id // 3 AS token_id FROM vocab ORDER BY token_id LIMIT 2000")
sql("tokenize", f"""WITH {VOCAB}, {ids_of('documents', 'doc_id', 'text', 2048)}
SELECT doc_id, ids AS input_ids, CASE WHEN tokens = 0 THEN 0 ELSE tokens END AS mask_sum, true AS labels_copy FROM encoded""")
sql("truncate_prompt", f"""WITH {VOCAB}, {DOCS}, {ids_of('code_docs', 'doc_id, rel_path', 'content', 1800)}
SELECT doc_id, rel_path, tokens, sha256(ids) AS digest FROM encoded""")
sql("pad_batches", f"""WITH {VOCAB}, {ids_of('documents', 'doc_id', 'text', 2048)},
ranked AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(':', '42', doc_id))) - 1 AS r FROM encoded),
b AS (SELECT *, r // 4 AS batch_id, r % 4 AS slot, max(tokens) OVER (PARTITION BY r // 4) - tokens AS gap FROM ranked)
SELECT doc_id, batch_id, slot, trim(ids || repeat(',1', gap), ',') AS input_ids,
  trim(repeat(',1', tokens) || repeat(',0', gap), ',') AS attention_mask, trim(ids || repeat(',-100', gap), ',') AS labels FROM b""")

# ---- user functions, whole plans --------------------------------------------------------------

sql("map_batches", """WITH b AS (SELECT doc_id, unnest(range(0, least(octet_length(encode(text)), 2048))) AS i, hex(encode(text)) AS h FROM documents)
SELECT doc_id, count(*) AS tokens, sha256(string_agg(('0x' || substring(h, 2 * i + 1, 2))::INTEGER::VARCHAR, ',' ORDER BY i)) AS digest FROM b GROUP BY doc_id""")
sql("custom_template", f"WITH {DOCS} SELECT doc_id, rel_path, sha256('<' || repo || '>' || rel_path || chr(10) || content) AS digest FROM code_docs")
sql("ingest_repositories", f"""WITH {SCANNED},
seen AS (SELECT repo, rel_path FROM kept UNION
         SELECT repo, rel_path FROM (SELECT * FROM scanned WHERE {OLD} QUALIFY row_number() OVER (PARTITION BY repo, content_hash ORDER BY rel_path) = 1)),
entries AS (SELECT repo, count(*) AS n FROM seen GROUP BY repo)
SELECT 'https://example.com/org/' || repo AS url, repo AS name, 'completed' AS status, count(*) FILTER (content IS NOT NULL) AS files,
  coalesce(sum(line_count), 0)::BIGINT AS lines, coalesce(round(sum(size_kb::DECIMAL(18,3))::DOUBLE, 3), 0) AS size_kb,
  coalesce(max(n), 0) AS catalogued
FROM (SELECT DISTINCT repo FROM code_docs) LEFT JOIN kept USING (repo) LEFT JOIN entries USING (repo) GROUP BY repo""")
sql("preprocess_files", f"""WITH {CHUNKS}
SELECT doc_id, rel_path, language, chunk_idx, chunk_size, token_estimate, sha256(text) AS digest FROM samples""")
sql("build_dataset", f"""WITH {TEXT_SPLIT}
SELECT id, language, chunk_idx, chunk_size, source_file, split, sha256(text) AS digest FROM split""")
sql("incremental_build", f"""WITH {CHUNKS},
merged AS (SELECT * FROM samples WHERE {OLD} UNION ALL
           SELECT * FROM samples WHERE text NOT IN (SELECT text FROM samples WHERE {OLD})),
{split_of('merged', SAMPLE_KEY)}
SELECT id, language, chunk_idx, chunk_size, source_file, split, sha256(text) AS digest FROM split""")
sql("grow_dataset", SQL["incremental_build"])
sql("training_input", f"""WITH {VOCAB}, {TEXT_SPLIT}, {ids_of('split', 'id', 'text', 2048)},
parts AS (SELECT id, split AS part FROM split UNION ALL SELECT id, 'eval' FROM split WHERE split = 'validation')
SELECT id, part, tokens, sha256(ids) AS digest, (SELECT count(*) FROM split WHERE split = 'train') AS total_samples
FROM parts JOIN encoded USING (id)""")
sql("finetune_input", f"""WITH {ID_SPLIT}
SELECT id, language, sha256({HEADER} || text || {FOOTER}) AS digest FROM split WHERE split = 'train'""")
sql("bulk_completion_frame", f"""WITH {VOCAB}, {SPARSE},
q AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'go' ELSE 'python' END AS language, coalesce(max_new_tokens, 256) AS max_new_tokens, prompt AS content
      FROM sparse WHERE coalesce(max_new_tokens BETWEEN 1 AND 2048, true) AND coalesce(temperature BETWEEN 0 AND 2, true)),
asked AS (SELECT conv_id, turn, max_new_tokens, language, {HEADER} || content AS prompt FROM q),
{ids_of('asked', 'conv_id, turn', 'prompt', 1800)}
SELECT conv_id, turn, language, max_new_tokens, 0.7::DOUBLE AS temperature, sha256(prompt) AS prompt, sha256(prompt || '|') AS generated_text,
  sha256(ids) AS input_ids, least(max_new_tokens, tokens)::BIGINT AS tokens_generated, round_even(tokens / 64.0::DOUBLE, 3) AS time_seconds,
  round_even(least(max_new_tokens, tokens) / nullif(tokens / 64.0::DOUBLE, 0), 2) AS tokens_per_second
FROM asked JOIN encoded USING (conv_id, turn)""")

# ---- streams ---------------------------------------------------------------------------------

sql("stream_ingest", f"WITH {SCANNED} SELECT DISTINCT repo, content_hash FROM scanned")
sql("stream_dedupe_state", f"WITH {SCANNED} SELECT DISTINCT repo, content_hash FROM scanned")
sql("stream_first_copies", f"WITH {SCANNED} SELECT repo, min(rel_path) AS rel_path, content_hash FROM scanned GROUP BY repo, content_hash")
sql("stream_dataset_build", f"""WITH {CHUNKS},
arrived AS (SELECT * FROM samples QUALIFY doc_id % 4 = min(doc_id % 4) OVER (PARTITION BY text)),
{split_of('arrived', SAMPLE_KEY)}
SELECT id, language, split, sha256(text) AS digest FROM split""")
