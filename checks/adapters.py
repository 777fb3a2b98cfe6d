"""Views that turn the given tables into the engine's inputs.

The same SQL text runs on Spark (tables passed as DataFrames) and on DuckDB (as CTEs). Code-like
text is wrapped around the given prose so that comments, boilerplate, functions, blank runs and
foreign line breaks occur; every given row is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODE_DOCS = """
WITH b AS (
  SELECT doc_id, source AS repo, text,
    CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.sql' WHEN 3 THEN '.sh'
                    WHEN 4 THEN '.TSX' WHEN 5 THEN '.go' ELSE '.md' END AS ext,
    CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' WHEN doc_id % 23 = 0 THEN 'src/builder/' ELSE 'src/' END AS dir
  FROM {documents}),
c AS (
  SELECT doc_id, repo, concat(dir, 'doc_', doc_id, ext) AS rel_path,
    CASE ext
      WHEN '.py' THEN concat('# note', chr(10), 'def f(x):', chr(10), '    return x  ', repeat(chr(10), 6), text, chr(10),
                             'if __name__ == ', chr(39), '__main__', chr(39), ':', chr(10), '    f(1)', chr(10), chr(10))
      WHEN '.js' THEN concat(chr(34), 'use strict', chr(34), ';', chr(10), '// note', chr(10),
                             'function f(x) {{ if (x) {{ return 1 }} }}', chr(10), 'const g = (y) => y + 1;', chr(9), chr(10), text)
      WHEN '.TSX' THEN concat('/* block', chr(10), 'comment */', chr(10), 'async function h(x) {{ return x }}', chr(13), chr(10), text)
      WHEN '.sql' THEN concat('-- note', chr(10), 'SELECT 1; /* a', chr(10), 'b */', chr(10), text)
      WHEN '.sh' THEN concat('#!/bin/sh', chr(10), '# note', chr(10), text)
      WHEN '.go' THEN concat('// note', chr(10), 'func f() {{}}', chr(10), text)
      ELSE text END AS content
  FROM b)
SELECT doc_id, repo, rel_path, content FROM c
UNION ALL
SELECT doc_id, repo, concat('zz_copy/', rel_path), content FROM c WHERE doc_id % 10 = 0
"""

REPOS_IN = """
SELECT s_suppkey AS id, concat('https://example.com/org', s_nationkey, '/', s_name, CASE WHEN s_suppkey % 3 = 0 THEN '/' ELSE '' END) AS url,
  CASE s_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
  o.o_orderdate AS created_at
FROM {supplier} s JOIN {orders} o ON o.o_orderkey = s_suppkey
"""

RUNS_IN = """
SELECT o_orderkey AS id, concat('run_', o_orderkey) AS name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'training' ELSE 'failed' END AS status,
  repeat(o_orderpriority, 8) AS base_model,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('out/', o_orderkey) END AS output_path,
  o_custkey AS total_samples, o_orderdate AS created_at
FROM {orders}
"""

VERSIONS_IN = """
SELECT o_orderkey AS id, concat('v', o_orderkey) AS version, o_custkey AS total_samples, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS path_exists
FROM {orders}
"""

CHECKPOINTS_IN = """
SELECT user_id AS run_id, event_id AS step, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS loss FROM {events}
"""

REQUESTS_IN = """
SELECT conv_id, turn, text AS prompt, (turn * 1000 + conv_id * 37) % 5000 AS max_new_tokens,
  CAST((conv_id * 7 + turn) % 30 AS DOUBLE) / CAST(10 AS DOUBLE) AS temperature,
  CAST((conv_id + turn) % 12 AS DOUBLE) / CAST(10 AS DOUBLE) AS top_p, (conv_id * 3 + turn) % 250 AS top_k,
  CAST((conv_id + turn) % 25 AS DOUBLE) / CAST(10 AS DOUBLE) AS repetition_penalty, turn % 3 <> 0 AS do_sample
FROM {conversations} WHERE role = 'user'
"""

GENERATIONS_IN = """
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN concat(text, chr(10), '### End', chr(10), text) ELSE text END AS raw_text,
  CAST(length(text) % 512 AS INT) AS tokens_generated, CAST((conv_id + turn) % 40 AS DOUBLE) / CAST(8 AS DOUBLE) AS elapsed
FROM {conversations} WHERE role = 'assistant'
"""

VIEWS = {
    "code_docs": (CODE_DOCS, ("documents",)),
    "repos_in": (REPOS_IN, ("supplier", "orders")),
    "runs_in": (RUNS_IN, ("orders",)),
    "versions_in": (VERSIONS_IN, ("orders",)),
    "checkpoints_in": (CHECKPOINTS_IN, ("events",)),
    "requests_in": (REQUESTS_IN, ("conversations",)),
    "generations_in": (GENERATIONS_IN, ("conversations",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, tables = VIEWS[name]
    frames = {t: documents(spark, sf_dir) if t == "documents" else table(spark, sf_dir, t) for t in tables}
    return spark.sql(text, **frames)


def cte(*names: str) -> str:
    """The views as DuckDB CTEs, without the leading WITH."""
    parts = []
    for name in names:
        text, tables = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{t: t for t in tables})})")
    return ",\n".join(parts)
