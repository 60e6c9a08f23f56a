"""Pieces of SQL shared by the SQL counterparts of the registered queries."""

from fathomdoc.functions import fixed
from fathomdoc.operators.embedding import HASH_DIMENSIONS
from fathomdoc.operators.search import code_pair

# Fixed windows of documents.
WINDOWS = """windows AS (
  SELECT doc_id, source, lang, i AS chunk_no, substring(text, i * 800 + 1, 1000) AS content,
         doc_id || '-' || i AS passage_id
  FROM (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(length(text) - 1000, 0) / 800.0) AS BIGINT))) AS i
        FROM documents WHERE length(text) > 0))"""

# Squared distance of lists a.e and b.e.
DISTANCE = ("round(list_sum(list_transform(range(1, len(a.e) + 1), "
            "lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))), 9)")
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def nearest(k: int, where: str = "true") -> str:
    """CTE ``hits`` over the embeddings table."""
    return f"""{VECTORS},
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {DISTANCE} AS distance FROM v a, v b WHERE {where}),
hits AS (SELECT query_id, chunk_id, distance,
                row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
         FROM pairs QUALIFY rank <= {k})"""


def shares_code(tables: int, bits: int, dimensions: int) -> str:
    """Condition that a.e and b.e agree on all comparisons of some table."""
    def agree(t, b):
        i, j = (x + 1 for x in code_pair(t, b, bits, dimensions))
        return f"((a.e[{i}] > a.e[{j}]) = (b.e[{i}] > b.e[{j}]))"

    return "(" + " OR ".join(
        "(" + " AND ".join(agree(t, b) for b in range(bits)) + ")" for t in range(tables)) + ")"


def hashed(name: str, relation: str, key: str, text: str) -> str:
    """CTEs giving ``<name>`` (key, b, v): the hashing embedder's vectors, without zeros."""
    return f"""{name}_words AS (
  SELECT {key}, CAST('0x' || substring(sha256(w), 1, 8) AS BIGINT) % {HASH_DIMENSIONS} AS b
  FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '\\s+')) AS w FROM {relation}) WHERE w <> ''),
{name}_counts AS (SELECT {key}, b, CAST(count(*) AS DOUBLE) AS c FROM {name}_words GROUP BY {key}, b),
{name}_norms AS (SELECT {key}, sqrt(sum(c * c)) AS n FROM {name}_counts GROUP BY {key}),
{name} AS (SELECT {key}, b, CAST(CAST(c / n AS FLOAT) AS DOUBLE) AS v
           FROM {name}_counts JOIN {name}_norms USING ({key}))"""


def lexical(question: str, content: str, index: str) -> str:
    words = f"list_filter(string_split_regex(lower({question}), '\\s+'), lambda w: length(w) > 2)"
    matches = (f"len(list_filter(string_split_regex(lower({content}), '\\s+'), "
               f"lambda w: list_contains({words}, w)))")
    return f"""round(CASE WHEN length({question}) = 0 OR length({content}) = 0 THEN 85.0 - 5 * {index}
  WHEN contains(lower({content}), lower({question})) THEN greatest(85.0, 90.0 - 2 * {index})
  ELSE greatest(25.0, least(95.0, CASE WHEN len({words}) > 0
    THEN CAST({matches} AS DOUBLE) / len({words}) ELSE 0.0 END * 60 + 30 - {index} * 3
    + (length({content}) % 10 - 5))) END, 1)"""


# Benchmark items as questions over windows: 50 nearest with texts, cand_idx from 0.
CANDIDATES = f"""{WINDOWS},
{hashed("q", "benchmark", "item_id", "text")},
{hashed("p", "windows", "passage_id", "content")},
dots AS (SELECT q.item_id, p.passage_id, sum(q.v * p.v) AS dot FROM q JOIN p USING (b) GROUP BY ALL),
q_len AS (SELECT item_id, sum(v * v) AS n FROM q GROUP BY item_id),
p_len AS (SELECT passage_id, sum(v * v) AS n FROM p GROUP BY passage_id),
scored AS (
  SELECT item_id AS query_id, w.passage_id, w.content, w.source,
         round(q_len.n + coalesce(p_len.n, 0) - 2 * coalesce(dot, 0), 9) AS distance
  FROM q_len CROSS JOIN windows w LEFT JOIN p_len USING (passage_id) LEFT JOIN dots USING (item_id, passage_id)),
candidates AS (
  SELECT query_id, passage_id, content, source, distance, b.text AS question,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, passage_id) - 1 AS cand_idx
  FROM scored JOIN benchmark b ON b.item_id = query_id QUALIFY cand_idx < 50)"""



def candidates_where(condition: str) -> str:
    """``CANDIDATES`` among the windows that meet a condition."""
    return CANDIDATES.replace("FROM documents WHERE length(text) > 0", f"FROM documents WHERE length(text) > 0 AND {condition}")


RETRIEVED = f"""{CANDIDATES},
rated AS (SELECT *, {lexical("question", "content", "cand_idx")} AS score FROM candidates),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_idx) AS retrieval_rank
         FROM rated QUALIFY retrieval_rank <= 5)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rag_prompt(context: str, question: str) -> str:
    return (f"{quoted(fixed.PROMPT_HEAD)} || {context} || {quoted(fixed.PROMPT_QUESTION)} || {question} || "
            f"{quoted(fixed.PROMPT_TAIL)}")
