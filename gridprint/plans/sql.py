"""Pieces of DuckDB SQL that the counterparts of the queries are made of."""

from __future__ import annotations

from gridprint.functions import lists

GRID = 32
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in lists.STOP_WORDS)
LETTERS = r"[\p{L}]+"


def generic(w: str, n: int = 3) -> str:
    return f"(length({w}) < {n} OR {w} IN ({STOP}) OR regexp_matches({w}, '^[0-9]+$'))"


def spread(v: str) -> str:
    out = f"(({v})::BIGINT & 65535)"
    for s, m in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = f"(({out} | ({out} << {s})) & {m})"
    return out


def morton(x: str, y: str) -> str:
    return f"({spread(x)} | ({spread(y)} << 1))"


def gather(v: str) -> str:
    out = f"(({v})::BIGINT & 1431655765)"
    for s, m in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0xFFFF)):
        out = f"(({out} | ({out} >> {s})) & {m})"
    return out


#: Words of every document with their places, and content words.
TOK = f"tok AS (SELECT doc_id AS context_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS ws FROM documents))"
ONE = f"{TOK}, one AS (SELECT context_id, w AS phrase, i FROM tok WHERE NOT {generic('w')}), posts AS (SELECT DISTINCT phrase, context_id FROM one)"
TWO = f"{TOK}, one AS (SELECT context_id, w, i FROM tok WHERE NOT {generic('w')}), posts AS (SELECT DISTINCT a.w || ' ' || b.w AS phrase, a.context_id FROM one a JOIN one b ON a.context_id = b.context_id AND b.i = a.i + 1)"
VOC = "voc AS (SELECT phrase, count(*) AS df FROM posts GROUP BY phrase HAVING count(*) >= 2)"
IDF = "idf AS (SELECT phrase, df, ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)) AS idf FROM voc)"
TCM = "tcm AS (SELECT phrase, context_id, idf AS weight FROM posts JOIN idf USING (phrase))"
CELL = f"cells AS (SELECT doc_id AS context_id, {morton(f'doc_id % {GRID}', f'(doc_id // {GRID}) % {GRID}')} AS cell FROM documents)"
#: Raw fingerprints of two-word phrases, and the documents' fingerprints that they add up to.
PHRASE = f"{TWO}, {VOC}, {IDF}, {TCM}, {CELL}, cnt AS (SELECT phrase, cell, count(*) AS n FROM tcm JOIN cells USING (context_id) GROUP BY phrase, cell), pfp AS (SELECT phrase, cell, n / max(n) OVER (PARTITION BY phrase) AS value FROM cnt)"
DOC = f"{PHRASE}, raw AS (SELECT context_id, cell, sum(weight * value) AS v FROM tcm JOIN pfp USING (phrase) GROUP BY context_id, cell), dfp AS (SELECT context_id, cell, round(v, 6) AS value FROM raw WHERE round(v, 6) <> 0)"
#: Vectors of `embeddings`, dense and long, and the block of queries.
EMB = "emb AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT id AS q_id, label AS q_label, v AS qv FROM emb WHERE id % 50 = 0), met AS (SELECT * FROM q, emb WHERE q_id <> id), flat AS (SELECT id, label, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS cell FROM emb)"
#: Two-word phrases of the benchmark's texts.
QUERY = f"qtok AS (SELECT item_id AS query_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS ws FROM benchmark)), qone AS (SELECT * FROM qtok WHERE NOT {generic('w')}), qphr AS (SELECT a.query_id, a.w || ' ' || b.w AS phrase, count(*) AS n FROM qone a JOIN qone b ON a.query_id = b.query_id AND b.i = a.i + 1 GROUP BY 1, 2)"


def pairs(f: str) -> str:
    """Sum of f over the places of both vectors (a: qv, b: v)."""
    return f"list_sum(list_transform(list_zip(qv, v), lambda z: {f.replace('a', 'z[1]').replace('b', 'z[2]')}))"
