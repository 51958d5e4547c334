"""SQL twins of the bindings, for the DuckDB oracle (same rows as
:mod:`textforge.sources.bindings`). Each value is a SELECT usable as a CTE."""

V = ("concat('{\"faithfulness\": ', CAST(1 + 4 * quality AS VARCHAR), "
     "', \"darija_quality\": ', CAST(5 - 4 * toxic AS VARCHAR), "
     "', \"conciseness\": ', CAST(1 + doc_id % 5 AS VARCHAR), "
     "', \"reasoning\": \"r', CAST(doc_id AS VARCHAR), '\"}')")

B1 = """SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
       CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS split_rank,
       CASE WHEN doc_id % 10 < 2 THEN doc_id // 10 ELSE doc_id // 10 * 8 + doc_id % 10 - 2 END AS pos, text AS article, split_part(text, chr(10), 1) AS headline
FROM documents"""

B2 = """SELECT doc_id AS id, 'Summarize this text:' AS instruction, text AS input, split_part(text, chr(10), 1) AS output
FROM documents"""

B3 = """SELECT doc_id AS id, m.model, text AS input, split_part(text, chr(10), 1) AS reference,
       CASE WHEN doc_id % 20 = 1 THEN '' ELSE substring(text, m.start, 80) END AS predicted
FROM documents JOIN (SELECT 'finetuned' AS model, 1 AS start UNION ALL SELECT 'base', 81) m ON TRUE"""

B3_GAPS = f"SELECT * FROM ({B3}) p WHERE id % 20 <> 0"

B4 = """SELECT a.vec_id AS id, k.model, a.embedding AS ref_vec, p.embedding AS pred_vec
FROM embeddings a JOIN (SELECT 'finetuned' AS model, 1 AS k UNION ALL SELECT 'base', 2) k ON TRUE
JOIN embeddings p ON p.vec_id = (a.vec_id + k.k) % (SELECT max(vec_id) + 1 FROM embeddings)"""

B5 = f"""SELECT doc_id AS id, n AS attempt,
       CASE WHEN n = 1 AND doc_id % 7 = 3 THEN translate({V}, '"', '\'\'')
            WHEN n = 1 AND doc_id % 7 = 5 THEN concat({V}, ' Hope this helps')
            WHEN n = 1 AND doc_id % 7 = 6 THEN concat({V}, ' {{')
            WHEN doc_id % 5 = 0 THEN {V}
            WHEN doc_id % 5 = 1 THEN concat('```json', chr(10), {V}, chr(10), '```')
            WHEN doc_id % 5 = 2 AND n < 3 THEN 'not json'
            WHEN doc_id % 5 = 2 THEN {V}
            WHEN doc_id % 5 = 3 THEN '{{"faithfulness": 3}}'
            ELSE concat('  ', {V}, ' ') END AS raw
FROM labels JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) t ON TRUE"""


def _axis(name: str, winner: str, conf: str) -> str:
    return (f"'\"{name}\": {{\"winner\": \"', {winner}, '\", \"confidence\": \"', {conf}, "
            f"'\", \"reason\": \"{name}\"}}'")


def _conf(k: str) -> str:
    return f"(['low', 'medium', 'high'])[CAST(({k}) % 3 + 1 AS INTEGER)]"


def _ab(c: str) -> str:
    return f"CASE WHEN {c} = 1 THEN 'A' ELSE 'B' END"


PAIRWISE = ("concat('{', " + _axis("faithfulness", _ab("quality"), _conf("doc_id")) + ", ', ', "
            + _axis("darija_quality", _ab("toxic"), _conf("doc_id + 1")) + ", ', ', "
            + _axis("conciseness", _ab("doc_id % 2"), _conf("doc_id + 2"))
            + ", ', \"overall_winner\": \"', " + _ab("quality")
            + ", '\", \"overall_confidence\": \"', " + _conf("doc_id")
            + ", '\", \"overall_reason\": \"o', CAST(doc_id AS VARCHAR), '\"}')")

B5P = f"SELECT doc_id AS id, {PAIRWISE} AS raw FROM labels"

B6 = """SELECT user_id AS request_id, seq, ts,
       CASE WHEN seq = last_seq THEN 'data: [DONE]' WHEN event_type = 'signup' THEN ''
            WHEN event_type = 'error' THEN 'data: {bad'
            WHEN event_type = 'view' THEN 'data: {"choices":[{"delta":{}}]}'
            WHEN event_id % 23 = 5 THEN 'data: {"choices":[]}'
            WHEN event_id % 23 = 7 THEN 'data: {''choices'':[{''delta'':{''content'':''q''}}]}'
            WHEN event_id % 23 = 9 THEN 'data: {"choices":[{"delta":{"content":"t"}}]} trailing'
            ELSE concat('data: {"choices":[{"delta":{"content":"c', CAST(event_id AS VARCHAR), ' "}}]}') END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
             count(*) OVER (PARTITION BY user_id) - 1 AS last_seq FROM events) e"""

B7 = """SELECT doc_id AS request_id,
       CASE WHEN doc_id % 50 = 0 THEN '   ' WHEN doc_id % 50 = 1 THEN NULL ELSE text END AS prompt,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 600 END AS max_tokens,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 25 AS DOUBLE) / 10 END AS temperature,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 0.5e0 + CAST(doc_id % 20 AS DOUBLE) / 10 END AS repetition_penalty,
       CASE WHEN doc_id % 17 = 3 THEN repeat('s', 501) WHEN doc_id % 17 = 5 THEN 'Answer in one line.' END AS system_prompt
FROM documents"""

B8 = """SELECT CASE WHEN user_id % 2 = 0 THEN 'sequential' ELSE 'concurrent' END AS label, event_id AS request_id,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE value END AS ttft_ms,
       value * 8 AS total_time_ms, event_id % 51 AS token_count,
       CASE WHEN value > 0 THEN CAST(event_id % 51 AS DOUBLE) / (value * 8 / 1000) ELSE 0e0 END AS tokens_per_sec,
       CASE WHEN event_type = 'error' THEN 'HTTP 500' WHEN event_type = 'view' THEN '' END AS error
FROM events"""

B9 = """SELECT event_type AS run, 50 * row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
       value AS loss, CASE WHEN event_id % 4 = 0 THEN value * 1.1e0 END AS eval_loss,
       2e-4 AS learning_rate, ts AS logged_at
FROM events"""

B10 = """SELECT event_id AS request_id, CASE WHEN user_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
       CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'exception' ELSE 'response' END AS outcome,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' AND event_id % 3 = 0 THEN 503 ELSE 200 END AS status_code,
       value * 8 AS latency_ms,
       CASE WHEN event_id % 17 = 6 THEN concat(body0, ' trailing') WHEN event_id % 17 = 8 THEN translate(body0, '"', '''') ELSE body0 END AS body
FROM (SELECT *, concat(CASE WHEN event_id % 17 = 4 THEN '{"choices":[' ELSE concat('{"choices":[{"message":{"content":"  s', CAST(event_id AS VARCHAR), ' "}}') END,
              '],"usage":{"prompt_tokens":', CAST(10 + event_id % 90 AS VARCHAR),
              ',"completion_tokens":', CAST(1 + event_id % 50 AS VARCHAR), ',"total_tokens":', CAST(11 + event_id % 90 + event_id % 50 AS VARCHAR), '}}') AS body0 FROM events) e"""

B11 = """SELECT request_id, k AS seq, t0 + to_microseconds(CAST(k * 250000 + (event_id % 200) * 1000 + event_id % 7
         + CASE WHEN request_id % 7 = 3 AND k >= 4 THEN 90000000 ELSE 0 END AS BIGINT)) AS ts, kind,
       CASE WHEN k = 0 THEN CASE WHEN request_id % 11 = 4 THEN 503 WHEN request_id % 11 = 9 THEN 429 ELSE 200 END END AS status,
       CASE WHEN kind = 'failure' THEN 'connection reset by peer' WHEN kind = 'line' THEN
         CASE WHEN k = n - 3 THEN 'data: [DONE]' WHEN event_type = 'signup' THEN '' WHEN event_type = 'error' THEN 'data: {bad'
              WHEN event_id % 10 = 7 THEN 'data: {''choices'':[{''delta'':{''content'':''q''}}]}'
              WHEN event_id % 10 = 8 THEN 'data: {"choices":[{"delta":{"content":"t"}}]} trailing'
              WHEN event_type = 'view' THEN 'data: {"choices":[{"delta":{}}]}'
              ELSE concat('data: {"choices":[{"delta":{"content":"c', CAST(event_id AS VARCHAR), ' "}}]}') END END AS text
FROM (SELECT *, CASE WHEN k = 0 THEN 'status' WHEN k = n - 1 THEN 'close'
                     WHEN request_id % 13 = 6 AND k = 3 THEN 'failure' ELSE 'line' END AS kind
      FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, min(ts) OVER (PARTITION BY request_id) AS t0
            FROM (SELECT event_id, ts, event_type, s % 12 AS k, user_id * 100000 + s // 12 AS request_id
                  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM events) a) b) c) d
WHERE NOT (request_id % 7 = 5 AND k >= 5)"""

_WS = r"\x09-\x0D\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _lead(line: int, k: int) -> str:
    return (f"array_to_string(list_filter(regexp_split_to_array(coalesce(ls[{line}], ''), '[{_WS}]+'), lambda x: x <> '')[1:{k}], ' ')")


B12 = f"""SELECT id, model, reference, CASE model WHEN 'finetuned' THEN {_lead(2, 12)} || chr(10) || {_lead(1, 9)}
         ELSE {_lead(3, 8)} || chr(10) || {_lead(2, 10)} END AS predicted
FROM (SELECT doc_id AS id, ls, concat(coalesce(ls[1], ''), chr(10), coalesce(ls[2], ''), chr(10), coalesce(ls[3], '')) AS reference
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) l) r
JOIN (SELECT 'finetuned' AS model UNION ALL SELECT 'base') m ON TRUE"""

ALL = {"b1": B1, "b2": B2, "b3": B3, "b3_gaps": B3_GAPS, "b4": B4, "b5": B5, "b5p": B5P, "b6": B6, "b7": B7,
       "b8": B8, "b9": B9, "b10": B10, "b11": B11, "b12": B12}


def with_bindings(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named bindings as CTEs."""
    need = []
    for n in names:
        if n not in need:
            need.append(n)
    ctes = ",\n".join(f"{n} AS ({ALL[n]})" for n in need)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
