"""The registered queries in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

import unicodedata

from quizloom import constants as K

L5 = "A, B, C, D, E"
CAPPED_ROWS = 170
CHUNKED_QUERIES, CHUNKED_SAMPLE = 12, 600
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _segment(i: int, step: str = "st", words: str = "w") -> str:
    return f"array_to_string({words}[{i} * {step} + 1 : ({i} + 1) * {step}], ' ')"


def _questions(name: str, source: str, key: str, nulls: dict[str, str]) -> str:
    def value(column: str, expression: str) -> str:
        if column in nulls:
            expression = f"CASE WHEN {nulls[column]} THEN NULL ELSE {expression} END"
        return f"{expression} AS {column}"

    options = ", ".join(
        value(x, f"nullif({_segment(i + 1)}, '')") for i, x in enumerate("ABCDE")
    )
    opening = (
        "CASE length(text) % 4 WHEN 0 THEN 'What is ' WHEN 1 THEN "
        "'Which of the following statements ' WHEN 2 THEN 'Which of the following is ' "
        "ELSE '' END"
    )
    prompt = value("prompt", f"{opening} || {_segment(0)} || '?'")
    answer = value("answer", "substr('ABCDE', (id // 5 % 5 + 1)::INT, 1)")
    return f"""{name}_w AS (SELECT {key} AS id, text, string_split_regex(text, '[ \\n]+') AS w,
      (len(string_split_regex(text, '[ \\n]+')) + 5) // 6 AS st FROM {source}),
    {name} AS (SELECT id, {prompt}, {options}, {answer} FROM {name}_w)"""


BENCH = _questions("mcq_bench", "benchmark", "item_id", {"E": "id % 7 = 0"})
DOCS = _questions(
    "mcq_docs", "documents", "doc_id",
    {"E": "id % 7 = 0", "B": "id % 13 = 0", "answer": "id % 11 = 10", "prompt": "id % 17 = 16"},
)
RUNS = DOCS + f""",
    eval_runs AS (SELECT id AS row_no, prompt, {L5}, answer,
      CASE id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE / 3 WHEN 2 THEN 0.5::DOUBLE
      WHEN 3 THEN 1.0::DOUBLE END AS mAP FROM mcq_docs)"""
CONTEXT = DOCS + f""",
    mcq_context AS (SELECT m.id, prompt, d.text AS context, {L5}, answer
      FROM mcq_docs m JOIN documents d ON d.doc_id = m.id)"""
PASSAGES = """passages AS (SELECT (min(doc_id) % 5)::INT AS shard, min(doc_id) AS passage_id, text
      FROM documents GROUP BY text)"""
SCORES = """option_scores AS (SELECT vec_id AS id, list_transform(range(5), lambda i:
      round(list_sum(list_transform(range(i, len(embedding), 5), lambda j:
        embedding[j + 1]::DOUBLE)), 9)) AS s,
      (label % 5)::INT AS label FROM embeddings)"""
PAGES = """page_text AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1)
      AS page_title, trim(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS wiki_text,
      substr('STEM', (page_id % 4 + 1)::INT, 1) AS stem_label FROM pages)"""
EDGES = """category_edges AS (
      SELECT 'Category:Region_' || n_regionkey AS parent, 'Category:Nation_' || n_nationkey AS child
      FROM nation UNION ALL
      SELECT 'Category:Nation ' || c_nationkey, c_name FROM customer UNION ALL
      SELECT 'Category:Nation 0', 'Category:Region_' || n_regionkey FROM nation
      WHERE n_nationkey = 0)"""

NO_ANSWER = _q(K.NO_ANSWER)


def _filled(columns: str) -> str:
    return ", ".join(f"coalesce({c}, {NO_ANSWER}) AS {c}" for c in columns.split(", "))


FULL_TEXT = (
    f"{_q(K.SEARCH_INSTRUCTION)} || prompt || chr(10)"
    + "".join(f" || '{x})' || {x} || chr(10)" for x in "ABCDE")
)
ASKED = BENCH + f""",
    filled AS (SELECT id, {_filled('prompt, ' + L5 + ', answer')} FROM mcq_bench),
    asked AS (SELECT *, {FULL_TEXT} AS full_text FROM filled)"""
_OPTIONS = "(A || ' ' || B || ' ' || C || ' ' || D || ' ' || E)"
_STEM = "full_text[8:-2]"
_THAT = " || ' ' || ".join(f"{_STEM} || ' is that ' || {x}" for x in "ABCDE")
QUERY_TEXT = f"""CASE WHEN contains(full_text, 'What is') THEN {_THAT}
      WHEN contains(full_text, 'Which of the following statements')
      THEN replace(replace(full_text, 'Which of the following statements ', '') || {_OPTIONS},
        '?', '. ')
      WHEN contains(full_text, 'Which of the following is')
      THEN replace(replace(full_text, 'Which of the following is ', '') || {_OPTIONS},
        '?', '. ')
      ELSE full_text || ' ' || {_OPTIONS} END"""


def _nfkd(expression: str) -> str:
    """Decompose the characters of the Latin-1 block, the only ones the texts hold."""
    for code in range(0xA0, 0x100):
        plain = unicodedata.normalize("NFKD", chr(code))
        if plain != chr(code):
            expression = f"replace({expression}, chr({code}), {_q(plain)})"
    return expression


_STOP = ", ".join(_q(w) for w in K.STOP_WORDS)
_PATTERN = _q(K.TOKEN_PATTERN)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {_PATTERN})"


def _kept(text: str) -> str:
    return f"list_filter({_tokens(text)}, lambda t: t NOT IN ({_STOP}))"


def _terms(tokens: str) -> str:
    return (
        f"list_concat({tokens}, list_transform(range(1, len({tokens})), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"
    )


def _lexical(queries: str, pool: str, size: int | None = None, sample: int | None = None) -> str:
    """CTEs from ``queries`` (query_id, text) and ``pool`` (passage_id, text) to ``ranked``, with
    ``size`` queries to a vocabulary and idf of the first ``sample`` passages if given."""
    scored = "replace(" + _nfkd("text") + ", '\"', '')"
    chunk = f"(row_number() OVER (ORDER BY query_id) - 1) // {size}" if size else "0::BIGINT"
    first = f"(SELECT passage_id FROM {pool} ORDER BY 1 LIMIT {sample})" if sample else f"(SELECT passage_id FROM {pool})"
    return f"""
    q_tok AS (SELECT query_id, {chunk} AS chunk, {_kept('text')} AS tk FROM {queries}),
    q_terms AS (SELECT chunk, query_id, term, count(*) AS tf FROM
      (SELECT chunk, query_id, unnest({_terms('tk')}) AS term FROM q_tok) GROUP BY ALL),
    vocab AS (SELECT DISTINCT chunk, term FROM q_terms),
    p_tok AS (SELECT passage_id, {_kept(scored)} AS tk FROM {pool}),
    p_terms AS (SELECT passage_id, term, count(*) AS tf FROM
      (SELECT passage_id, unnest({_terms('tk')}) AS term FROM p_tok)
      WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
    first_pool AS {first},
    n_pool AS (SELECT count(*) AS n FROM first_pool),
    idf AS (SELECT chunk, v.term, coalesce(df, 0) AS df,
      ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf
      FROM vocab v LEFT JOIN (SELECT term, count(*) AS df FROM p_terms JOIN first_pool
        USING (passage_id) GROUP BY term) d
      ON d.term = v.term, n_pool),
    q_w AS (SELECT chunk, query_id, term, tf * idf / sqrt(sum((tf * idf) ^ 2)
      OVER (PARTITION BY query_id)) AS w FROM q_terms JOIN idf USING (chunk, term)),
    p_w AS (SELECT chunk, passage_id, term, tf * idf / sqrt(sum((tf * idf) ^ 2)
      OVER (PARTITION BY chunk, passage_id)) AS w FROM p_terms JOIN idf USING (term)),
    hits AS (SELECT query_id, passage_id, round(sum(q_w.w * p_w.w), 6) AS score
      FROM q_w JOIN p_w USING (chunk, term) GROUP BY ALL),
    ranked AS (SELECT * FROM (SELECT query_id, passage_id, coalesce(score, 0.0) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, passage_id)
      AS rank FROM {queries} q CROSS JOIN {pool} p LEFT JOIN hits USING (query_id, passage_id))
      WHERE rank <= 10)"""


def _own_pool() -> str:
    """As ``_lexical``, with each of ``bq`` scored against its own 14 of ``near`` per shard."""
    base = _lexical("bq", "own_pool")
    return f"""own_pool AS (SELECT passage_id, text FROM passages WHERE passage_id IN
      (SELECT passage_id FROM near WHERE rank <= 14)),
    {base[:base.index("ranked AS")]}
    own AS (SELECT query_id, passage_id, coalesce(score, 0.0) AS score
      FROM (SELECT query_id, passage_id FROM near WHERE rank <= 14)
      LEFT JOIN hits USING (query_id, passage_id)),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, passage_id) AS rank FROM own) WHERE rank <= 10)"""


def _assembled(pool: str) -> str:
    return f"""contexts AS (SELECT query_id,
      string_agg({_nfkd('p.text')} || chr(10), '' ORDER BY rank) AS context
      FROM ranked JOIN {pool} p USING (passage_id) GROUP BY query_id)"""


_SQUARE = (
    "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
)


def _square(a: str, b: str) -> str:
    return "round(" + _SQUARE.format(a=a, b=b) + ", 6)"


def _unit(vector: str) -> str:
    norm = f"sqrt(list_sum(list_transform({vector}, lambda y: y * y)))"
    return (
        f"CASE WHEN {norm} = 0 THEN {vector} "
        f"ELSE list_transform({vector}, lambda x: x / {norm}) END"
    )


def _mean(name: str, source: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, list(x ORDER BY pos) AS v FROM (SELECT {key}, pos,
      avg(x) AS x FROM (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS pos
      FROM {source}) GROUP BY ALL) GROUP BY ALL)"""


VECTORS = f"""shard_vectors AS (SELECT (vec_id % 5)::INT AS shard, vec_id // 5 AS row_no,
      vec_id AS passage_id, label::BIGINT AS query_id, embedding::DOUBLE[] AS v FROM embeddings),
    {_mean('label_means', 'shard_vectors', 'query_id')},
    query_vectors AS (SELECT query_id, {_unit('v')} AS v FROM label_means)"""
_CELL = " + ".join(f"CASE WHEN v[{i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(6))
CELLS = VECTORS + f""",
    signed AS (SELECT *, ({_CELL})::INT AS cell FROM shard_vectors),
    {_mean('centroids', 'signed', 'cell')}"""


def _nearest(queries: str, passages: str, k: int = 15, name: str = "near") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT shard, query_id, passage_id, distance,
      row_number() OVER (PARTITION BY shard, query_id ORDER BY distance, passage_id) AS rank
      FROM (SELECT p.shard, q.query_id, p.passage_id, {_square('q.v', 'p.v')} AS distance
        FROM {queries} q CROSS JOIN {passages} p)) WHERE rank <= {k})"""


def _encoded(name: str, source: str, key: str, keys: str) -> str:
    """Hashed token counts of ``text`` as unit vectors of 64 components."""
    return f"""{name}_c AS (SELECT {key}, ('0x' || substr(md5(tok), 1, 2))::INT % 64 AS b,
      count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({_tokens('text')}) AS tok
      FROM {source}) GROUP BY ALL),
    {name}_g AS (SELECT {keys}, r.i FROM {source}, range(64) r(i)),
    {name}_m AS (SELECT {keys}, list(coalesce(n, 0.0::DOUBLE) ORDER BY i) AS v
      FROM {name}_g LEFT JOIN (SELECT {key}, b AS i, n FROM {name}_c) c USING ({key}, i)
      GROUP BY ALL),
    {name} AS (SELECT {keys}, {_unit('v')} AS v FROM {name}_m)"""


_UPPER = f"translate({{x}}, '{LOWER}', '{LOWER.upper()}')"


def _record(j: int, last: str) -> str:
    texts = [_segment(6 * j + p) for p in range(6)]
    answer = _UPPER.format(x=texts[j % 5 + 1]) if j % 2 else _q(K.OPTION_KEYS[j % 5])
    names = ("question", *K.OPTION_KEYS, last)
    return "{" + ", ".join(
        f"{_q(n)}: {v}" for n, v in zip(names, [*texts, answer], strict=True)
    ) + "}"


def _reply(records: int, last: str) -> str:
    return "to_json([" + ", ".join(_record(j, last) for j in range(records)) + "])::VARCHAR"


REPLIES = PAGES + f""",
    page_w AS (SELECT page_id, string_split_regex(wiki_text, '[ \\n]+') AS w,
      (len(string_split_regex(wiki_text, '[ \\n]+')) + 29) // 30 AS st FROM page_text),
    reply_t AS (SELECT page_id, {_reply(5, 'answer')} AS f, {_reply(4, 'answer')} AS s,
      {_reply(5, 'solution')} AS o FROM page_w),
    replies AS (SELECT page_id, attempt::INT AS attempt, CASE (page_id + attempt) % 4
      WHEN 0 THEN chr(10) || ' ' || f || ' ' || chr(10) WHEN 1 THEN substr(f, 1, length(f) // 2)
      WHEN 2 THEN s ELSE o END AS reply FROM reply_t, range(1, 4) r(attempt))"""
_KEYS = "[" + ", ".join(_q(k) for k in sorted(K.RECORD_KEYS)) + "]"
VALID = REPLIES + f""",
    parsed AS (SELECT page_id, attempt, CASE WHEN json_valid(reply)
      THEN json_extract(reply::JSON, '$[*]') END AS records FROM replies),
    checked AS (SELECT page_id, attempt, records, coalesce(len(records) = 5 AND
      len(list_filter(records, lambda r: list_sort(json_keys(r)) = {_KEYS})) = 5, false) AS valid
      FROM parsed),
    first_valid AS (SELECT page_id, min(attempt) FILTER (valid) AS attempt FROM checked GROUP BY 1)
    """
RECORDS = VALID + f""",
    listed AS (SELECT page_id, unnest(records) AS r, generate_subscripts(records, 1) - 1 AS pos
      FROM checked JOIN first_valid USING (page_id, attempt)),
    fields AS (SELECT page_id, pos, r ->> 'question' AS question,
      {', '.join(f"r ->> '{k}' AS {k}" for k in K.OPTION_KEYS)}, r ->> 'answer' AS raw_answer
      FROM listed),
    records AS (SELECT *, CASE WHEN raw_answer IN ({', '.join(_q(k) for k in K.OPTION_KEYS)})
      THEN raw_answer ELSE 'option_' || nullif(list_position([{', '.join(
          f"lower({k})" for k in K.OPTION_KEYS)}], lower(raw_answer)), 0) END AS answer FROM fields)
    """
_AP3 = """CASE WHEN answer = p1 THEN 1.0::DOUBLE WHEN answer = p2 THEN 0.5::DOUBLE
      WHEN answer = p3 THEN 1.0::DOUBLE / 3 ELSE 0.0::DOUBLE END"""
_ORDERED = """list_transform(list_reverse_sort([{s: s[1], l: 'A'}, {s: s[2], l: 'B'},
      {s: s[3], l: 'C'}, {s: s[4], l: 'D'}, {s: s[5], l: 'E'}]), lambda x: x.l)"""
TOP3 = SCORES + f""",
    best AS (SELECT id, s, label, {_ORDERED} AS o FROM option_scores)"""
EVALUATED = DOCS + ", " + TOP3 + f""",
    evaluated AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN {_AP3} END AS mAP FROM
      (SELECT id, prompt, answer, o[1] AS p1, o[2] AS p2, o[3] AS p3, {L5}
      FROM mcq_docs LEFT JOIN best USING (id)))"""
DEDUPED = RUNS + """,
    unique_runs AS (SELECT * FROM eval_runs QUALIFY row_number()
      OVER (PARTITION BY prompt ORDER BY row_no DESC) = 1)"""
FOLDS = RUNS + """,
    folds AS (SELECT row_no, coalesce(ascii(answer) % 4, 0) AS fold FROM eval_runs
      WHERE mAP >= 0.5),
    fold_sets AS (SELECT e.row_no, e.answer, e.mAP, g.fold::INT AS fold,
      CASE WHEN coalesce(f.fold = g.fold, false) THEN 'validation' ELSE 'train' END AS split
      FROM eval_runs e LEFT JOIN folds f USING (row_no), range(4) g(fold)
      WHERE e.mAP IS NOT NULL)"""


def _w(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def _hash(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"


_FIRST = "'[CLS] ' || context"
_SECOND = "' #### ' || prompt || ' [SEP] ' || option || ' [SEP]'"
_PAIRS = """pairs AS (SELECT id, c.i AS choice, {first} AS first, {second} AS second, label FROM
      (SELECT id, context, prompt, strpos('ABCDE', answer) - 1 AS label, {x} FROM {source}),
      LATERAL (SELECT unnest([A, B, C, D, E]) AS option, unnest([0, 1, 2, 3, 4]) AS i) c)"""


def _pairs(source: str) -> str:
    return _PAIRS.format(first=_FIRST, second=_SECOND, x=L5, source=source)


_WORDS = "list_filter(string_split_regex({x}, '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> '')"


def _truncated(budget: int) -> str:
    return f"""worded AS (SELECT id, choice, label, {_WORDS.format(x='first')} AS a,
      {_WORDS.format(x='second')} AS b FROM pairs),
    cut AS (SELECT id, choice, label,
      a[1:least(len(a), greatest({budget} - len(b), {(budget + 1) // 2}))] AS a,
      b[1:least(len(b), greatest({budget} - len(a), {budget // 2}))] AS b FROM worded)"""


def _message(expression: str) -> str:
    return (
        f"SELECT page_id, {_q('system')} AS role, {_q(K.GENERATION_REQUEST)} AS content "
        f"FROM {expression} UNION ALL SELECT page_id, 'user', '####' || wiki_text || '####' "
        f"FROM {expression}"
    )


def _prompt() -> str:
    parts = K.SCORING_PROMPT
    sql = _q(parts)
    for name, column in [("prompt", "prompt"), *[(x.lower(), x) for x in "ABCDE"]]:
        sql = sql.replace("{" + name + "}", f"' || coalesce({column}, 'None') || '")
    return sql


def oracle_sql() -> dict[str, str]:
    runs_columns = f"row_no, prompt, {L5}, answer, mAP"
    mcq_columns = f"id, prompt, {L5}, answer"
    lexical = ASKED + f""",
    bq AS (SELECT id AS query_id, {QUERY_TEXT} AS text FROM asked), {PASSAGES},
    {_lexical('bq', 'passages')}"""
    lexical_chunks = ASKED + f""",
    bq AS (SELECT id AS query_id, {QUERY_TEXT} AS text FROM asked), {PASSAGES},
    {_lexical('bq', 'passages', CHUNKED_QUERIES, CHUNKED_SAMPLE)}"""
    neighbours = ASKED + f""",
    {PASSAGES}, qt AS (SELECT id AS query_id, full_text AS text FROM asked),
    {_encoded('qv', 'qt', 'query_id', 'query_id')},
    {_encoded('pv', 'passages', 'passage_id', 'shard, passage_id')},
    {_nearest('qv', 'pv')}"""
    lexical_own = neighbours + f""",
    bq AS (SELECT id AS query_id, {QUERY_TEXT} AS text FROM asked), {_own_pool()}"""
    flagship_own = lexical_own + f""",
    {_assembled('own_pool')}"""
    flagship = neighbours + f""",
    pool AS (SELECT min(passage_id) AS passage_id, text FROM passages WHERE passage_id IN
      (SELECT passage_id FROM near WHERE rank <= 14) GROUP BY text),
    bq AS (SELECT id AS query_id, {QUERY_TEXT} AS text FROM asked),
    {_lexical('bq', 'pool')}, {_assembled('pool')}"""
    walked_pages = "WITH RECURSIVE " + EDGES + """,
            e AS (SELECT replace(parent, '_', ' ') AS parent, child,
              replace(child, '_', ' ') AS plain FROM category_edges
              WHERE replace(child, '_', ' ') <> 'Category:Nation 5'),
            walk AS (SELECT *, [node] AS path FROM (VALUES ('S', 'Category:Region 0', 0),
                ('T', 'Category:Region 1', 0), ('E', 'Category:Region 2', 0),
                ('M', 'Category:Region 3', 0), ('M', 'Category:Region 4', 0))
                v(stem_label, node, depth)
              UNION ALL
              SELECT w.stem_label, e.plain, w.depth + 1, list_append(w.path, e.plain)
              FROM walk w JOIN e ON e.parent = w.node
              WHERE starts_with(e.child, 'Category') AND NOT list_contains(w.path, e.plain))
            SELECT stem_label, e.child AS page, min(w.depth + 1)::INT AS depth
            FROM walk w JOIN e ON e.parent = w.node
            WHERE NOT starts_with(e.child, 'Category') GROUP BY ALL"""
    probed = CELLS + f""",
            celled AS (SELECT * EXCLUDE (rn) FROM (SELECT p.shard, p.passage_id, p.v, c.cell,
              row_number() OVER (PARTITION BY p.passage_id ORDER BY {_square('p.v', 'c.v')},
              c.cell) AS rn FROM shard_vectors p, centroids c) WHERE rn = 1),
            probes AS (SELECT query_id, v, cell FROM (SELECT q.query_id, q.v, c.cell,
              row_number() OVER (PARTITION BY q.query_id ORDER BY {_square('q.v', 'c.v')}, c.cell)
              AS rn FROM query_vectors q, centroids c) WHERE rn <= {K.NPROBE}),
            near AS (SELECT * FROM (SELECT shard, query_id, passage_id, distance, row_number()
              OVER (PARTITION BY shard, query_id ORDER BY distance, passage_id) AS rank
              FROM (SELECT p.shard, q.query_id, p.passage_id, {_square('q.v', 'p.v')} AS distance
              FROM probes q JOIN celled p USING (cell))) WHERE rank <= 15)"""
    sql = {
        "rag_context": _w(flagship, f"""SELECT id, prompt, coalesce(context, '') AS context,
            {L5}, answer FROM asked LEFT JOIN contexts ON query_id = id"""),
        "rag_context_own_pool": _w(flagship_own, f"""SELECT id, prompt,
            coalesce(context, '') AS context, {L5}, answer
            FROM asked LEFT JOIN contexts ON query_id = id"""),
        # sources and sinks
        "scan_parquet_exclude": """SELECT 'documents.parquet' AS source_file, text FROM documents
            UNION ALL SELECT 'conversations.parquet', text FROM conversations""",
        "csv_roundtrip": _w(DOCS, f"SELECT {mcq_columns} FROM mcq_docs"),
        "split_select": _w(RUNS, f"""SELECT {runs_columns} FROM eval_runs WHERE mAP = 0.5"""),
        "shard_id_from_path": """SELECT page_id, nullif(regexp_extract(url, '(\\d+)', 1), '')
            ::BIGINT AS shard FROM pages""",
        "rag_output": _w(BENCH, f"""SELECT prompt, text AS context, {L5}, answer
            FROM mcq_bench JOIN benchmark ON item_id = id"""),
        "scan_nested_exclude": "SELECT text FROM documents",
        "stored_shard": _w(PASSAGES, "SELECT shard, passage_id, text FROM passages WHERE shard = 3"),
        "page_lead_sentences": _w(PAGES, """SELECT page_id, array_to_string(regexp_extract_all(
            wiki_text, '[^.!?]+[.!?]*')[1:7], '') AS wiki_text FROM page_text"""),
        # projections and filters
        "fill_all": _w(DOCS, f"SELECT id, {_filled('prompt, ' + L5 + ', answer')} FROM mcq_docs"),
        "fill_options": _w(DOCS, f"SELECT id, prompt, {_filled(L5)}, answer FROM mcq_docs"),
        "filter_train_rows": _w(DOCS, f"""SELECT {mcq_columns} FROM mcq_docs
            WHERE prompt IS NOT NULL AND answer IS NOT NULL"""),
        "filter_eval_rows": _w(CONTEXT, f"""SELECT id, prompt, context, {L5}, answer
            FROM mcq_context WHERE (prompt || context || A || B || C || D || E || answer)
            IS NOT NULL"""),
        "dense_row_id": """SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1
            AS row_id FROM documents""",
        "answer_codes": _w(DOCS, """SELECT id, answer,
            CASE WHEN answer IS NOT NULL THEN (strpos('ABCDE', answer) - 1)::INT END AS label,
            answer AS letter, CASE WHEN id % 6 < 5 THEN substr('ABCDE', (id % 6 + 1)::INT, 1) END
            AS from_key FROM mcq_docs"""),
        "cap_rows": f"""SELECT doc_id, text FROM documents ORDER BY doc_id
            LIMIT {CAPPED_ROWS}""",
        "split_category_page": _w(EDGES, """SELECT parent, child,
            CASE WHEN NOT starts_with(child, 'Category') THEN 'page'
            WHEN replace(child, '_', ' ') = 'Category:Nation 5' THEN 'excluded'
            ELSE 'category' END AS kind FROM category_edges"""),
        # text
        "retrieval_text": _w(DOCS + f""",
            f AS (SELECT id, {_filled('prompt, ' + L5)} FROM mcq_docs)""",
            f"SELECT id, {FULL_TEXT} AS full_text FROM f"),
        "eval_prompt": _w(DOCS, f"SELECT id, {_prompt()} AS text FROM mcq_docs"),
        "gen_messages": _w(PAGES, _message("page_text")),
        "lexical_query": _w(DOCS + f""",
            f AS (SELECT id, {_filled('prompt, ' + L5)} FROM mcq_docs),
            asked AS (SELECT *, {FULL_TEXT} AS full_text FROM f)""",
            f"SELECT id, {QUERY_TEXT} AS query_text FROM asked"),
        "nfkd": f"SELECT doc_id, {_nfkd('text')} AS text FROM documents",
        "tokenise": f"""SELECT doc_id, len({_tokens('text')}) AS n_tokens,
            array_to_string({_kept('text')}, ' ') AS tokens FROM documents""",
        "ngrams": _w(f"k AS (SELECT {_kept('text')} AS tk FROM documents)",
            f"""SELECT term, count(*) AS n FROM (SELECT unnest({_terms('tk')}) AS term FROM k)
            GROUP BY term"""),
        "flatten_text_lists": """SELECT doc_id, replace(text, chr(10), ' ') AS lines, lang
            FROM documents""",
        "choice_pairs": _w(CONTEXT + f""",
            m AS (SELECT id, prompt, context, {_filled(L5)}, answer FROM mcq_context
              WHERE prompt IS NOT NULL AND answer IS NOT NULL), {_pairs('m')}""",
            "SELECT id, choice::INT AS choice, first, second, label::INT AS label FROM pairs"),
        "truncate_pairs": _w(CONTEXT + f""",
            m AS (SELECT id, prompt, context, {_filled(L5)}, answer FROM mcq_context
              WHERE prompt IS NOT NULL AND answer IS NOT NULL), {_pairs('m')},
            {_truncated(K.EVAL_TOKENS)}""",
            """SELECT id, choice::INT AS choice, array_to_string(a, ' ') AS first,
            array_to_string(b, ' ') AS second, label::INT AS label FROM cut"""),
        "pad_choices": _w(BENCH + f""",
            m AS (SELECT id, prompt, text AS context, {_filled(L5)}, answer
              FROM mcq_bench JOIN benchmark ON item_id = id), {_pairs('m')},
            {_truncated(K.TRAIN_TOKENS)},
            numbered AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 2 AS batch
              FROM (SELECT DISTINCT id FROM cut)),
            wide AS (SELECT batch, id, choice, label, list_concat(a, b) AS w, max(len(a) + len(b))
              OVER (PARTITION BY batch) AS width FROM cut JOIN numbered USING (id))""",
            """SELECT batch, id, choice::BIGINT AS choice, width::BIGINT AS width,
            array_to_string(list_concat(w, list_transform(range(width - len(w)),
              lambda x: '[PAD]')), ' ') AS words,
            repeat('1', len(w)) || repeat('0', width - len(w)) AS mask,
            label::INT AS label FROM wide"""),
        # joins
        "attach_context": _w(DOCS, f"""SELECT {mcq_columns}, coalesce(text, '') AS context
            FROM mcq_docs LEFT JOIN (SELECT doc_id, text FROM documents
            JOIN labels USING (doc_id)) ON doc_id = id"""),
        "unseen_pages": """SELECT page_id, url FROM pages WHERE page_id NOT IN
            (SELECT doc_id FROM labels)""",
        # dense retrieval
        "l2_normalise": f"""SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos,
            round(unnest(v), 6) AS x FROM (SELECT vec_id, {_unit('v')} AS v FROM
            (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e * (vec_id + 1)) AS v
            FROM embeddings))""",
        "dense_topk_per_shard": _w(VECTORS + f""",
            {_nearest('query_vectors', 'shard_vectors')}""",
            "SELECT shard, query_id, passage_id, distance, rank FROM near"),
        "ivf_topk": _w(probed, "SELECT shard, query_id, passage_id, distance, rank FROM near"),
        "ivf_stored_topk": _w(probed,
            "SELECT shard, query_id, passage_id, distance, rank FROM near"),
        "encoded_passages": _w(f"""numbered AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS passage_id, text
            FROM documents), {_encoded('pv', 'numbered', 'passage_id', 'passage_id')}""",
            """SELECT (passage_id // 300)::INT AS shard, passage_id % 300 AS row_no, passage_id,
            round(v[1], 6) AS v0, round(v[22], 6) AS v21, round(v[43], 6) AS v42, round(v[64], 6) AS v63 FROM pv"""),
        "cell_topk_exact": _w(VECTORS + f""",
            {_nearest('query_vectors', 'shard_vectors')}""",
            "SELECT shard, query_id, passage_id, distance, rank FROM near"),
        "cell_topk_passages": _w(PASSAGES + f""",
            asked AS (SELECT item_id AS query_id, text FROM benchmark),
            {_encoded('qv', 'asked', 'query_id', 'query_id')},
            {_encoded('pv', 'passages', 'passage_id', 'shard, passage_id')},
            {_nearest('qv', 'pv')}""",
            "SELECT shard, query_id, passage_id, distance, rank FROM near"),
        "aligned_texts": _w(VECTORS, """SELECT v.shard, v.row_no, v.passage_id, d.text
            FROM shard_vectors v JOIN documents d
            ON d.doc_id % 5 = v.shard AND d.doc_id // 5 = v.row_no"""),
        "candidate_pool": _w(VECTORS + f""",
            {_nearest('query_vectors', 'shard_vectors')}""",
            """SELECT min(doc_id) AS passage_id, text FROM documents WHERE doc_id IN
            (SELECT passage_id FROM near WHERE rank <= 14) GROUP BY text"""),
        "row_batches": """SELECT doc_id, row_id, row_id // 300 AS batch FROM (SELECT doc_id,
            row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)""",
        # lexical rerank
        "query_vocab": _w(lexical, "SELECT chunk, term FROM vocab"),
        "idf": _w(lexical, """SELECT chunk, term, df::BIGINT AS df, round(idf, 6) AS idf
            FROM idf"""),
        "term_counts": _w(lexical, "SELECT passage_id, term, tf FROM p_terms"),
        "tfidf_vectors": _w(lexical, """SELECT chunk, passage_id, term, round(w, 6) AS weight
            FROM p_w"""),
        "tfidf_scores": _w(lexical, """SELECT query_id, passage_id, coalesce(score, 0.0) AS score
            FROM bq CROSS JOIN passages LEFT JOIN hits USING (query_id, passage_id)"""),
        "lexical_top10": _w(lexical, "SELECT query_id, rank, score, passage_id FROM ranked"),
        "lexical_top10_index": _w(lexical, "SELECT query_id, rank, score, passage_id FROM ranked"),
        "lexical_top10_chunks": _w(lexical_chunks, "SELECT query_id, rank, score, passage_id FROM ranked"),
        "context_assembly": _w(lexical + ", " + _assembled("passages"),
            "SELECT query_id, context FROM contexts"),
        # metrics
        "top3_options": _w(TOP3, """SELECT id, o[1] AS first, o[2] AS second, o[3] AS third
            FROM best"""),
        "apk": _w(TOP3 + """,
            lists AS (SELECT id, [substr('ABCDE', label + 1, 1), o[5]] AS actual,
              [o[1], o[1], o[2], o[3]] AS predicted FROM best)""",
            """SELECT id, round((CASE WHEN list_contains(actual, predicted[1])
              THEN 1.0::DOUBLE ELSE 0 END
              + CASE WHEN list_contains(actual, predicted[3]) THEN
                (1 + list_contains(actual, predicted[1])::INT) / 3.0::DOUBLE ELSE 0 END
              + CASE WHEN list_contains(actual, predicted[4]) THEN
                (1 + list_contains(actual, predicted[1])::INT
                 + list_contains(actual, predicted[3])::INT) / 4.0::DOUBLE ELSE 0 END)
              / 2, 6) AS ap FROM lists"""),
        "map_mean": _w(EVALUATED, "SELECT round(avg(mAP), 6) AS map_at_3 FROM evaluated"),
        "precision_at_k": _w(TOP3 + """,
            hits AS (SELECT id, list_transform(o, lambda x: (x = substr('ABCDE', label + 1, 1))
              ::INT) AS r FROM best)""",
            """SELECT id, k, round(list_sum(r[1:k])::DOUBLE / k, 6) AS precision
            FROM hits, range(1, 6) g(k)"""),
        "map_at_3_strings": _w(TOP3, """SELECT round(avg(CASE WHEN t = o[1]
              THEN 1.0::DOUBLE + 2.0::DOUBLE / 3 WHEN t = o[2] THEN 0.5::DOUBLE ELSE 0.0 END), 6)
              AS map_at_3 FROM (SELECT *, substr('ABCDE', label + 1, 1) AS t FROM best)"""),
        "map_at_3_scores": _w(SCORES + """,
            placed AS (SELECT id, 1 + (SELECT count(*) FROM range(5) g(i)
              WHERE s[i + 1] > s[label + 1] OR (s[i + 1] = s[label + 1] AND i < label)) AS rank
              FROM option_scores)""",
            """SELECT round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE / rank ELSE 0 END), 6)
            AS map_at_3 FROM placed"""),
        "argmax_accuracy": _w(SCORES, """SELECT round(avg(CASE WHEN
            list_position(s, list_max(s)) = label + 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
            FROM option_scores"""),
        "map_distribution": _w(RUNS, """SELECT round(mAP, 6) AS mAP, count(*) AS n,
            round(count(*)::DOUBLE / (SELECT count(mAP) FROM eval_runs), 6) AS share
            FROM eval_runs WHERE mAP IS NOT NULL GROUP BY mAP"""),
        "fold_stats": _w(FOLDS, """SELECT fold, split, count(*) AS n,
            round(sum(mAP), 6) AS positive, round(count(*) - sum(mAP), 6) AS negative,
            round(100 * sum(mAP) / count(*), 6) AS positive_percent,
            round(100 - 100 * sum(mAP) / count(*), 6) AS negative_percent
            FROM fold_sets GROUP BY fold, split"""),
        "difficulty_bucket": _w(RUNS, """SELECT difficulty, count(*) AS n FROM (SELECT
            CASE WHEN mAP <= 0.6 THEN 'hard' WHEN mAP > 0.6 THEN 'simple' END AS difficulty
            FROM eval_runs) GROUP BY difficulty"""),
        "eval_table": _w(EVALUATED, f"""SELECT id, prompt, answer, p1 AS "prediction-1",
            p2 AS "prediction-2", p3 AS "prediction-3", round(mAP, 6) AS mAP, {L5}
            FROM evaluated"""),
        # splits
        "dedupe_keep_last": _w(DEDUPED, f"""SELECT row_no, prompt, {L5}, answer,
            round(mAP, 6) AS mAP FROM unique_runs"""),
        "class_codes": _w(RUNS, """SELECT round(mAP, 6) AS mAP, row_number() OVER
            (ORDER BY min(row_no)) - 1 AS code FROM eval_runs GROUP BY mAP"""),
        "seeded_sample": _w(RUNS, f"""SELECT row_no, answer FROM eval_runs
            ORDER BY {_hash(7, 'row_no')}, row_no LIMIT {K.VALIDATION_ROWS}"""),
        "train_val_split": _w(DEDUPED, """SELECT row_no, prompt, round(mAP, 6) AS mAP,
            CASE WHEN mAP = 1 THEN 'validation' ELSE 'train' END AS split FROM unique_runs"""),
        "split_csv": _w(DEDUPED, f"""SELECT row_no, prompt, {L5}, answer, round(mAP, 6) AS mAP,
            CASE WHEN mAP = 1 THEN 'validation' ELSE 'train' END AS split FROM unique_runs"""),
        "folds_csv": _w(FOLDS, """SELECT row_no, answer, round(mAP, 6) AS mAP, fold, split
            FROM fold_sets"""),
        "target_size_sample": _w(RUNS, f"""SELECT row_no, answer FROM eval_runs
            ORDER BY {_hash(11, 'row_no')}, row_no LIMIT 658"""),
        "bias_partition": _w(RUNS, """SELECT row_no, round(mAP, 6) AS mAP,
            CASE WHEN mAP >= 0.5 THEN 'bias' WHEN mAP < 0.5 THEN 'remainder' END AS part
            FROM eval_runs"""),
        "group_kfold": _w(RUNS + f""",
            bias AS (SELECT * FROM eval_runs WHERE mAP >= 0.5),
            classes AS (SELECT list(DISTINCT mAP ORDER BY mAP) AS cs FROM bias),
            groups AS (SELECT answer, list_transform(cs, lambda c: len(list_filter(ms, lambda m: m = c))) AS v,
              len(ms) AS size, {_hash(K.FOLD_SEED, 'answer')} AS key
              FROM (SELECT answer, list(mAP) AS ms FROM bias GROUP BY answer), classes),
            totals AS (SELECT list(t ORDER BY c) AS total FROM (SELECT c, sum(v[c]) AS t
              FROM groups, range(1, 1000) r(c) WHERE c <= len(v) GROUP BY c)),
            ordered AS (SELECT *, row_number() OVER (ORDER BY round(list_sum(list_transform(v,
              lambda x: (x - size / len(v)) ^ 2)), 6) DESC, size DESC, key NULLS FIRST) AS i FROM groups, totals),
            walk AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS answer, -1 AS fold,
                list_transform(range(4), lambda f: list_transform(total, lambda t: 0::BIGINT)) AS held FROM totals
              UNION ALL
              SELECT i, answer, best.f::INT, list_transform(range(4), lambda f: list_transform(range(len(v)),
                lambda c: held[f + 1][c + 1] + CASE WHEN f = best.f THEN v[c + 1] ELSE 0 END)) FROM (
                SELECT o.i, o.answer, v, held, list_min(list_transform(range(4), lambda f: {{
                  's': round(list_sum(list_transform(range(len(v)), lambda c: list_aggregate(list_transform(range(4),
                    lambda j: (held[j + 1][c + 1] + CASE WHEN j = f THEN v[c + 1] ELSE 0 END)::DOUBLE
                    / greatest(total[c + 1], 1)), 'var_pop'))), 12),
                  'n': list_sum(held[f + 1]), 'f': f}})) AS best
                FROM walk w JOIN ordered o ON o.i = w.i + 1))""",
            """SELECT row_no, b.answer, mAP, fold
            FROM bias b JOIN walk d ON d.i > 0 AND b.answer IS NOT DISTINCT FROM d.answer""",
            recursive=True),
        "fold_sets": _w(FOLDS, """SELECT row_no, answer, round(mAP, 6) AS mAP, fold, split
            FROM fold_sets"""),
        "weighted_sample": _w(PAGES + f""",
            sized AS (SELECT page_id, stem_label, count(*) OVER (PARTITION BY stem_label) AS n
              FROM page_text),
            keyed AS (SELECT page_id, stem_label, round(-ln((('0x' || substr(
              {_hash(3, 'page_id')}, 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE)
              / (CASE stem_label WHEN 'T' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END / n), 6)
              AS sample_key FROM sized)""",
            """SELECT page_id, stem_label, sample_key FROM keyed
            ORDER BY sample_key, page_id LIMIT 100"""),
        "top_n_articles": """SELECT doc_id, n_chars, text FROM documents
            ORDER BY n_chars DESC, doc_id LIMIT 100""",
        # generation
        "category_pages": walked_pages,
        "sampled_category_pages": f"""SELECT stem_label, page, depth, sample_key FROM (
            SELECT *, round(-ln((('0x' || substr({_hash(5, "stem_label || '|' || page")}, 1, 13))::BIGINT::DOUBLE + 1)
              / 4503599627370496.0::DOUBLE) / (CASE stem_label WHEN 'T' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END
              / count(*) OVER (PARTITION BY stem_label)), 6) AS sample_key FROM ({walked_pages}))
            ORDER BY sample_key, stem_label || '|' || page LIMIT 100""",
        "valid_mcq": _w(VALID, "SELECT page_id, attempt, valid FROM checked"),
        "first_valid_reply": _w(VALID, """SELECT f.page_id, f.attempt, count(*) FILTER
            (NOT valid AND (f.attempt IS NULL OR c.attempt < f.attempt)) AS failed_attempts
            FROM first_valid f JOIN checked c USING (page_id) GROUP BY ALL"""),
        "repair_answer": _w(RECORDS, """SELECT page_id, pos::INT AS pos, raw_answer, answer
            FROM records"""),
        "gen_compet_format": _w(RECORDS, """SELECT row_number() OVER (ORDER BY page_id, pos) - 1
            AS id, question AS prompt, option_1 AS A, option_2 AS B, option_3 AS C,
            option_4 AS D, option_5 AS E, CASE WHEN answer IS NOT NULL THEN
            substr('ABCDE', right(answer, 1)::INT, 1) END AS answer, wiki_text, page_id,
            page_title, stem_label FROM records JOIN page_text USING (page_id)"""),
        "questions_csv": _w(RECORDS + """, final AS (SELECT row_number() OVER
            (ORDER BY page_id, pos) - 1 AS id, question AS prompt, option_1 AS A, option_2 AS B,
            option_3 AS C, option_4 AS D, option_5 AS E, CASE WHEN answer IS NOT NULL THEN
            substr('ABCDE', right(answer, 1)::INT, 1) END AS answer, wiki_text, page_id,
            page_title, stem_label FROM records JOIN page_text USING (page_id))""",
            """SELECT *, 'raw' AS file FROM final UNION ALL
            SELECT * REPLACE (NULL::VARCHAR AS wiki_text, NULL::BIGINT AS page_id,
            NULL::VARCHAR AS page_title, NULL::VARCHAR AS stem_label), 'final' FROM final"""),
        # user functions
        "batch_scorer": _w(DOCS, "SELECT id, " + ", ".join(
            f"""('0x' || substr(md5('{x}' || coalesce({x}, '')), 1, 4))::INT / 65536.0::DOUBLE
            AS s_{x.lower()}""" for x in "ABCDE") + " FROM mcq_docs"),
    }
    return sql
