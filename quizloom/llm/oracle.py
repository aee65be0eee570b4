"""The same results in DuckDB SQL."""

from __future__ import annotations

from quizloom.llm.urls import SOFT_TERMS, STRICT_TERMS


def _hits(terms) -> str:
    each = (
        f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT" for term in terms
    )
    return "(" + " + ".join(each) + ")"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_URLS = f"""
WITH rest AS (
  SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS low,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, low, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
      WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    {_hits(STRICT_TERMS)} AS strict_hits, {_hits(SOFT_TERMS)} AS soft_hits
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits
FROM ruled
"""

# The digits of base 32 four at a time, from five hexadecimal digits of the digest.
_BASE32 = """
list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda d:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, g * 5 + 1, 5))::BIGINT
    >> (15 - 5 * d)::BIGINT) & 31)::INT + 1]), 'string_agg', '')), 'string_agg', '')
"""

_WARC = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS h FROM pages
), kept AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS keep FROM hashed)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = keep OR keep IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM kept
"""


_WORDS = (
    "regexp_extract_all(" + _LOWER.format("coalesce(text, '')")
    + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_CONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, w[i:i + 12] AS words FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(words) AS n FROM windows),
grams AS (
  SELECT row_no, i, n, w[i:i + n - 1] AS words FROM (
    SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (SELECT row_no, i, n, item FROM grams JOIN windows USING (words)),
words AS (SELECT row_no, count(DISTINCT p) AS n FROM (
    SELECT row_no, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row_no),
found AS (SELECT row_no, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (
    SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit,
  coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (row_no) LEFT JOIN found USING (row_no)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_KEYS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), "[aA][pP][iI]_?[kK][eE][yY]"])
# Kind, pattern, measured group, least length; a run of hexadecimal digits is measured at once.
_SECRETS = (
    ("assign", f"({_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+", 0, 1),
)


def _secret_matches() -> str:
    """All matches of each rule, with the lengths of what is measured."""
    return " UNION ALL ".join(
        f"""SELECT row_no, '{kind}' AS kind, {number} AS place, {least} AS least,
        regexp_extract_all(body, '{pattern}') AS found,
        list_transform(regexp_extract_all(body, '{pattern}', {group}), lambda g: length(g)) AS sizes
        FROM docs"""
        for number, (kind, pattern, group, least) in enumerate(_SECRETS)
    )


# A match is where its text comes first behind the match before it.
_SECRET_SCAN = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents
), matches AS ({_secret_matches()}),
walk AS (
  SELECT row_no, kind, place, 0 AS i, 0::BIGINT AS first, 0::BIGINT AS last FROM matches WHERE len(found) > 0
  UNION ALL
  SELECT row_no, kind, place, i + 1,
    last + instr(substr(body, last + 1), found[i + 1]) - 1,
    last + instr(substr(body, last + 1), found[i + 1]) - 1 + length(found[i + 1])
  FROM walk JOIN matches USING (row_no, kind, place) JOIN docs USING (row_no) WHERE i < len(found)
), spans AS (
  SELECT row_no, kind, place, first, kind || ':' || first || ':' || last AS span
  FROM walk JOIN matches USING (row_no, kind, place) WHERE i > 0 AND sizes[i] >= least
), listed AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY first, place) AS spans,
    string_agg(span, ',' ORDER BY first, place) FILTER (place < 3) AS base
  FROM spans GROUP BY row_no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_no)
"""


_INFILL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), numbered AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered
), pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:n], '') AS s FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM pieces
"""

# Every order walked for itself, filter by filter.
_AUDIT = r"""
WITH RECURSIVE marked AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
  FROM docs LEFT JOIN marked USING (doc_id)
), counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing GROUP BY ALL
), orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o, k, o[k] AS f, o[1:k - 1] AS before FROM orders, range(1, 6) r(k) WHERE length(o) = 5
), walked AS (
  SELECT part, o, k, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS alone,
    before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone
  FROM counts, steps
), summed AS (
  SELECT part, o, k, f, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY part, o, k, f
)
SELECT part, o AS filter_order, k::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM summed
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": _CONTAMINATION,
        "op4_warc_bundles": _WARC,
        "op6_secret_scan": _SECRET_SCAN,
        "op7_url_filter": _URLS,
        "op12_fill_in_middle": _INFILL,
        "op13_filter_audit": _AUDIT,
    }
