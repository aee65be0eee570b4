import re

from pyspark.sql import functions as F

from quizloom.llm import queries, urls

URLS = [
    None, "", "no scheme/porn", "http://Sub.Example.NET/en/x?q#f", "http://example.net/fr/", "http://a.net",
    "http://x.org/fr/page", "http://x.org/fr", "http://www.example.com/de/1", "http://notexample.com/de/1?free",
    "http://free-bets.example.com/", "http://spam.example.com", "http://spammer.example.com", "http://c.com/win?win=win",
    "http://c.com/win?x=bonus", "http://ÄB.COM/Ä?://x", "://", "a://b://c/d", "http://h#frag/porn", "HTTP://C.com/CASINO",
    "http://net/", "http://org/fr/", "http://xorg/fr/", "http://c.com/" + "a" * 50_000 + "-xxx", "http://c.com/\n/porn",
]


def brute(url):
    text = "".join(c.lower() if c.isascii() else c for c in url or "")
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in queries.SITE_RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path) and host]
    rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
    found = {t for t in (*urls.STRICT_TERMS, *urls.SOFT_TERMS) if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)}
    strict = len(found & set(urls.STRICT_TERMS))
    soft = len(found) - strict
    verdict = rule.verdict if rule else ("block" if strict or soft > 1 else "allow")
    return host, path, rule.host + rule.path if rule else None, verdict, strict, soft


def test_rows_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rows = urls.judge_urls(df, "url", queries.SITE_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict, r.strict_hits, r.soft_hits) == brute(r.url), r.url
    assert urls.judge_urls(df.limit(0), "url", queries.SITE_RULES).count() == 0


def test_other_vocabularies(spark):
    df = spark.createDataFrame([("http://x/one-two",), ("http://x/one",)], "url string").withColumn("host", F.lit(1))
    three = urls.Vocabulary(strict=(), soft=("one", "two"), reject_weight=2)
    assert [r.verdict for r in urls.judge_urls(df, "url", (), three).collect()] == ["block", "allow"]
    none = urls.Vocabulary(strict=(), soft=())
    assert {r.verdict for r in urls.judge_urls(df, "url", (), none).collect()} == {"allow"}
