import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import folder, lower_ascii
from pyspark.sql import functions as F

from tripmesh.llm import op13_url_filter as op
from tripmesh.llm.common import plain

PAGE = "page_id long, url string, html string"


def split(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return lower_ascii(host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def ruled(host, path):
    fits = [r for r in op.RULES if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme/at all", "http://", "https://NET/", "http://a.net", "http://a.net?x=/", "http://a.net/#/", "HTTP://WWW.Example.NET/en/1",
    "http://example.net/EN/1", "http://xexample.net/en/", "http://example.com/de/1?u=http://b.net/", "http://m.example.com/de", "ftp://b.org/fr/\nnext",
    "http://b.org/fr", "https://É.ORG/fr/é", "a?b://c.net/d", "x" * 50_000 + "://h.net/" + "p" * 50_000, "http://b.org/x/://c.net/", "://net/", "http://a.net:80/",
]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls)], PAGE)


def test_hosts_paths_and_rules_against_brute_force(spark, tmp_path):
    df = pages(spark, URLS + URLS).selectExpr("*", "1 AS host", "2 AS features", "3 AS verdict", "4 AS prediction", "5 AS fold")
    got = op.query(spark, folder(tmp_path, pages=df))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = sorted(got.collect())
    assert [r.page_id for r in rows] == list(range(2 * len(URLS)))
    for r, url in zip(rows, URLS + URLS):
        rule = ruled(*split(url))
        assert (r.host, r.path) == split(url) and r.rule == (rule and rule.text), url
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert [r.verdict for r in rows[: len(URLS)]] == [r.verdict for r in rows[len(URLS) :]]
    wide = plain(op.judged(df, op.Constant("allow")))
    assert wide.columns == df.columns


def test_features_against_python(spark):
    urls = [u for u in URLS if u and len(u) < 100] + ["https://a-b.c9.org/x1/y%20z.html?p=1&q=2;r=3&&#f", "http://h/" + "é😀" * 5]
    rows = op.with_rules(pages(spark, urls)).select("url", "host", "path", *[c.cast("double").alias(f"f_{n}") for n, c in op.lexical().items()]).collect()
    for r in rows:
        n = Counter(r.path)
        assert r.f_path_entropy == pytest.approx(-sum(c / len(r.path) * math.log2(c / len(r.path)) for c in n.values()) if n else 0)
        assert r.f_depth == len([p for p in r.path.split("/") if p]) and r.f_url_length == len(r.url)
        assert r.f_digit_ratio == pytest.approx(len(re.findall("[0-9]", r.url)) / len(r.url))
    last = next(r for r in rows if "a-b" in r.url)
    assert (last.f_parameters, last.f_hyphens, last.f_escapes, last.f_fragment, last.f_extension, last.f_host_parts) == (3, 1, 1, 1, 1, 3)


def lexical_urls(n, seed):
    """Blocked ones have many digits and parameters, whatever their host."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        bad = r.random() < 0.4
        host = f"{r.choice(['www', 'blog', 'm'])}.{''.join(r.choices('abcdefgh', k=6))}.{r.choice(['com', 'org', 'info'])}"
        letters = "0123456789x" if bad else "abcdefghij0"
        path = "/".join("".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(r.randint(1, 3)))
        tail = "?" + "&".join(f"p{k}={r.randint(0, 9999)}" for k in range(r.randint(1, 5))) if r.random() < (0.8 if bad else 0.2) else ""
        out.append((f"http://{host}/{path}{tail}", int(bad)))
    return out


def test_held_out_urls(spark):
    known, held = lexical_urls(1500, 1), lexical_urls(600, 2)
    model = op.fit(spark.createDataFrame(known, "url string, blocked int"))
    got = plain(op.judged(pages(spark, [u for u, _ in held]), model, rules=()), "verdict", "by").collect()
    assert {r.by for r in got} == {"trees"}
    assert np.mean([(r.verdict == "block") == bool(held[r.page_id][1]) for r in got]) > 0.93


def test_suffix_statistics_leave_out_the_own_fold(spark):
    rows = [(f"http://h{k}.{'bad' if k % 3 == 0 else 'good'}/p{k}", int(k % 3 == 0)) for k in range(300)]
    labelled = spark.createDataFrame(rows, "url string, blocked int").withColumns({"host": op.host_of(F.col("url")), "fold": op.fold()})
    bad = labelled.where("host LIKE '%.bad'").withColumn("at", op.bucket(1))
    odds = {(r.bucket, r.fold): r.odds for r in op.suffix_odds(labelled).collect()}
    at, sizes = bad.first()["at"], Counter(r.fold for r in bad.collect())
    for k in range(op.FOLDS):
        assert odds[at, k] == pytest.approx(math.log((100 - sizes[k] + 2) / 2))
    assert odds[at, op.ALL] == pytest.approx(math.log(102 / 2))


def test_defined_cases(spark):
    none = spark.createDataFrame([], "url string, blocked int")
    assert op.fit(none) == op.Constant("allow")
    assert op.fit(spark.createDataFrame([("http://a/", 1), (None, 0), ("b", None)], "url string, blocked int")) == op.Constant("block")
    model = op.fit(spark.createDataFrame([("http://a.com/1", 1), ("http://b.com/x", 0)] * 3, "url string, blocked int"))
    assert op.judged(pages(spark, []), model).count() == 0
    assert op.fit(spark.createDataFrame(lexical_urls(400, 3), "url string, blocked int"), max_labels=100).trees.numFeatures == len(op.lexical()) + 2
