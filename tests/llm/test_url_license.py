import os
import random

import pytest

pytest.importorskip("swathline.llm")
from pyspark.sql import functions as F

from swathline.llm import license_scan, url_filter
from swathline.llm.license_texts import NOTICES
from swathline.llm.queries import URL_RULES


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", ""
    host = rest[: min(rest.find(c) if c in rest else len(rest) for c in "/?#")]
    path = rest[len(host) :]
    path = path[: min(path.find(c) if c in path else len(path) for c in "?#")]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def verdict(host, path):
    best = None
    for v, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = v, rule
    return (best[1], best[0]) if best else (None, "allow")


URLS = [None, "", "no scheme/en/", "http://a.example.com/en/7?x", "http://Example.COM/en/70", "http://xexample.com/en/7", "https://com/en/", "x://net/de/8", "http://example.net/de/8#f", "http://a.b.example.net/de/81",
        "http://w.net/de", "http://é.org/es/é", "http://org?/es/", "a://b://org/es/", "://org/es/1", "http://ÄÖ.Org/es/\nx", "http:///en/", "http://example.com.net/de/", "http://..com/en/", "http://u@example.com:80/en/7", "line\nhttp://example.org/es/"]


def test_urls(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(99)}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, urls[5], "", ""), (3, urls[3], "", "")], "page_id long, url string, host string, keys string")
    got = url_filter.judge_urls(df, URL_RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path = plain(urls[r.page_id if r.page_id is not None else 5])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == verdict(host, path), (host, path)
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("n", [1, 900, 20000])
def test_cascade_is_exact_on_its_universe(spark, n):
    keys = spark.range(60000).selectExpr("concat('k', id) AS key", "id")
    member = url_filter.cascade(keys, keys.filter(F.col("id") % (60000 // n) == 0).select("key"))
    got = keys.filter(member(F.col("key"))).select("id").collect()
    assert {r.id for r in got} == set(range(0, 60000, 60000 // n))


COMMON = "/usr/share/common-licenses"
FOREIGN = ["Данный документ Released under the MIT License. является частью", "本文 Released under the MIT License. 如下", "Est licencié: Licensed under CC BY-NC 4.0. Été", "Our own copyright 2024 Licensed under the MIT License.", "Copyright law of 2024 says so\n" + "x y " * 3 + NOTICES[0][1]]


def test_other_scripts_and_prose_are_no_licence(spark):
    df = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id long, text string")
    assert [r.license for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()] == [None] * len(FOREIGN)


def test_notices_in_their_usual_forms(spark):
    mit = NOTICES[0][1]
    flat = "Copyright (c) 2019-2021 Jane Doe and others. " + " ".join(mit.split())
    heads = ["Copyright (c) <year> <copyright holders>\n", "Copyright [yyyy] [name of copyright owner]\n", "# Copyright © 2020, A. B.\n", "(c) 1999 X\nAll rights reserved.\n"]
    rows = [flat, *[h + mit for h in heads], "Copyright 2020 X. Licensed under the MIT License.", "licence licence licensed under the MIT licence"]
    got = [r.license for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT"] * 6 + [None]
    canon = spark.createDataFrame([("licence licence LICENCE",)], "t string").select(license_scan.canonical(F.col("t"))).first()[0]
    assert canon == "license license license"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files")
def test_whole_licence_documents_are_found(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    text = {f: open(f"{COMMON}/{f}").read() for f in names}
    rows = [(n, t) for f, n in names.items() for t in (text[f], text[f].upper(), " ".join(text[f].replace(",", " ; ").split(" ")))] + [(None, t + " more") for t in text.values()] + [("MIT", n) for i, n in NOTICES if i == "MIT"]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = [r.license for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == [n for n, _ in rows]


def test_sql_of_the_scan_on_odd_texts(spark):
    """The comparison's SQL gives the same digests and licences where there are some to find."""
    import duckdb
    import pandas as pd

    from swathline.llm import queries

    texts = [t for _, t in NOTICES] + FOREIGN + ["", None, "Ünder LICENCE v2, v3 ver 4", "Copyright (c) 2019 A\r\nx", "a\tb\u00a0c"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.connect().register("documents", docs).sql(queries.oracle_sql()["op6_license_scan"]).fetchall()
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "canonical_sha256", "license").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.license is not None for r in got) == len(NOTICES)


def test_licenses(spark):
    mit = NOTICES[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2019 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub" + "licence")), (3, "MIT LICENCE\nCopyright 1999-2020 A B, all rights reserved\n" + mit.replace(",", " ;")), (4, mit + " extra"), (5, None), (6, ""), (7, "licensed under the apache licence, v2.0"), (8, "Copyright 2020 me"), (None, "Licensed under CC BY-NC 4.0."), (9, "word " * 9000), (1, mit)]
    df = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    got = license_scan.scan_licenses(df).collect()
    assert sorted((str(r.doc_id), r.license) for r in got if r.license) == [("1", "MIT"), ("1", "MIT"), ("2", "MIT"), ("3", "MIT"), ("7", "Apache-2.0"), ("None", "CC-BY-NC-4.0")]
    assert len(got) == len(rows)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
