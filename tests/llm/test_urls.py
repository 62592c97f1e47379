"""The URL filter: URLs of another writer, features against plain Python, labels as a table, ties and awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import url_filter as U

GOOD = """https://stack-overflow.com/questions/11227809/why-is-it-faster
www.new-york-times.com/x
https://en.wikipedia.org/wiki/Python_(programming_language)
https://www.nytimes.com/2024/05/12/world/europe/story-of-a-thing.html
https://docs.python.org/3/library/re.html
https://www.youtube.com/watch?v=dQw4w9WgXcQ
https://bbc.co.uk/news/world-12345678
https://therha.example.com/en/676
https://www.amazon.com/dp/B08N5WRWNW
https://github.com/numpy/numpy/issues/12345
https://www.cambridge.org/core/journals/article/abs/title
https://de.wikipedia.org/wiki/Berlin
http://www.gutenberg.org/files/1342/1342-h/1342-h.htm
https://www.lemonde.fr/politique/article/2023/01/19/titre-de-l-article_6158468_823448.html
https://openlibrary.org/works/OL45804W
https://www.who.int/news-room/fact-sheets/detail/measles""".split("\n")
BAD = """xvideos.com/video123/abc
http://192.168.3.4/a.php?id=33333
bit.ly/3xYzAbC
http://paypal.com.secure-login.verify-acct.tk/webscr?cmd=_login
http://best-casino-bonus.win/free
http://kjh3g4k2jh3g4.xyz/
http://hotsexcams.net/live/123
http://www.cheap-pills.example.com/en/450
http://tinyurl.com/y6abc12
http://45.77.12.9:8080/login.php?id=7
https://buy-viagra-online-cheap.top/
http://free-money-fast.click/win/bonus-12
http://adult-porn-tube.com/watch/9912
http://appleid-verify-account.ml/signin.php""".split("\n")


def test_urls_of_another_writer():
    f = U.default_filter()
    assert [u for u in GOOD if f.score([u])[0] >= 0.5] == [] and [u for u in BAD if f.score([u])[0] < 0.5] == []


def plain(url):
    """The features that need no statistics, one URL at a time."""
    url = url.lower()
    m = re.match(U._PARTS.replace("(?P<", "(?P<"), url, re.S)
    scheme, host, path, query = (m[k] or "" for k in ("scheme", "host", "path", "query"))
    found = re.search(r"([^.]+)\.[^.]*$", host)
    name = found[1] if found else ""

    def entropy(s):
        b = s.encode()
        return -sum(c / len(b) * math.log2(c / len(b)) for c in Counter(b).values()) if b else 0.0

    size = lambda s: len(s.encode())
    digits = len(re.findall("[0-9]", url))
    return [
        size(url), size(host), size(path), size(query), path.count("/"), digits / max(size(url), 1), entropy(url), entropy(host), len(re.findall("[^&]+", query)), host.count("-"), host.count("."), name.count("-"), size(name),
        len(re.findall("[0-9]", host)), max(map(len, re.findall("[0-9]+", url)), default=0), float(scheme == "https"), len(re.findall("[aeiou]", name)) / max(size(name), 1), url.count("%"), entropy(path), url.count("@"), len(re.findall(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", host)), len(re.findall("[0-9]", path)),
    ]


def test_features_equal_plain_python():
    urls = [*GOOD, *BAD, "", "?", "mailto:x", "é" * 300, "http://[::1]/", "HTTP://u@Host.Example.com:80/a/b?x=1&y#z", "a.b", "//h/p", "http://", "x?&&a=1&", "0" * 50, None]
    rows = [(u, k % 2) for k, u in enumerate(GOOD + BAD)]
    f = U.Filter(rows)
    array = pa.array(["skip", *urls], pa.string()).slice(1)  # an offset, as slices of batches have
    got = U.features(U.Parts(array), [(f.statistics, np.ones(len(urls), bool))])
    want = np.array([plain(u or "") for u in urls])
    assert np.allclose(got[:, : want.shape[1]], want) and np.isfinite(got).all()
    assert U.split("HTTP://u@Host.Example.com:80/a/b?x=1&y#z") == ("http", "host.example.com", "/a/b", "x=1&y")


def test_statistics_equal_plain_counts():
    rows = [(f"http://{'bad' if k % 3 == 0 else 'good'}{k % 5}.{['com', 'org'][k % 2]}/p{k % 4}.html", int(k % 3 == 0)) for k in range(60)]
    y = np.array([v for _, v in rows], float)
    parts = U.Parts(pa.array([u for u, _ in rows]))
    s = U.Statistics(parts, y, np.ones(60, bool))
    base = math.log((y.sum() + 1) / ((1 - y).sum() + 1))
    share = 1 / (1 + math.exp(-base))
    for value in ("com", "org"):
        own = [v for u, v in rows if u.split("/")[2].endswith(value)]
        p = (sum(own) + 4 * share) / (len(own) + 4)
        assert np.isclose(s.look(s.tables[0], pa.array([value]))[0], math.log(p / (1 - p)) - base)
    assert s.look(s.words, pa.array(["never"]))[0] == 0 and s.look(s.words, pa.array(["bad0"]))[0] > 0


def test_tied_splits_and_single_kinds():
    x = np.repeat(np.arange(40.0)[:, None], 2, 1)  # two equal features
    t = U.Trees().fit(x, (x[:, 0] >= 20).astype(float))
    assert t.trees[0][0][0] == 0 and ((t.score(x) >= 0.5) == (x[:, 0] >= 20)).all()
    assert U.Trees().fit(np.zeros((30, 1)), np.ones(30)).score(np.zeros((1, 1)))[0] > 0.9
    one = U.Filter([(u, 1) for u in BAD])
    assert np.ptp(one.score(BAD + GOOD)) < 1e-9


def test_labels_as_a_table(spark):
    rows = [(f"http://site{k}.{'aaa' if k % 2 else 'bbb'}/x", k % 2) for k in range(300)] + [(None, 1), ("", 1), ("u", None), ("v", 7)]
    labels = spark.createDataFrame(rows, "url string, label int").withColumn("score", F.lit("clash"))
    f = U.train(labels.repartition(3))
    assert np.allclose(f.score(["http://z.aaa/", "http://z.bbb/"]), U.train(labels.orderBy("url")).score(["http://z.aaa/", "http://z.bbb/"]))
    assert f.score(["http://z.aaa/"])[0] > 0.5 > f.score(["http://z.bbb/"])[0]
    assert np.isfinite(U.train(labels.where("false")).score(GOOD)).all()


def test_clashing_columns_and_nulls(spark):
    pages = spark.createDataFrame([(1, GOOD[0]), (1, GOOD[0]), (2, BAD[0]), (None, None), (3, "")], "page_id int, url string")
    for c in ("score", "blocked", "host", "label"):
        pages = pages.withColumn(c, F.lit("clash"))
    got = sorted((r.page_id or 0, r.blocked) for r in U.score_urls(pages).collect())
    assert got == [(0, False), (1, False), (1, False), (2, True), (3, False)]
    assert U.score_urls(pages.where("false")).columns == ["page_id", "url", "score", "blocked"]
