"""URL filter: gradient-boosted trees on lexical features.

Features: lengths, depth, digit ratio, entropy, parameter counts, hyphens and labels of
the host, address hosts, and statistics of the labelled URLs: the smoothed log-odds of
unwanted ones by the host's last label and its last two, by file ending, by the words of the
URL and by the host's four-letter runs. In training these come from the other folds, so that
the trees learn what the statistics are worth on unseen URLs. The trees are histogram trees on
the logistic loss. All features are computed a batch at a time by Arrow and numpy.

The labelled table is the caller's (a DataFrame of url and label, of which a sample of at
most SAMPLE rows, chosen by hash, is used) or ``labelled_urls``, which is made from word lists
and a fixed seed as no given table labels URLs: spam shops, adult sites, phishing, address
hosts, random hosts, short links and affiliate links against shops, news, encyclopaedias,
code, documents, and sites with hyphens, digits and parameters that are harmless.

Defined results: a null or empty URL has score 0 and isn't blocked; a URL without scheme
is read as host and path; repeated rows are scored each; of equal splits the first
feature and lowest value is taken; labels are 0 or 1, others and nulls are ignored; with
labels of one kind only every URL has the same score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read
from .text import buffers, chunks

TREES = 80
DEPTH = 4
RATE = 0.15
BINS = 64
LEAST = 8
FOLDS = 5
#: Labelled rows that are used at most.
SAMPLE = 200_000
_GRAMS = 1 << 16
_PARTS = r"^(?:(?P<scheme>[a-z][a-z0-9+.-]*)://|//)?(?:[^/?#@]*@)?(?P<host>[^/?#:]*)(?::[0-9]*)?(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?"

_UNWANTED = "cheap pills casino free win bonus spam farm loan replica watches deals poker bet crypto seo links buy viagra money fast best jackpot slots betting dating cash payday cialis meds pharmacy discount outlet prize winner lottery forex earn rich hacks cracked warez torrent keygen ads track popup traffic".split()
_ADULT = "xxx porn sex sexy cam cams nude adult hot tube video videos milf babes escort fetish erotic hentai live x xx girls".split()
_LURE = "login secure account verify update signin banking support confirm service wallet security webscr paypal amazon apple office billing".split()
_PLAIN = "stack overflow new york times world daily post guardian science nature health travel food garden house music film book school open data free source code park city river mountain green blue red small great union national public library museum university press journal review history art sport team club weather market economy energy water light space earth road bridge work life home family north south east west research college hospital church company group studio design design lab works media best buy video games live online store shop".split()


def labelled_urls(n: int = 8000, seed: int = 7) -> list[tuple[str, int]]:
    """A labelled table of URLs, 1 for unwanted, made from word lists and a fixed seed."""
    r = np.random.RandomState(seed)
    pick = lambda *x: x[r.randint(len(x))]
    of = lambda words, least, most, by="-": by.join(pick(*words) for _ in range(r.randint(least, most + 1)))
    part = lambda: "".join(pick("th", "er", "an", "on", "re", "in", "ti", "ou", "st", "ha", "le", "mo", "ka", "sh", "ble", "ly", "en", "ing", "ed", "es", "nt", "nd", "wh", "ar", "al", "ic", "um", "ver", "ter", "ion", "tion") for _ in range(r.randint(2, 5)))
    noise = lambda k, letters="abcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(list(letters), k))
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    number = lambda a, b: str(r.randint(a, b))
    tld = lambda: pick("com", "com", "com", "org", "net", "de", "fr", "es", "co.uk", "io", "info", "eu", "example.com", "example.org", "example.net")
    odd = lambda: pick("xyz", "top", "click", "tk", "ml", "ru", "cn", "biz", "info", "com", "net", "example.com", "example.org", "example.net")
    front = lambda: pick("", "", "www.", "www.", "m.", "blog.", "shop.", "en.", "de.")
    scheme = lambda: pick("http://", "https://", "https://", "https://", "")
    page = lambda: f"/{pick('en', 'de', 'es', 'fr', 'blog', 'news')}/{number(1, 10 ** pick(2, 3, 4, 5))}" + pick("", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed")

    def unwanted() -> str:
        kind = r.randint(0, 9)
        if kind < 3:
            host = front() + of(_UNWANTED, 2, 4) + pick("", "", number(1, 999)) + "." + odd()
            return scheme() + host + pick(page(), page(), f"/{pick(*_UNWANTED)}/{pick(*_UNWANTED)}-{number(1, 99999)}", "")
        if kind == 3:
            host = front() + of(_ADULT, 2, 3, pick("", "", "-")) + pick("", "", number(1, 99)) + "." + pick(odd(), "com", "com", "net", "tv")
            return scheme() + host + pick("", f"/video{number(1, 99999)}/{part()}", f"/{pick(*_ADULT)}/{part()}-{part()}", f"/watch/{number(1, 999999)}")
        if kind == 4:
            host = ".".join(str(x) for x in r.randint(1, 255, 4)) + pick("", "", ":8080")
            return pick("http://", "http://", "") + host + pick("/", f"/{pick('a', 'x', 'index', 'login', 'get')}.php?id={number(1, 10**6)}", f"/{noise(6)}/{noise(4)}.exe", f"/{pick(*_LURE)}/{noise(8)}", "/")
        if kind == 5:
            host = pick("bit.ly", "tinyurl.com", "goo.gl", "t.co", "is.gd", "ow.ly", "cutt.ly", noise(2, "abcdefghijklmnopqrstuvwxyz") + "." + pick("ly", "gd", "co", "gl"))
            return scheme() + host + "/" + noise(r.randint(5, 9), mixed)
        if kind == 6:
            host = of(_LURE, 1, 4, pick("-", "-", ".")) + pick(".", "-") + noise(r.randint(3, 9)) + "." + odd()
            return scheme() + host + pick("/", f"/{of(_LURE, 1, 2, '/')}.php", f"/{noise(20)}/{pick(*_LURE)}?{pick(*_LURE)}={noise(24)}")
        if kind == 7:
            return scheme() + front() + noise(r.randint(8, 18), "bcdfghjklmnpqrstvwxyz0123456789") + "." + odd() + pick("/", "", f"/{noise(12)}", f"/{noise(5)}.php")
        return scheme() + front() + part() + "." + odd() + f"/{pick('go', 'click', 'out', 'track', 'r')}.php?id={number(1, 10**9)}&aff={number(1, 10**6)}&t={pick(*_UNWANTED)}" + pick("", f"&sub={noise(8)}")

    def wanted() -> str:
        kind = r.randint(0, 10)
        host = front() + pick(part(), part(), of(_PLAIN, 1, 1), of(_PLAIN, 2, 3), of(_PLAIN, 2, 3, "")) + "." + tld()
        if kind < 3:
            host = front() + (part() if r.rand() < 0.9 else part() + "-" + part()) + "." + tld()
            return scheme() + host + page()
        if r.rand() < 0.05:  # the sites that lures name
            host = pick("www.", "", "login.", "support.") + pick("paypal", "amazon", "apple", "microsoft", "google", "office") + "." + pick("com", "com", "de", "co.uk")
        if kind == 3:
            return scheme() + host + f"/20{number(10, 25)}/{number(1, 13)}/{number(1, 29)}/{of(_PLAIN, 3, 8)}" + pick("", ".html", "/")
        if kind == 4:
            return scheme() + host + f"/wiki/{of(_PLAIN, 1, 3, '_').title()}" + pick("", "#history", f"?oldid={number(10**6, 10**9)}")
        if kind == 5:
            return scheme() + pick("github.com", "gitlab.com", host) + f"/{part()}/{part()}" + pick("", f"/blob/main/src/{part()}.py", f"/issues/{number(1, 9999)}", f"/commit/{noise(40, '0123456789abcdef')}")
        if kind == 6:
            return scheme() + pick("www." + part() + ".edu", part() + ".ac.uk", "www." + part() + ".gov", host) + f"/~{part()}/papers/{part()}{number(1990, 2025)}.pdf"
        if kind == 7:
            return scheme() + host + f"/{pick('product', 'p', 'item', 'questions', 'articles', 'dp')}/{number(1000, 10**8)}" + pick("", f"/{of(_PLAIN, 2, 6)}", f"?color={pick('red', 'blue')}&size={number(1, 50)}")
        if kind == 8:
            return scheme() + host + pick(f"/search?q={of(_PLAIN, 1, 4, '+')}", f"/watch?v={noise(11, mixed)}", f"/static/{noise(8, '0123456789abcdef')}.{pick('css', 'js', 'png')}", f"/docs/v{number(1, 9)}.{number(0, 20)}/index.html", f"/list?page={number(1, 90)}&sort=asc", f"/files/{number(1, 10**5)}/{number(1, 10**5)}-h.htm", f"/{pick(*_PLAIN)}/{number(1, 10**6)}/{number(1, 999)}", f"/works/OL{number(1, 10**6)}W")
        return scheme() + host + pick("", "/", "/about", "/contact.html", f"/{of(_PLAIN, 1, 2, '/')}/", "/index.php", f"/{of(_PLAIN, 1, 1)}.html")

    return [(unwanted(), 1) if r.rand() < 0.45 else (wanted(), 0) for _ in range(n)]


def split(url: str) -> tuple[str, str, str, str]:
    """Scheme, host (without user and port), path and query."""
    p = pc.extract_regex(pc.utf8_lower(pa.array([url])), _PARTS)[0].as_py() or {}
    return tuple(p.get(k) or "" for k in ("scheme", "host", "path", "query"))


def _group(column: pa.Array, pattern: str) -> pa.Array:
    """The group ``x`` of the pattern; empty where it doesn't match."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(column, pattern), "x"), "")


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest, least and mean of the values of each row; 0 for a row without."""
    top, low = np.zeros(n), np.zeros(n)
    if len(values):
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        top[row[begin]], low[row[begin]] = np.maximum.reduceat(values, begin), np.minimum.reduceat(values, begin)
    return top, low, np.bincount(row, values, n) / np.maximum(np.bincount(row, minlength=n), 1)


def _entropy(column: pa.Array) -> np.ndarray:
    offsets, data = buffers(column)
    data = data[offsets[0] : offsets[-1]]
    n, row = len(column), _rows(offsets)
    key, count = np.unique(row * 256 + data, return_counts=True)
    p = count / np.maximum(np.diff(offsets), 1)[key // 256]
    return -np.bincount(key // 256, p * np.log2(p), n)


def _longest_digits(column: pa.Array) -> np.ndarray:
    offsets, data = buffers(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    digit = (data >= 48) & (data <= 57)
    row = _rows(offsets)
    new = np.ones(len(data), bool)
    new[1:] = (digit[1:] != digit[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(data)))
    keep = digit[begin]
    return _per_row(size[keep], row[begin][keep], len(column))[0]


class Parts:
    """A batch of URLs, cut into what the features need."""

    def __init__(self, urls: pa.Array):
        self.url = pc.utf8_lower(pc.fill_null(urls, ""))
        found = pc.extract_regex(self.url, _PARTS)
        self.scheme, self.host, self.path, self.query = (pc.fill_null(pc.struct_field(found, k), "") for k in ("scheme", "host", "path", "query"))
        self.keys = [_group(self.host, r"(?:^|\.)(?P<x>[^.]*)$"), _group(self.host, r"(?:^|\.)(?P<x>[^.]*\.[^.]*)$"), _group(self.path, r"\.(?P<x>[^./]*)$")]
        words = pc.split_pattern_regex(self.url, "[^a-z0-9]+")
        self.words, self.word_row = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
        offsets, data = buffers(self.host)
        data, offsets = data[offsets[0] : offsets[-1]].astype(np.uint32), offsets - offsets[0]
        row = _rows(offsets)
        m = max(len(data) - 3, 0)
        inside = row[:m] == row[3 : m + 3]
        grams = (data[:m] | (data[1 : m + 1] << 8) | (data[2 : m + 2] << 16) | (data[3 : m + 3] << 24)) * np.uint32(0x9E3779B1) >> np.uint32(16)
        self.grams, self.gram_row = grams[inside].astype(np.int64), row[:m][inside]

    def __len__(self) -> int:
        return len(self.url)


class Statistics:
    """Smoothed log-odds of unwanted URLs, by host suffix, ending, word and four-letter run."""

    def __init__(self, parts: Parts, y: np.ndarray, use: np.ndarray):
        self.base = np.log((y[use].sum() + 1) / ((1 - y[use]).sum() + 1))
        self.tables = [self._table(k, np.arange(len(parts)), y, use) for k in parts.keys]
        self.words = self._table(parts.words, parts.word_row, y, use)
        keep = use[parts.gram_row]
        bad, n = (np.bincount(parts.grams[keep], w, _GRAMS) for w in (y[parts.gram_row[keep]], None))
        self.grams = np.where(n > 0, self._odds(bad, n, 20.0), 0.0)

    def _odds(self, bad: np.ndarray, n: np.ndarray, strength: float = 4.0) -> np.ndarray:
        share = 1 / (1 + np.exp(-self.base))
        p = (bad + strength * share) / (n + strength)
        return np.log(p / (1 - p)) - self.base

    def _table(self, values: pa.Array, row: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        keep = use[row]
        coded = values.filter(pa.array(keep)).dictionary_encode()
        code = coded.indices.to_numpy()
        bad, n = (np.bincount(code, w, len(coded.dictionary)) for w in (y[row[keep]], None))
        return coded.dictionary, self._odds(bad, n)

    @staticmethod
    def look(table: tuple[pa.Array, np.ndarray], values: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(values, value_set=table[0]), -1).to_numpy()
        return np.append(table[1], 0.0)[at]

    def columns(self, parts: Parts) -> list[np.ndarray]:
        n = len(parts)
        word = _per_row(self.look(self.words, parts.words), parts.word_row, n)
        gram = _per_row(self.grams[parts.grams], parts.gram_row, n)
        return [*(self.look(t, k) for t, k in zip(self.tables, parts.keys)), *word, *gram]


def features(parts: Parts, statistics: list[tuple[Statistics, np.ndarray]]) -> np.ndarray:
    """(URLs, features). ``statistics``: each with the rows it serves."""
    size = lambda c: pc.binary_length(c).to_numpy().astype(float)
    count = lambda c, p: pc.count_substring_regex(c, p).to_numpy().astype(float)
    n = np.maximum(size(parts.url), 1)
    name = _group(parts.host, r"(?P<x>[^.]+)\.[^.]*$")
    flat = [
        size(parts.url), size(parts.host), size(parts.path), size(parts.query), count(parts.path, "/"), count(parts.url, "[0-9]") / n, _entropy(parts.url), _entropy(parts.host), count(parts.query, "[^&]+"), count(parts.host, "-"), count(parts.host, r"\."), count(name, "-"), size(name),
        count(parts.host, "[0-9]"), _longest_digits(parts.url), pc.equal(parts.scheme, "https").to_numpy(False).astype(float), count(name, "[aeiou]") / np.maximum(size(name), 1), count(parts.url, "%"), _entropy(parts.path), count(parts.url, "@"), count(parts.host, r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), count(parts.path, "[0-9]"),
    ]
    learned = np.zeros((len(statistics[0][0].columns(parts)), len(parts)))
    for own, rows in statistics:
        learned[:, rows] = np.stack(own.columns(parts))[:, rows]
    return np.stack([*flat, *learned], 1)


class Trees:
    """Boosted histogram trees of one depth; nodes are stored breadth first."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    key = node * BINS + b[:, j]
                    G, H, N = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None))
                    left, right = (G, H, N), (G[:, -1:] - G, H[:, -1:] - H, N[:, -1:] - N)
                    gain = sum(a**2 / (c + 1) for a, c, _ in (left, right)) - G[:, -1:] ** 2 / (H[:, -1:] + 1)
                    gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first : first + width][better] = j
                    cut[first : first + width][better] = at[better]
                here = first + node
                node = node * 2 + (b[np.arange(len(y)), feature[here]] > cut[here])
            G, H = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
            leaf = RATE * G / (H + 1)
            f += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        f, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                here = 2**level - 1 + node
                node = node * 2 + (b[row, feature[here]] > cut[here])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


class Filter:
    def __init__(self, rows: list[tuple[str, int]]):
        rows = sorted(set(rows))  # the order of the rows is of no account
        y = np.array([label for _, label in rows], float)
        parts = Parts(pa.array([url for url, _ in rows], pa.string()))
        fold = np.random.RandomState(3).permutation(len(rows)) % FOLDS
        self.statistics = Statistics(parts, y, np.ones(len(y), bool))
        held = [(Statistics(parts, y, fold != k), fold == k) for k in range(FOLDS)] if len(y) > FOLDS else [(self.statistics, np.ones(len(y), bool))]
        self.trees = Trees().fit(features(parts, held), y)

    def score(self, urls: pa.Array | list[str]) -> np.ndarray:
        urls = urls if isinstance(urls, pa.Array) else pa.array(urls, pa.string())
        if not len(urls):
            return np.zeros(0)
        return self.trees.score(features(Parts(urls), [(self.statistics, np.ones(len(urls), bool))]))


@lru_cache(1)
def default_filter() -> Filter:
    return Filter(labelled_urls())


def train(labels: DataFrame, sample: int = SAMPLE) -> Filter:
    """A filter from labelled URLs (url, label 0 or 1), of which at most ``sample`` are used."""
    rows = labels.where("url IS NOT NULL AND url <> '' AND label IN (0, 1)").select("url", F.col("label").cast("int").alias("label")).distinct()
    rows = rows.orderBy(F.xxhash64("url", "label"), "url", "label").limit(sample).collect()
    return Filter([(r["url"], r["label"]) for r in rows]) if rows else Filter([("", 0)])


def score_urls(pages: DataFrame, model: Filter | None = None, limit: float = 0.5) -> DataFrame:
    """(page_id, url, score, blocked) for every page."""
    model = pages.sparkSession.sparkContext.broadcast(model or default_filter())  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "url"):
            urls = batch.column("url")
            some = pc.greater(pc.fill_null(pc.binary_length(urls), 0), 0).to_numpy(zero_copy_only=False)
            score = np.zeros(len(urls))
            score[some] = model.value.score(urls.filter(pa.array(some)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), urls, pa.array(score.round(6)), pa.array(score >= limit)], ["page_id", "url", "score", "blocked"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, url string, score double, blocked boolean")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_urls(read(spark, sf_dir, "pages"))
