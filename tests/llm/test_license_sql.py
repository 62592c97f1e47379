"""License scan against its SQL on every template, with gaps, ties in frequency, two texts of one id."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import licenses
from graphloom.llm.text import Tokens


def rows():
    r, out = np.random.RandomState(2), []
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        words = notice.replace("[", " ").replace("]", " ").split()
        out.append((k, "Some words. " + " ".join(words).title() + ", and more"))
        broken = list(words)
        broken[r.randint(len(words))] = "other"
        out.append((k % 7, " ".join(broken)))  # several texts of one id
        out.append((100 + k, " ".join(words[1:])))
        out.append((200 + k, " ".join([*words[: len(words) // 2], "pushed", *words[len(words) // 2 :]])))
    return [*out, (1, None), (None, out[0][1]), (300, ""), out[0], out[0]]


def test_scan_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows())
    want = sorted(map(str, con.execute(licenses.OP3_SQL).fetchall()))
    docs = spark.createDataFrame(rows(), "doc_id int, text string").withColumn("license", F.lit("clash"))
    got = sorted(str((r.doc_id, r.license, r.first_word)) for r in licenses.scan(docs.repartition(3)).collect())
    assert got == want and {n for n, _ in licenses.TEMPLATES} == {r.license for r in licenses.scan(docs).collect()}


def test_ties_in_frequency():
    """Words of equal frequency are chosen by the alphabet, so the index doesn't depend on the order they were counted in."""
    words = sorted({w for _, t in licenses.TEMPLATES for _, p in licenses.parse(t) for w in p})
    one, two = licenses.Index({w: 3 for w in words}), licenses.Index({w: 3 for w in reversed(words)})
    assert one.keys.tolist() == two.keys.tolist() and one.postings == two.postings
    tokens = Tokens(pa.array([t for _, t in rows()]))
    assert one.find(tokens) == licenses.Index({}).find(tokens)
