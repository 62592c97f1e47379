"""Personal data: check digits, other kinds, redaction, rows from other labels, spans against plain loops, awkward rows."""

import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import crf, pii
from graphloom.llm.text import Tokens


def values(*texts):
    return [(r, k, v) for r, k, _, _, v in pii.find(pii.train(), pa.array(texts))]


def test_check_digits():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("378282246310005")
    assert pii.iban("DE89 3704 0044 0532 0130 00") and not pii.iban("DE88 3704 0044 0532 0130 00")
    assert values("20240517123456", "isbn 9783161484100", "978-3-16-148410-0", "paid with 4111111111111112") == []


def test_kinds():
    assert values("pay 4111 1111 1111 1111.", "4111-1111-1111-1111,", "to DE89 3704 0044 0532 0130 00 now", "GB82WEST12345698765432;", 'Bob <bob@x.org>;', "api_key=sk_live_abcdef0123456789abcdef01") == [
        (0, "card", "4111 1111 1111 1111"), (1, "card", "4111-1111-1111-1111"), (2, "iban", "DE89 3704 0044 0532 0130 00"), (3, "iban", "GB82WEST12345698765432"), (4, "email", "bob@x.org"), (5, "secret", "sk_live_abcdef0123456789abcdef01")]
    assert values("see 2001:0db8:85a3:0000:0000:8a2e:0370:7334 there") == [(0, "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]


def test_held_out_rows_of_another_writer():
    """Entities in plain sentences that no template of the training table has."""
    r = np.random.RandomState(3)
    names = ["maria", "j.smith", "kontakt", "info", "paul_99"]
    lines, want = [], []
    for k in range(200):
        who = f"{names[r.randint(5)]}@{['uni', 'firma', 'shop'][r.randint(3)]}.{['edu', 'de', 'co.uk'][r.randint(3)]}"
        ip = ".".join(str(x) for x in r.randint(1, 255, 4))
        lines.append([f"Please write to {who} before noon on 12 May 2024.", f"The host {ip} answered in 35 ms.", f"Ticket 48213 was closed by {who}, thanks", f"from {ip}: connection 7 refused"][k % 4])
        want.append(ip if k % 2 else who)
    got = {}
    for r_, _, v in values(*lines):
        got.setdefault(r_, []).append(v)
    assert np.mean([got.get(i) == [w] for i, w in enumerate(want)]) > 0.95


def test_spans_equal_plain_loops():
    """States to spans: the same as a loop over the tokens."""
    texts = [" ".join(t) for t, _ in pii.labelled_rows(60, seed=5)] + ["é" * 50, "", None, "x " * 30 + "+1 (743) 555-3824 +1 (743) 555-3825"]
    model, tokens = pii.train(), Tokens(pa.array(texts), by_space=True)
    state, want = pii.decode(model, tokens), []
    for i, text in enumerate(texts):
        found = [(m.start(), m.end()) for m in re.finditer(r"[^\t\n\v\f\r ]+", text or "")]
        own, k = state[tokens.bounds[i] : tokens.bounds[i + 1]], 0
        while k < len(found):
            kind = int(pii._KIND[own[k]])
            if kind:
                j = k + 1
                while j < len(found) and pii._INSIDE[own[j]] and pii._KIND[own[j]] == kind:
                    j += 1
                raw = text[found[k][0] : found[j - 1][1]]
                at = found[k][0]
                if kind == 7 and "=" in raw[:-1]:
                    at += raw.rindex("=", 0, -1) + 1
                    raw = raw[raw.rindex("=", 0, -1) + 1 :]
                while raw and not (raw[0].isalnum() or raw[0] in pii._EDGE[kind]):
                    raw, at = raw[1:], at + 1
                while raw and not (raw[-1].isalnum() or (kind == 5 and raw[-1] == ")")):
                    raw = raw[:-1]
                if raw and pii._valid(kind, raw):
                    want.append((i, pii.STATES[kind], at, len(raw), raw))
                k = j
            else:
                k += 1
    assert list(pii.find(model, pa.array(texts))) == want and len(want) > 100


def test_ties_go_to_no_data():
    model = (np.zeros((pii.BUCKETS, len(pii.STATES)), np.float32), np.zeros(len(pii.STATES), np.float32), np.zeros((len(pii.STATES),) * 2, np.float32))
    assert not pii.decode(model, Tokens(pa.array(["a@b.com 1 2 3"]), by_space=True)).any()
    assert crf.viterbi(np.zeros((3, 2)), np.array([3]), np.zeros(2), np.zeros((2, 2))).tolist() == [0, 0, 0]


def test_long_marks_are_linear():
    text = "bob@mail.example.com" + "!" * 400_000
    began = time.time()
    assert values(text, "word " * 1000) == [(0, "email", "bob@mail.example.com")] and time.time() - began < 5


def test_redaction_and_awkward_rows(spark):
    rows = [(1, "ünï call +1 (743) 555-3824, or bob.77@mail3.example.com!"), (1, "plain"), (1, "plain"), (2, None), (None, "at 152.143.123.131"), (3, ""), (1, "at 152.143.123.131")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("kind", F.lit("clash")).withColumn("value", F.lit(1))
    got = pii.redact(docs)
    assert got.columns == docs.columns and sorted(str(r.text) for r in got.collect()) == sorted(["ünï call [PHONE], or [EMAIL]!", "plain", "plain", "None", "at [IP]", "", "at [IP]"])
    found = sorted((r.doc_id or 0, r.kind, r.first_char) for r in pii.personal_data(docs.unionAll(docs)).collect())
    assert found == sorted([(0, "ip", 3), (1, "ip", 3), (1, "email", 31), (1, "phone", 9)] * 2)
    assert pii.redact(docs.where("false")).count() == 0


def test_own_labels(spark):
    rows = [(["the", f"ORD{k:05d}x", "was", "paid"], [0, pii.STATES.index("secret"), 0, 0]) for k in range(200)] + [(["a", "plain", f"line{k}"], [0, 0, 0]) for k in range(200)]
    docs = spark.createDataFrame([(1, "see ORD99999x here")], "doc_id long, text string")
    assert [(r.kind, r.value) for r in pii.personal_data(docs, rows).collect()] == [("secret", "ORD99999x")]
