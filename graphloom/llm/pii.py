"""Personal data by a linear-chain conditional random field over word shapes.

Tokens are split at white space. Features are hashed: the collapsed shape (runs of
character classes), the full shape of short tokens, the set of classes with the length,
whether there is an @ or a digit, digit counts, the shapes on both sides and the word before. The field is trained once
per run from a small labelled table, ``labelled_rows`` or the caller's own, and decoded by
Viterbi in numpy batches over whole texts.

Kinds: email, ip, card, phone, secret, ssn, iban. Tokens of one phone, card or account number
follow each other as begin and inside. What the field marks as a card must also pass the check
digit (Luhn), and an IBAN its remainder; a card has 13 to 19 digits, a secret 8 characters, else it isn't
reported; dates run together and book numbers so go. ``redact`` puts ``[KIND]`` in the place
of every entity.

Defined results: a null or empty text, or one of white space, has no row (and stays as it is
when redacted); a null doc_id is carried as null; repeated rows give repeated results, two
texts of one doc_id each their own; ties in decoding go to the lower state ('no data' first);
ids are integers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import crf
from .tables import read, with_ids
from .text import Tokens, chunks, mix, span_hashes

BUCKETS = 1 << 16
STATES = ["", "email", "ip", "card", "card+", "phone", "phone+", "secret", "ssn", "iban", "iban+"]
_KIND = np.array([0, 1, 2, 3, 3, 5, 5, 7, 8, 9, 9])
_INSIDE = np.array([s.endswith("+") for s in STATES])
_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "", "@", ".", "-", "+", "(", ")", "\"'`", "=", ":/", "_"], 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 2
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_JUNK = 15


def labelled_rows(n: int = 1500, seed: int = 10) -> list[tuple[list[str], list[int]]]:
    """A small labelled table: token lists with a state for each token. Made from fixed templates and a fixed seed."""
    r = np.random.RandomState(seed)
    pick = lambda *x: x[r.randint(len(x))]
    digits = lambda k: "".join(map(str, r.randint(0, 10, k)))
    word = lambda most=5: "".join(pick("an", "er", "th", "ion", "re", "de", "la", "é", "ü", "ch", "os", "ent", "qu", "st") for _ in range(r.randint(1, most)))
    tail = lambda: pick("", "", ",", ".", "###", "$$$", "&&&", "%%%", "***", "!!", ";", ":", ",!!", ".###", ":", ")", ">", "?", "!")
    S = {s: i for i, s in enumerate(STATES)}
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(list(of), k))

    def entity() -> tuple[list[str], list[int]]:
        kind = r.randint(0, 14)
        if kind == 12:
            number = pick("DE", "FR", "GB", "ES", "NL", "CH") + digits(2) + pick("", letters(4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + digits(pick(14, 16, 18))
            if r.rand() < 0.5:
                return [number], [S["iban"]]
            parts = [number[i : i + 4] for i in range(0, len(number), 4)]
            return parts, [S["iban"]] + [S["iban+"]] * (len(parts) - 1)
        if kind == 13:
            if r.rand() < 0.5:
                return [":".join(letters(pick(1, 3, 4, 4), "0123456789abcdef") for _ in range(8))], [S["ip"]]
            return [f"{letters(4, '0123456789abcdef')}:{letters(4, '0123456789abcdef')}::{letters(pick(1, 4), '0123456789abcdef')}"], [S["ip"]]
        if kind < 2:
            name = pick(f"{word()}.{digits(2)}", f"{word()}_{word()}", word() + digits(r.randint(0, 3)), f"{word()}.{word()}", f"{word()}+{word()}", word(), word(3), f"{word(2)}.{word()}")
            return [pick("", "", "<", "(") + f"{name}@{pick('mail', word())}{digits(r.randint(0, 2))}.{pick('example.', '', word() + '.')}{pick('com', 'org', 'net', 'de', 'io', 'com', 'org', 'net', 'edu', 'co.uk', 'es', 'fr', 'gov', 'info')}"], [S["email"]]
        if kind < 4:
            return [pick("", "", "[", "(") + ".".join(str(r.randint(0, pick(10, 100, 256, 256))) for _ in range(4)) + pick("", "", "", ":" + digits(4), ":")], [S["ip"]]
        if kind < 6:
            n = pick(16, 16, 16, 15, 13)
            return [pick("3", "4", "5", "2", "6") + digits(n - 1)], [S["card"]]
        if kind == 6:
            if r.rand() < 0.4:
                return ["-".join([pick("4", "5") + digits(3), digits(4), digits(4), digits(4)])], [S["card"]]
            return [pick("4", "5") + digits(3), digits(4), digits(4), digits(4)], [S["card"]] + [S["card+"]] * 3
        if kind < 9:
            style = r.randint(0, 6)
            if style < 3:
                return [f"+{pick('1', '1', '44', '49')}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [S["phone"], S["phone+"], S["phone+"]]
            if style == 3:
                return [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [S["phone"], S["phone+"]]
            if style == 4:
                return [f"{digits(3)}-{digits(3)}-{digits(4)}"], [S["phone"]]
            return [f"+{digits(2)}", digits(2), digits(4), digits(4)], [S["phone"]] + [S["phone+"]] * 3
        if kind < 11:
            code = "".join(pick(*"0123456789abcdef") for _ in range(pick(32, 40, 40, 64)))
            if r.rand() < 0.6:
                return [pick("token", "token", "key", "secret", "password"), "=", f'"{code}"'], [0, 0, S["secret"]]
            return [pick("", '"', "token=", "password:", "api_key=") + pick(code, "sk_live_" + code[:24], "AKIA" + code[:16].upper(), "ghp_" + letters(36), "xoxb-" + digits(11) + "-" + letters(24), letters(pick(32, 40)))], [S["secret"]]
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"], [S["ssn"]]

    def plain() -> str:
        k = r.randint(0, 75)
        if k > 59:  # what looks like personal data and isn't
            return [digits(pick(9, 10, 11, 12)), f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", f"20{digits(2)}{digits(2)}{digits(2)}", f"@{word()}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", word(10) + "_" + word(8), f"#{letters(6, '0123456789abcdef')}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(4)}", word(9).capitalize() + word(6).capitalize(), f"${digits(3)}.{digits(2)}", f"{word()}.{pick('py', 'html', 'txt')}", f"/{word()}/{word()}/{word()}.{pick('png', 'css')}"][k - 60]
        if k > 11:
            w = word(10) if k < 56 else pick("a", "e", "é", "I", "o", "y")
            return pick(w, w, w, w.capitalize(), w.upper())
        return [digits(1) + ".", f"{digits(1)}.{digits(1)}.", digits(4), f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}:{digits(2)}", digits(r.randint(1, 8)), f"https://{word()}.example.com/{word()}", "=", f"{word()}-{word()}", word() + digits(1)][k]

    rows = []
    for _ in range(n):
        tokens: list[str] = []
        tags: list[int] = []
        loud = r.rand() < 0.25
        noisy = r.rand() < 0.3
        for _ in range(r.randint(2, 7)):
            for _ in range(r.randint(0, 12)):
                tokens.append(plain() + (tail() if noisy or r.rand() < 0.25 else ""))
                tags.append(0)
            e, t = entity()
            e[-1] += tail() if noisy or r.rand() < 0.3 else ""
            tokens += e
            tags += t
        if loud:
            tokens = [x.upper() + "!!" for x in tokens]
        rows.append((tokens, tags))
    return rows


def features(tokens: Tokens) -> list[np.ndarray]:
    """Hashed feature numbers, one array of each kind."""
    n = len(tokens)
    s, e, data = tokens.starts, tokens.ends, tokens.data
    size = e - s
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(s - first[:-1], size) + np.arange(first[-1])
    raw = data[at]
    cls = _CLASS[raw]
    junk = cls == _JUNK
    head = np.ones(len(cls), bool)
    head[1:] = cls[1:] != cls[:-1]
    head[first[:-1]] = True
    head &= ~junk
    keep = np.flatnonzero(head)
    cut = np.searchsorted(keep, first)
    collapsed = span_hashes(cls[keep], cut[:-1], cut[1:])
    solid = np.flatnonzero(~junk)
    cut = np.searchsorted(solid, first)
    core = np.diff(cut)
    full = span_hashes(cls[solid], cut[:-1], cut[1:])
    full = np.where(core <= 12, full, collapsed)

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int32), first[:-1])

    digit, hexa = total(cls == 3), total(_HEX[raw])
    letters = total(cls <= 2)
    marks = np.bitwise_or.reduceat((np.uint32(1) << cls.astype(np.uint32)) & np.uint32(0xFFFE & ~(1 << _JUNK)), first[:-1])
    bucket = np.where(core > 20, 20 + np.minimum(core, 70) // 8, core)
    form = mix(marks.astype(np.uint64) * np.uint64(64) + bucket.astype(np.uint64))
    amount = mix((np.minimum(digit, 24) * 1000 + (hexa == digit + letters) * 500 + np.minimum(letters, 40)).astype(np.uint64))
    coarse = mix(((marks & np.uint32(1 << 5)) * 8 + np.minimum(digit, 3)).astype(np.uint64))
    word = tokens.hashes
    doc = tokens.doc
    before, after = np.full(n, np.uint64(1)), np.full(n, np.uint64(2))
    last = np.full(n, np.uint64(3))
    if n > 1:
        same = doc[1:] == doc[:-1]
        before[1:] = np.where(same, full[:-1], np.uint64(1))
        after[:-1] = np.where(same, full[1:], np.uint64(2))
        last[1:] = np.where(same, word[:-1], np.uint64(3))
    mask = np.uint64(BUCKETS - 1)
    return [(mix(f + np.uint64(101 * k)) & mask).astype(np.int64) for k, f in enumerate((coarse, collapsed, full, form, amount, before, after, last))]


@lru_cache(1)
def train() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return fit(labelled_rows())


def fit(rows: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = Tokens(pa.array([" ".join(t) for t, _ in rows]), by_space=True)
    tags = np.concatenate([np.array(t) for _, t in rows])
    return crf.fit(features(tokens), BUCKETS, tags, tokens.counts, len(STATES), rounds=60)


def decode(model: tuple, tokens: Tokens) -> np.ndarray:
    """The state of each token."""
    weights, start, trans = model
    if not len(tokens):
        return np.zeros(0, np.int8)
    emission = np.zeros((len(tokens), len(STATES)), np.float32)
    for f in features(tokens):
        emission += weights[f]
    return crf.viterbi(emission, tokens.counts, start, trans)


_EDGE = {1: "@._-+", 2: ".:", 3: "", 5: "+()", 7: "_", 8: "", 9: ""}


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether an account number's remainder is 1."""
    code = "".join(c for c in value.upper() if c.isalnum() and c.isascii())
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _valid(kind: int, value: str) -> bool:
    if kind == 3:
        digits = "".join(c for c in value if c.isdigit() and c.isascii())
        return 13 <= len(digits) <= 19 and luhn(digits)
    return len(value) >= 8 if kind == 7 else kind != 9 or iban(value)


def _core(raw: str, lead: str, tail: str) -> tuple[int, int]:
    """Where the entity stands in its tokens, without marks around it."""
    a, b = 0, len(raw)
    while a < b and not (raw[a].isalnum() or raw[a] in lead):
        a += 1
    while b > a and not (raw[b - 1].isalnum() or raw[b - 1] in tail):
        b -= 1
    return a, b


def find(model: tuple, column: pa.Array) -> Iterator[tuple[int, str, int, int, str]]:
    """(row, kind, first character, characters, value) of every entity in a text column."""
    tokens = Tokens(column, by_space=True)
    state = decode(model, tokens)
    hits = np.flatnonzero(state)
    if not len(hits):
        return
    kind, inside = _KIND[state[hits]], _INSIDE[state[hits]]
    doc = np.searchsorted(tokens.bounds, hits, "right") - 1
    new = np.ones(len(hits), bool)
    new[1:] = ~(inside[1:] & (np.diff(hits) == 1) & (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(hits)) - 1
    chars = np.cumsum((tokens.data & 0xC0) != 0x80)
    for b, e in zip(begin.tolist(), end.tolist()):
        lo, hi = int(tokens.starts[hits[b]]), int(tokens.ends[hits[e]])
        raw = tokens.data[lo:hi].tobytes().decode()
        k, last = int(kind[b]), int(kind[b]) == 7 and "=" in raw
        skip = raw.rindex("=", 0, -1) + 1 if last and "=" in raw[:-1] else 0  # a secret's name
        x, y = _core(raw[skip:], _EDGE[k], ")" if k == 5 else "")
        core = raw[skip + x : skip + y]
        if core and _valid(k, core):
            base = int(tokens.offsets[doc[b]])
            first = int(chars[lo - 1] if lo else 0) - int(chars[base - 1] if base else 0) + skip + x
            yield int(doc[b]), STATES[k], first, len(core), core


def _model(docs: DataFrame, rows: list[tuple[list[str], list[int]]] | None):
    return docs.sparkSession.sparkContext.broadcast(fit(rows) if rows else train())  # a table of fixed size


def personal_data(docs: DataFrame, rows: list[tuple[list[str], list[int]]] | None = None) -> DataFrame:
    """(doc_id, kind, first_char, n_chars, value) of all personal data; first_char counts characters from 0. ``rows``: labelled token lists in place of ``labelled_rows``."""
    model = _model(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = list(find(model.value, batch.column("text")))
            if rows:
                at, kind, first, size, value = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(kind), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(value)], ["doc_id", "kind", "first_char", "n_chars", "value"])

    return with_ids(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, first_char long, n_chars long, value string")


def redact(docs: DataFrame, rows: list[tuple[list[str], list[int]]] | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced by its kind, as ``[EMAIL]``."""
    model = _model(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            spans: dict[int, list[tuple[str, int, int]]] = {}
            for at, kind, first, size, _ in find(model.value, batch.column("text")):
                spans.setdefault(at, []).append((kind, first, size))
            if spans:
                texts = batch.column("text").to_pylist()
                for at, found in spans.items():
                    out, end, text = [], 0, texts[at]
                    for kind, first, size in found:
                        out += [text[end:first], f"[{kind.upper()}]"]
                        end = first + size
                    texts[at] = "".join(out) + text[end:]
                k = batch.schema.get_field_index("text")
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
