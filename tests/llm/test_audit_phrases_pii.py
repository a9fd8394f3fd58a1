"""Filter audit, collocations and personal data against brute force, with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slidejobs.llm import collocations, exact_dedup, filter_audit, pii, url_filter, wordscan

SF = Path("/root/testdata/sf0.001")
rng = np.random.default_rng(3)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = ["a", "b", "A", "É", "日", "😀", "#", "|", " ", " ", "\t", "\n", "\x0b", "\r", ".", "!", "12", "longerthaneight", "longerthaneighT", "\x00"]


def text_of(n):
    return "".join(rng.choice(ALPHABET, n))


def rows_of(df, order):
    return sorted(tuple(r[c] for c in order) for r in df.collect())


def test_scan_by_brute_force():
    texts = ["", " ", "a", *[text_of(int(n)) for n in rng.integers(0, 400, 60)], "", "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 5000, "w " * 3000]
    arr = pa.array(["skipped", *texts]).slice(1)
    for bits in (44, 3):  # with 3 bits most words share their hash with another
        got = filter_audit.scan(arr, bits)
        for i, t in enumerate(texts):
            ws = WORD.findall(t)
            want = (len(ws), len(set(ws)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t))
            assert tuple(int(got[k][i]) for k in ("words", "distinct", "capitals", "symbols", "chars")) == want


def test_words_of_equal_hashes_are_told_apart():
    data = np.frombuffer(b"ab\x00 ab cd", np.uint8)
    starts, sizes, text = wordscan.words(data != 32, np.array([0, len(data)]))
    assert sizes.tolist() == [3, 2, 2] and text.tolist() == [0, 0, 0]
    blocks = wordscan.Blocks(data)
    assert wordscan.same_bytes(blocks, starts[:2], starts[1:], np.array([2, 2])).tolist() == [True, False]


def brute_audit(rows, labels):
    """rows: doc_id, text, lang; labels: doc_id, quality, toxic."""
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in least and (d is None or d > least[t])}
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for i, c in enumerate(order):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                shapley[c] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), sum(c in d[0] and bool(d[0] & set(order[:i])) for d in own), sum(d[0] == {c} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), c]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]] if isinstance(v[-1], str) else v[-1]
    return sorted((*k, *v) for k, v in out.items())


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "HELLO", "a # b", long, long + " $", long.upper(), "same " * 300, *[text_of(int(n)) for n in rng.integers(0, 900, 40)]]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(100 + i, long, "fr") for i in range(30)] + [(4, long, "en"), (4, long, "en"), (None, long, "en"), (None, "only null ids", "en"), (None, "only null ids", "de"), (None, None, None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 130, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1), (2, 0, 1)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, good int, digest string, spread int").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    audit = lambda d, x: filter_audit.report(filter_audit.cells(filter_audit.text_masks(d), x))
    assert rows_of(audit(docs, lab), AUDIT) == brute_audit(rows, labels)
    assert rows_of(audit(docs, lab.limit(0)), AUDIT) == brute_audit(rows, [])
    assert audit(docs.limit(0), lab).count() == 0


def brute_phrases(rows, least=10, most_words=3, top=2000, percent=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, most_words + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    held = defaultdict(int)
    for (lang, p), v in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                held[lang, p[i : i + m]] = max(v, held[lang, p[i : i + m]])
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * held[lang, p] >= percent * a:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        s, _, x, y = min(cuts)
        out[lang].append((-s, -a, " ".join(p).encode(), x, y))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("shard_bytes", "most_words", "bits"), [(1 << 23, 3, 27), (300, 3, 27), (300, 4, 15), (2000, 2, 27)])
def test_collocations(spark, shard_bytes, most_words, bits):
    vocab = ["the", "The", "of", "straße", "日本", "#1", "ab\x00", "eightlong", "eightlongs", "x"]
    sep = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\x0b"]
    gen = np.random.default_rng(shard_bytes + most_words)
    text = lambda n: "".join(w + s for w, s in zip(gen.choice(vocab, n, p=np.r_[0.3, 0.1, 0.2, [0.4 / 7] * 7]), gen.choice(sep, n), strict=True))
    rows = [(text(int(n)), ["en", "de", None, "und", "a\tb"][i % 5]) for i, n in enumerate(gen.integers(0, 120, 60))]
    rows += [(None, "en"), ("", None), (" \t\n", "xx"), ("new york city is big. " * 40, "en"), ("word " * 500, "fr"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(i, *r, 1, "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, key string").repartition(4)
    counts = collocations.phrase_counts(docs, most_words=most_words, shard_bytes=shard_bytes, filter_bits=bits)
    got = rows_of(collocations.collocations(counts), PHRASE)
    assert got and got == brute_phrases(rows, most_words=most_words)
    assert rows_of(collocations.collocations(counts, top=3), PHRASE) == brute_phrases(rows, most_words=most_words, top=3)
    assert collocations.collocations(collocations.phrase_counts(docs.limit(0))).count() == 0


def test_scores_pass_64_bits(spark):
    big = 7_000_000_001
    counts = spark.createDataFrame([("en", "", 0, 10**11), ("en", "a", 1, 2 * big), ("en", "b", 1, 3 * big + 1), ("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    (r,) = collocations.collocations(counts).collect()
    assert r.score == 10**6 * big * big // (2 * big * (3 * big + 1)) and (r.l, r.r, r.n) == (2 * big, 3 * big + 1, 10**11)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for i, (kind, p) in enumerate(list(pii.TERMS.items())[:4]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((i, m.start(), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def private_text(n):
    parts = ["a@b.c", "x.y+1@mail.example.com", "@", ".", "_", "-", "1.2.3.4", "001.002.255.0255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4242424242424242", "1234567890123", "+1 (743) 555-3824", "+49", "(030) 12", "0", "7", " ", "  ", "\n", "é😀", "日", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "call 555-123-4567 now", "phone:", "A"]
    return "".join(rng.choice(parts, n))


@pytest.fixture(scope="module")
def private(spark):
    texts = [None, "", "no data", "é😀 a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b@c.d", "x" * 2000 + "@", "1" * 3000, "+1" + " " * 3000 + "2", "a@b.c," * 3000, "4111111111111111 " * 500, "9." * 2000]
    texts += [private_text(int(n)) for n in rng.integers(1, 60, 150)]
    rows = [(i, t, "x", 1, "m") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "a@b.c", "x", 1, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m0 string, e0 int, spans string").repartition(5)
    return rows, docs


def test_base_spans(private):
    rows, docs = private
    got = Counter((r.doc_id, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in {k.name for k in pii.BASE})) for r in pii.spans(docs).collect())
    assert got == Counter((r[0], tuple(brute_base(r[1] or ""))) for r in rows)
    assert pii.spans(docs.limit(0)).count() == 0


def test_values_stand_where_spans_say(private):
    rows, docs = private
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in pii.spans(docs).collect():
        for s in r.spans:
            assert r.doc_id is None or texts[r.doc_id][s.start : s.end] == s.value
            assert pii.THRESHOLD <= s.score <= 100


def test_checks_and_context(spark):
    cases = {
        "pay to GB82 WEST 1234 5698 7654 32 today": ["iban:7:34"], "pay to GB82 WEST 1234 5698 7654 33 today": [], "xGB82WEST12345698765432": [],
        "DE89370400440532013000.": ["iban:0:22"], "phone 555-123-4567": ["tel:6:18"], "part 555-123-4567": [], "tel (555) 123-4567, ok": ["tel:4:18"], "call 9555-123-4567": [], "call +1 555-123-4567": ["phone:5:20"],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in pii.spans(docs).collect()}
    assert got == dict(enumerate(cases.values()))
    plain, near = pii.spans(spark.createDataFrame([(0, "a 1.2.3.4"), (1, "server 1.2.3.4")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert near.spans[0].score - plain.spans[0].score == pii.BONUS


def test_long_runs(spark):
    """Runs that a pattern which goes back would read once for each of their characters, or on a stack of their length."""
    n = 400_000
    texts = ["x" * n + "@", "x" * n + "@y.z", "1" * n, "+1" + " " * n, "+" * n, "9." * n, "1 " * n, "a@" * n, "555-" * n, "AB12" * n, "a@b" + ".c" * n]
    got = {r.doc_id: r.spans for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    places = {i: [(s.kind, s.start, s.end) for s in x] for i, x in got.items()}
    assert places[1] == [("email", 0, n + 4)] and places[10] == [("email", 0, 2 * n + 3)]
    assert places[5] == [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)]
    assert sorted(i for i, x in places.items() if x) == [1, 5, 10]


def test_plan_has_no_python(spark):
    docs = spark.range(9).select("id", F.lit("a@b.c").alias("text"))
    assert not re.search("Python|Pandas|Arrow|Exchange", pii.spans(docs, "id")._jdf.queryExecution().executedPlan().toString())


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize(("module", "name"), [(exact_dedup, "op2_exact_dedup"), (url_filter, "op9_url_filter"), (filter_audit, "op11_filter_audit"), (collocations, "op12_collocations"), (pii, "op13_pii")])
def test_query_equals_its_sql(spark, module, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = getattr(module, name)(spark, str(SF))
    cur = c.execute(module.SQL)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(map(str, (tuple(r[x] for x in columns) for r in df.collect())))
    assert got and got == sorted(map(str, cur.fetchall()))


def test_digest_of_no_spans(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "a@b.c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = pii.op13_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert one.base_sha256 == hashlib.sha256(b"").hexdigest() and one.spans == ""
    assert two.base_sha256 == hashlib.sha256(b"email:0:5").hexdigest() and two.n_email == 1
