"""Every operator against a brute-force version or a round trip, and the edge cases: nulls, empty texts, ties, repeats, long texts, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slidejobs.llm import bpe, chat_tree, exact_dedup, lm_score, near_dedup, packing, quality, token_counts, url_filter, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = prose(120)


def near(text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
    return " ".join(w)


TEXTS = (
    [None, "", "   \n\t", "One", "one  TWO", "a\x0bb\x0cc\r\n", "Éte ΑΣ İ 12's <|endoftext|> ½²", "日本語 テキスト 😀", "x" * 5000, "long " * 3000, "<s> </s> ▁ a  b ", "\x00nul \x1c sep"]
    + [prose(rng.randint(1, 200)) for _ in range(60)]
    + [BASE] * 4
    + [near(BASE, e) for e in (0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20) for _ in range(5)]
    + [BASE.replace(" ", "  "), BASE.upper()]
)


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like the operators' own, and a row that is there twice
    rows = [(7 * i + 3, t, "n", "x", 0.5, True, 1) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, digest string, token string, score double, kept boolean, bucket int"
    return spark.createDataFrame(rows + rows[20:21], schema).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


IDS = {7 * i + 3: t or "" for i, t in enumerate(TEXTS)}


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(TEXTS) + 1
    groups = defaultdict(list)
    for i, t in [*IDS.items(), (7 * 20 + 3, IDS[7 * 20 + 3])]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    for r in got:
        key = re.sub(r"[\x20\x09-\x0D]", "", IDS[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(groups[key])[1], len(groups[key]), r.doc_id == min(groups[key])[1], hashlib.sha256(key.encode()).hexdigest())
    few = {(r.text_sha256, r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(docs, broadcast_rows=0)[0].collect()}
    assert few == {(r.text_sha256, r.keep_id, r.group_size) for r in got if r.group_size > 1}
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_of_null_and_reused_ids(spark):
    rows = [(None, "a  b"), (1, "a b"), (2, "ab"), (None, "nobody"), (None, "nobody"), (7, "alone"), (7, "a b"), (8, "twice"), (8, "twice"), (None, "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {i: got[i, sha("ab")] for i in (None, 1, 2, 7)} == {None: (1, 4, False), 1: (1, 4, True), 2: (1, 4, False), 7: (1, 4, False)}
    assert got[None, sha("nobody")] == (None, 2, True) and got[7, sha("alone")] == (7, 1, True)
    left = sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_duplicates(df).collect())
    assert left == [(0, "nobody"), (0, "single"), (1, "a b"), (7, "alone"), (8, "twice")]


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.word_bpe())
    got = by_id(bpe.encode_decode(docs, bpe.word_bpe(), keep_ids=True))
    for i, t in IDS.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(none, bpe.word_bpe()).count() == 0


def merge_all(ids, rank, made):
    while True:
        best = min((rank.get(p, math.inf), i) for i, p in enumerate(zip(ids, ids[1:], strict=False))) if len(ids) > 1 else (math.inf, 0)
        if best[0] == math.inf:
            return ids
        ids = [*ids[: best[1]], made[best[0]], *ids[best[1] + 2 :]]


@pytest.mark.parametrize("seed", range(30))
def test_lookahead_is_sufficient(seed):
    """Random merge lists: tokens that end that far before the end of a prefix are tokens of every longer text."""
    r = random.Random(seed)
    size, merges, made = [1, 1, 1], [], []
    while len(merges) < 14:
        pair = (r.randrange(len(size)), r.randrange(len(size)))
        if pair not in merges and size[pair[0]] + size[pair[1]] <= 9:
            merges.append(pair)
            made.append(len(size))
            size.append(size[pair[0]] + size[pair[1]])
    rank = {p: i for i, p in enumerate(merges)}
    look = bpe.sufficient_lookahead(merges, made, size)
    m = bpe.Merges(merges, made, size)
    for _ in range(30):
        text = [r.randrange(3) for _ in range(60)]
        whole = merge_all(text, rank, made)
        ids, _ = m.apply(np.array(text, np.int32), np.array([len(text)]))
        assert ids.tolist() == whole
        ends = list(np.cumsum([size[i] for i in whole]))
        for n in range(1, 60):
            part = merge_all(text[:n], rank, made)
            for k, e in enumerate(np.cumsum([size[i] for i in part])):
                if e <= n - look:
                    assert ends[k] == e and whole[k] == part[k]


def test_small_windows_give_the_same_ids():
    enc = bpe.Encoder(bpe.word_bpe())
    texts = pa.array(["".join(rng.choice("etaoinshrdlu") for _ in range(3000)), "ab" * 2000, "é" * 1500])
    whole = enc.encode(texts)
    enc.window = enc.merges.max_token + enc.merges.lookahead + 1
    assert enc.encode(texts) == whole


def test_decoder_in_any_steps():
    pieces = [bytes([b]) for b in range(256)]
    raw = "aé日😀".encode() + b"\xff\xe6\x97z"
    for step in range(1, 5):
        d = bpe.TextDecoder(pieces)
        assert "".join(d.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + d.finish() == raw.decode("utf-8", "replace")


def packed_ok(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= capacity
    return len(seqs)


def first_fit(lengths, capacity):
    """Bins of first-fit decreasing."""
    bins = []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, free in enumerate(bins) if free >= n), None)
        if i is None:
            bins.append(capacity - n)
        else:
            bins[i] -= n
    return len(bins)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.word_bpe())
    rows = packing.pack_documents(docs, capacity=256, keep_ids=True).collect()
    used = packed_ok(rows, 256)
    assert math.ceil(sum(r.length for r in rows) / 256) <= used <= first_fit([r.length for r in rows], 256)
    whole = defaultdict(dict)
    for r in rows:
        whole[r.doc_id][r.piece] = r
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, t in IDS.items():
        parts = [whole[i][k] for k in sorted(whole[i])]
        assert [x for p in parts for x in p.ids] == [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert all(p.length == 256 for p in parts[:-1]) and [p.start for p in parts] == [256 * k for k in range(len(parts))]
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_every_piece_once_and_packs_tightly(seed):
    r = random.Random(seed)
    counts = Counter(min(64, max(1, int(r.lognormvariate(2.5, 1)))) for _ in range(3000))
    plan = packing.plan(counts, 64)
    used = Counter()
    for bin_, times in plan:
        assert sum(bin_) <= 64
        for length in bin_:
            used[length] += times
    assert used == counts
    assert sum(t for _, t in plan) <= math.ceil(sum(k * v for k, v in counts.items()) / 64) * 1.02 + 1


def test_two_pieces_take_the_place_of_the_smallest():
    # greedy: 6 + 3, gap 1; 2 + 2 fill the widened gap of 4
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(i, int(not re.search("xx|long long", t)), 0) for i, t in IDS.items()] + [(10**9, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)
    assert quality.scores(none, model).count() == 0
    flat = quality.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.scores(docs, flat).collect()} == {0.7}


def test_quality_learns_preferences():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, len(quality.NAMES)))
    good = (x[:, 3] - 2 * x[:, 5] + 0.1 * r.normal(size=600) > -1).astype(int)
    m = quality.fit(x[:400], good[:400])
    assert ((m.score(x[400:]) >= 0.7) == good[400:]).mean() > 0.93


def test_quality_learns_from_every_labelled_row(spark):
    texts = [f"{'ab' * (i % 7)}, {i} {'Zq| ' * (i % 11)}" for i in range(34_000)]
    good = [int(i % 9 != 4) for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    learnt = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(good[i] for i in learnt) > 20_000
    x, y = quality.features(pa.array([texts[i] for i in learnt])), np.array([good[i] for i in learnt])
    model = quality.train(df, labels)
    np.testing.assert_allclose(model.centre, x.mean(axis=0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(model.scale, x.std(axis=0) + 1e-9, rtol=1e-9)
    raw = np.sort(model.raw(x))
    assert raw[(y == 0).sum() - 1] - 1e-9 <= model.cut <= raw[(y == 0).sum()] + 1e-9
    again = quality.train(df.repartition(3, "text"), labels.repartition(2))
    assert (again.weights == model.weights).all() and again.cut == model.cut


@pytest.mark.parametrize("flip", [0, 1])
@pytest.mark.parametrize("group, few", [(4, 2), (50, 1), (10**6, 2)])
def test_quality_groups_miss_no_row(spark, monkeypatch, group, few, flip):
    monkeypatch.setattr(quality, "GROUP", group)
    monkeypatch.setattr(quality, "FEW", few)
    monkeypatch.setattr(quality, "MOST", 20)
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(400, len(quality.NAMES))), 1)
    y = (np.arange(400) % 8 == 0).astype(int) ^ flip
    rows = spark.createDataFrame([(i, int(q), bytearray(v.tobytes())) for i, (q, v) in enumerate(zip(y, x, strict=True))], "doc_id long, quality int, features binary")
    found = quality.grouped(rows).collect()
    assert (len(found) > 1) == (group < 400)
    met, own = [set(), set()], [Counter(), Counter()]
    for g in found:
        sides = [quality.matrix(g[side]) for side in ("bad", "good")]
        assert len(sides[0]) and len(sides[1])
        for q, side in enumerate(sides):
            met[q] |= {v.tobytes() for v in side}
        for q, side in zip((1, 0), quality.once(sides[1], sides[0], g["group"] < g["parts"], g["rarer"]), strict=True):
            own[q].update(v.tobytes() for v in side)
    for q in (0, 1):
        want = Counter(v.tobytes() for v in x[y == q])
        assert own[q] == want and met[q] == set(want)
    labels = spark.createDataFrame([(i, int(q)) for i, q in enumerate(y)], "doc_id long, quality int")
    model, learnt = quality.learn(rows.drop("quality"), labels), [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    raw = np.sort(model.raw(x[learnt]))
    n = int((y[learnt] == 0).sum())
    assert abs(model.cut - raw[n - 1 : n + 1].mean()) < 1e-9


def test_place_of_a_value(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST", 3)
    v = [0.5] * 40 + [1e6, -1e6] + [i / 7 for i in range(300)] + [1e-9 * i for i in range(50)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (0, 1, 30, 52, 75, 120, len(v) - 1):
        assert quality.nth(df, k) == sorted(v)[k]


def test_token_counts(docs, none, spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.piece_bpe())
    cache = f"file://{tmp_path}/cache"
    want = {i: (len(t.encode()), len(sp.encode(t))) for i, t in IDS.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, token_counts.piece_bpe(), cache, limit=100).collect()} == want
    entries = spark.read.parquet(cache).select("digest").distinct().count()
    assert entries == len(set(IDS.values()))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, "new text"), (-6, IDS[150])], "doc_id long, text string"))
    got = {r.doc_id: r for r in token_counts.count_tokens(more, token_counts.piece_bpe(), cache, limit=100).collect()}
    assert got[-5].n_tokens == len(sp.encode("new text")) and got[-6].n_tokens == want[150][1]
    assert all(r.over_limit == (r.n_tokens > 100) for r in got.values())
    assert spark.read.parquet(cache).select("digest").distinct().count() == entries + 1  # only the miss was encoded and added
    assert token_counts.count_tokens(none, token_counts.piece_bpe(), f"file://{tmp_path}/other").count() == 0


def test_chat_tree(spark):
    bad = chat_tree.HOSTILE
    convs = {
        1: [("system", "be brief"), ("user", "hi"), ("assistant", "hello\\n\\")],
        2: [("system", "be brief"), ("user", "hi"), ("assistant", "hello\\n\\"), ("user", "more <"), ("assistant", bad)],
        3: [("system", "be brief"), ("user", "other"), ("assistant", None)],
        4: [("system", "be brief"), ("user", "hi"), ("assistant", "hello\\n\\")],
        5: [("us\ner", bad), (None, "\\|<\\|")],
        6: [("user", "")],
        7: [("assistant", "x" * 9000)],
    } | {100 + i: [("system", "be brief"), ("user", f"q{i % 5}"), ("assistant", f"a{i % 9}")] for i in range(40)}
    rows = [(c, k, r, t, "extra") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string").repartition(4)
    path = chat_tree.byte_bpe()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encode = lambda s: library.encode(s, add_special_tokens=False).ids
    nodes, members = chat_tree.build(df, path)
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, members, path).collect()}
    for c, turns in convs.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len("".join(chat_tree.segment(a, b))) for a, b in turns)
        assert r.n_tokens == sum(len(encode(x)) for a, b in turns for x in chat_tree.segment(a, b))
    # each shared prefix once, depth-first, and every conversation's tokens are its attended intervals and the node itself
    prefixes = {tuple((r or "", t or "") for r, t in turns[:k]) for turns in convs.values() for k in range(1, len(turns) + 1)}
    nodes = nodes.collect()
    assert len(nodes) == len(prefixes)
    trees = defaultdict(list)
    for n in nodes:
        trees[n.tree].append(n)
    at = {}
    for tree, ns in trees.items():
        ns.sort(key=lambda n: n.start)
        assert [n.start for n in ns] == [sum(m.length for m in ns[:i]) for i in range(len(ns))]
        at[tree] = [(x, y) for n in ns for x, y in zip(n.tokens, n.position_ids, strict=True)]
        for a, b in zip(ns, ns[1:], strict=False):
            assert b.depth <= a.depth + 1
    where = {(n.tree, n.start): n for n in nodes}
    last = {}
    for m in members.collect():
        last[m.conv_id] = max(last.get(m.conv_id, (0, 0, 0)), (m.k, m.tree, m.start))
    for c, (_, tree, start) in last.items():
        n = where[tree, start]
        turns = [(a or "", b or "") for a, b in convs[c]]
        seen = [x for i in n.attend for x in at[tree][i["from"] : i["to"]]] + list(zip(n.tokens, n.position_ids, strict=True))
        assert n.position == len(seen) - n.length and [y for _, y in seen] == list(range(len(seen)))
        assert [x for x, _ in seen] == [x for a, b in turns for part in chat_tree.segment(a, b) for x in encode(part)]
        role, text = turns[-1]
        assert library.decode(n.tokens[n.loss_from : n.loss_to], skip_special_tokens=False) == (chat_tree.escape(text) if role == "assistant" else "")
    assert chat_tree.read_back(*chat_tree.build(df.limit(0), path), path).count() == 0


def test_chat_query_by_brute_force(spark, tmp_path):
    """op7 with its conversation of control strings; texts of many scripts, broken surrogates of escapes, long texts."""
    texts = ["plain", "", None, "é 漢字 😀\x00\r\n", "\\n<|", "<|endoftext|>", " \t" * 50, "ab " * 200_000, "z" * 50_000]
    rows = [(c, k, ("user", "assistant", "to\\ol")[k % 3], texts[(c * k + c) % len(texts)], "x") for c in range(12) for k in range(1 + c % 4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    convs = defaultdict(list)
    for c, _, role, text, _ in [*rows, (-1, 0, "user", chat_tree.HOSTILE, ""), (-1, 1, "assistant", chat_tree.HOSTILE, "")]:
        convs[c].append((role, text or ""))
    want = set()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((c, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len("".join(chat_tree.segment(r, t))) for r, t in turns)))
    got = [tuple(r)[:6] for r in chat_tree.op7_chat_tree(spark, f"file://{tmp_path}").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("k,w", [(25, 76), (3, 4), (7, 5), (1, 1)])
def test_winnowing_by_brute_force(k, w):
    for n in (0, 1, 2, 24, 25, 26, 99, 100, 101, 150, 400):
        for letters in ("ab", "abcdefgh é😀"):
            t = "".join(rng.choice(letters) for _ in range(n))
            c = winnowing.code_points(t)
            kk = min(k, max(n, 1))
            hs = [int(winnowing.kgram_hashes(c[i : i + kk], kk)[0]) for i in range(n - kk + 1)] if n else []
            ww, want = min(w, len(hs)), []
            for i in range(len(hs) - ww + 1 if hs else 0):
                p = max(j for j in range(i, i + ww) if hs[j] == min(hs[i : i + ww]))
                want += [p] if not want or want[-1] != p else []
            pos, h = winnowing.winnow(t, k, w)
            assert pos.tolist() == want and h.tolist() == [hs[p] for p in want]


def test_shared_passages_share_a_hash():
    t = winnowing.K + winnowing.WINDOW - 1
    for _ in range(50):
        a, b, shared = prose(40), prose(40), prose(60)[:t]
        p, q = winnowing.winnow(a + shared + b), winnowing.winnow(b[:17] + shared + a)
        own = {int(h) for x, h in zip(*p, strict=True) if len(a) <= x <= len(a) + t - winnowing.K}
        other = {int(h) for x, h in zip(*q, strict=True) if 17 <= x <= 17 + t - winnowing.K}
        assert own & other


def test_half_of_a_short_text_shares_a_hash():
    for n in range(1, 260):
        for following in ("", prose(60), "zq"):
            t = prose(n)[:n]
            own, new = (set(winnowing.winnow(x)[1].tolist()) for x in (t, winnowing.edited(t, following)))
            assert own & new
            assert own >= set(winnowing.winnow(t, winnowing.K, winnowing.WINDOW)[1].tolist())


@pytest.mark.parametrize("per_bucket", [1000, 5])
def test_fingerprints(docs, none, monkeypatch, per_bucket):
    plain = winnowing.with_next
    monkeypatch.setattr(winnowing, "with_next", lambda rows: plain(rows, per_bucket=per_bucket))
    got = winnowing.fingerprints(docs.dropDuplicates(["doc_id"])).collect()
    assert len(got) == len(TEXTS)
    order = sorted(IDS)
    for r in got:
        t, following = IDS[r.doc_id], IDS[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == winnowing.as_text(*winnowing.winnow(t)) and r.edited_fingerprint == winnowing.as_text(*winnowing.winnow(new))
        own, e, n = (set(winnowing.winnow(x)[1].tolist()) for x in (t, new, following))
        like = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
        assert (r.near_edited, r.near_next) == (pytest.approx(like(own, e)), pytest.approx(like(own, n)))
    assert winnowing.fingerprints(docs).count() == len(TEXTS) + 1
    assert winnowing.fingerprints(none).count() == 0
    one = winnowing.fingerprints(docs.filter("doc_id = 3 + 7 * 15")).first()
    assert one.near_next == 1.0


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "http://badexample.org/es/", "http://b.com/de/x#f", "http://c.com/fr/", "http://c.com", "http://x.net/a.html", "http://x.net/a/", "http://x.net/a?b", "ftp://y://z/q", "http://x.net/a\n"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 3)], "page_id long, url string, key string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, spark.createDataFrame([("x.net/a",), ("x.net/a",)], "url string")).collect()
    assert len(got) == len(URLS) * 3
    for r in got:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", URLS[r.page_id % len(URLS)] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = host + re.sub(r"(\.html|/+)\Z", "", path) == "x.net/a"
        best = max(fits, default=(0, None, "block" if listed else "allow"))
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == (host, path, best[1], best[2], listed)
    empty = spark.createDataFrame([], "url string")
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), empty).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules, empty).count() == 0


def test_url_filter_takes_every_length_of_rule(spark):
    paths = ["/" + "a" * i for i in range(300)]
    rules = spark.createDataFrame([(f"h{i}.org", p, "block") for i, p in enumerate(paths)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = url_filter.judge(pages, rules, spark.createDataFrame([], "url string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: (f"h{i}.org{p}", "block") for i, p in enumerate(paths)}


def test_url_filter_joins_of_any_size(spark, monkeypatch):
    """Long lists of rules and URLs, hashed after a shuffle, judge like short ones that are broadcast; hot URLs and null ids besides."""
    urls = [f"https://s{i % 7}.net/{'abc'[i % 3]}/{i % 40}.html?q={i}" for i in range(400)] + ["http://s1.net/a/1"] * 200 + [None]
    pages = spark.createDataFrame([(None if i % 9 == 0 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame([(f"s{i}.net", f"/{'abc'[i % 3]}/1", "allow") for i in range(7)], "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"s{i % 7}.net/{'abc'[i % 3]}/{i}",) for i in range(0, 60, 2)], "url string")
    found = []
    for most in (url_filter.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
        found.append(Counter(tuple(r) for r in url_filter.judge(pages, rules, listed).collect()))
    assert found[0] == found[1] and sum(found[0].values()) == len(urls)
    assert len({(r[3], r[4], r[5]) for r in found[0]}) > 4


def test_bloom_never_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = url_filter.BlockedBloom.of(keys)
    inside = np.array([r.h for r in keys.collect()])
    outside = np.array([r.h for r in spark.range(5000, 25000).select(F.xxhash64("id").alias("h")).collect()])
    assert bloom.may_hold(inside).all() and bloom.may_hold(outside).mean() < 0.03
    tiny = url_filter.BlockedBloom.of(keys, max_blocks=4)
    assert tiny.words.shape[0] == 4 and tiny.may_hold(inside).all()


def brute_near(k, ids=None):
    sets = {}
    for i, t in (ids or IDS).items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, none, k):
    want = brute_near(k)
    got = near_dedup.near_duplicates(docs, k=k).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if k == 5:
        left = near_dedup.drop_near_duplicates(docs, k=k)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}
        assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("pairs,heavy", [(2, 100), (16, 100_000)])
def test_near_dedup_of_a_large_group(spark, monkeypatch, pairs, heavy):
    """A group of near copies on both sides of the limit, longer than lists whose members meet directly; few and many broadcast lists."""
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "HEAVY", heavy)
    monkeypatch.setattr(near_dedup, "LONG", 1)
    ids = {i: near(BASE, i % 14) for i in range(160)} | {1000 + i: prose(50) for i in range(40)}
    df = spark.createDataFrame(list(ids.items()), "doc_id long, text string")
    asked = []
    whole = near_dedup.NearDuplicates.by_shingles
    monkeypatch.setattr(near_dedup.NearDuplicates, "by_shingles", lambda self, members: asked.append(members.count()) or whole(self, members))
    got = near_dedup.near_duplicates(df, k=2).collect()
    assert asked and asked[0] > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(2, ids)


def test_near_dedup_of_long_texts_goes_in_bounded_batches(spark, monkeypatch):
    words = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(words[:j] + [f"x{j}"] + words[j + 1 :]) for j in range(0, 4000, 100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    frame = type(df)
    whole = frame.mapInArrow

    def watched(self, func, schema, *rest):
        def run(batches):
            def each():
                for b in batches:
                    if b.num_rows > 1 and b.nbytes > 5_000_000:
                        raise ValueError(f"a batch of {b.nbytes} bytes")
                    yield b

            yield from func(each())

        return whole(self, run, schema, *rest)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = near_dedup.near_duplicates(df, k=5).collect()
    assert {(r.component_id, r.kept) for r in got if r.doc_id} == {(0, False)} and len(got) == len(texts)


def test_near_dedup_of_null_and_reused_ids(spark):
    other, third = prose(40), prose(40)
    rows = [(None, BASE), (None, BASE + " end"), (9, BASE + " tail"), (None, other), (None, other), (4, third), (4, BASE), (3, third + " x"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, k=5).collect())
    assert got == Counter({(None, 4, False): 2, (9, 4, False): 1, (4, 4, True): 1, (None, None, True): 4, (4, 3, False): 1, (3, 3, True): 1})
    left = near_dedup.drop_near_duplicates(df, k=5)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(4, BASE), (3, third + " x"), (None, other), (None, other), (None, None), (None, "")])


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    sf = f"{tmp_path}/sf"
    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(not re.search("xxx|long long", t)), 0) for i, t in IDS.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = rows.columns, dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.stored(stages["quality_classifier"](spark, rows, sf))
    unique = corpus_pipeline.stored(stages["exact_dedup"](spark, good, sf))
    apart = corpus_pipeline.stored(stages["near_dedup"](spark, unique, sf))
    assert good.columns == unique.columns == apart.columns == columns
    texts = {r.doc_id: r.text or "" for r in good.collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    left = {r.doc_id: r.text or "" for r in unique.collect()}
    assert set(left) == {min(g)[1] for g in groups.values()} and unique.count() == len(left)
    assert {r.doc_id for r in apart.collect()} == {i for i, (_, c) in brute_near(5, left).items() if i == c}
    packed = corpus_pipeline.run(spark, sf).collect()
    packed_ok(packed, packing.CAPACITY)
    assert {r.doc_id for r in packed} == {r.doc_id for r in apart.collect()}


def brute_losses(texts, in_target, size):
    """Mean losses of each text under the target and the background model, its own counts left out."""
    split = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    chains = [[None, *w, None] if w else [] for w in split]
    count = lambda c: (Counter(zip(c, c[1:], strict=False)), Counter(c[1:]))
    own = [count(c) for c in chains]
    out = []
    for member in (in_target, [True] * len(texts)):
        pairs, words = Counter(), Counter()
        for m, (p, w) in zip(member, own, strict=True):
            if m:
                pairs.update(p)
                words.update(w)
        total = sum(words.values())
        losses = []
        for c, m, (p, w) in zip(chains, member, own, strict=True):
            loss, rest = 0.0, total - m * sum(w.values())
            for a, b in zip(c, c[1:], strict=False):
                u = (words[b] - m * w[b] + 1) / (rest + size + 1)
                loss -= math.log((pairs[a, b] - m * p[a, b] + lm_score.PRIOR * u) / (words[a] - m * w[a] + lm_score.PRIOR))
            losses.append(loss / max(len(c) - 1, 1))
        out.append(losses)
    return [len(w) for w in split], *out


@pytest.mark.parametrize(("chunk_bytes", "fan"), [(2000, lm_score.FAN), (2000, 8), (1000, 4), (1 << 22, lm_score.FAN)])
def test_lm_score_keeps_every_word_and_bigram(spark, tmp_path, monkeypatch, chunk_bytes, fan):
    """The query against brute force, where most words and bigrams occur once; repeated rows and null ids are scored each."""
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(5, "Rare once only"), (5, "Rare once only"), (None, "lone words here"), (None, "long lone"), (None, "long lone")]
    rows = [(i, t, 0.5, 3, "n", True) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, score double, chunk int, w string, target boolean").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 2 == 0)) for i in range(len(TEXTS))] + [(None, 1), (4, 1), (77777, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size, total = lm_score.sizes(docs)
    words = {x for _, t in texts for x in WORD.findall((t or "").translate(LOWER))}
    assert abs(size - len(words) - 1) <= 0.02 * size and total == sum(len((t or "").encode()) for _, t in texts)
    n, t, g = brute_losses([t for _, t in texts], [i is not None and i < len(TEXTS) and i % 2 == 0 for i, _ in texts], size)
    want = sorted((-1 if i is None else i, *x) for (i, _), *x in zip(texts, n, t, g, strict=True))
    if chunk_bytes <= 2000:
        assert lm_score.levels_of(total // chunk_bytes + 1, fan)[0] == (1 if fan == lm_score.FAN else 2 if fan == 8 else 3)
        got = lm_score.scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").filter("quality = 1").select("doc_id"), chunk_bytes=chunk_bytes, fan=fan).collect()
    else:
        got = lm_score.op1_lm_score(spark, str(tmp_path)).collect()
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.loss_target, r.loss_background) for r in got)
    assert [r[:2] for r in rows] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in rows], [r[2:] for r in want], atol=1e-9)
    assert all(math.isclose(r.score, r.loss_target - r.loss_background, abs_tol=1e-12) for r in got)


def test_lm_score_messages_grow_with_the_input():
    """Messages a chunk stay bounded at any size, and so does what one bucket gets."""
    for chunks in (1, 7, 64, 600, 8192, 10_000, 350_000, 10**6, 35 * 10**6):
        levels, ways = lm_score.levels_of(chunks)
        assert ways <= lm_score.FAN and levels <= 3
        assert chunks / ways**levels <= 8  # a bucket gets what eight chunks ask at most
        assert ways**levels <= max(chunks, 64) * 1.1
    keys = np.unique(np.random.default_rng(5).integers(0, 2**64, 5000, np.uint64))
    one = np.ones(len(keys), np.int64)
    for chunks in (64, 512, 4096):  # each chunk asks for keys of every range
        levels, ways = lm_score.levels_of(chunks, 8)
        sent = [lm_score.questions(c, c, 0, 1, levels, ways, keys, one, one) for c in range(0, chunks, 37)]
        assert {len(x) for x in sent} == {ways} and ways <= 8


def test_lm_score_without_target_or_documents(docs, none):
    no_ids = none.select("doc_id")
    got = lm_score.scores(docs, no_ids).collect()
    size = lm_score.sizes(docs)[0]
    assert len(got) == len(TEXTS) + 1 and all(math.isclose(r.loss_target, math.log(size + 1) * (r.n_words > 0)) for r in got)
    assert lm_score.scores(none, no_ids).count() == 0


def test_null_ids_keep_their_rows(spark, tmp_path):
    """Every operator gives each row with a null id its own result."""
    texts = [(None, "null one " * 20), (None, "null two " * 30), (None, "null two " * 30), (3, "three is here " * 9), (9, "the last one of all " * 8), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = bpe.encode_decode(df, bpe.word_bpe()).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    counts = token_counts.count_tokens(df, token_counts.piece_bpe(), f"file://{tmp_path}/cache").collect()
    assert Counter(r.doc_id for r in counts) == Counter(i for i, _ in texts)
    assert sorted((r.n_bytes, r.n_tokens is None) for r in counts) == sorted((len(t or ""), False) for _, t in texts)
    prints = winnowing.fingerprints(df).collect()
    assert Counter((r.doc_id, r.n_chars) for r in prints) == Counter((i, len(t or "")) for i, t in texts)
    packed = packing.pack_documents(df).collect()
    assert sorted(r.length for r in packed) == sorted(r.n_tokens + 1 for r in got)
    labels = spark.createDataFrame([(3, 1), (9, 0)], "doc_id long, quality int")
    assert quality.scores(df, quality.train(df, labels)).count() == len(texts)
    pages = spark.createDataFrame([(None, "http://a.org/x"), (None, None), (None, "http://a.org/x")], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert Counter((r.host, r.verdict) for r in url_filter.judge(pages, rules, pages.limit(0)).collect()) == Counter({("a.org", "allow"): 2, ("", "allow"): 1})
    turns = [(None, 0, "user", "hi"), (None, 1, "assistant", "there"), (4, 0, "user", "hi"), (4, None, "assistant", "all"), (4, None, "assistant", "all")]
    chats = chat_tree.read_back(*chat_tree.build(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), chat_tree.byte_bpe()), chat_tree.byte_bpe()).collect()
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chats} == {(None, 2, 5), (4, 3, 6)}
