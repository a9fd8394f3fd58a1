"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

Encoding. A pretoken is fed to the transducer in windows. From the merge list alone a lookahead is computed
that is enough for every text: a token that ends at least that many bytes before the known end can't change
whatever follows, so it is emitted and its bytes are forgotten. What stays in memory is one window, however long
the pretoken is. Windows of many pretokens are merged side by side with array operations.

Sufficient lookahead. Two continuations of a text differ first at its end. A merge (x, y) can come out differently
if its bytes reach over the end: it alters at most |xy| - 1 known bytes. It can also come out differently because an
earlier merge (u, v) did, whose altered part begins where y begins; then y is u, or is built upon u from its left
edge, and the altered part grows by |x|. Ranks rise along such a chain, so one pass over the merge list gives the
longest one.

Decoding. Tokens come one by one; bytes of unfinished characters are held back until they are complete (or are found
invalid, which gives U+FFFD).

Edge cases: null counts as empty, an empty text has no tokens and decodes to the empty string. Repeated rows are
encoded each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slidejobs.functions.storage import table

NONE = np.int32(2**31 - 1)
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words with one of these need the exact classes of the pattern; for others, those of re are the same.
_RARE = re.compile("[\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u017f]")
#: Rows with one of these go word by word: special tokens, and characters that array functions split or lower in another way.
_ODD = "[\\x00\\x1c-\\x1f]|\u0130|<\\|"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Pair lookup by open addressing in arrays, and the lookahead of a merge list."""

    def __init__(self, merges: list[tuple[int, int]], made: list[int], size: list[int]):
        """merges: pairs of ids by rank; made: the id each gives; size: bytes of each id."""
        self.made, self.max_token = np.array(made or [0], np.int32), max(size, default=1)
        born: dict[int, int] = {}
        for rank, t in enumerate(made):
            born.setdefault(t, rank)
        #: Every token has one merge and none is used before it is made: all places of a pair can then be merged at once.
        self.proper = len(born) == len(made) and all(max(born.get(a, -1), born.get(b, -1)) < r for r, (a, b) in enumerate(merges))
        self.lookahead = sufficient_lookahead(merges, made, size)
        keys = np.array([a << 32 | b for a, b in merges], np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 5))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left, self.probes = self._hash(keys), np.arange(len(keys)), 0
        while len(left):
            slot = (at[left] + self.probes) & ((1 << self.bits) - 1)
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.ranks[slot[first]] = keys[left[first]], left[first]
            left, self.probes = np.delete(left, first), self.probes + 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot, mask = self._hash(keys), (1 << self.bits) - 1
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        for p in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + p) & mask
            k = self.keys[s]
            hit = k == keys[open_]
            out[open_[hit]] = self.ranks[s[hit]]
            open_ = open_[~hit & (k != -1)]
        return out

    def apply(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every segment of ids (lens: their lengths, all > 0) to the end. Returns ids and lengths, in the same order."""
        seg = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        done_ids, done_seg = [], []
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, np.diff(np.r_[starts, len(ids)]))
            over = each == NONE
            if over.any():
                done_ids.append(ids[over])
                done_seg.append(seg[over])
                left = ~over
                ids, seg, rank, each = ids[left], seg[left], rank[left], each[left]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == each)
            if self.proper:  # of a run of overlapping places, every second one
                begin = np.r_[True, np.diff(at) != 1]
                if not begin.all():
                    k = np.arange(len(at))
                    at = at[((k - np.maximum.accumulate(np.where(begin, k, 0))) & 1) == 0]
            else:  # the leftmost of each segment
                at = at[np.r_[True, seg[at][1:] != seg[at][:-1]]]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, seg, rank = ids[keep], seg[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged ones stand now
            for i in (at, at[at > 0] - 1):
                rank[i] = NONE
                i = i[i + 1 < len(ids)]
                i = i[seg[i] == seg[i + 1]]
                rank[i] = self.rank(ids[i], ids[i + 1])
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
        ids, seg = np.concatenate(done_ids), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return ids[order], np.bincount(seg, minlength=len(lens))


def sufficient_lookahead(merges: list[tuple[int, int]], made: list[int], size: list[int]) -> int:
    """Bytes before the known end of a text beyond which no continuation changes a token (see the module's text)."""
    parts: dict[int, list[int]] = {}
    for (a, _), t in zip(merges, made, strict=True):
        parts.setdefault(t, []).append(a)
    reach: dict[int, int] = {}  # by left part of a merge
    most = 0
    for x, y in merges:
        grown, edge, seen = size[x] + size[y] - 1, [y], set()
        while edge:  # y and all that it is built upon from its left edge
            t = edge.pop()
            if t in seen:
                continue
            seen.add(t)
            grown = max(grown, size[x] + reach.get(t, -size[x]))
            edge += parts.get(t, ())
        reach[x] = max(reach.get(x, 0), grown)
        most = max(most, grown)
    return most


class Encoder:
    """A byte-level BPE tokenizer file (JSON with end-of-word suffix, or without). One per Python worker."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, chunk: int = 1024):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.text_of: dict[int, str] = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        top = max(self.text_of) + 1
        self.id_text = [str(i) for i in range(top)]
        self.token_bytes = [self.text_of.get(i, "").encode() for i in range(top)]
        plain = lambda t: t[: -len(end)] if end and t.endswith(end) and t != end else t
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = [0] * top
        for t, i in vocab.items():
            size[i] = len(plain(t))
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs], size)
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last_id = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        self.size = np.array(size, np.int64)
        back = {c: b for b, c in letters.items()}
        self.raw_bytes = [bytes(back[c] for c in plain(t)) + (b" " if end and t != plain(t) else b"") if all(c in back for c in plain(t)) else t.encode() for t in (self.text_of.get(i, "") for i in range(top))]
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer", {}).get("type") == "Sequence" else [spec.get("normalizer") or {}]
        kinds = [s.get("type") for s in steps]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"this tokenizer file normalises in another way: {kinds}")
        self.pattern, self.pattern_nl = regex.compile(split), regex.compile(split + "|\n")
        self.common_nl = re.compile(split.replace(r"[\p{L}]+", r"[^\W\d_]+").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+") + "|\n")
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.window = chunk + self.merges.lookahead + 1
        self.chunk = max(chunk, self.merges.max_token)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def pretokens(self, word: str) -> list[str]:
        """Of a piece of text without white space or special tokens."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = word.lower() if "Σ" not in word else "".join(c.lower() for c in word)  # each letter by itself
        return [word] if word.isalpha() else self.pattern.findall(word)

    def transduce(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pretokens (their bytes one after the other, and their lengths), and their number for each."""
        begin = np.cumsum(lens) - lens
        at = begin.copy()  # first byte of each pretoken that isn't emitted yet
        stop = begin + lens
        live = np.flatnonzero(lens)
        out_ids, out_seg = [], []
        while len(live):
            n = np.minimum(stop[live] - at[live], self.window)  # never 0: a pretoken has a byte
            first = np.cumsum(n) - n
            where = np.repeat(at[live] - first, n) + np.arange(n.sum())
            ids = self.byte_id[flat[where]]
            whole = at[live] + n == stop[live]
            last = (first + n - 1)[whole]
            ids[last] = self.last_id[flat[where[last]]]
            ids, k = self.merges.apply(ids, n)
            seg = np.repeat(np.arange(len(live)), k)
            ends = np.cumsum(self.size[ids]) - np.repeat(first, k)
            stable = whole[seg] | (ends <= (n - 1 - self.merges.lookahead)[seg])
            out_ids.append(ids[stable])
            out_seg.append(live[seg[stable]])
            far = np.zeros(len(live), np.int64)
            np.maximum.at(far, seg[stable], ends[stable])
            at[live] += far
            live = live[~whole]
        ids, seg = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out_seg))
        order = np.argsort(seg, kind="stable")
        return ids[order], np.bincount(seg.astype(np.int64), minlength=len(lens))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many different lowered words without special tokens or NUL; where each word's begin, and their number."""
        alone = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)  # one pretoken
        letters = words.filter(pa.array(alone))
        joined = "\n".join(words.filter(pa.array(~alone)).to_pylist())
        found = (self.pattern_nl if _RARE.search(joined) else self.common_nl).findall(joined)
        raw = np.frombuffer("\0".join([*found, "\n", ""]).encode(), np.uint8)
        stop = np.flatnonzero(raw == 0)
        begin = np.r_[0, stop[:-1] + 1]
        breaks = raw[begin] == 10
        keep = raw != 0
        keep[begin[breaks]] = False
        text = np.frombuffer(letters.buffers()[2] if len(letters) else b"", np.uint8)
        size = pc.binary_length(letters).to_numpy().astype(np.int64)
        ids, k = self.transduce(np.concatenate([text[: size.sum()], raw[keep]]), np.concatenate([size, (stop - begin)[~breaks]]))
        ends = np.cumsum(np.r_[0, k])
        at = np.flatnonzero(breaks) - np.arange(breaks.sum()) + len(letters)  # pretokens before the end of each word
        start, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[alone], n[alone] = ends[: len(letters)], k[: len(letters)]
        if len(letters) < len(words):
            rest = np.r_[ends[len(letters)], ends[at]]
            start[~alone], n[~alone] = rest[:-1], np.diff(rest)
        return ids, start, n

    def encode_odd(self, text: str) -> bytes:
        out = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.specials:
                out.append(self.specials[part].to_bytes(4, "little"))
                continue
            pre = [x.encode() for w in _SPACES.split(part) for x in self.pretokens(w)]
            ids, _ = self.transduce(np.frombuffer(b"".join(pre), np.uint8), np.array([len(x) for x in pre], np.int64))
            out.append(ids.astype("<u4").tobytes())
        return b"".join(out)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (no nulls) as little-endian unsigned 32-bit numbers. Equal words are encoded once."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = texts.filter(pc.invert(odd))
        if not pc.all(pc.string_is_ascii(plain)).as_py():
            plain = pa.array([t if t.isascii() else unicodedata.normalize("NFC", t) for t in plain.to_pylist()], pa.string())
        plain = pc.utf8_lower(plain)
        split = pc.utf8_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        if len(split) and len(words):
            ids, start, k = self.words(words.dictionary)
            at = words.indices.to_numpy()
            n = k[at]
            ends = np.cumsum(n)
            where = np.repeat((start[at] - ends + n).astype(np.int32), n)
            where += np.arange(len(where), dtype=np.int32)
            flat = ids.astype("<u4")[where].tobytes()
            cuts = (np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()] * 4).tolist()
        else:
            flat, cuts = b"", [0] * (len(split) + 1)
        rows = iter(zip(cuts, cuts[1:], strict=False))
        return [self.encode_odd(t.as_py()) if o else flat[slice(*next(rows))] for t, o in zip(texts, odd.to_pylist(), strict=True)]


class TextDecoder:
    """Ids to text, any number at a time. glue: what stands between two tokens' bytes; pieces: the bytes of each id."""

    def __init__(self, pieces: list[bytes], glue: bytes = b""):
        self.pieces, self.glue, self.begun = pieces, glue, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if not len(ids):
            return ""
        raw = self.glue.join(map(self.pieces.__getitem__, ids))
        if self.begun:
            raw = self.glue + raw
        self.begun = True
        return self.state.decode(raw)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def slices(texts: pa.Array, most: int = 1 << 23) -> Iterator[slice]:
    """Runs of texts with together about `most` bytes, so that what is held at once stays small."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // most
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def over_texts(docs: DataFrame, schema: str, make: Callable[[pa.Array, pa.Array], list[pa.Array]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """make(ids, texts) gives the columns of `schema` for a run of rows; the runs are bounded by bytes."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(1), 1 << 21):
                yield pa.RecordBatch.from_arrays(make(b.column(0)[part], b.column(1)[part]), names)

    return rows.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, step: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs; ids array and decoded text on request.

    decoded: as a tokenizer file without a decoder gives it, tokens joined by single spaces.
    """

    def make(doc_ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        enc = Encoder.at(path)
        n, a, b, ids_out, text_out = [], [], [], [], []
        for raw in enc.encode(texts):
            ids = memoryview(raw).cast("I")
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(enc.id_text.__getitem__, ids)).encode()).hexdigest())
            dec, sha, kept = TextDecoder(enc.token_bytes, b" "), hashlib.sha256(), []
            for i in range(0, len(ids), step):
                sha.update((t := dec.feed(ids[i : i + step])).encode())
                kept.append(t)
            kept.append(t := dec.finish())
            sha.update(t.encode())
            b.append(sha.hexdigest())
            if keep_ids:
                ids_out.append(list(ids))
                text_out.append("".join(kept))
        return [doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] + ([pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())] if keep_ids else [])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return over_texts(docs, schema, make, id_col, text_col)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), word_bpe())
