"""Byte-pair encoding by speculation and verification, and decoding.

A pretoken's bytes are first cut greedily into the longest vocabulary entries.
That proposal is the exact encoding if and only if each adjacent pair of it is
stable, that is, if merging the pair's bytes from scratch gives back the pair.
Stability is tested for all distinct pairs of a batch at once in numpy: the last
merges on the inner edges of both tokens are undone from the latest on, and a
pair is unstable if at any stage the two tokens that touch would have merged
before the later of the undone merges. Only words with an unstable pair are
merged exactly, by rank, with a heap. Entries that do not encode to themselves
are never proposed.

The vocabulary is a file in the `tokenizers` JSON format with a byte-level BPE
model and no normaliser; its path is a parameter. It is read on the driver and
broadcast (a fixed 50 thousand entries). Added tokens in a text are matched first,
as that library does by default. Results are cached by pretoken in each worker, up
to a bound of entries and of bytes. A file with another pre-tokeniser, or with added
tokens that take spaces or whole words only, is refused.

Special cases: null and empty texts have no ids and decode to ""; whole texts of
any length are encoded; of two merges of equal rank the left one comes first; a null
id is kept; repeated rows get a row each; an empty table gives an empty result;
extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .blocks import lean

SLICE_BYTES = 2 << 20
CACHE_WORDS, CACHE_BYTES = 500_000, 96 << 20
#: Up to this many bytes, a word is merged in a plain list.
SHORT = 48
NEVER = 1 << 30
#: Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Vocabulary, merge trees and cache."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if data.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normaliser, dropout or prefix space is needed")
        if data["pre_tokenizer"]["type"] != "ByteLevel" or not data["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only the byte-level pre-tokeniser with its own pattern is known")
        if any(a.get(k) for a in data["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens must not take spaces or whole words only")
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.added = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.vocab: dict[bytes, int] = {}
        self.bytes: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.added.values()]) + 1)
        for t, i in model["vocab"].items():
            if t not in self.added:
                self.bytes[i] = bytes(to_byte[c] for c in t)
                self.vocab[self.bytes[i]] = i
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        n = len(self.bytes)
        self.rank = np.full(n, -1)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        self.made_by: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib, ic = (model["vocab"][x] for x in (a, b, a + b))
            self.merges[ia, ib] = (r, ic)
            self.rank_of[ia << 20 | ib] = r
            self.made_by.append(ic)
            if self.rank[ic] < 0:
                self.rank[ic], self.left[ic], self.right[ic] = r, ia, ib
        order = sorted(self.merges)
        self.pair_keys = np.array([a << 32 | b for a, b in order], np.int64)
        self.pair_rank = np.array([self.merges[p][0] for p in order], np.int64)
        self.single = {b: self.vocab[bytes([b])] for b in range(256) if bytes([b]) in self.vocab}
        self.proposed = {b: i for b, i in self.vocab.items() if len(b) == 1 or self.merged(b) == [i]}
        self.longest: dict[bytes, int] = {}
        for b in self.proposed:
            if len(b) <= 2:
                self.longest[b] = len(b)
        for b in self.proposed:
            if len(b) > 2:
                self.longest[b[:3]] = max(self.longest.get(b[:3], 1), len(b))
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda t: [t]
        self.stable: dict[int, bool] = {}
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.cached = 0

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding: the lowest rank first, from the left."""
        ids: list[int] = [self.single[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            return self._merged_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(r, i, c, a, b) for r, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, c, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((c, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], c, ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], c))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], c))
        return [x for x in ids if x >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        """The same over a list of the neighbours' ranks."""
        rank, made = self.rank_of.get, self.made_by
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NEVER:
                break
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def greedy(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        proposed, longest = self.proposed, self.longest
        while i < n:
            k = longest.get(word[i : i + 3]) or longest.get(word[i : i + 2], 1)
            while (t := proposed.get(word[i : i + k])) is None:
                k -= 1
            out.append(t)
            i += k
        return out

    def unstable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair from scratch would not give back the pair."""
        bad = np.zeros(len(a), bool)
        far = np.iinfo(np.int64).max
        until_a, until_b = np.full(len(a), far), np.full(len(a), far)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], far)
            # Of equal ranks the merge further left comes first.
            now = (rank < until_a) & (rank <= until_b) & (rank < far)
            bad[live[now]] = True
            ra, rb = self.rank[a], self.rank[b]
            undo_a = ra > rb
            undo_b = ~undo_a & (rb >= 0)
            until_a, until_b = np.where(undo_a, ra, until_a), np.where(undo_b, rb, until_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            on = ~now & (undo_a | undo_b)
            live, a, b, until_a, until_b = live[on], a[on], b[on], until_a[on], until_b[on]
        return bad

    def learn(self, words: set[str]) -> tuple[int, int]:
        """Puts the encodings of new pretokens in the cache; (words, words merged exactly)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        made = [self.greedy(b) for b in raw]
        sizes = np.array([len(x) for x in made], np.int64)
        flat = np.fromiter((t for x in made for t in x), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(made)), sizes)
        pair = np.flatnonzero(word[1:] == word[:-1])
        codes, number = np.unique(flat[pair] << 32 | flat[pair + 1], return_inverse=True)
        new = np.array([c not in self.stable for c in codes.tolist()], bool)
        if new.any():
            bad = self.unstable(codes[new] >> 32, codes[new] & 0xFFFFFFFF)
            self.stable.update(zip(codes[new].tolist(), (~bad).tolist(), strict=True))
        good = np.array([self.stable[c] for c in codes.tolist()], bool)
        failing = np.unique(word[pair[~good[number]]]) if len(pair) else []
        for k in failing:
            made[k] = self.merged(raw[k])
        for w, x in zip(words, made, strict=True):
            self.ids[w] = ",".join(map(str, x))
            self.decoded[w] = b"".join([self.bytes[i] for i in x])
            self.cached += len(self.ids[w]) + 2 * len(w)
        return len(made), len(failing)

    def pretokens(self, text: str) -> list[str]:
        if any(a in text for a in self.added):
            return [t for k, part in enumerate(self.split(text)) for t in ([part] if k % 2 else self.find(part))]
        return self.find(text)

    def prepare(self, texts: list[list[str]]) -> None:
        words = set().union(*texts) if texts else set()
        if len(self.ids) + len(words) > CACHE_WORDS or self.cached > CACHE_BYTES:
            for cache in (self.ids, self.decoded, self.stable):
                cache.clear()
            self.cached = 0
        if not self.ids:
            for a, i in self.added.items():
                self.ids[a], self.decoded[a] = str(i), self.bytes[i]
        new = words.difference(self.ids)
        if new:
            self.learn(new)


_codecs: dict[int, Codec] = {}


def codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): decimal ids joined by commas, and the text decoded from them."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in T.slices(batch, "text", SLICE_BYTES):
                texts = [c.pretokens(t) if t else [] for t in part.column("text").to_pylist()]
                c.prepare(texts)
                ids, decoded = c.ids.__getitem__, c.decoded.__getitem__
                joined = [",".join(map(ids, t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x.count(",") + 1 if x else 0 for x in joined], pa.int64()), pa.array(joined, pa.string()), pa.array([b"".join(map(decoded, t)).decode("utf-8", "replace") for t in texts], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids string, decoded string")
