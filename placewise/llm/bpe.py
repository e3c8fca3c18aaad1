"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a chunk are laid end to end as symbols. An index maps every mergeable pair to its positions; the
active ranks are applied in ascending order, all positions of a rank at once, and each merge adds the two pairs it makes
to their lists. Words are independent of each other, so this gives every word the merges it would get alone.

The tokenizer file (tokenizers JSON) must be a BPE with NFC, white space and lower-case normalisation, a split pattern,
byte-level symbols, a word-end suffix and no decoder; others are refused. White space separates words whatever the pattern, so words
between white space are encoded once and kept in a table of bounded size per worker.

Nulls count as empty texts: no tokens. Repeated rows give repeated results. Texts are encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from placewise.llm import common as C

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEPT_WORDS = 200_000  # size of a worker's word table; when full it is started anew
# what the normaliser's \s stands for; str.split() would also split at the separators 1C to 1F
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = regex.compile("[\x1c-\x1f]")


class Bpe:
    """Encoder and decoder of one tokenizer file, given as its JSON text."""

    def __init__(self, spec: str):
        tok = json.loads(spec)
        model = tok["model"]
        kinds = [n["type"] for n in tok["normalizer"]["normalizers"]]
        split, level = tok["pre_tokenizer"]["pretokenizers"]
        if (model["type"], kinds, level["type"], tok["decoder"], tok["post_processor"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "ByteLevel", None, None):
            raise ValueError("unsupported tokenizer file")
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in tok["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[symbols[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        by_key = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[by_key], by_key  # a pair's place in the file is its rank
        self.made = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.kept: dict[str, tuple[bytes, bytes]] = {}

    def pieces(self, word: str) -> list[str]:
        """What the split pattern makes of a word between white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # lower() would look for a word's last one
        word = word.lower()
        return [word] if word.isalpha() else self.pattern.findall(word)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (their UTF-8 bytes) end to end, and where each word's begin (one more than words)."""
        begin = np.cumsum([0, *map(len, words)])
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        sym = self.inner[data]
        sym[begin[1:] - 1] = self.last[data[begin[1:] - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[begin[1:] - 1] = before[begin[:-1]] = -1
        where: dict[int, list[np.ndarray]] = {}  # positions by the rank of the pair that starts there
        active: list[int] = []

        def note(left: np.ndarray) -> None:
            keys = sym[left] << 32 | sym[after[left]]
            found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[found] == keys
            left, rank = left[known], self.pair_ranks[found[known]]
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            cuts = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    r = int(rank[a])
                    if r not in where:
                        where[r] = []
                        heapq.heappush(active, r)
                    where[r].append(left[a:b])

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.made[rank]
            listed = where.pop(rank)
            i = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
            i = i[(sym[i] == a) & (after[i] >= 0)]
            i = i[sym[after[i]] == b]  # earlier merges took parts of the others
            if a == b and len(i):
                i = _alternate(i, after)
            j = after[i]
            k = after[j]
            sym[i], sym[j] = new, -1
            after[i] = k
            on = k >= 0
            before[k[on]] = i[on]
            note(np.concatenate((i[on], before[i][before[i] >= 0])))
        alive = sym >= 0
        return sym[alive], np.concatenate(([0], np.cumsum(alive)))[begin]

    def learn(self, words: set[str]) -> None:
        """Puts the encoding of each word into the table: its ids as bytes, and its decoded text."""
        cut = [(w, self.pieces(w)) for w in words]
        distinct = list({p for _, pieces in cut for p in pieces})
        if not distinct:
            return
        flat, begin = self.merge([p.encode() for p in distinct])
        flat, begin = flat.tolist(), begin.tolist()
        ids = {p: flat[a:b] for p, a, b in zip(distinct, begin, begin[1:])}
        for w, pieces in cut:
            self.kept[w] = self._kept(ids[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids[p]])

    def _kept(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), self.decode(ids).encode()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; without a decoder the tokens are joined by blanks."""
        return " ".join([self.token[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """Words between white space; a special token is a word of its own, marked by a leading blank."""
        out = []
        for no, part in enumerate(self.specials.split(text) if "<" in text else [text]):
            if no % 2:
                out.append(" " + part)
            elif ODD.search(part):
                out.extend(w for w in SPACE.split(part) if w)
            else:
                out.extend(part.split())
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text: its ids as 32-bit little-endian integers, and the decoded text in UTF-8."""
        split = [self.words(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        fresh = set().union(*split) - self.kept.keys()
        for special, i in self.special.items():
            if " " + special in fresh:
                fresh.discard(" " + special)
                self.kept[" " + special] = self._kept([i])
        self.learn(fresh)
        out, kept = [], self.kept
        for words in split:
            found = [kept[w] for w in words]
            out.append((b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])))
        return out


def _alternate(i: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs of equal symbols that overlap, the first, third, ... of each run."""
    at = np.arange(len(i))
    follows = np.concatenate(([False], after[i[:-1]] == i[1:]))
    first = np.maximum.accumulate(np.where(follows, 0, at))
    return i[(at - first) % 2 == 0]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BUILT: dict[str, Bpe] = {}


def bpe_codes(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers) and decoded (UTF-8) of every text. ``tokenizer`` is the file's path."""
    return _mapped(df, tokenizer, id_col, text_col, "doc_id long, ids binary, decoded binary",
                   lambda ids, text: {"ids": ids, "decoded": text})


def bpe_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The number of tokens and the SHA-256 of ``bpe_codes``'s two columns, without shipping them."""
    def digest(ids, text):
        return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
                "decoded_sha256": hashlib.sha256(text).hexdigest()}

    return _mapped(df, tokenizer, id_col, text_col, SCHEMA, digest)


def _mapped(df, path, id_col, text_col, schema, row):
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not follow the data

    key = hashlib.sha256(spec.value.encode()).hexdigest()

    def one(batch):
        if key not in _BUILT:
            _BUILT[key] = Bpe(spec.value)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = [row(*codes) for codes in _BUILT[key].encode(texts)]
        return {"doc_id": batch.column("doc_id"), **{n: pa.array([r[n] for r in rows]) for n in rows[0]}}

    return C.per_chunk(C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col), schema, one)
