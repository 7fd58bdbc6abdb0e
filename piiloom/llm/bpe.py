"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array.  A pair of neighbours is one
integer key; its rank is found by binary search over the sorted keys of all
merges.  Each round merges in every word its pair of lowest rank, from the left,
and looks up again only the pairs that a merge touched; a word without a ranked
pair leaves the array.

Defined results: a null text counts as empty and has no ids (the digests are
those of the empty string); a text of white space likewise.  Texts are encoded
whole, in blocks of bounded size between texts.  Repeated rows give equal rows.
The strings of special tokens in a text become their ids, as the format has it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the Unicode property, as the format's normaliser has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Code points that the regex module counts as letters or numbers and the
#: format's older Unicode tables do not.
_UNASSIGNED = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd"
    "\\ua7e2\\ua7f1\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7"
    "\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f"
    "\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168"
    "\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff"
    "\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed"
    "\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead"
    "\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f")
#: Lower case of letters newer than Python's tables.
_LATE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
               **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
               **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
_CACHE_WORDS = 300_000
_BLOCK_WORDS = 40_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


class WordBpe:
    """Encoder of a lower-casing word-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [""] * size
        for text, i in {**vocab, **self.special}.items():
            self.token[i] = text
        self.number = [str(i) for i in range(size)]
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # a key listed twice keeps its first, lower rank
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) != 0])
        self.keys, self.rank, self.made = keys[order][first], order[first], made[order][first]
        self.none = len(pairs)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                     if p["type"] == "Split")
        for kind in ("\\p{L}", "\\p{N}"):
            split = split.replace(kind, f"[{kind}--[{_UNASSIGNED}]]")
        self.words = regex.compile(split.replace("\\s", _SPACE), regex.V1)
        self.space = regex.compile(f"[{_SPACE}]+")
        self.late = re.compile("[" + "".join(map(chr, _LATE_LOWER)) + "]")
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.cache: dict[str, tuple[str, str, int]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``none``) and merged symbol of each pair, by binary search."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], self.none), self.made[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words, one after another, and how many each word has."""
        raw = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbol = self.inner[data]
        last = np.cumsum(length) - 1
        symbol[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), length)
        rank = np.full(len(symbol), self.none, dtype=np.int64)
        made = np.zeros(len(symbol), dtype=np.int64)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at], made[at] = self.ranks(symbol[at], symbol[at + 1])
        done_word, done_symbol = [], []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ends = np.append(starts[1:], len(symbol))
            least = np.minimum.reduceat(rank, starts)
            ended = least == self.none
            keep = np.repeat(~ended, ends - starts)
            done_word.append(word[~keep])
            done_symbol.append(symbol[~keep])
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            if not len(symbol):
                break
            best = np.repeat(least[~ended], (ends - starts)[~ended])
            hit = rank == best
            at = np.flatnonzero(hit)
            # of a run of overlapping hits (one symbol repeated), every other one merges
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[nth % 2 == 0]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            touched = np.zeros(len(symbol), dtype=bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            touched[np.maximum(at - 2, 0)] |= ~keep[np.maximum(at - 1, 0)]
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            again = np.flatnonzero(touched[keep])
            rank[again] = self.none
            again = again[again + 1 < len(symbol)]
            again = again[word[again] == word[again + 1]]
            rank[again], made[again] = self.ranks(symbol[again], symbol[again + 1])
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbol)[order], np.bincount(word, minlength=len(raw))

    def pieces(self, text: str) -> list[str]:
        """The parts of a text between white space, normalised, special tokens among them.

        No word reaches over white space, so each part is encoded by itself and
        a part seen before is not looked at again.
        """
        if "<|" not in text:
            return self._plain(text)
        out, start = [], 0
        for m in self.specials.finditer(text):
            out += [*self._plain(text[start:m.start()]), m[0]]
            start = m.end()
        return out + self._plain(text[start:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
            try:
                text.encode("latin-1")  # the quick way to see that none of the late letters is there
            except UnicodeEncodeError:
                if self.late.search(text):
                    text = text.translate(_LATE_LOWER)
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return [p for p in self.space.split(text) if p]
        return text.split()

    def remember(self, parts: Iterable[str]) -> None:
        """Encode the parts that the cache lacks, all in the same merge rounds."""
        parts = set(parts)
        new = [p for p in parts if p not in self.cache]
        if len(self.cache) + len(new) > _CACHE_WORDS:
            self.cache.clear()
            new = list(parts)
        for i in range(0, len(new), _BLOCK_WORDS):
            block = new[i:i + _BLOCK_WORDS]
            words: list[str] = []
            ends = []
            for part in block:
                if part.isascii() and part.isalpha():
                    words.append(part)
                elif part not in self.special:
                    words += self.words.findall(part)
                ends.append(len(words))
            ids, size = self.encode_words(words) if words else (np.empty(0, int), [0])
            reach = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
            ids = ids.tolist()
            number = [self.number[k] for k in ids]
            token = [self.token[k] for k in ids]
            start = 0
            for part, end in zip(block, reach, strict=True):
                self.cache[part] = (" ".join(number[start:end]), " ".join(token[start:end]),
                                    end - start)
                start = end
            for part in self.special.keys() & set(block):
                self.cache[part] = (str(self.special[part]), part, 1)

    def encode(self, text: str | None) -> list[int]:
        words = list(self.pieces(text or ""))
        self.remember(words)
        return [int(i) for w in words for i in self.cache[w][0].split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special ones too; the format has no decoder of its own."""
        return " ".join([self.token[i] for i in ids])


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 ids: bool = False, block_chars: int = 1_000_000) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each row, and ``ids`` if asked for.

    ``path`` names a vocabulary file that every worker can read.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = source.schema["key"].dataType.simpleString()
    schema = (f"key {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
              + ", ids array<int>" * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                block, size = [], 0
                while at + len(block) < len(texts) and (not block or size < block_chars):
                    value = texts[at + len(block)].as_py() or ""
                    block.append(list(bpe.pieces(value)))
                    size += len(value)
                bpe.remember([w for words in block for w in words])
                found = [[bpe.cache[w] for w in words] for words in block]
                coded = [" ".join([f[0] for f in row]) for row in found]
                plain = [" ".join([f[1] for f in row]) for row in found]
                arrays = [keys.slice(at, len(block)),
                          pa.array([sum([f[2] for f in row]) for row in found], pa.int64()),
                          pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coded]),
                          pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain])]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    arrays.append(pa.array([list(map(int, x.split())) for x in coded],
                                           pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
                at += len(block)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_ids(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: the decoded text of each list of ids; null for a null list."""
    source = rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    key_type = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for batch in batches:
            texts = [None if v is None else bpe.decode(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             ["key", "text"])

    return source.mapInArrow(run, f"key {key_type}, text string").withColumnRenamed("key", key)
