"""Token counts of byte-level BPE vocabularies, by rank-synchronous merging of batched pre-tokens."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.ragged import Merges
from bytelake.llm.shared import bounded_batches

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points outside these ranges may have another class in the library's Unicode version than in this one's.
ODD = regex.compile("[^\u0000-՗ -₎₠-⯿　-龥가-힣\U0001f600-\U0001f64f]")
CACHE = 300_000  #: pre-tokens whose counts a task keeps; then it starts over


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of whole texts as the library does for a byte-level BPE `file` (.json), without special tokens added."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is counted here")
        self.file, vocab = file, model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs])
        self.ids = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that depend on what stands around them aren't read")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}
        self.library = None

    def split(self, text: str) -> list[str]:
        if ODD.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.file).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return PATTERN.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            parts, special = [text], 0
            if self.special and (found := self.special.findall(text)):
                parts, special = self.special.split(text), len(found)
            out.append(special)
            tokens = [t for p in parts if p for t in self.split(p)]
            waiting.append((i, tokens))
            size += len(tokens)
            if size > 400_000:
                self._add(waiting, out)
                waiting, size = [], 0
        self._add(waiting, out)
        return out

    def _add(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self.known) > CACHE:
            self.known = {}
        new = set().union(*(t for _, t in waiting)).difference(self.known) if waiting else set()
        if new:
            new = sorted(new, key=len)
            for at in range(0, len(new), 50_000):
                self.known.update(zip(new[at : at + 50_000], self.encode(new[at : at + 50_000]).tolist()))
        get = self.known.__getitem__
        for i, tokens in waiting:
            out[i] += sum(map(get, tokens))

    def encode(self, words: list[str]) -> np.ndarray:
        """The number of symbols that survive in each pre-token."""
        raw = [w.encode() for w in words]
        seq = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        _, left = self.merges.merge(self.ids[np.frombuffer(b"".join(raw), np.uint8)], seq)
        return np.bincount(left, minlength=len(raw))


@lru_cache(2)
def counter(file: str) -> Counter:
    return Counter(file)


def token_counts(docs: DataFrame, file: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), of whole texts.

    `file`: a byte-level BPE tokenizer file that every executor has. A special token's string inside a text counts as
    that token. Null and empty texts have no bytes and no tokens; repeated rows are counted each; other columns are
    not read; an empty table gives no rows.
    """

    def run(batches):
        c = counter(file)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
