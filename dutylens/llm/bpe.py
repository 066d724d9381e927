"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs by binary search over the
sorted pair keys, takes the lowest rank of every word and merges all its places, until no pair of any word is in the
merge table. Text is cut into words by the tokenizer file's own normaliser and pre-tokeniser, once per distinct run
between blanks; the merges, ids and decoding are ours.

Merging all places of the lowest rank at once equals merging one place at a time as long as no merge makes a symbol
that takes part in an earlier merge; `Merges` tests that for the file and merges only the leftmost place otherwise.

Cases: a null text is the empty text and has no tokens; strings of special tokens in a text become their ids, as in
the library; very long texts and words are encoded whole; repeated rows are encoded alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutylens.llm.common import keep_for, let_go, use_workers, with_columns_apart

#: Distinct runs of text between blanks whose encoding a worker keeps, in each of two generations.
CACHED_RUNS = 250_000
#: White space of the tokenizer files, that is of Unicode.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NONE = np.iinfo(np.int64).max


class Merges:
    """The merge table of a `tokenizers` BPE file."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        self.vocab, self.suffix, self.base = vocab, suffix, max(vocab.values(), default=0) + 1
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, rank = left * self.base + right, np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order], made
        # does any merge use a symbol that is made at its own rank or later?
        latest = np.full(self.base, -1, np.int64)
        np.maximum.at(latest, made, rank)
        self.ordered = bool(np.all(np.maximum(latest[left], latest[right]) < rank)) if len(pairs) else True

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(a):
            return np.full(len(a), NONE)
        k = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.rank[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which are in the file's own alphabet, in one array, and where each word's end."""
        ids, lens, look, end = [], [], self.vocab, self.suffix
        for w in words:
            s = [look[c] for c in w[:-1] if c in look]
            if w and (w[-1] + end) in look:
                s.append(look[w[-1] + end])
            ids += s
            lens.append(len(s))
        sym, word = np.array(ids, np.int64), np.repeat(np.arange(len(words)), np.array(lens, np.int64))
        rank = self._ranks_within(sym, word)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, first), sizes)
            done = low == NONE
            if done.any():
                done_sym.append(sym[done])
                done_word.append(word[done])
                sym, word, rank, low = sym[~done], word[~done], rank[~done], low[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            if self.ordered:  # of places that overlap, as in "aaa", every second one from the left of its run
                run = np.r_[True, np.diff(at) > 1]
                start = at[run][np.cumsum(run) - 1]
                at = at[(at - start) % 2 == 0]
            else:
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols are after the cut
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.r_[moved, moved - 1]
            touched = touched[touched >= 0]
            rank[touched] = NONE
            inner = touched[touched < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        if not done_sym:
            return sym, np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(words)))

    def _ranks_within(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(sym) else np.empty(0, np.int64)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        return rank


class Coder:
    """Encodes and decodes whole texts with a `tokenizers` BPE file that has no decoder or post-processor."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, lib = spec["model"], Tokenizer.from_file(path)
        self.normalise = lib.normalizer.normalize_str if lib.normalizer else (lambda x: x)
        self.lower = self.normalise("AbC!") == "abc!"  # then ASCII text need not go through the library
        self.cut = lib.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.number = [str(i) for i in range(max(names) + 1)]
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.runs: dict[str, tuple[int, str, str]] = {}
        self.void = False  # was there ever a run without tokens?
        self._turn()

    def _turn(self) -> None:
        """Begin a new generation of known runs; the one before it stays at hand."""
        self.old, self.runs = self.runs, {s: (1, self.number[i], self.names[i]) for s, i in self.special.items()}

    def forget(self) -> None:
        """Let go of all known runs; the file's tables stay, as building them takes more than they do."""
        self._turn()
        self.old = {}

    def _learn(self, new: list[str]) -> None:
        """new: runs without blanks. Normal forms and cuts don't reach across blanks, so all are cut in one call."""
        plain = [r.lower() if r.isascii() else self.normalise(r) for r in new] if self.lower else [self.normalise(r) for r in new]
        starts = np.cumsum([0, *[len(r) + 1 for r in plain]])
        cut = self.cut(" ".join(plain))
        distinct = {w: k for k, w in enumerate(dict.fromkeys([w for w, _ in cut]))}
        ids, ends = self.merges.encode_words(list(distinct))
        number, names, flat, ends_l = self.number, self.names, ids.tolist(), ends.tolist()
        told, i = [], 0
        for j in ends_l:
            part = flat[i:j]
            told.append((j - i, " ".join([number[x] for x in part]), " ".join([names[x] for x in part])))
            i = j
        owner = np.searchsorted(starts, [x[0] for _, x in cut], side="right") - 1
        which = [told[distinct[w]] for w, _ in cut]
        bounds = np.searchsorted(owner, np.arange(len(new) + 1)).tolist()
        for k, run in enumerate(new):
            ws = which[bounds[k] : bounds[k + 1]]
            if len(ws) != 1:
                ws = [w for w in ws if w[0]]
                ws = [(sum([w[0] for w in ws]), " ".join([w[1] for w in ws]), " ".join([w[2] for w in ws]))]
            self.void |= not ws[0][0]
            self.runs[run] = ws[0]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, the ids as decimals joined by blanks, the decoded text."""
        pieces = []
        for t in texts:
            runs: list[str] = []
            for p in self.split.split(t or "") if self.split else [t or ""]:
                if p in self.special:
                    runs.append(p)
                else:  # str.split() also cuts at 1C to 1F, which are no blanks for the file
                    runs += BLANKS.split(p) if any(c in p for c in "\x1c\x1d\x1e\x1f") else p.split()
            pieces.append(runs)
        wanted = set().union(*pieces)
        new = [r for r in wanted if r not in self.runs]
        if len(self.runs) + len(new) > CACHED_RUNS:
            self._turn()
            new = [r for r in wanted if r not in self.runs]
        old, look = self.old, self.runs
        if old:  # what is still in use moves to the new generation
            look.update({r: old[r] for r in new if r in old})
            new = [r for r in new if r not in look]
        if new:
            self._learn(new)
        for runs in pieces:
            found = [look[r] for r in runs]
            if self.void:
                found = [x for x in found if x[0]]
            n, ids, names = zip(*found) if found else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(names)

    def decode(self, ids: list[int]) -> str:
        """A file without a decoder: the tokens' strings, joined by blanks; ids without a token are left out."""
        return " ".join(self.names[i] for i in ids if 0 <= i < len(self.names) and self.names[i])


@lru_cache(maxsize=2)
def coder_of(path: str) -> Coder:
    """One for all tasks of a worker: the file is read once and the runs that are known stay known."""
    return Coder(path)


def in_pieces(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` characters, at least one text each."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t or "") > limit:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_text adds ids (array<int>) and decoded."""
    use_workers(docs.sparkSession)
    d = with_columns_apart(docs, ["doc_id", "text"])
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("bpe")
        coder = coder_of(path)
        keep_for("bpe", coder.forget)
        for b in (batch.slice(s, 500) for batch in batches for s in range(0, batch.num_rows, 500)):
            texts = b.column(1).to_pylist()
            for i, j in in_pieces(texts):
                n, ids, decoded, full, plain = [], [], [], [], []
                for k, numbers, text in coder.encode(texts[i:j]):
                    n.append(k)
                    ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_text:
                        full.append([int(x) for x in numbers.split()])
                        plain.append(text)
                cols = [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    cols += [pa.array(full, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", ids array<int>, decoded string" if with_text else ""
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
