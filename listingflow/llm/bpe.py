"""BPE encoding and decoding: speculate by longest match, verify by pairs.

For every word the longest known token is taken again and again. That guess is
the true encoding exactly if each two adjacent tokens are compatible: if merging
their joined text would keep the seam. All adjacent pairs of a batch are tested
together in numpy by undoing merges on both sides of the seam, latest first;
words with a bad seam (and only those) are merged exactly by rank.
"""

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.text import give_back, text_slices

_NONE = np.iinfo(np.int64).max
#: What Unicode calls white space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_GAPS = re.compile(f"[{''.join(map(chr, _SPACES))}]+")
_ASCII_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: About how many bytes of encoded words a task keeps from slice to slice.
CACHE = 32 << 20
#: Bytes of text that a worker has in hand at once; its places take ten times that.
SLICE = 2 << 20


class WordBpe:
    """Encoder and decoder for a byte-level BPE file with a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        #: Only its normaliser and word splitter are used, for non-ASCII text.
        self.parts = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.rank, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        ends = np.zeros(n, bool)
        self.inner_base = {s: i for s, i in vocab.items() if len(s) == 1}
        self.final_base = {s[0]: i for s, i in vocab.items() if len(s) == 1 + len(suffix) and s.endswith(suffix)}
        ends[list(self.final_base.values())] = True
        self.merge: dict[tuple[int, int], int] = {}
        keys = []
        for r, (a, b) in enumerate(model["merges"]):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = t
            self.rank[t], self.left[t], self.right[t], ends[t] = r, x, y, ends[y]
            keys.append((x << 32 | y, r))
        keys.sort()
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64).T
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(n, bool)
        whole = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t, good in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda p: self.rank[p[0]]):
            sound[t] = good and sound[self.left[t]] and sound[self.right[t]]
        # The tokens that encode to themselves, by their text without the suffix.
        self.inner = {s: i for s, i in vocab.items() if sound[i] and not ends[i]}
        self.final = {s[: -len(suffix)]: i for s, i in vocab.items() if sound[i] and ends[i]}
        # The longest token that starts with these three characters.
        self.longest: dict[str, int] = {}
        for s in [*self.inner, *self.final]:
            self.longest[s[:3]] = max(self.longest.get(s[:3], 0), len(s))
        #: What ids and tokens look like in a line, with a space behind each.
        self.numbers = pa.array([f"{i} " for i in range(n)], pa.large_string())
        self.spaced = pa.array([x + " " for x in self.strings], pa.large_string())
        self.pair_table = {k: int(self.rank[t]) << 20 | t for k, t in self.merge.items()}
        self.forget()

    def forget(self) -> None:
        """Empty the table of words: a reused worker gives back what a task took.

        A word's row has its tokens from ends[row] to ends[row + 1] in tokens.
        Special tokens are words of their own, under a key that no word has.
        """
        self.words: dict[str, int] = {}
        self.tokens, self.ends, self.held = array("i"), array("q", [0]), 0
        self._add("\n", [])  # the end of a piece
        for content, i in self.special.items():
            self._add("\0" + content, [i])

    def _add(self, word: str, ids: list[int]) -> None:
        self.words[word] = len(self.ends) - 1
        self.tokens.extend(ids)
        self.ends.append(len(self.tokens))
        self.held += 170 + len(word) + 4 * len(ids)

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether a seam between tokens a and b stays, for arrays of pairs.

        Going back in time, the later-made of both neighbours is undone; a merge
        over the seam that ranks before that moment would have come first. At
        equal rank the merge further left comes first.
        """
        good = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NONE) if limit is None else limit.astype(np.int64)
        while len(at):
            crossed = self.pair_rank(x, y) < limit
            good[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return good

    def propose(self, word: str) -> list[int]:
        """Longest match from the left; a word is in the byte alphabet."""
        out, i, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while i < n:
            end = min(n, i + longest.get(word[i : i + 3], 2))
            t = None
            if end == n:
                t = final.get(word[i:])
                end = n if t is not None else n - 1
            while t is None:
                if end <= i:  # the last character alone
                    t, end = self.final_base[word[i]], n
                    break
                t = inner.get(word[i:end])
                if t is None:
                    end -= 1
            out.append(t)
            i = end
        return out

    def exact(self, word: str) -> list[int]:
        """Merging by rank, lowest first and leftmost at equal rank."""
        ids = [*map(self.inner_base.__getitem__, word[:-1]), self.final_base[word[-1]]]
        if len(ids) > 64:
            return self._exact_long(ids)
        table, none = self.pair_table, _NONE
        # rank << 20 | token of every adjacent pair
        cost = [table.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while cost:
            best = min(cost)
            if best == none:
                break
            i = cost.index(best)
            ids[i : i + 2] = (best & 0xFFFFF,)
            del cost[i]
            if i:
                cost[i - 1] = table.get((ids[i - 1], ids[i]), none)
            if i < len(cost):
                cost[i] = table.get((ids[i], ids[i + 1]), none)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words whose pairs are many."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive, table = [True] * len(ids), self.pair_table
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and (c := table.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (c >> 20, i, c & 0xFFFFF, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            _, i, t, x, y = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= len(ids) or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = t, False, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word, guessed and then verified together."""
        guesses = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[seam] << 32 | flat[seam + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        for i in np.unique(owner[seam[~good]]).tolist():
            guesses[i] = self.exact(words[i])
        return guesses

    def split(self, text: str) -> list[str]:
        """The words, in the byte alphabet, of any text."""
        out = []
        for p in self.special_split.split(text):
            if p in self.special:
                out.append("\0" + p)
            elif p:
                out += [w for w, _ in self.parts.pre_tokenizer.pre_tokenize_str(self.parts.normalizer.normalize_str(p))]
        return out

    def split_pieces(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words of pieces of text without ASCII white space, and for each
        piece the place of its first word and how many it has.

        Plain pieces are cut together: ASCII ones by one pattern, others by one
        call of the library, each over all of them in a line. Pieces with other
        white space or marks of special tokens are cut alone.
        """
        first, count = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        plain, other, odd = [], [], []
        for i, c in enumerate(chunks):
            if "<|" in c:
                odd.append(i)
            elif c.isascii():
                (plain if c.isprintable() else odd).append(i)
            else:
                (odd if _GAPS.search(c) or not c.isprintable() else other).append(i)
        words = _ASCII_WORDS.findall("\n".join([chunks[i] for i in plain]).lower())
        ends = np.flatnonzero(np.fromiter((w == "\n" for w in words), bool, len(words)))
        bounds = np.concatenate([[-1], ends, [len(words)]])
        if plain:
            first[plain], count[plain] = bounds[:-1] + 1, np.diff(bounds) - 1
        line = self.parts.normalizer.normalize_str(" ".join([chunks[i] for i in other]))
        found = self.parts.pre_tokenizer.pre_tokenize_str(line)
        if other:
            gaps = np.fromiter((m.start() for m in re.finditer(" ", line)), np.int64)
            place = np.searchsorted(gaps, np.fromiter((at for _, (at, _) in found), np.int64, len(found)))
            n = np.bincount(place, minlength=len(other))
            first[other], count[other] = len(words) + np.cumsum(n) - n, n
        words += [w for w, _ in found]
        for i in odd:
            own = self.split(chunks[i])
            first[i], count[i] = len(words), len(own)
            words += own
        return words, first, count

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The row of each word in the table; new ones are encoded first."""
        known = self.words
        new = list(dict.fromkeys(w for w in words if w not in known))
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self._add(w, ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a line, and where each text ends in it.

        Arrow cuts the texts at ASCII white space and numbers the distinct pieces;
        only those are cut into words, and only distinct words are encoded. The
        line of ids is put together again by places alone.
        """
        if self.held > CACHE:
            self.forget()
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
        flat = pc.dictionary_encode(pc.list_flatten(cut))
        words, first, count = self.split_pieces(flat.dictionary.to_pylist())
        rows = self.rows_of(words)
        at, ends = flat.indices.to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(cut).to_numpy())
        seq, ends = _unfold(first[at], count[at], ends)
        seq, to = rows[seq], np.frombuffer(self.ends, np.int64).copy()
        line, ends = _unfold(to[seq], to[seq + 1] - to[seq], ends)
        return np.frombuffer(self.tokens, np.int32)[line], ends

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text; None encodes to nothing."""
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _unfold(first: np.ndarray, count: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first, first + 1, ... of each run in one line; ends, given in
    runs, in places of that line."""
    upto = np.cumsum(count)
    line = np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + count, count)
    return line, np.concatenate([[0], upto])[ends]


def _joined(strings: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The strings of each text's ids, which end in a space, without the last."""
    _, offsets, data = strings.take(pa.array(ids)).buffers()
    to = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends])].tolist() if len(ids) else [0] * (len(ends) + 1)
    view = memoryview(data or b"")
    return [view[a : max(a, b - 1)] for a, b in zip(to, to[1:], strict=False)]


def _sha256(texts: list[memoryview]) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())


def encoded(docs: DataFrame, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) per row.

    Null and empty texts give no tokens and the digests of the empty text. Every
    row is coded, those that repeat and those without doc_id too; an empty table
    gives no rows, and columns besides doc_id and text play no part. One pass
    without a shuffle: batches are cut into slices of a few megabytes of text (a
    longer text is one slice), pieces of text are encoded once for a slice, and
    recurrent ones come from caches of bounded size that end with the task.
    keep_text adds the ids and the decoded text.
    """
    digest = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or default_path())
        try:
            for part in text_slices(batches, SLICE):
                line, ends = bpe.encode_all(part.column("text"))
                ids, decoded = _joined(bpe.numbers, line, ends), _joined(bpe.spaced, line, ends)
                out = [part.column("doc_id"), pa.array(np.diff(ends, prepend=0), pa.int64()), _sha256(ids), _sha256(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_text:
                    out += [pa.array([list(map(int, bytes(x).split())) for x in ids], pa.list_(pa.int32())), pa.array([bytes(x).decode() for x in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)
        finally:
            bpe.forget()
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, digest + (", ids array<int>, decoded string" if keep_text else ""))
