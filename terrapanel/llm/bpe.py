"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the last token of its encoding is unique.  An
Aho-Corasick automaton over the vocabulary yields the tokens that end at each
position; the one whose pair with the last token of the remaining prefix is
compatible (encoding the two tokens' joint text gives back these two) is stored
as that prefix's last token.  Following the stored tokens back from the end of
the word gives the exact ids that merging by rank would give, in linear time.

The vocabulary file is read where the tasks run, from a path that is a
parameter; it belongs to the environment, like the library that ships it.

Defined results: a null text counts as empty; an empty text or one of white
space only has no ids and decodes to the empty text; repeated rows are encoded
alike; a very long text is encoded whole, word by word, and a very long word
in one array of its length; an empty table gives an empty result; other columns
are carried along, but for those of the results' names, which are replaced.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from terrapanel.llm.joins import by_place

#: Entries of a worker's caches before the older half is given up.
CACHE_ENTRIES = 150_000
#: Bytes of the longest word that is remembered.
LONGEST_KEPT = 64
#: Bytes of results after which a batch is handed on.
OUTPUT_BYTES = 4 << 20


def byte_characters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Recent:
    """The latest entries of a mapping: at least ``entries``, at most twice as many."""

    def __init__(self, entries: int):
        self.entries, self.new, self.old = entries, {}, {}

    def find(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(key) > LONGEST_KEPT:
            return
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PrefixBpe:
    """A vocabulary with merges by rank and a mark on the last byte of a word.

    Inside, a word is a string of characters 0-255, one a byte, where 256 is
    added to the last one; so tokens at a word's end are tokens like any other.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.to_byte = to_byte = byte_characters()
        self.path = path

        def inner(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix)
            raw = [to_byte[c] for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                raw[-1] += 256
            return "".join(map(chr, raw))

        self.names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.mark = 256 if suffix else 0
        ids = {inner(t): i for t, i in model["vocab"].items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[inner(a)], ids[inner(b)], model["vocab"][a + b]
            self.pairs[left, right] = rank
            self.parts[whole] = rank, left, right
        # What is no encoding of its own text ends no prefix.
        self._automaton({text: i for text, i in ids.items() if self._reachable(i)})
        self.known: dict[int, bool] = {}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words = Recent(CACHE_ENTRIES)

    def _automaton(self, tokens: dict[str, int]) -> None:
        """Aho-Corasick states: for each the longest token that is a suffix; for each token the next shorter one."""
        size = max(self.names) + 1
        self.length, self.shorter = [0] * size, [-1] * size
        self.edges: dict[int, int] = {}
        self.fail, self.longest, below = [0], [-1], [[]]
        for text, i in tokens.items():
            state = 0
            for c in map(ord, text):
                to = self.edges.get(state << 9 | c)
                if to is None:
                    to = self.edges[state << 9 | c] = len(self.fail)
                    self.fail.append(0)
                    self.longest.append(-1)
                    below.append([])
                    below[state].append((c, to))
                state = to
            self.longest[state] = i
            self.length[i] = len(text)
        self.steps: dict[int, int] = {}
        level = [to for _, to in below[0]]
        while level:
            for state in level:
                for c, to in below[state]:
                    self.fail[to] = self._step(self.fail[state], c)
                suffix = self.longest[self.fail[state]]
                if self.longest[state] < 0:
                    self.longest[state] = suffix
                else:
                    self.shorter[self.longest[state]] = suffix
            level = [to for state in level for _, to in below[state]]
        self.steps.clear()

    def _step(self, state: int, c: int) -> int:
        """The state for the longest suffix that continues with c; remembered."""
        at = state
        while (to := self.edges.get(at << 9 | c)) is None and at:
            at = self.fail[at]
        if len(self.steps) > 2 * CACHE_ENTRIES:
            self.steps.clear()
        self.steps[state << 9 | c] = to = to or 0
        return to

    def _reachable(self, token: int) -> bool:
        """Whether the token's text is encoded as that token."""
        if token not in self.parts:
            return True
        rank, left, right = self.parts[token]
        return self._compatible(left, right, rank) and self._reachable(left) and self._reachable(right)

    def _compatible(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether merging the joint text of tokens a and b by rank (below ``until``) never joins across their border.

        A piece at the border lives until the merge that takes it into a larger
        piece of its own token.  Both sides are undone merge by merge, the
        latest first, so that each visited pair of pieces does face each other
        at some time; their own merge must come too late for one of them.  Of
        two places for the same merge the one further left goes first.
        """
        until = len(self.pairs) if until is None else until
        end_a, end_b = until, until - 1
        while True:
            rank = self.pairs.get((a, b), end_a)
            if rank < end_a and rank <= end_b:
                return False
            rank_a, left_a, right_a = self.parts.get(a, (-1, 0, 0))
            rank_b, left_b, right_b = self.parts.get(b, (-1, 0, 0))
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                end_a, a = rank_a, right_a
            else:
                end_b, b = rank_b, left_b

    def _test(self, a: int, b: int) -> bool:
        if len(self.known) > 2 * CACHE_ENTRIES:
            self.known.clear()
        found = self.known[a << 20 | b] = self._compatible(a, b)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one piece of normalised text."""
        steps, longest, length, shorter, known = self.steps, self.longest, self.length, self.shorter, self.known
        last: list[int] = []  # of each prefix
        state, final = 0, len(word) - 1
        for end, c in enumerate(word):
            if end == final:
                c += self.mark
            to = steps.get(state << 9 | c)
            state = self._step(state, c) if to is None else to
            token = longest[state]
            start = end - length[token]
            while start >= 0:
                a = last[start]
                fits = known.get(a << 20 | token)
                if self._test(a, token) if fits is None else fits:
                    break
                token = shorter[token]
                start = end - length[token]
            last.append(token)
        ids, at = [], final
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def _word(self, word: bytes) -> list[int]:
        found = self.words.find(word)
        if found is None:
            found = self.encode_word(word)
            self.words.keep(word, found)
        return found

    @functools.cached_property
    def library(self) -> Tokenizer:
        """Used for its normaliser and its splitting, never for merges."""
        return Tokenizer.from_file(self.path)

    def split(self, text: str) -> list[str]:
        """The normalised pieces of a text; letters beyond the Latin ones by the library's own Unicode tables."""
        if not text or max(text) < "\u0250":
            return self.pieces.findall(unicodedata.normalize("NFC", text).lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.to_byte[c] for c in piece).decode() for piece, _ in pieces]

    def encode_chunk(self, chunk: bytes) -> list[int]:
        """Ids of a text without ASCII white space."""
        if chunk.isalpha():
            return self._word(chunk.lower())
        text = chunk.decode()
        ids: list[int] = []
        for n, part in enumerate(self.added_pattern.split(text) if self.added_pattern and "<" in text else [text]):
            if n % 2:
                ids.append(self.added[part])
            else:
                for word in self.split(part):
                    ids += self._word(word.encode())
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for chunk in text.encode().split() for i in self.encode_chunk(chunk)]

    def decode(self, ids) -> str:
        """The vocabulary strings, joined by blanks: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.cache
def vocabulary(path: str) -> PrefixBpe:
    """One copy for each worker."""
    return PrefixBpe(path)


class _Chunks(dict):
    """From a chunk's bytes to its packed ids and its decoded bytes; the latest entries, as in Recent."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.older = bpe, {}

    def __missing__(self, chunk: bytes) -> tuple[bytes, bytes]:
        found = self.older.get(chunk)
        if found is None:
            ids = self.bpe.encode_chunk(chunk)
            packed = array("I", ids)
            if sys.byteorder == "big":
                packed.byteswap()
            found = packed.tobytes(), self.bpe.decode(ids).encode()
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = True) -> DataFrame:
    """docs with ``ids`` (packed little-endian unsigned 32-bit integers), ``n_tokens`` and, if asked for, ``decoded``.

    The three columns replace columns of these names.
    """
    carried = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens", "decoded")])
    source = by_place(carried, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    names = [*carried.columns, "ids", "n_tokens", *["decoded"] * decoded]

    def run(batches):
        known = _Chunks(vocabulary(path))  # given up with the task, like the words below
        known.bpe.words = Recent(CACHE_ENTRIES)
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                ids, texts, size, first = [], [], 0, at
                while at < batch.num_rows and size < OUTPUT_BYTES:
                    found = list(map(known.__getitem__, raw[at].as_py().split()))
                    ids.append(b"".join([x[0] for x in found]))
                    if decoded:
                        texts.append(b" ".join([x[1] for x in found if x[0]]))
                        size += len(texts[-1])
                    size += len(ids[-1])
                    at += 1
                new = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    new.append(pa.array(texts, pa.binary()).cast(pa.string()))
                old = [c.slice(first, at - first) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*old, *new], names=names)
        known.bpe.words = Recent(CACHE_ENTRIES)

    schema = T.StructType([*carried.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.StringType())] * decoded])
    return source.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with ``decoded``: the text of its packed ids; null ids decode to the empty text."""
    carried = encoded.drop("decoded")
    at, names = carried.columns.index(ids_col), [*carried.columns, "decoded"]

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return carried.mapInArrow(run, T.StructType([*carried.schema.fields, T.StructField("decoded", T.StringType())]))
