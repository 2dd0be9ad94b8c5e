"""Byte-level BPE by depth-first traversal of a trie of distinct words.

Greedy merging gives every prefix of a word one last token, and the tokens before it are the encoding of the
shorter prefix. So a trie node needs one state, its last token, found from the states of its ancestors: it is
the token ending there that borders stably on the last token of what precedes it. Words are visited in byte
order, which is depth-first order; the states of a prefix shared with the word before stay on the stack and are
not computed again.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from pagewright.llm.common import read_table, with_fields

#: Splits text into words before any merge: the published pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker keeps the encoding of.
REMEMBERED = 200_000
#: What it keeps of them, and of token borders, once a task is done: the earliest, so mostly the frequent ones.
KEPT_IDLE = 50_000
#: Token borders that are remembered.
MOST_BORDERS = 400_000
#: Characters of the documents whose words enter one trie.
CHARS_AT_ONCE = 1_500_000
#: Lengths in bytes in which a last token is looked for; the order matters for speed only, as one token fits at most.
LENGTHS_FIRST = (2, 3, 4, 1, 5)
#: Characters whose class depends on no version of Unicode; texts with others are compared with the library's own splitting.
PLAIN = regex.compile(r"[^\x00-\u024F\u0391-\u03A9\u03B1-\u03C9\u0410-\u044F\u2010-\u2027\u20AC\u4E00-\u9FA5\u3041-\u3096\u30A1-\u30FA\uAC00-\uD7A3]")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a vocabulary file: itself, or the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = spec["model"]["vocab"]
        self.ids = {bytes(letters[c] for c in name): i for name, i in names.items() if name not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: name.encode() for name, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pair, whole = (names[left], names[right]), names[left + right]
            if whole in self.parts:
                raise ValueError(f"two merges make {left + right!r}")
            self.rank[pair] = rank
            self.parts[whole] = (*pair, rank)
        self.border: dict[int, bool] = {}
        self.lengths = [*LENGTHS_FIRST, *(n for n in range(1, self.longest + 1) if n not in LENGTHS_FIRST)]
        self.split = regex.compile(PATTERN)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """What stands at one edge of a token while it is put together: (piece, rank from, rank until)."""
        out, until = [], float("inf")
        while True:
            left, right, rank = self.parts.get(token, (-1, -1, -1))
            out.append((token, rank, until))
            if rank < 0:
                return out
            token, until = (left, right)[side], rank

    def stable(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border of two neighbouring tokens; the leftmost of equal ranks goes first."""
        for x, x_from, x_until in self._spine(left, 1):
            for y, y_from, y_until in self._spine(right, 0):
                rank = self.rank.get((x, y))
                if rank is not None and x_from < rank < x_until and y_from < rank <= y_until:
                    return False
        return True

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its tokens, by depth-first traversal of their trie.

        A step looks at no more than the longest token's bytes, so a word takes time linear in its length.
        """
        if len(self.border) > MOST_BORDERS:
            self.border.clear()
        find, lengths, longest, border, stable = self.ids.get, self.lengths, self.longest, self.border, self.stable
        last: list[int] = [-1]
        wide: list[int] = [0]
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], wide[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                token = find(word[:end]) if end <= longest else None
                if token is not None:
                    last.append(token)
                    wide.append(end)
                    continue
                for n in lengths:
                    token = find(word[end - n : end]) if n < end else None
                    if token is None:
                        continue
                    key = last[end - n] << 32 | token
                    fits = border.get(key)
                    if fits is None:
                        fits = border[key] = stable(last[end - n], token)
                    if fits:
                        last.append(token)
                        wide.append(n)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= wide[end]
            before = word
            out.reverse()
            yield word, out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes and decodes whole texts; keeps the encodings of a bounded number of words."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.library = ByteLevel(add_prefix_space=False)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.same: dict[str, bool] = {}
        for name, token in self.vocabulary.special.items():
            self.known[name] = (str(token), 1, self.vocabulary.bytes[token])

    def _look_up(self, pieces: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """Encodings of all pieces; those that are not remembered enter one trie, and are remembered while there is room."""
        fresh = pieces.difference(self.known)
        table, new = self.vocabulary.bytes, {}
        for word, tokens in self.vocabulary.encode_words([w.encode() for w in fresh]):
            new[word.decode()] = (",".join(map(str, tokens)), len(tokens), b"".join([table[t] for t in tokens]))
        if len(self.known) + len(new) <= REMEMBERED:
            self.known.update(new)
            return self.known
        return {w: new.get(w) or self.known[w] for w in pieces}

    def shrink(self) -> None:
        """Let go of most memory between tasks: the worker may serve other operators next."""
        self.known = dict(itertools.islice(self.known.items(), KEPT_IDLE))
        self.vocabulary.border = dict(itertools.islice(self.vocabulary.border.items(), KEPT_IDLE))
        self.same = {}

    def _alike(self, char: str) -> bool:
        """Whether both splitters class a character alike: next to a letter, a digit, a sign and a space."""
        same = self.same.get(char)
        if same is None:
            probe = f"a{char}1{char}!{char} {char}"
            same = self.same[char] = self.vocabulary.split.findall(probe) == self._by_library(probe)
        return same

    def _by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _split(self, text: str) -> list[str]:
        odd = PLAIN.search(text)
        if odd and not all(map(self._alike, set(PLAIN.findall(text, odd.start())))):
            return self._by_library(text)
        return self.vocabulary.split.findall(text)

    def pieces(self, text: str) -> list[str]:
        """The words of a text; special strings are words of their own."""
        special = self.vocabulary.special
        if self.vocabulary.mark is None or not any(name in text for name in special):
            return self._split(text)
        out: list[str] = []
        for part in self.vocabulary.mark.split(text):
            out += [part] if part in special else self._split(part)
        return out

    def run(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by commas, text decoded from the ids) of each text, null as empty."""
        pieces = [self.pieces(text or "") for text in texts]
        known = self._look_up(set().union(*pieces))
        for words in pieces:
            rows = [known[w] for w in words]
            yield sum([r[1] for r in rows]), ",".join([r[0] for r in rows]), b"".join([r[2] for r in rows]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS_AT_ONCE characters; a longer text is a range of its own."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > CHARS_AT_ONCE:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def encode_documents(documents: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """documents plus n_tokens, ids_sha256 and decoded_sha256, and tokens (array of int) if keep_ids.

    The text column is encoded whole as the tokenizers library does without added special tokens: special
    strings in a text become their token. Null counts as empty; an empty text has no tokens. Rows are encoded one by
    one, so repeated rows get equal results; time is linear in the length of a text, also of one that is a single
    word. Columns of those names are replaced, all others are kept. One pass without a shuffle; path must be
    readable on executors.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["tokens"] * keep_ids]
    df = documents.drop(*new)
    names = df.columns
    schema = with_fields(df, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * keep_ids)

    def encode(batches):
        worker = encoder(path)
        run = worker.run
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            for begin, end in portions(texts):
                part = batch.slice(begin, end - begin)
                counts, sums, decoded, tokens = [], [], [], []
                for n, ids, text in run(texts[begin:end]):
                    counts.append(n)
                    sums.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        tokens.append([int(x) for x in ids.split(",")] if ids else [])
                arrays = [pa.array(counts, pa.int64()), pa.array(sums), pa.array(decoded), *[pa.array(tokens, pa.list_(pa.int32()))] * keep_ids]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*names, *new])
        worker.shrink()

    return df.mapInArrow(encode, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(documents.select("doc_id", F.col("text")), default_path(), keep_ids=False).drop("text")
