"""Token counts by heap-and-linked-list byte-pair merging.

A word becomes a doubly linked list of byte symbols, the last one marked with the word end. The adjacent pair of lowest rank
is popped from a heap again and again and merged in place; stale entries are skipped. The count is the number of symbols
at the start less the merges made. No identifiers are made, and a word costs n log n whatever its length.

Counts of words are kept in a bounded cache in each Python worker, since words repeat.

The word pattern is read from the tokenizer's file. What is a letter, a number, a mark or a lower-case letter differs between versions of Unicode, and the
library has several at once; characters asks it for all code points, on the driver. Without the library Python's own version is taken.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a very long text, or word, is counted whole; other columns are dropped, whatever their names;
repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbframe.llm.common import table

CACHE_WORDS = 500_000
LONGEST_CACHED = 64

#: Letters of ASCII and the Latin blocks after it, lower case: here a simpler pattern gives the same words.
_LATIN = "a-zß-öø-ÿĀ-įı-ʯ"
_PLAIN = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{_LATIN}]*\\Z")
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\\x09-\\x0d\\x20{_LATIN}0-9]+")

# The word pattern that the simpler one above stands for, and the steps of its normalizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def _ranges(code_points: Iterable[int]) -> str:
    """Code points as the inside of a character class."""
    out = []
    for _, run in itertools.groupby(enumerate(sorted(code_points)), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


@dataclass(frozen=True)
class Characters:
    """What a library takes code points for. breaks: characters that Python's NFC would reorder or compose and the library wouldn't; lower: lower-case forms that differ from Python's."""

    letters: str
    numbers: str
    spaces: str
    breaks: frozenset[str] = frozenset()
    lower: dict[str, str] = field(default_factory=dict)


def _all() -> list[str]:
    return [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def python_characters() -> Characters:
    of = lambda kind: _ranges(ord(c) for c in _all() if unicodedata.category(c)[0] == kind)
    return Characters(of("L"), of("N"), _ranges(ord(c) for c in _all() if c.isspace() and not "\x1c" <= c <= "\x1f"))


_asked: list[Characters] = []


def characters() -> Characters:
    """As the tokenizers library has them, asked for each code point, once; where it isn't installed, as Python has them."""
    # No functools.cache, which would travel to workers by name.
    if not _asked:
        _asked.append(_ask())
    return _asked[0]


def _ask() -> Characters:
    try:
        from tokenizers import Regex, normalizers, pre_tokenizers
    except ImportError:
        return python_characters()
    every, nul = _all(), "\0"
    text = nul.join(every)

    def held(pattern: str) -> str:
        pieces = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)
        return _ranges({ord(c) for piece, _ in pieces for c in piece})

    lowered = normalizers.Lowercase().normalize_str(text).split(nul)
    lower = {c: low for c, low in zip(every, lowered, strict=True) if low != c.lower()}
    nfc = normalizers.NFC().normalize_str
    same = lambda s: nfc(s) == unicodedata.normalize("NFC", s)
    around = ("a{}\u0316", "a\u0316{}", "\u00e1{}", "a{}\u0301", "e\u0345{}")
    breaks = {c for c in every if unicodedata.combining(c) and not all(same(x.format(c)) for x in around)}
    for c in every:
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<" and " " in parts:
            first, second = (chr(int(x, 16)) for x in parts.split())
            if not same(first + second):
                breaks.add(second)
    return Characters(held(r"[\p{L}]"), held(r"[\p{N}]"), held(r"\s"), frozenset(breaks), lower)


class Merges:
    """Ranks of adjacent pairs, the marks of a word end and of special strings, the word pattern and what its classes hold."""

    def __init__(self, ranks: dict[tuple[str, str], int], word_end: str, specials: list[str], pattern: str = PATTERN, known: Characters | None = None):
        self.ranks, self.word_end, self.specials, self.pattern, self.known = ranks, word_end, specials, pattern, known or characters()

    @classmethod
    def read(cls, path: str) -> Merges:
        """From a tokenizer file of kind BPE with byte-level symbols that normalizes by NORMALIZERS; another kind is an error."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        if told["model"]["type"] != "BPE" or steps != NORMALIZERS or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path} is no byte-level BPE that normalizes by {', '.join(NORMALIZERS)}")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        return cls({p: i for i, p in enumerate(pairs)}, told["model"]["end_of_word_suffix"] or "", [t["content"] for t in told["added_tokens"]], cuts[0]["pattern"]["Regex"])


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left: list[str | None] = list(symbols)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if left[i] != a or j >= n or left[j] != b:
            continue  # one of the two has been merged meanwhile
        left[i], left[j] = a + b, None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((left[i], left[k]))) is not None:
                heapq.heappush(heap, (r, i, left[i], left[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((left[h], left[i]))) is not None:
            heapq.heappush(heap, (r, h, left[h], left[i]))
    return n - merges


def counter(merges: Merges) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    to_symbol, ranks, end = byte_symbols(), merges.ranks, merges.word_end

    def of_word(word: str) -> int:
        symbols = [to_symbol[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += end
        return merged_count(symbols, ranks)

    class Counts(dict):
        def __missing__(self, word: str) -> int:
            n = of_word(word)
            if len(word) <= LONGEST_CACHED:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = n
            return n

    get = Counts().__getitem__
    known, nfc = merges.known, unicodedata.normalize
    words = re.compile(merges.pattern.replace("\\p{L}", known.letters).replace("\\p{N}", known.numbers).replace("\\s", known.spaces)).findall
    simple = merges.pattern == PATTERN
    apart = re.compile("([" + "".join(map(re.escape, sorted(known.breaks))) + "])") if known.breaks else None
    lower = known.lower

    def of_piece(text: str) -> int:
        low = text.lower()
        if simple and _PLAIN.match(low):
            return sum(map(get, _PLAIN_WORDS.findall(low)))
        if apart and apart.search(text):
            text = "".join(nfc("NFC", part) for part in apart.split(text))
        else:
            text = nfc("NFC", text)
        # Character by character: a final sigma is lowered as any other.
        low = text.lower() if "Σ" not in text and lower.keys().isdisjoint(text) else "".join(lower.get(c) or c.lower() for c in text)
        return sum(map(get, words(low)))

    if not merges.specials:
        return of_piece
    split = re.compile("|".join(map(re.escape, sorted(merges.specials, key=len, reverse=True))))

    def of_text(text: str) -> int:
        found = split.findall(text) if "<|" in text else None
        return len(found) + sum(map(of_piece, split.split(text))) if found else of_piece(text)

    return of_text


def count_tokens(docs: DataFrame, merges: Merges, *, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast((merges.ranks, merges.word_end, merges.specials, merges.pattern, vars(merges.known)))  # the vocabulary: a fixed size, about 5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *told, known = sent.value
        count = counter(Merges(*told, Characters(**known)))
        for b in batches:
            texts = b.column("text").to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op5_bpe_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    merges = Merges.read(public_tokenizers.path("word_bpe_49k.json"))
    return count_tokens(table(spark, sf_dir, "documents"), merges)
