"""Texts: patterns that Java, RE2 and Python read alike, and the sequential kernels that run in Arrow batches."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Words, single marks, and white space: the matches tile a text.
TILE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]|[\s\p{Z}]+"
_TOKEN = re.compile(r"[^\s\w]|\w+")

Ranges = list[tuple[int, int]]


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def tiles(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TILE), 0)


class _Characters(Sequence):
    """(i, i + 1) for each character, none of them stored."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[int, int]:
        i = range(self.n)[i]
        return i, i + 1


@lru_cache(4)
def _bpe(name: str):
    """A byte-level BPE of tiktoken: one of its own names, if the vocabulary is at hand, or bpe:path of a rank file."""
    import tiktoken

    kind, _, path = name.partition(":")
    if kind != "bpe":
        return tiktoken.get_encoding(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The published split of the byte-level vocabularies of 50,000 tokens.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def bpe_spans(text: str, name: str) -> Ranges:
    """Spans of the tokens in characters; tokens that share a character have one span together."""
    enc = _bpe(name)
    data = enc.decode_tokens_bytes(enc.encode_ordinary(text))
    out: Ranges = []
    at = lo = 0  # characters that began so far
    for piece in data:
        began = sum(b & 0xC0 != 0x80 for b in piece)
        if not began and out:
            continue  # the rest of a character of the token before
        lo, at = at, at + began
        if out and piece[0] & 0xC0 == 0x80:
            out[-1] = out[-1][0], at
        else:
            out.append((lo, at))
    return out


def token_spans(text: str, tokenizer: str = "regex") -> Ranges | _Characters:
    """tokenizer: regex (words and marks), character, a name of tiktoken's, such as cl100k_base, or bpe:path."""
    if tokenizer == "character":
        return _Characters(len(text))
    if tokenizer != "regex":
        return bpe_spans(text, tokenizer)
    return [m.span() for m in _TOKEN.finditer(text)]


class Ruler:
    """Token counts of any range of one text by bisection, as if the range were tokenized alone."""

    def __init__(self, text: str, tokenizer: str = "regex") -> None:
        self.text, self.spans = text, token_spans(text, tokenizer)
        if tokenizer == "character":
            self.starts, self.ends = range(len(text)), range(1, len(text) + 1)
        else:
            self.starts, self.ends = [s for s, _ in self.spans], [e for _, e in self.spans]

    def count(self, start: int, end: int) -> int:
        # a token that a border cuts still counts as one on each side
        return max(0, bisect_left(self.starts, end) - bisect_right(self.ends, start)) if start < end else 0

    def back(self, start: int, n: int) -> int:
        """start moved back by n tokens."""
        at = bisect_left(self.starts, start)
        return self.starts[max(0, at - n)] if n and at and self.spans else start


@lru_cache(1)
def ruler_of(text: str, tokenizer: str = "regex") -> Ruler:
    """The ruler of the text last asked for, which a chunker and the count of its chunks' tokens share."""
    return Ruler(text, tokenizer)


def trim(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The range without white space at its ends."""
    piece = text[lo:hi]
    lo += len(piece) - len(piece.lstrip())
    return lo, lo + len(piece.strip())


def outermost(ranges: Ranges) -> Ranges:
    """Without ranges inside the last one kept."""
    out: Ranges = []
    for r in ranges:
        if not out or r[0] < out[-1][0] or r[1] > out[-1][1]:
            out.append(r)
    return out


def fixed(text: str, size: int = 512, overlap: int | None = None, tokenizer: str = "regex") -> Ranges:
    """Windows of size tokens, size - overlap apart, each begun overlap tokens early."""
    overlap = size // 8 if overlap is None else overlap
    spans = token_spans(text, tokenizer)
    out: Ranges = []
    for at in range(0, len(spans), size - overlap):
        out.append(trim(text, spans[max(0, at - overlap)][0], spans[min(len(spans), at + size) - 1][1]))
        if at + size >= len(spans):
            break
    return outermost(out)


SEPARATORS = (*"\n\n|\n|. |? |! |; |, | ".split("|"), "")


def recursive(text: str, size: int = 512, overlap: int | None = None, tokenizer: str = "regex", separators: tuple[str, ...] = SEPARATORS) -> Ranges:
    """Pieces cut at the coarsest separator that makes them fit, packed again up to size tokens."""
    if not text.strip():
        return []
    overlap = size // 8 if overlap is None else overlap
    ruler = Ruler(text, tokenizer)

    def windows(lo: int, hi: int) -> Ranges:
        own = token_spans(text[lo:hi], tokenizer)
        return [(lo + own[i][0], lo + own[min(len(own), i + size) - 1][1]) for i in range(0, len(own), size)] or [(lo, hi)]

    pieces: Ranges = []
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if lo >= hi:
            continue
        if ruler.count(lo, hi) <= size:
            pieces.append((lo, hi))
        elif level >= len(separators) or separators[level] == "":
            pieces += windows(lo, hi)
        else:
            sep, cuts, at = separators[level], [lo], lo
            while (found := text.find(sep, at, hi)) >= 0:
                at = found + len(sep)
                cuts.append(at)
            if cuts[-1] != hi:
                cuts.append(hi)
            todo += [(a, b, level + 1) for a, b in reversed(list(zip(cuts, cuts[1:])))]
    packed: Ranges = []
    for lo, hi in pieces:
        if packed and ruler.count(packed[-1][0], hi) <= size:
            packed[-1] = packed[-1][0], hi
        else:
            packed.append((lo, hi))
    packed = [trim(text, lo, hi) for lo, hi in packed]
    if overlap <= 0 or len(packed) < 2:
        return packed
    return [packed[0], *((ruler.back(lo, overlap), hi) for lo, hi in packed[1:])]


_CLOSERS = re.escape("\"')]’”")
_END = re.compile(rf"[!.?]+[{_CLOSERS}]*(?!\S)")
_BEFORE = frozenset("\"')]’”!.?")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SHORT = frozenset("al approx cf corp dr eg etc ie inc jr ltd mr mrs ms prof sr vs".split())
_SHORT_CAPITAL = frozenset("Art Ch Co Fig No Sec St Vol".split())


def _goes_on(text: str, at: int) -> bool:
    """Whether the mark at this place ends an abbreviation or a number, not a sentence."""
    if text[at + 1 : at + 2].isdigit():
        return True
    least = max(0, at - 200)
    hi = at - 1 if at > least and text[at - 1] == "\n" else at
    while hi > least and text[hi - 1] in _BEFORE:
        hi -= 1
    if hi > least and text[hi - 1].isdecimal():
        return True
    lo = hi
    while lo > least and hi - lo < 8 and text[lo - 1] in _LETTERS:  # no abbreviation has 8 letters
        lo -= 1
    return text[lo:hi].lower() in _SHORT or text[lo:hi] in _SHORT_CAPITAL


def sentences(text: str) -> Ranges:
    out, at = [], 0
    for m in _END.finditer(text):
        if not _goes_on(text, m.start()):
            out.append(trim(text, at, m.end()))
            at = m.end()
    out.append(trim(text, at, len(text)))
    return [r for r in out if r[0] < r[1]]


def sentence_windows(text: str, window: int = 3, stride: int = 1) -> Ranges:
    parts, out = sentences(text), []
    for at in range(0, len(parts), stride):
        out.append((parts[at][0], parts[min(len(parts), at + window) - 1][1]))
        if at + window >= len(parts):
            break
    return outermost(out)


def paragraphs(text: str) -> Ranges:
    """Paragraphs, which blank lines separate."""
    out, at = [], 0
    for m in re.finditer(r"\n[ \t]*\n", text):
        out.append(trim(text, at, m.start()))
        at = m.end()
    out.append(trim(text, at, len(text)))
    return [r for r in out if r[0] < r[1]]


_ATX = re.compile(r"(#{1,6})[\t ]")
_UNDER = re.compile(r"(?:--+|=+)[\t ]*$")
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_KINDS = ((re.compile(r"[\t ]*\|(?:.*\|)[\t ]*$"), "table"), (re.compile(r"[\t ]*(?:\d+[).]|[*+-])[\t ]"), "list_item"), (re.compile(r"[ \t]*>"), "quote"))

Block = tuple[int, int, str, int | None]


def markdown_blocks(text: str) -> list[Block]:
    """(start, end, kind, level) of headings, fenced code, tables, lists, quotes and paragraphs, in order."""
    out: list[Block] = []
    held: Ranges = []
    held_kind, fence, fence_at, at = "paragraph", None, 0, 0

    def flush() -> None:
        if held:
            lo, hi = trim(text, held[0][0], held[-1][1])
            if lo < hi:
                out.append((lo, hi, held_kind, None))
            held.clear()

    for line in text.split("\n"):
        lo, hi = at, at + len(line)
        at = hi + 1
        if fence is not None:
            if line.strip()[:3] == fence:
                out.append((fence_at, hi, "code", None))
                fence = None
        elif m := _FENCE.match(line):
            flush()
            fence, fence_at = m[1], lo
        elif m := _ATX.match(line):
            flush()
            out.append((lo, hi, "heading", len(m[1])))
        elif len(held) == 1 and _UNDER.match(line) and text[slice(*held[0])].strip():
            out.append((held[0][0], hi, "heading", 1 if line.startswith("=") else 2))
            held.clear()
        elif not line.strip():
            flush()
        else:
            kind = next((k for p, k in _KINDS if p.match(line)), "paragraph")
            if kind != held_kind:
                flush()
            held_kind = kind
            held.append((lo, hi))
    if fence is not None:
        out.append((fence_at, len(text), "code", None))
    flush()
    return sorted(out, key=lambda b: b[0])


def structural(text: str, max_size: int = 512, min_size: int | None = None, split_tables: bool = False, tokenizer: str = "regex") -> Ranges:
    """A section for each heading; small ones join the one before, large ones are cut, tables are kept whole."""
    if not text.strip():
        return []
    min_size = max_size // 8 if min_size is None else min_size
    blocks, ruler = markdown_blocks(text), Ruler(text, tokenizer)
    heads = [b[0] for b in blocks if b[2] == "heading"]
    if not heads:
        return recursive(text, max_size, 0, tokenizer)
    parts = [trim(text, lo, hi) for lo, hi in zip([0, *heads], [*heads, len(text)])]
    merged: Ranges = []
    for lo, hi in parts:
        if lo >= hi:
            continue
        if merged and ruler.count(lo, hi) < min_size and ruler.count(merged[-1][0], hi) <= max_size:
            merged[-1] = merged[-1][0], hi
        else:
            merged.append((lo, hi))
    tables = [] if split_tables else [(b[0], b[1]) for b in blocks if b[2] == "table"]

    def split(lo: int, hi: int) -> Ranges:
        return [(lo + a, lo + b) for a, b in recursive(text[lo:hi], max_size, 0, tokenizer)]

    out: Ranges = []
    for lo, hi in merged:
        if ruler.count(lo, hi) <= max_size:
            out.append((lo, hi))
            continue
        for a, b in tables:
            if lo <= a and b <= hi:
                out += [*split(lo, a), (a, b)] if lo < a else [(a, b)]
                lo = b
        out += split(lo, hi) if lo < hi else []
    return [r for r in out if r[0] < r[1]]


def percentile(values: list[float], p: float) -> float:
    """Between the two nearest ranks, linearly."""
    ordered = sorted(values)
    if not ordered:
        return 0.0
    at = p / 100 * (len(ordered) - 1)
    lo = int(at)
    hi = min(lo + 1, len(ordered) - 1)
    return ordered[lo] + (ordered[hi] - ordered[lo]) * (at - lo)


def semantic(text: str, cut_at: float = 90.0, buffer: int = 1, max_size: int = 1024, similarity: Callable[[list[str]], list[float]] | None = None, tokenizer: str = "regex") -> Ranges:
    """Runs of sentences, cut where neighbouring windows are least alike: at this percentile of the text's own distances."""
    parts = sentences(text)
    if len(parts) < 2:
        return parts
    from .vectors import tfidf_neighbours

    windows = [text[parts[max(0, i - buffer)][0] : parts[min(len(parts), i + buffer + 1) - 1][1]] for i in range(len(parts))]
    far = [1 - s for s in (similarity or tfidf_neighbours)(windows)]
    cutoff = percentile(far, cut_at)
    ruler, out, first = ruler_of(text, tokenizer), [], 0
    for i in range(1, len(parts) + 1):
        lo, hi = parts[first][0], parts[i - 1][1]
        if i == len(parts) or (far[i - 1] >= cutoff and far[i - 1] > 0) or ruler.count(lo, hi) >= max_size:
            out.append((lo, hi))
            first = i
    return out


def heading_paths(text: str) -> list[tuple[int, list[str]]]:
    """Where each heading starts, and the titles from the top down to it."""
    stack: list[tuple[int, str]] = []
    out = []
    for lo, hi, kind, level in markdown_blocks(text):
        if kind == "heading":
            title = text[lo:hi].split("\n")[0].strip().strip("#").strip()
            stack = [s for s in stack if s[0] < level] + [(level, title)]
            out.append((lo, [t for _, t in stack]))
    return out


CHUNKERS: dict[str, Callable[..., Ranges]] = {"fixed": fixed, "recursive": recursive, "sentence": sentence_windows, "structural": structural, "semantic": semantic}
