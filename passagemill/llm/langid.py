"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text recognises every substring of that text. A document is
parsed greedily into the longest phrases that a language's text contains; the number of phrases c of n characters
estimates the cross entropy as c * log2(N) / n bits a character. N is the length of the longest language's text, for
all languages: with its own, a language of little text would be charged little for what it does not know. The
language with the fewest phrases wins.

The greedy parse only walks forward from the root, so that a table of transitions is all it needs; where one lacks, a
phrase ends and the next begins at the root. A table takes room in proportion to the labelled sample, not to the alphabet.
A batch of documents runs in lockstep, one vectorised lookup a character position and language. One scan, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._common import code_points, free_names, frugal, named, pick, slices, utf8

#: Bounds of the labelled sample that the automata are fitted to: documents and characters a language.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 24_000
#: A document whose complete phrases alone cost more bits a character is in none of the languages: other
#: scripts cost over 14, text of the fitted languages with numbers, codes and names in it up to 5.5.
MAX_BITS = 6.0
#: The least N, so that a phrase a character costs more than MAX_BITS however little text the labels have.
LEAST_N = 256
_CHUNK = 1 << 19


def _letters() -> np.ndarray:
    """Lower case of each letter of the basic plane, else 0."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0]) if ord(chr(c).lower()[0]) < 0x10000 else c
    return table


_LETTERS: list[np.ndarray] = []


def normalised(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, each run of anything else as one 0, none at either end of a text; new offsets."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    low = np.where(points < 0x10000, _LETTERS[0][np.minimum(points, 0xFFFF)], points)
    keep = low != 0
    if len(low):
        follows = np.zeros(len(low), bool)
        follows[1:] = keep[:-1]
        inner = np.ones(len(low), bool)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        inner[firsts] = False
        # a separator stays if a letter precedes it in the same text and another letter follows later
        last_letter = np.full(len(offsets) - 1, -1, np.int64)
        at = np.flatnonzero(keep)
        if len(at):
            doc = np.searchsorted(offsets, at, "right") - 1
            last_letter[doc] = at
        sep = np.flatnonzero(~keep & follows & inner)
        sep = sep[sep < last_letter[np.searchsorted(offsets, sep, "right") - 1]]
        keep[sep] = True
    total = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return low[keep], total[offsets]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton whose paths from state 0 are the substrings of text."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def overlapped(nxt: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions as rows of a table that overlap: a row is moved until its entries fall on free places, and each place knows
    the state it belongs to. (row, owner, to): a place a transition or little more, however large the alphabet."""
    sizes = np.array([len(t) for t in nxt], np.int64)
    row = np.zeros(len(nxt) + 1, np.int64)
    owner, to = np.full(int(sizes.sum()) + 8192, -1, np.int64), np.zeros(int(sizes.sum()) + 8192, np.int64)
    low = 0  # no place before it is free
    for state in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[state]:
            continue
        columns = np.fromiter(nxt[state], np.int64, sizes[state])
        least, most = int(columns.min()), int(columns.max())
        at = max(0, low - least)
        while True:
            if at + most + 4097 > len(owner):
                more = len(owner) + most + 4097
                owner, to = np.concatenate([owner, np.full(more, -1, np.int64)]), np.concatenate([to, np.zeros(more, np.int64)])
            free = owner[at + columns[0] : at + columns[0] + 4096] < 0
            for c in columns[1:].tolist():
                free &= owner[at + c : at + c + 4096] < 0
            gap = int(free.argmax())
            if free[gap]:
                at += gap
                break
            at += 4096
        owner[at + columns], row[state] = state, at
        to[at + columns] = np.fromiter(nxt[state].values(), np.int64, sizes[state])
        while low < len(owner) and owner[low] >= 0:
            low += 1
    return row, owner, to


class Model:
    """The tables of all languages, one after another, and their common alphabet."""

    def __init__(self, texts: dict[str, str]) -> None:
        """texts: labelled text by language, documents separated by a line feed."""
        self.languages = sorted(texts)
        parts = {}
        for lang in self.languages:
            points, offsets = code_points(pa.array(texts[lang].split("\n")))
            low, off = normalised(points, offsets)
            parts[lang] = [low[off[i] : off[i + 1]] for i in range(len(off) - 1) if off[i + 1] > off[i]]
        self.alphabet = np.unique(np.concatenate([np.zeros(1, np.uint32), *[p for x in parts.values() for p in x]]))  # 0, the separator, comes first
        self.width = len(self.alphabet) + 1  # the last column: a character that no text has
        rows, owners, tos, firsts, self.roots, sizes, states, places = [], [], [], [], [], [], 0, 0
        for lang in self.languages:
            coded: list[int] = []
            for p in parts[lang]:
                coded += np.searchsorted(self.alphabet, p).tolist() + [0]
            nxt = suffix_automaton(coded)
            row, owner, to = overlapped(nxt)
            last = int(np.flatnonzero(owner >= 0).max(initial=-1)) + 1
            first = np.full(self.width, len(nxt), np.int64)  # after a character that the language's text lacks: a phrase that nothing extends
            for c, s in nxt[0].items():
                first[c] = s
            pad = np.full(self.width, -1, np.int64)  # so that no row reads into the next language's
            rows.append(row + places), owners.append(np.concatenate([np.where(owner[:last] < 0, -1, owner[:last] + states), pad])), tos.append(np.concatenate([to[:last] + states, pad]))
            firsts.append(first + states)
            self.roots.append(states)
            sizes.append(len(coded))
            states, places = states + len(row), places + last + self.width
        joined = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
        self.row, self.owner, self.to, self.first = joined(rows), joined(owners), joined(tos), joined(firsts)
        self.bits = [math.log2(max([LEAST_N, *sizes]))] * len(sizes)

    def encode(self, low: np.ndarray) -> np.ndarray:
        """Columns of the tables for normalised characters."""
        codes = np.searchsorted(self.alphabet, low)
        codes[codes == len(self.alphabet)] = 0
        codes[self.alphabet[codes] != low] = self.width - 1
        return codes.astype(np.uint8 if self.width <= 256 else np.uint16 if self.width <= 65_536 else np.int32)

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of phrases: (language, text). A phrase that the end of the text cuts counts."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        lengths, place = lengths[order], offsets[:-1][order].copy()
        live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(lengths), 1)
        begin = np.arange(len(self.roots), dtype=np.int32)[:, None] * np.int32(self.width)
        count = np.zeros(state.shape, np.int32)
        row, owner, to, first = self.row, self.owner, self.to, self.first
        for k in live.tolist():
            code, now = codes[place[:k]], state[:, :k]
            at = row[now] + code
            new = owner[at] != now
            state[:, :k] = np.where(new, first[begin + code], to[at])
            count[:, :k] += new
            place[:k] += 1
        out = np.empty_like(count)
        # the first character has no phrase before it to end: it counts only if the root lacks it
        lead = np.flatnonzero(lengths > 0)
        known = np.ones(count.shape, bool)
        if len(lead):
            code = codes[offsets[:-1][order][lead]]
            root = np.array(self.roots)[:, None]
            known[:, lead] = owner[row[root] + code] == root
        out[:, order] = count + (lengths > 0) - ~known
        return out

    def identify(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (index), its entropy in bits a character, the same without the last phrase, which the
        end of the text cuts, its phrases, and characters that counted."""
        codes, n = [], np.zeros(len(col), np.int64)
        for lo, hi in slices(utf8(col)[1], _CHUNK):  # what is wider than a byte a character is held for a few texts only
            low, offsets = normalised(*code_points(col.slice(lo, hi - lo)))
            codes.append(self.encode(low))
            n[lo:hi] = np.diff(offsets)
        offsets = np.concatenate([[0], np.cumsum(n)])
        if not self.languages:
            zero = np.zeros(len(n))
            return zero.astype(np.int64), zero, zero, zero, n
        phrases = self.phrases(np.concatenate(codes) if codes else np.zeros(0, np.uint8), offsets)
        bits = phrases * np.array(self.bits)[:, None] / np.maximum(n, 1)
        best = np.argmin(bits, axis=0)
        at = np.arange(len(n))
        c = phrases[best, at]
        return best, bits[best, at], bits[best, at] * (c - 1) / np.maximum(c, 1), c, n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit to at most sample_docs labelled documents a language, those with the smallest hashed ids, and to
    sample_chars characters of them: short ones whole, the rest of the room in even shares. What comes to the driver is
    sample_chars characters of each of them at most. The ids are chosen without reading a text."""
    labelled = pick(docs, id=id_col, lang=lang_col).where("id is not null and lang is not null")
    hashed = F.xxhash64(F.col("id").cast("string"))
    chosen = labelled.select("id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(hashed, "id")).alias("nth")).where(F.col("nth") <= sample_docs)
    ids = [r.id for r in chosen.select("id").distinct().collect()]
    texts: dict[str, list[str]] = {}
    rows = pick(docs, id=id_col, lang=lang_col, text=text_col).where(F.col("id").isin(ids) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    for r in sorted(rows.select("lang", "id", F.substring("text", 1, sample_chars).alias("text")).collect(), key=lambda r: (r.lang, str(r.id), r.text)):
        texts.setdefault(r.lang, []).append(r.text.replace("\n", " "))
    fitted = {}
    for lang, parts in texts.items():
        left, kept = sample_chars, []
        for i, part in enumerate(sorted(parts, key=len)):  # short ones leave their share to the rest
            part = part[: left // (len(parts) - i)]
            kept.append(part)
            left -= len(part)
        fitted[lang] = "\n".join(kept)
    return Model(fitted)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """(doc_id, lang, bits, phrases, chars, accepted) for every row.

    lang: the language of the fewest phrases, the first by name if several tie; null, with null
    bits, for a text without a letter, an empty or null text, and with a model of no language. accepted: a
    language was found and the entropy of all but the last phrase is at most max_bits. Repeated rows give repeated rows, null ids stay,
    texts of any length count whole, and extra columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.languages, pa.string())
        for batch in batches:
            best, bits, whole, phrases, n = m.identify(batch.column(1))
            none = (n == 0) | (not m.languages)
            lang = names.take(pa.array(best, mask=none)) if m.languages else pa.nulls(len(n), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(bits, mask=none), pa.array(phrases.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(~none & (whole <= max_bits))], ["id", "lang", "bits", "phrases", "chars", "accepted"])

    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    found = picked.mapInArrow(frugal(run), f"id {kind}, lang string, bits double, phrases bigint, chars bigint, accepted boolean")
    return found.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, that identify() accepts, with the language found in lang_col; one scan, no join.

    Null, empty and letterless texts go, and all rows with a model of no language. Null ids and labels, repeated rows and texts
    of any length are no obstacle. A table without lang_col gets it. Clashing names as in free_names()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = free_names(docs)
    if lang_col.lower() not in [c.lower() for c in docs.columns]:
        docs = docs.withColumn(lang_col, F.lit(None).cast("string"))
    lang = docs.columns.index(named(docs, lang_col))
    docs = docs.withColumn(docs.columns[lang], F.col(docs.columns[lang]).cast("string"))
    at = docs.columns.index(named(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value.languages, pa.string())
        for batch in batches:
            if len(names):
                best, _, whole, _, n = shared.value.identify(batch.column(at))
                found = batch.set_column(lang, batch.schema.names[lang], names.take(pa.array(best)))
                yield found.filter(pa.array((n > 0) & (whole <= max_bits)))

    return docs.mapInArrow(frugal(run), docs.schema)
