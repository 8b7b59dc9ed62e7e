"""Statistics of each document's text that tell running prose from lists, tables and junk, in any language.

Layout of each block of lines: vertical alignment (runs of lines with as many of a delimiter or bracket, or of wide gaps, and short cells
between), list marks, the period of the indentation and the autocorrelation of line lengths. Lines that these show to be rows of a table or
items of a list stand by themselves; all other text of a block runs on over its line ends.

Running text is cut into sentences, and a sentence counts as prose if it can be read as one: it begins with a capital (or a letter of a
script without case) and is closed by . ! ? or …, has between LEAST_WORDS and MOST_WORDS words of ordinary length, most of them different,
is made of letters rather than digits and symbols, and isn't for its greater part in rows or items. So word lists, word salad, code,
encoded bytes and records aren't prose, whatever their language, and wrapped, indented or bulleted sentences are. Scripts without blanks between
words aren't covered.

Words thrown together at random may have capitals and stops, but not in a usual order: how usually one of the COMMON words that most texts
of the collection have follows another is counted over the whole collection (so the counts have a fixed bound), and a block whose pairs of common words are unusual isn't prose.
Texts of the same words count once and a text's own pairs don't count for it, so that neither it nor its copies make their own order
usual. Nothing is listed per language: a language that is rare in the collection has few common words and is judged by layout and sentences alone.

Everything is computed on arrays over a chunk of documents; only the common words of each text, counts added up in each task, and repeated ids
are shuffled.

Defined results: a null or blank text has no characters, so that its shares are null and it isn't reported as lacking prose.
Rows without an id are left out; repeated ids give one row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.splitting import _white
from pressmill.llm.text_arrays import Words, chunks, is_word, mix, words

RUN, LAGS, PERIODIC, CHANCE, COMMON, LEAST_USUAL, LEAST_PAIRS = 3, 4, 0.5, 3.0, 100, -5.5, 5
LEAST_WORDS, MOST_WORDS, MOST_IN_CELL = 4, 80, 3.5
LEAST_LETTERS, MOST_SYMBOLS, LEAST_DIFFERENT = 0.7, 0.2, 0.5
WORD_LENGTH = (2.0, 12.0)
_DELIMITERS = tuple(map(ord, "|\t,;=(<"))
_BULLETS, _ENDS, _CLOSERS, _MARKS = "-*•·–+", ".!?…", "\"'”“’»)]", ".):"
_CLOSING = _ENDS + _CLOSERS + ":;"
STATS = (
    "doc_id long, words long, mean_word_length double, symbol_ratio double, digit_ratio double, closed_lines double, common_words double, "
    "aligned_share double, list_share double, indent_period double, length_autocorrelation double, prose_share double"
)
NAMES = [c.split()[0] for c in STATS.split(", ")]


@lru_cache(1)
def _begins() -> np.ndarray:
    """By code point: whether a sentence may begin with it."""
    return np.fromiter(((x := chr(c)).isupper() or x.istitle() or x.isalpha() and x.lower() == x.upper() for c in range(0x110000)), bool, 0x110000)


@lru_cache(8)
def _table(characters: str) -> np.ndarray:
    """By code point: whether it is one of the characters."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in characters]] = True
    return out


def _autocorrelation(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The largest autocorrelation of each group's series at lags up to LAGS; 0 where it doesn't vary."""
    size = np.maximum(np.bincount(group, minlength=n), 1)
    c = x - (np.bincount(group, x, n) / size)[group]
    power = np.bincount(group, c * c, n)
    best = np.full(n, -1.0)
    for lag in range(1, LAGS + 1):
        same = group[lag:] == group[:-lag]
        r = np.bincount(group[lag:][same], (c[lag:] * c[:-lag])[same], n)
        best = np.maximum(best, np.where(power > 0, r / np.maximum(power, 1e-9), 0))
    return best


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """For each line the length of the run it is in; same[k] tells whether line k continues the run of line k - 1."""
    run = np.cumsum(~same)
    return np.bincount(run)[run]


def _ahead(x: np.ndarray, k: int, fill) -> np.ndarray:
    return np.concatenate((x[k:], np.full(min(k, len(x)), fill, x.dtype)))


def _once(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash comes first in its group."""
    return np.unique(mix(group.astype(np.uint64)) ^ h, return_index=True)[1]


def _which(w: Words, common: np.ndarray) -> np.ndarray:
    """The number of each word among the common ones, or their number if it is none."""
    if not len(common):
        return np.zeros(len(w.hash), np.int64)
    k = np.minimum(np.searchsorted(common, w.hash), len(common) - 1)
    return np.where(common[k] == w.hash, k, len(common))


def _streams(w: Words, common: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Per text a hash of its words in order, and the numbers of its common words, with a mark where others stand between."""
    k, n = _which(w, common), len(common)
    keep = k < n
    keep[1:] |= (k[:-1] < n) & (w.text[1:] == w.text[:-1])
    place = np.arange(len(k)) - w.first[w.text]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w.hash + mix(place + 1)))))
    at = np.searchsorted(w.text[keep], np.arange(len(w.first)))
    codes = k[keep].astype(np.uint16)
    return (sums[w.first[1:]] - sums[w.first[:-1]]).view(np.int64), [codes[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]


def usual_pairs(docs: DataFrame, common: np.ndarray) -> np.ndarray:
    """How often each pair of common words, then each common word, occurs in all documents; texts of the same words count once."""
    n = len(common)

    def listed(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in chunks(texts):
                key, streams = _streams(words(texts[s:e]), common)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(streams, pa.binary())], ["key", "listed"])

    def count(batches):
        total = np.zeros(n * n + n, np.int64)
        for b in batches:
            k = np.frombuffer(b"\xff\xff".join(b.column(0).to_pylist()), np.uint16).astype(np.int64)
            both = (k[:-1] < n) & (k[1:] < n)
            total += np.bincount(np.concatenate(((k[:-1] * n + k[1:])[both], n * n + k[k < n])), minlength=n * n + n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    # only the common words of a text are shuffled; in the end at most n * n + n rows, whatever the input
    once = docs.select("text").mapInArrow(listed, "key long, listed binary").where("length(listed) > 0").dropDuplicates(["key"])
    total = np.zeros(n * n + n)
    for pair, c in once.select("listed").mapInArrow(count, "pair long, n long").groupBy("pair").agg({"n": "sum"}).collect():
        total[pair] = c
    return total


def _usualness(w: Words, common: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, log of how usually the second follows it in other texts) of the adjacent common words that others tell about."""
    n, k = len(common), _which(w, common)
    at = np.flatnonzero((k[:-1] < n) & (k[1:] < n) & (w.text[:-1] == w.text[1:])) if len(k) else k
    pair = k[at] * n + k[at + 1] if len(at) else at
    listed = np.flatnonzero(k < n)
    _, which, own = np.unique(w.text[listed] * n + k[listed], return_inverse=True, return_counts=True)
    single = np.zeros(len(k))
    single[listed] = usual[n * n + k[listed]] - own[which]
    _, which, own = np.unique(w.text[at] * n * n + pair, return_inverse=True, return_counts=True)
    together = np.maximum(usual[pair] - own[which], 0)
    likely = np.sqrt(np.maximum(single[at], 1) * np.maximum(single[at + 1], 1))
    # a pair never seen says something only if a usual one would have been
    told = (together > 0) | (likely * np.exp(LEAST_USUAL) >= 1)
    return at[told], np.log((together + 0.01) / likely)[told]


def measure(texts: list[str | None], common: np.ndarray | None = None, usual: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The statistics of a chunk of texts, by name; common: hashes of the common words, in order, and usual: the counts of usual_pairs."""
    n = len(texts)
    w = words(texts, keep_case=True)
    codes = w.codes
    feed = codes == 10
    line = np.cumsum(feed) - feed
    L = int(line[-1]) + 1 if len(line) else 0
    count = lambda mask: np.bincount(line[mask], minlength=L).astype(float)
    white = _white()[codes]
    solid = ~white
    digit = (codes >= 48) & (codes <= 57)
    letter = is_word(codes) & ~digit
    text = np.searchsorted(w.text_at, np.flatnonzero(feed), "right") - 1
    full, lettered, digits = count(solid), count(letter), count(digit)
    symbols = full - lettered - digits
    wl = line[w.start]
    length = (w.end - w.start).astype(float)
    some, chars = np.bincount(wl, minlength=L).astype(float), np.bincount(wl, length, L)
    # the first and last solid characters of each line
    place = np.flatnonzero(solid)
    first, last = np.full(L, -1), np.full(L, -1)
    first[line[place[::-1]]] = place[::-1]
    last[line[place]] = place
    begin = np.concatenate(([0], np.flatnonzero(feed)[:-1] + 1))[:L]
    indent = np.where(first >= 0, first - begin, 0).astype(float)
    blank = full == 0
    head, after = codes[np.maximum(first, 0)], codes[np.minimum(np.maximum(first, 0) + 1, len(codes) - 1)] if L else first
    continues = np.zeros(L, bool)
    if L > 1:
        continues[1:] = (text[1:] == text[:-1]) & ~blank[1:] & ~blank[:-1]
    block = np.cumsum(~continues) - 1
    blocks = int(block[-1]) + 1 if L else 0
    # list marks: a bullet, or a number and a mark, before the rest of the line
    number_end = np.zeros(L, np.int64)
    numbered = np.zeros(L, bool)
    if len(w.start):
        opener = np.searchsorted(w.start, np.maximum(first, 0))
        safe = np.minimum(opener, len(w.start) - 1)
        at_word = (w.start[safe] == first) & (first >= 0)
        number_end[at_word] = w.end[safe][at_word]
        numbered = at_word & digit[np.maximum(first, 0)] & _table(_MARKS)[codes[np.minimum(number_end, len(codes) - 1)]]
    listed = (_table(_BULLETS)[head] & _white()[after] | numbered) & ~blank
    closed = _table(_CLOSING)[codes[np.maximum(last, 0)]] & ~blank
    # vertical alignment: as many of a delimiter as in the lines around it, with few words between
    small = is_word(head) & ~_begins()[head] & ~((head >= 48) & (head <= 57))
    runs_on = (_ahead(small, 1, False) & _ahead(continues, 1, False)) if L else blank  # lines that end in the middle of a sentence
    aligned = np.zeros(L, bool)
    gap = np.zeros(len(codes), bool)
    if len(codes) > 2:
        gap[2:] = solid[2:] & (codes[1:-1] == 32) & (codes[:-2] == 32) & (line[2:] == line[:-2])
        gap &= np.arange(len(codes)) > first[line]
    for mask in [*(codes == c for c in _DELIMITERS), gap]:
        c = count(mask)
        cells = (c >= 1) & (some <= MOST_IN_CELL * (c + 1)) & ~runs_on
        # a wide gap may be narrow in a row with a long cell
        same = continues & cells & np.append(False, (np.abs(c[1:] - c[:-1]) <= (mask is gap)) & cells[:-1])[:L]
        aligned |= (_run_lengths(same) >= RUN) & cells
    # blocks whose indentation or line lengths come again and again
    shown = np.flatnonzero(~blank)
    size = np.bincount(block[shown], minlength=blocks)
    periodic = np.zeros(blocks, bool)
    for x in (indent, full):
        # by chance the autocorrelation of k lines varies by 1 / sqrt(k)
        periodic |= _autocorrelation(x[shown], block[shown], blocks) >= np.maximum(PERIODIC, CHANCE / np.sqrt(np.maximum(size, 1)))
    # rows and items stand by themselves, as do the lines of such blocks, unless they end in the middle of a sentence
    regular = periodic[block] & ~closed & ~runs_on if L else blank
    sums = np.concatenate(([0], np.cumsum(digit)))
    numeric = np.bincount(wl, sums[w.end] - sums[w.start] == w.end - w.start, L) > some / 2
    item = (aligned | listed | regular | numeric) & ~blank
    # sentences: from a block's, row's or item's beginning, or the stop before, to the next stop
    opens = np.zeros(len(codes) + 1, bool)
    end, closer = _table(_ENDS)[codes], _table(_CLOSERS)[codes]
    one, two = _ahead(closer, 1, False), _ahead(closer, 2, False)
    # up to two closing marks may follow
    stop = end & (_ahead(white, 1, True) | one & (_ahead(white, 2, True) | two & _ahead(white, 3, True)))
    if len(w.start):
        # a stop behind a number ends a sentence only if the next word begins one
        at = np.flatnonzero(stop)
        next_word = np.searchsorted(w.start, at, "right")
        follows = codes[w.start[np.minimum(next_word, len(w.start) - 1)]]
        within = (next_word < len(w.start)) & digit[np.maximum(at - 1, 0)] & ~_begins()[follows] & (block[line[w.start[np.minimum(next_word, len(w.start) - 1)]]] == block[line[at]])
        stop[at[within]] = False
    opens[1:][stop] = True
    goes_on = np.zeros(L, bool)  # lines that continue the item before
    if L > 1:
        goes_on[1:] = item[:-1] & ~item[1:] & continues[1:] & ~_begins()[head[1:]]
    alone = ~continues | item
    alone[1:] |= item[:-1] & ~goes_on[1:]
    opens[begin[alone]] = True
    sentence = np.cumsum(opens[:-1])
    S = int(sentence[-1]) + 1 if len(sentence) else 0
    per = lambda mask: np.bincount(sentence[mask], minlength=S).astype(float)
    s_full, s_letters, s_digits = per(solid), per(letter), per(digit)
    s_symbols = s_full - s_letters - s_digits
    ws = sentence[w.start]
    s_words, s_chars = np.bincount(ws, minlength=S), np.bincount(ws, length, S)
    different = np.bincount(ws[_once(ws, w.hash)], minlength=S)
    ended = per(stop) > 0
    lead = np.zeros(S, np.int64)
    alpha = np.flatnonzero(letter)
    lead[sentence[alpha[::-1]]] = alpha[::-1]
    mean = s_chars / np.maximum(s_words, 1)
    in_item = np.bincount(sentence, (item & ~(listed & closed & ~aligned))[line] & solid, S) if S else s_full
    prose = (
        ended & _begins()[codes[lead]] & (s_letters > 0) & (s_words >= LEAST_WORDS) & (s_words <= MOST_WORDS) & (mean >= WORD_LENGTH[0]) & (mean <= WORD_LENGTH[1])
        & (different >= LEAST_DIFFERENT * s_words) & (s_letters >= LEAST_LETTERS * s_full) & (s_symbols <= MOST_SYMBOLS * s_full) & (in_item <= s_full / 2)
    )
    if usual is not None and L:
        at, score = _usualness(w, common, usual)
        inner = block[wl[at]] == block[wl[at + 1]]
        at, score = at[inner], score[inner]
        pairs_n = np.bincount(block[wl[at]], minlength=blocks)
        odd = (pairs_n >= LEAST_PAIRS) & (np.bincount(block[wl[at]], score, blocks) < LEAST_USUAL * pairs_n)
        prose &= ~odd[block[line[lead]]]
    of_text = lambda x: np.bincount(text, x, n)
    solid_n, lines_n, words_n = of_text(full), of_text((~blank).astype(float)), of_text(some)
    part = lambda x, whole: np.where(whole > 0, x / np.maximum(whole, 1), np.nan)
    often = np.zeros(L) if common is None else np.bincount(wl, _which(w, common) < len(common), L)
    return {
        "words": words_n.astype(np.int64), "mean_word_length": part(of_text(chars), words_n), "symbol_ratio": part(of_text(symbols), solid_n),
        "digit_ratio": part(of_text(digits), solid_n), "closed_lines": part(of_text(closed.astype(float)), lines_n), "common_words": part(of_text(often), words_n),
        "aligned_share": part(of_text(full * aligned), solid_n), "list_share": part(of_text(full * listed), solid_n),
        "indent_period": _autocorrelation(indent[shown], text[shown], n), "length_autocorrelation": _autocorrelation(full[shown], text[shown], n),
        "prose_share": part(of_text(np.bincount(line[solid], prose[sentence[solid]], L) if L else full), solid_n),
    }


def common_words(docs: DataFrame, k: int = COMMON) -> np.ndarray:
    """Hashes of the k words that most rows of the collection contain, in order."""

    def count(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in chunks(texts):
                w = words(texts[s:e])
                h, n = np.unique(w.hash[_once(w.text, w.hash)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    top = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(k)
    return np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(np.uint64))


def text_quality(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to a row of statistics per document."""
    common = common_words(docs)
    usual = usual_pairs(docs, common)

    def rows(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in chunks(texts):
                m = measure(texts[s:e], common, usual)
                columns = [b.column(0).slice(s, e - s).cast(pa.int64())]
                for name in NAMES[1:]:
                    columns.append(pa.array(m[name], pa.int64() if name == "words" else pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(rows, STATS).dropDuplicates(["doc_id"])


def lacking_prose(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id) of the documents of which prose makes up less than ``least`` of the characters that aren't blank."""
    return text_quality(docs).where(f"prose_share < {least}").select("doc_id")
