"""Periodic runs of words, by recompression: a run-length grammar answers exact extensions of harmonic-grid candidates.

The words of a slice of texts become one sequence of symbols with a mark of its own between texts. Recompression
shortens it level by level: block compression replaces each maximal block of one symbol by a symbol for (symbol,
count), then pair compression parts the symbols into left and right ones by a bit of their hash and replaces each left
symbol with the right one behind it. Equal stretches are so replaced alike but at their ends, and each level has about
three quarters of the symbols of the one below.

The longest common extension of two places climbs the levels while both places begin a symbol, compares a symbol or
two where they do not, and comes down where symbols differ: two steps a level, never a scan. The mirrored levels
answer extensions to the left.

A run of period p holds a stretch of at least max(p, 12 - p) places that equal the place p further, so it holds one
whose number is a multiple of that. These harmonic grids have n log n places in all; a place whose word and one
neighbour recur p further is a candidate, and its two extensions give the whole run or none.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomdoc.llm.common import columns_of, mix, slices, word_hashes, word_spans

LEAST = 12
#: Grid places looked at in one step.
STEP = 1 << 18

_PAIR = np.array([0xD1342543DE82EF95, 0xA0761D6478BD642F], np.uint64)
_BLOCK = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class Grammar:
    """Levels of a sequence: the symbols of each, and of each but the lowest where its symbols begin in the one below.

    Symbols are 64-bit hashes of what they stand for, so equal stretches have equal symbols wherever they lie.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.first, self.block = [symbols], [np.zeros(0, np.int64)], [False]
        while len(symbols) > 1:
            block = not self.block[-1]
            if block:
                begins = np.r_[True, symbols[1:] != symbols[:-1]]
            else:
                left = (mix(symbols + np.uint64(len(self.block))) & np.uint64(1)).astype(bool)
                begins = np.r_[True, ~(left[:-1] & ~left[1:])]
            first = np.append(np.flatnonzero(begins), len(symbols))
            count, symbols = np.diff(first), symbols[first[:-1]]
            many = np.flatnonzero(count > 1)
            if block:
                symbols[many] = mix(symbols[many] * _BLOCK[0] + count[many].astype(np.uint64) * _BLOCK[1])
            else:
                symbols[many] = mix(symbols[many] * _PAIR[0] + self.symbols[-1][first[many] + 1] * _PAIR[1])
            self.symbols.append(symbols)
            self.first.append(first)
            self.block.append(block)

    def mirrored(self) -> "Grammar":
        """The grammar of the sequence read from its end."""
        out = object.__new__(Grammar)
        out.block = self.block
        out.symbols = [s[::-1] for s in self.symbols]
        out.first = [self.first[0], *[f[-1] - f[::-1] for f in self.first[1:]]]
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each two different places, how many symbols from there on are equal. Some symbol must differ before
        the sequence ends."""
        begun, met = i, [[] for _ in self.symbols]
        who = np.arange(len(i))
        for level in range(len(self.symbols)):
            if not len(who):
                break
            symbols = self.symbols[level]
            if level + 1 == len(self.symbols):
                met[level].append((who, i, j))
                break
            first = self.first[level + 1]
            up = [np.searchsorted(first, at, "right") - 1 for at in (i, j)]
            risen = [[], [], []]
            while len(who):
                even = (first[up[0]] == i) & (first[up[1]] == j)
                for out, values in zip(risen, (who, *up)):
                    out.append(values[even])
                same = symbols[i] == symbols[j]
                ends = ~even & ~same
                met[level].append((who[ends], i[ends], j[ends]))
                on = ~even & same
                who, i, j, up = who[on], i[on], j[on], [u[on] for u in up]
                step = np.minimum(first[up[0] + 1] - i, first[up[1] + 1] - j)
                i, j = i + step, j + step
                up = [np.searchsorted(first, at, "right") - 1 for at in (i, j)]
            who, i, j = (np.concatenate(x) for x in risen)
        length = np.zeros(len(begun), np.int64)
        carried = (np.zeros(0, np.int64),) * 3
        for level in reversed(range(len(self.symbols))):
            who, i, j = (np.concatenate(x) for x in zip(carried, *met[level]))
            if not level:
                break
            first, below = self.first[level], self.symbols[level - 1]
            sizes = [first[at + 1] - first[at] for at in (i, j)]
            i, j = first[i], first[j]
            step = np.where(below[i] == below[j], np.minimum(*sizes) if self.block[level] else 1, 0)
            carried = who, i + step, j + step
        length[who] = i - begun[who]
        return length


def _grid(lengths: np.ndarray, ends: np.ndarray, least: int):
    """(places, periods), some at a time by rising period, over texts in falling order of length in one sequence."""
    longest = int(lengths[0]) // 2 if len(lengths) else 0
    periods = np.arange(1, longest + 1)
    long_enough = np.searchsorted(-lengths, -np.maximum(2 * periods, least), "right")
    limit = np.where(long_enough > 0, ends[np.maximum(long_enough - 1, 0)], 0)
    every = np.maximum(periods, least - periods)
    counts = limit // every
    at = 0
    while at < longest:
        upto = max(at + 1, at + int(np.searchsorted(np.cumsum(counts[at : at + 4096]), STEP)))
        upto = min(upto, longest)
        n = counts[at:upto]
        period, spacing = np.repeat(periods[at:upto], n), np.repeat(every[at:upto], n)
        number = np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)
        for part in range(0, len(period), STEP):
            yield (number[part : part + STEP] + 1) * spacing[part : part + STEP], period[part : part + STEP]
        at = upto


def find_runs(symbols: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of every text, by text, start and period.

    ``symbols`` are the texts' words one text after the other. A run is a stretch with smallest period p of at least
    ``least`` and 2 p words that no neighbouring word extends.
    """
    empty = np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= least]
    if not len(order):
        return empty, empty, empty, empty
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    # One mark before each text and one behind the last.
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes
    sequence = mix(np.arange(ends[-1] + 1, dtype=np.uint64) + np.uint64(0x5EED << 40))
    for b, s, n in zip(begins, starts, sizes):
        sequence[b : b + n] = symbols[s : s + n]
    ahead = Grammar(sequence)
    back, last = ahead.mirrored(), len(sequence) - 1
    # Period and end of a run found over each place; multiples of its period say nothing new inside it.
    covering, reach = np.zeros(len(sequence), np.int64), np.zeros(len(sequence), np.int64)
    found = []
    for place, period in _grid(sizes, ends, least):
        inside = place + period < last
        place, period = place[inside], period[inside]
        agree = sequence[place] == sequence[place + period]
        place, period = place[agree], period[agree]
        near = (sequence[place + 1] == sequence[place + period + 1]) | (sequence[place - 1] == sequence[place + period - 1])
        known = (covering[place] > 0) & (period % np.maximum(covering[place], 1) == 0) & (place + period < reach[place])
        place, period = place[near & ~known], period[near & ~known]
        if not len(place):
            continue
        right = ahead.extension(place, place + period)
        left = back.extension(last - place + 1, last - place - period + 1)
        good = right + left >= np.maximum(period, least - period)
        runs = np.unique(np.stack([(place - left)[good], (right + left + period)[good], period[good]]), axis=1)
        for start, length, p in runs.T.tolist():
            found.append((start, length, p))
            if length >= 4 * p:
                new = covering[start : start + length] == 0
                covering[start : start + length][new] = p
                reach[start : start + length][new] = start + length
    if not found:
        return empty, empty, empty, empty
    start, length, period = np.array(found, np.int64).T
    # A stretch found again with a multiple of its smallest period.
    rank = np.lexsort((period, length, start))
    start, length, period = start[rank], length[rank], period[rank]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
    start, length, period = start[new], length[new], period[new]
    which = np.searchsorted(begins, start, "right") - 1
    text, start = order[which], start - begins[which]
    rank = np.lexsort((period, start, text))
    return text[rank], start[rank], length[rank], period[rank]


def _runs_of(batches):
    """Runs and collapsed text of each text."""
    for batch in batches:
        for part, data, offsets in slices(batch):
            row, begin, end = word_spans(data, offsets)
            lengths = np.bincount(row, minlength=part.num_rows)
            text, start, length, period = find_runs(word_hashes(data, begin, end, fold=False), lengths)
            base = np.cumsum(lengths) - lengths
            change = np.zeros(len(row) + 1, np.int32)
            np.add.at(change, base[text] + start + period, 1)
            np.add.at(change, base[text] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            collapsed, raw = [], data.tobytes()
            has_runs = np.bincount(text, minlength=part.num_rows) > 0
            for i in range(part.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                if has_runs[i]:
                    words = [words[k] for k in np.flatnonzero(kept[base[i] : base[i] + lengths[i]])]
                collapsed.append(b" ".join(words))
            edges = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), runs),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of (doc_id, text): all runs as (start, length, period) in words,
    by start and then period, and the text without the words that a run holds behind its first period.

    A word is a run of other characters than white space of ASCII; the collapsed text has one blank between words.
    A run has its smallest period p, at least 12 and 2 p words, and no neighbouring word extends it. Runs may overlap,
    and a word goes if any run drops it. Null and empty texts have no words and no runs and an empty collapsed text.
    Rows are answered one by one: repeated rows and null ids come out as they went in, an empty table gives an empty
    one, other columns are ignored. Texts are read whole in slices of a few megabytes, a longer one alone; memory is
    some hundred bytes for each word of the longest slice. Words are compared by 64-bit hashes.
    """
    docs = columns_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_runs_of, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
