"""Text quality: statistics per document and a robust Mahalanobis distance from its language's prose.

A text is read in segments: the lines between blank lines, in groups of at least SEGMENT characters where there are more.
Each segment gets seven statistics. Per language, mean and covariance of prose are fitted to the segments of all documents
by concentration: from medians and quartiles on, only segments within a quantile of the distance enter the next mean and
covariance. A segment beyond the cut isn't running text, and each statistic's part of its squared distance says why.
Languages borrow from all, the more the smaller they are.

Two distances are given. The plain one is the Mahalanobis distance itself. In the one that decides, a deviation to the good
side (more common words or longer lines than in ordinary prose, fewer symbols, digits or repetitions) is no deviation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

STATISTICS = ("word_length", "common_share", "symbol_share", "digit_share", "line_words", "line_ends", "repetition")
NO_FAULT_ABOVE = ("common_share", "line_words")  # more of it than in ordinary prose makes no text junk
NO_FAULT_BELOW = ("symbol_share", "digit_share", "repetition")
SEGMENT = 600  # characters
PIECE = 1_000_000  # characters worked on at a time; a longer text is taken in parts that change nothing
FEW = 20.0  # segments of all that a language's mean is mixed with
PRIOR = 4.0  # words, or lines, of ordinary prose added to a segment, so that a short one isn't judged by chance
NGRAM = 8  # a run of so many words is repeated if the text had it before
CUT = 20.28  # 0.995 of a chi-squared distribution with as many degrees of freedom as there are statistics
# Kinds of characters.
OTHER, LETTER, DIGIT, SPACE, LINE, END, INNER, MARKUP, SYMBOL = range(9)
_ENDS = ".!?…:"
_INNER = ",;'\"’‘“”«»„()¿¡–—-‐"
_MARKUP = "*_>#`~"


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character below 0x30000; those above are symbols."""
    kind, low = np.full(0x30001, SYMBOL, np.uint8), np.arange(0x30001, dtype=np.uint32)
    for i in range(0x30000):
        c = chr(i)
        category = unicodedata.category(c)
        if category[0] == "L":
            kind[i] = LETTER
            x = c.lower()
            low[i] = ord(x) if len(x) == 1 else i
        elif category[0] == "N":
            kind[i] = DIGIT
        elif category[0] == "M" or category == "Cf":
            kind[i] = OTHER
        elif c in "\n\x0b\x0c\r\x85  ":
            kind[i] = LINE
        elif c.isspace():
            kind[i] = SPACE
        elif c in _ENDS:
            kind[i] = END
        elif c in _INNER:
            kind[i] = INNER
        elif c in _MARKUP:
            kind[i] = MARKUP
    return kind, low


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sums(starts: np.ndarray, ends: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])
    return c[ends] - c[starts]


def word_hash(word: str) -> int:
    """The hash that measure() gives a word."""
    h, p = 0, 1
    for c in word.lower():
        h = (h + ord(c) * p) % (1 << 64)
        p = p * _BASE % (1 << 64)
    return h


@dataclass
class Before:
    """What a part of a long text needs to know of the parts before: characters of the open paragraph, the last words, and the
    hashes of all runs of words so far."""

    inside: int = 0
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def measure(texts: list[str], tables: list[np.ndarray], before: Before | None = None) -> dict[str, np.ndarray]:
    """Counts per segment of the texts: text (its number), chars, words, letters, solid (characters other than white space),
    symbols, digits, lines, ended (lines that end in punctuation), grams, repeated, and common_0, common_1, ... the words
    found in each of the sorted tables of word hashes. A run of words counts where it ends. With before, texts is one part
    of a text, and before is brought up to its end."""
    text = "\n".join(texts) + "\n"
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x30000)
    kinds, low = _kinds()
    kind = kinds[code]
    edges = np.cumsum([len(t) + 1 for t in texts])
    # lines
    line_end = np.flatnonzero(kind == LINE)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    owner = np.searchsorted(edges, line_start, "right")
    solid = (kind != SPACE) & (kind != LINE) & (kind != OTHER)
    here = _sums(line_start, line_end, solid)
    seen = np.maximum.accumulate(np.where(solid | (kind == LINE), np.arange(len(kind)), -1))  # the last solid character so far
    last = np.where(here > 0, kind[seen[np.maximum(line_end - 1, 0)]], SPACE)
    # words: runs of letters
    letter = kind == LETTER
    flips = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    begin, stop = flips[::2], flips[1::2]
    up, down = _powers(len(code))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low[code].astype(np.uint64) * up[:-1] * letter)])
    word = (total[stop] - total[begin]) * down[begin]
    del total, up, down
    first = np.searchsorted(begin, line_start)
    after = np.searchsorted(begin, line_end)
    # runs of words, by their last word
    known = before.words if before is not None else np.zeros(0, np.uint64)
    line = np.concatenate([known, word])
    whole, again = np.zeros(len(line), bool), np.zeros(len(line), bool)
    runs = np.zeros(0, np.uint64)
    if len(line) >= NGRAM:
        n = len(line) - NGRAM + 1
        run = np.zeros(n, np.uint64)
        for j in range(NGRAM):
            run = run * np.uint64(0xD6E8FEB86659FD93) + line[j : j + n]
        of = np.concatenate([np.zeros(len(known), np.int64), np.searchsorted(edges, begin, "right")])
        valid = of[:n] == of[NGRAM - 1 :]
        run = run + of[:n].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        order = np.argsort(run, kind="stable")
        same = run[order][1:] == run[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        if before is not None:
            at = np.searchsorted(before.runs, run)
            at[at == len(before.runs)] = 0
            twice |= before.runs[at] == run if len(before.runs) else False
            runs = np.unique(np.concatenate([before.runs, run]))
        whole[NGRAM - 1 :], again[NGRAM - 1 :] = valid, valid & twice
    whole, again = whole[len(known) :], again[len(known) :]
    # segments: lines between blank ones, in groups
    blank = here == 0
    para = np.cumsum(blank | (np.diff(owner, prepend=-1) > 0))
    chars = line_end - line_start
    upto = np.cumsum(chars) - chars
    start_of = np.flatnonzero(np.diff(para, prepend=-1))
    inside = upto - upto[start_of][np.cumsum(np.diff(para, prepend=-1) > 0) - 1]
    if before is not None:
        inside = inside + np.where(para == para[0], 0 if blank[0] else before.inside, 0)
        before.inside = int(inside[-1] + chars[-1])
        before.words, before.runs = line[max(0, len(line) - NGRAM + 1) :], runs if len(runs) else before.runs
    keep = np.flatnonzero(~blank)
    if not len(keep):
        return {"text": np.zeros(0, np.int64)}
    new = np.concatenate([[True], (np.diff(para[keep]) > 0) | (np.diff(inside[keep] // SEGMENT) > 0)])
    cuts = np.flatnonzero(new)
    group = lambda x: np.add.reduceat(x[keep].astype(np.int64), cuts)
    out = {"text": owner[keep][cuts], "chars": group(chars), "words": group(after - first), "solid": group(here), "lines": group(~blank)}
    out["letters"] = group(_sums(line_start, line_end, letter))
    out["symbols"] = group(_sums(line_start, line_end, kind == SYMBOL))
    out["digits"] = group(_sums(line_start, line_end, kind == DIGIT))
    out["ended"] = group(last == END)
    out["grams"] = group(_sums(first, after, whole))
    out["repeated"] = group(_sums(first, after, again))
    for i, t in enumerate(tables):
        out[f"common_{i}"] = group(_sums(first, after, np.isin(word, t)))
    return out


def parts(text: str, size: int) -> list[str]:
    """A long text cut at line ends that begin a segment, into parts of about `size` characters; a line, or a segment, is never
    cut, however long. The line end itself falls away."""
    code = np.minimum(np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), 0x30000)
    kind = _kinds()[0][code]
    ends = np.flatnonzero(kind == LINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    blank = _sums(starts, ends, (kind != SPACE) & (kind != LINE) & (kind != OTHER)) == 0
    para = np.cumsum(blank)
    chars = ends - starts
    upto = np.cumsum(chars) - chars
    inside = upto - upto[np.flatnonzero(np.diff(para, prepend=-1))][np.cumsum(np.diff(para, prepend=-1) > 0) - 1]
    filled = np.flatnonzero(~blank)
    if not len(filled):
        return [text]
    new = np.concatenate([[False], (np.diff(para[filled]) > 0) | (np.diff(inside[filled] // SEGMENT) > 0)])
    spots, out, at = starts[filled[new]], [], 0
    while len(text) - at > size and (k := int(np.searchsorted(spots, at + size))) < len(spots):
        out.append(text[at : spots[k] - 1])
        at = int(spots[k])
    return [*out, text[at:]]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(positions, texts) in groups of about PIECE characters; a longer text comes alone."""
    at, held, size = [], [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if not t.isascii():
            t = unicodedata.normalize("NFC", t)
        if size and size + len(t) > PIECE:
            yield at, held
            at, held, size = [], [], 0
        at.append(i)
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _measured(held: list[str], tables: list[np.ndarray]) -> dict[str, np.ndarray]:
    """measure() of the texts; of a single long one part by part."""
    if len(held) > 1 or len(held[0]) <= PIECE:
        return measure(held, tables)
    before = Before()
    found = [m for m in (measure([p], tables, before) for p in parts(held[0], PIECE)) if len(m["text"])]
    return {c: np.concatenate([m[c] for m in found]) for c in found[0]} if found else {"text": np.zeros(0, np.int64)}


def segments(documents: DataFrame, key: str, text: str, lang: str, common: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc, segment, lang, chars, counts, x): one row per segment that has a character, x being its STATISTICS; and the
    languages. common: (lang, word), a side table of fixed size. A segment's language is that of most common words in it; of
    fewer than three, that of the document's words in this batch; without any, the document's own, if known."""
    words: dict[str, set] = {}
    for r in common.where("lang IS NOT NULL AND word IS NOT NULL").collect():
        words.setdefault(r["lang"], set()).add(r["word"])
    names = sorted(words)
    # apostrophes end a word here; a word of the table that has one can't be found
    tables = [np.sort(np.array([word_hash(w) for w in words[n] if w.isalpha()], np.uint64)) for n in names]
    count = ("words", "letters", "solid", "symbols", "digits", "lines", "ended", "grams", "repeated")
    kind = documents.schema[key].dataType.simpleString()
    shape = f"doc {kind}, segment int, lang string, chars long, {', '.join(f'{c} long' for c in count)}, common long, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, said = b.column(1).to_pylist(), b.column(2).to_pylist()
            number = np.zeros(len(texts), np.int64)
            for at, part in _pieces(texts):
                m = _measured(part, tables)
                if not len(m["text"]):
                    continue
                row = np.array(at)[m["text"]]
                hits = np.stack([m[f"common_{i}"] for i in range(len(names))], 1) if names else np.zeros((len(row), 1), np.int64)
                per = np.zeros((len(texts), hits.shape[1]), np.int64)
                np.add.at(per, row, hits)
                best = np.where(hits.max(1) >= 3, hits.argmax(1), np.where(per[row].max(1) > 0, per[row].argmax(1), -1))
                known = np.array([names.index(x) if x in words else -1 for x in said] or [-1])
                best = np.where(best < 0, known[row], best)
                common_ = hits.max(1)
                w, n = m["words"], m["lines"]
                size = np.maximum(m["solid"], 1)
                x = np.stack([
                    (m["letters"] + 4.5 * PRIOR) / (w + PRIOR),
                    (common_ + 0.45 * PRIOR) / (w + PRIOR),
                    m["symbols"] / (size + 4 * PRIOR),
                    m["digits"] / (size + 4 * PRIOR),
                    np.log((w + PRIOR) / n),
                    (m["ended"] + 0.7) / (n + 1),
                    m["repeated"] / (m["grams"] + PRIOR),
                ], 1)
                order = np.concatenate([np.arange(c) for c in np.bincount(row, minlength=len(texts))]) if len(row) else row
                order = order + number[row]
                number += np.bincount(row, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(order.astype(np.int32)), pa.array([names[i] if i >= 0 else None for i in best], pa.string()), pa.array(m["chars"]), *(pa.array(m[c]) for c in count), pa.array(common_), pa.array(list(x), pa.list_(pa.float64()))],
                    names=["doc", "segment", "lang", "chars", *count, "common", "x"],
                )

    return documents.select(key, text, lang).mapInArrow(run, shape), names


BINS = {"word_length": (0.0, 25.0), "line_words": (0.0, 12.0)}  # ranges of statistics that aren't shares, for their quantiles
GRID = 2000  # bins of a statistic's range


def _by_language(found: DataFrame, columns: list[str], add) -> dict[str | None, np.ndarray]:
    """The sum over all segments of a vector per language that add(batch of one language, x) gives, and under None that of all.
    Sums are added up batch by batch with numpy and place by place in one aggregate; no more than a vector per language
    comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            x = _numbers(b.column("x"))
            names = b.column("lang").dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for c in np.unique(code):
                name = names.dictionary[int(c)].as_py() if c >= 0 else None
                v = add(b, x, code == c)
                sums[name] = sums[name] + v if name in sums else v
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "at", "v"])

    rows = found.select("lang", "x", *columns).mapInArrow(run, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    size = max((r["at"] for r in rows), default=-1) + 1
    out: dict = {None: np.zeros(size)}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(size))[r["at"]] += r["v"]
    whole = sum(out.values(), np.zeros(size))
    return {**{k: v for k, v in out.items() if k is not None}, None: whole}


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scale() -> tuple[np.ndarray, np.ndarray]:
    low, high = np.array([BINS.get(s, (0.0, 1.0)) for s in STATISTICS]).T
    return low, high - low


def fit(found: DataFrame, rounds: int = 4, inner: float = 16.0, borrow: float = 300.0) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance of prose for each language and for None, the whole. Each round is one pass over all segments of
    at least eight words. A language's mean is mixed with that of FEW segments of all, its covariance with that of `borrow`."""
    k = len(STATISTICS)
    low, width = _scale()

    def counts(b: pa.RecordBatch, x: np.ndarray, mine: np.ndarray) -> np.ndarray:
        mine = mine & (b.column("words").to_numpy() >= 8)
        at = np.clip((x[mine] - low) / width * GRID, 0, GRID - 1).astype(np.int64) + np.arange(k) * GRID
        return np.bincount(at.ravel(), minlength=k * GRID).astype(np.float64)

    histograms = _by_language(found, ["words"], counts)
    if not histograms[None].any():
        return {}
    full = {name: np.pad(h, (0, k * GRID - len(h))).reshape(k, GRID) for name, h in histograms.items()}
    floor = np.array([0.3, 0.03, 0.01, 0.03, 0.25, 0.15, 0.03])  # least standard deviations

    def quartiles(h: np.ndarray) -> np.ndarray:
        upto = np.cumsum(h, 1)
        return np.stack([[(np.searchsorted(u, p * u[-1]) + 0.5) / GRID for u in upto] for p in (0.25, 0.5, 0.75)], 1) * width[:, None] + low[:, None]

    of_all = quartiles(full[None])
    models = {}
    for name, h in full.items():
        n = h[0].sum()
        if n:
            q = (n * quartiles(h) + FEW * of_all) / (n + FEW)
            models[name] = (q[:, 1], np.diag(1 / np.maximum((q[:, 2] - q[:, 0]) / 1.349, floor) ** 2))
    i, j = np.triu_indices(k)
    for _ in range(rounds):
        now = models

        def moments(b: pa.RecordBatch, x: np.ndarray, mine: np.ndarray) -> np.ndarray:
            mine = np.flatnonzero(mine & (b.column("words").to_numpy() >= 8))
            name = b.column("lang")[int(mine[0])].as_py() if len(mine) else None
            x = x[mine]
            x = x[_contributions(now.get(name, now[None]), x)[0].sum(1) <= inner]
            return np.concatenate([[len(x)], x.sum(0), (x[:, i] * x[:, j]).sum(0)])

        got = _by_language(found, ["words"], moments)
        if not len(got[None]) or got[None][0] < 2:
            break

        def fitted(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            n, mean, second = v[0], v[1 : k + 1] / v[0], np.zeros((k, k))
            second[i, j] = second[j, i] = v[k + 1 :] / n - mean[i] * mean[j]
            return n, mean, second

        got = {name: np.pad(v, (0, 1 + k + len(i) - len(v))) for name, v in got.items()}
        _, mean, whole = fitted(got[None])
        models = {None: (mean, np.linalg.inv(whole + np.diag(floor**2)))}
        for name, v in got.items():
            if name is not None and v[0] > 0:
                n, m, c = fitted(v)
                models[name] = ((n * m + FEW * mean) / (n + FEW), np.linalg.inv((n * c + borrow * whole) / (n + borrow) + np.diag(floor**2)))
    return models


def _contributions(model: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each statistic's part of the squared distance that decides, and the plain squared distance, of each row."""
    mean, inverse = model
    off = x - mean
    plain = np.einsum("ij,jk,ik->i", off, inverse, off)
    for s in NO_FAULT_ABOVE:
        off[:, STATISTICS.index(s)] = np.minimum(off[:, STATISTICS.index(s)], 0.0)
    for s in NO_FAULT_BELOW:
        off[:, STATISTICS.index(s)] = np.maximum(off[:, STATISTICS.index(s)], 0.0)
    return off * (off @ inverse), plain


COUNTS = ("chars", "words", "letters", "solid", "symbols", "digits", "lines", "ended", "grams", "repeated", "common")


def text_quality(documents: DataFrame, key: str, text: str, lang: str, common: DataFrame, beyond: float = CUT) -> DataFrame:
    """One row per document with a text that has a character: key, lang, chars, words, mean_word_length, symbol_share,
    digit_share, line_end_share, common_share, line_words, repeated_share, distance (the mean of its segments' distances by
    characters), plain_distance (that of their plain Mahalanobis distances), outlying_share (the part of its characters in segments whose squared distance exceeds `beyond`), and for each
    of STATISTICS part_<statistic>, its mean part of the squared distance by characters.

    Null texts and those of white space only give no row; repeated keys are one document with all their segments. lang is
    that of its longest segment. Texts of any length are read whole; parts of long ones change nothing. Statistics and models cover all
    documents; per language one mean and covariance come to the driver, no text does.
    """
    found, names = segments(documents, key, text, lang, common)
    found = cut(found)
    models = fit(found)
    if not models:
        models = {None: (np.zeros(len(STATISTICS)), np.eye(len(STATISTICS)))}
    kind = documents.schema[key].dataType.simpleString()
    sums = (*COUNTS, "far", "plain", "out", *(f"part_{s}" for s in STATISTICS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, said = _numbers(b.column("x")), b.column("lang").to_pylist()
            share, plain = np.empty_like(x), np.empty(len(x))
            tongue = np.array([names.index(n) if n is not None and n in models else -1 for n in said])
            for c in np.unique(tongue):
                mine = tongue == c
                share[mine], plain[mine] = _contributions(models[names[c] if c >= 0 else None], x[mine])
            d, chars = share.sum(1), b.column("chars").to_numpy().astype(np.float64)
            columns = [b.column(c).to_numpy().astype(np.float64) for c in COUNTS]
            columns += [chars * np.sqrt(np.maximum(d, 0.0)), chars * np.sqrt(np.maximum(plain, 0.0)), np.where(d > beyond, chars, 0.0), *(chars * share[:, i] for i in range(x.shape[1]))]
            doc = b.column("doc")
            new = np.ones(len(x), bool)
            if len(x) > 1:
                new[1:] = ~pc.fill_null(pc.equal(doc.slice(1), doc.slice(0, len(x) - 1)), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)  # a document's segments lie together, so mostly one row each is left
            longest = np.lexsort((tongue, chars, np.cumsum(new)))[np.append(starts[1:], len(x)) - 1]
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(starts)), pa.array(chars[longest].astype(np.int64)), pa.array([said[i] for i in longest], pa.string()), *(pa.array(np.add.reduceat(c, starts)) for c in columns)], names=["doc", "most", "lang", *sums])

    scored = found.select("doc", "lang", "x", *COUNTS).mapInArrow(score, f"doc {kind}, most long, lang string, {', '.join(f'{c} double' for c in sums)}")
    by = scored.groupBy("doc").agg(*[F.sum(c).alias(c) for c in sums], F.max(F.struct("most", "lang"))["lang"].alias("lang"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1.0)), 6)
    mean = lambda c: F.round(F.col(c) / F.col("chars"), 6)
    return by.select(
        F.col("doc").alias(key), "lang", F.col("chars").cast("long").alias("chars"), F.col("words").cast("long").alias("words"), share("letters", "words").alias("mean_word_length"), share("symbols", "solid").alias("symbol_share"), share("digits", "solid").alias("digit_share"), share("ended", "lines").alias("line_end_share"), share("common", "words").alias("common_share"), share("words", "lines").alias("line_words"), share("repeated", "grams").alias("repeated_share"),
        mean("far").alias("distance"), mean("plain").alias("plain_distance"), mean("out").alias("outlying_share"), *[mean(f"part_{s}").alias(f"part_{s}") for s in STATISTICS],
    )
