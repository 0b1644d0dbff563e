"""Phrase collocations by contiguous pattern growth over projected occurrences (after PrefixSpan, Pei et al. 2001).

Texts are lowered (A-Z), cut into pieces at sentence marks and line ends, and pieces into words. A
phrase is a run of words of one piece; everything is counted per language.

 1. Words are counted. A word's number is a 64-bit hash of it and its language; should two
    words share one, which is looked for, all is numbered anew by another hash.
 2. Projection: for every occurrence of a frequent word, the words to its right go to that
    prefix, up to the end of the piece or to an infrequent word, which no frequent phrase
    holds. What is infrequent is read off a bitmap of 2**23 places (1 MB, whatever the input); a
    word that shares the place of a frequent one stays, which costs room but no count. A task sums
    equal occurrences of some million words at a time, so a prefix is a row with lists.
 3. Growth: each prefix is dealt to one task, which extends it to the right, depth first: in sorted
    order the occurrences of each longer prefix lie together, and only runs of at least `least` are
    followed further. A prefix with over 1 / SHARES of all words (there are fewer than SHARES such) is
    dealt in parts by its second word, so every longer prefix still lies in one part. Where a
    part is too large for the memory set aside (MOST occurrences), its sums go on unjudged
    and Spark adds them up; the bar is applied after that.
 4. Scores: each phrase is cut after each word; both parts are frequent, so their counts are there to
    be joined. Arithmetic is in decimals of 38 digits and whole-number division.
 5. Phrases that a longer one mostly accounts for are dropped, and the best of each language
    are ranked: first within groups of rows dealt by hash, keeping ties, and then among those that
    are left, so no task sees all phrases of a language.

Defined results: null texts have no words, a null language counts as `und`; a row's id isn't used, so
null and repeated ids do no harm and repeated rows count as often as they occur. Long texts are worked
on in stretches that end between words. An empty table has no phrases. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.llm.common import lowered, mix, span_hashes, stored, text_buffer, tidy, word_spans

#: Ends of pieces and white space between words, as the contract has them.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[list(b".,;:!?\n\v\f\r")] = True
BLANK = np.zeros(256, bool)
BLANK[list(b" \t")] = True
_IN_WORD = ~(PIECE_ENDS | BLANK)

#: Bytes of text, words held (times `longest`), occurrences looked at together, and those of one prefix that wait for more of it.
STRETCH, FLUSH, AT_ONCE, MOST = 4 << 20, 4 << 20, 1 << 20, 1 << 21
PLACES, SHARES = 1 << 23, 4096
NO_LANG = "und"


@dataclass
class _Words:
    """Consecutive words: their numbers, the piece each belongs to (rising), the language's place in `langs`; and where they lie in data."""

    ids: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class _Langs:
    """The languages met by a task, and a hash of each."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, int] = {}
        self.hashes: list[int] = []

    def places(self, column: pa.Array) -> np.ndarray:
        coded = column.fill_null(NO_LANG).dictionary_encode()
        for name in coded.dictionary.to_pylist():
            if name not in self.at:
                self.at[name] = len(self.names)
                self.names.append(name)
                self.hashes.append(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))
        own = np.array([self.at[name] for name in coded.dictionary.to_pylist()], np.int32)
        return own[coded.indices.to_numpy()]


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit number of each word's bytes; every seed has its own."""
    if not seed:
        return span_hashes(data, starts, ends)
    key = seed.to_bytes(8, "little")
    return np.array([int.from_bytes(hashlib.blake2b(data[s:e].tobytes(), digest_size=8, key=key).digest(), "little") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _stretches(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes that end between texts, or, in a longer text, between words."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + most, end)
        if to < end:
            row = int(np.searchsorted(offsets, to, side="right")) - 1
            if offsets[row] > at:
                to = int(offsets[row])
            else:
                until = int(offsets[row + 1])
                while to < until and _IN_WORD[data[to - 1]]:
                    some = _IN_WORD[data[to : min(to + 4096, until)]]
                    to += len(some) if some.all() else int(some.argmin()) + 1
        yield at, to
        at = to


def _words(batches: Iterator[pa.RecordBatch], langs: _Langs, seed: int) -> Iterator[_Words]:
    """All words of all texts in order, a stretch at a time."""
    piece = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = text_buffer(batch.column("text"))
        lang = langs.places(batch.column("lang"))
        seeds = np.array(langs.hashes, np.uint64)
        for s, e in _stretches(raw, offsets, STRETCH):
            data = lowered(raw[s:e])
            first = max(int(np.searchsorted(offsets, s, side="right")) - 1, 0)
            last = int(np.searchsorted(offsets, e, side="left"))
            cuts = np.clip(offsets[first : last + 1], s, e) - s
            starts, ends, rows = word_spans(data, cuts, _IN_WORD)
            row = np.repeat(np.arange(first, first + len(rows) - 1), np.diff(rows))
            marks = np.cumsum(PIECE_ENDS[data])
            ids = mix(_numbers(data, starts, ends, seed) + seeds[lang[row]])
            ids[ids == 0] = 1
            yield _Words(ids, piece + row + marks[starts], lang[row], data, starts, ends)
            piece += int(marks[-1]) if len(marks) else 0
        piece += batch.num_rows + 1


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)]
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def _unlike(w: _Words, like: np.ndarray) -> np.ndarray:
    """Places of the words that differ, in bytes or language, from those at the places `like`."""
    size = w.ends - w.starts
    differs = (size != size[like]) | (w.lang != w.lang[like])
    size = np.where(differs, 0, size)
    before = np.cumsum(size) - size
    step = np.arange(size.sum())
    wrong = w.data[np.repeat(w.starts - before, size) + step] != w.data[np.repeat(w.starts[like] - before, size) + step]
    differs[np.repeat(np.arange(len(size)), size)[wrong]] = True
    return np.flatnonzero(differs)


def _input(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null")


def word_counts(texts: DataFrame, seed: int = 0) -> DataFrame:
    """id, lang, word, f. texts: text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = _Langs()
        for w in _words(batches, langs, seed):
            ids, first, own, count = np.unique(w.ids, return_index=True, return_inverse=True, return_counts=True)
            other = _unlike(w, first[own])
            count -= np.bincount(own[other], minlength=len(ids))
            ids, first, count = np.r_[ids, w.ids[other]], np.r_[first, other], np.r_[count, np.ones(len(other), int)]
            names = pa.DictionaryArray.from_arrays(pa.array(w.lang[first]), pa.array(langs.names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), names, _texts(w.data, w.starts[first], w.ends[first]), pa.array(count.astype(np.int64))], names=["id", "lang", "word", "c"])

    found = texts.mapInArrow(tidy(run), "id long, lang string, word string, c long")
    return found.groupBy("id", "lang", "word").agg(F.sum("c").alias("f"))


def _numbered(texts: DataFrame, most_seeds: int = 8) -> tuple[DataFrame, int]:
    """Stored word counts in which no two words share a number, and the seed that gave them."""
    for seed in range(most_seeds):
        words = stored(word_counts(texts, seed), "words")
        if not words.groupBy("id").count().where("count > 1").limit(1).count():
            return words, seed
    raise ValueError(f"words share 64-bit numbers under {most_seeds} hashes")


def _frequent_places(words: DataFrame, least: int) -> np.ndarray:
    """Whether a frequent word's number falls to each of PLACES places."""
    place = F.pmod(F.col("id"), F.lit(PLACES)) + 1
    some = words.where(F.col("f") >= least).groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(PLACES, bool)
    for r in some.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.k - 1) * len(bits) : r.k * len(bits)] = bits[: PLACES - (r.k - 1) * len(bits)]
    return out


def _hot(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (sorted) of the words with over 1 / SHARES of all occurrences, fewer than SHARES of them, and the parts of each."""
    total = words.agg(F.sum("f")).first()[0] or 0
    got = sorted((r.id % (1 << 64), -(-r.f * SHARES // total)) for r in words.where(F.col("f") * SHARES > total).select("id", "f").collect()) if total else []
    return np.array([k for k, _ in got], np.uint64), np.array([p for _, p in got], np.int64)


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lists(cut: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))


def project(texts: DataFrame, places: np.ndarray, hot: tuple[np.ndarray, np.ndarray], longest: int, seed: int = 0) -> DataFrame:
    """lang, prefix, part, w2 .. w<longest> (lists of numbers, 0: none), times: the distinct right contexts of a word in FLUSH words of text."""
    shared = texts.sparkSession.sparkContext.broadcast((np.packbits(places), *hot))
    after = [f"w{k}" for k in range(2, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, hot_ids, hot_parts = shared.value
        frequent, langs = np.unpackbits(packed).astype(bool), _Langs()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            ids, piece, lang = (np.concatenate(x) for x in zip(*held, strict=True))
            held[:] = [] if last else [(ids[1 - longest :], piece[1 - longest :], lang[1 - longest :])]
            n = len(ids) if last else len(ids) - (longest - 1)
            known = frequent[(ids & np.uint64(PLACES - 1)).astype(np.int64)]
            open_, columns = known[:n].copy(), []
            for k in range(1, longest):
                there = np.zeros(n, bool)
                there[: len(ids) - k] = (known[k:] & (piece[k:] == piece[:-k]))[:n]
                open_ &= there
                word = np.zeros(n, np.uint64)
                word[: len(ids) - k] = ids[k:][:n]
                columns.append(np.where(open_, word, np.uint64(0)))
            some = columns[0] != 0
            prefix, lang, columns = ids[:n][some], lang[:n][some], [c[some] for c in columns]
            if not len(prefix):
                return
            part = np.zeros(len(prefix), np.int32)
            if len(hot_ids):
                at = np.minimum(np.searchsorted(hot_ids, prefix), len(hot_ids) - 1)
                is_hot = hot_ids[at] == prefix
                part[is_hot] = (mix(columns[0][is_hot]) % hot_parts[at[is_hot]].astype(np.uint64)).astype(np.int32)
            order = np.lexsort((*columns[::-1], part, prefix))
            prefix, part, lang, columns = prefix[order], part[order], lang[order], [c[order] for c in columns]
            one = _runs([prefix, part, *columns])
            times = np.diff(np.r_[one, len(prefix)])
            prefix, part, lang, columns = prefix[one], part[one], lang[one], [c[one] for c in columns]
            own = _runs([prefix, part])
            cut = np.r_[own, len(prefix)]
            names = pa.DictionaryArray.from_arrays(pa.array(lang[own]), pa.array(langs.names, pa.string())).cast(pa.string())
            lists = [_lists(cut, c.view(np.int64), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([names, pa.array(prefix[own].view(np.int64)), pa.array(part[own]), *lists, _lists(cut, times.astype(np.int32), pa.int32())], names=["lang", "prefix", "part", *after, "times"])

        for w in _words(batches, langs, seed):
            held.append((w.ids, w.piece, w.lang))
            if sum(len(x[0]) for x in held) >= FLUSH // longest + longest:
                yield from flush(False)
        if held:
            yield from flush(True)

    return texts.mapInArrow(tidy(run), "lang string, prefix long, part int, " + ", ".join(f"{c} array<long>" for c in after) + ", times array<int>")


def _grow(columns: list[np.ndarray], times: np.ndarray, judged: np.ndarray, depth: int, least: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Frequent phrases of `depth` words and more with their counts, from sorted occurrences (columns: language, then words); what isn't judged all counts as frequent.

    Occurrences of a longer prefix lie together inside those of the shorter one, so a level is
    a look at where runs begin, and only the rows of frequent runs go one deeper.
    """
    there = columns[depth] != 0
    columns, times, judged = [c[there] for c in columns], times[there], judged[there]
    if not len(times):
        return
    begin = _runs(columns[: depth + 1])
    count = np.add.reduceat(times, begin)
    kept = (count >= least) | ~judged[begin]
    if kept.any():
        yield [c[begin[kept]] for c in columns[: depth + 1]], count[kept]
    if depth + 1 < len(columns):
        rows = np.repeat(kept, np.diff(np.r_[begin, len(times)]))
        yield from _grow([c[rows] for c in columns], times[rows], judged[rows], depth + 1, least)


class _Prefixes:
    """Occurrences of prefixes as they come in order of (prefix, part): language, part, prefix, words after it, times."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.waiting: list[list[np.ndarray]] = []
        #: The prefix and part whose sums go on unjudged.
        self.open: tuple[int, int] | None = None

    def add(self, rows: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        self.waiting.append(rows)
        if sum(len(r[0]) for r in self.waiting) >= AT_ONCE:
            yield from self.given(False)

    def given(self, last: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Phrases of all prefixes but the one that may go on; of that one too, unjudged, where it has grown too large."""
        if not self.waiting:
            return
        rows = [np.concatenate(x) for x in zip(*self.waiting, strict=True)]
        order = np.lexsort((*rows[3:-1][::-1], rows[1], rows[2]))
        rows = [r[order] for r in rows]
        one = _runs(rows[1:-1])
        rows = [*(r[one] for r in rows[:-1]), np.add.reduceat(rows[-1].astype(np.int64), one)]
        end = rows[2][-1], rows[1][-1]
        ongoing = (rows[2] == end[0]) & (rows[1] == end[1])
        if last or ongoing.sum() > MOST:
            if not last:
                self.open = end
            ongoing[:] = False
        judged = np.ones(len(one), bool) if self.open is None else (rows[2] != self.open[0]) | (rows[1] != self.open[1])
        out = [r[~ongoing] for r in rows]
        self.waiting = [[r[ongoing] for r in rows]] if ongoing.any() else []
        yield from _grow([out[0], *out[2:-1]], out[-1], judged[~ongoing], 2, self.least)


def grow(projected: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, words (array of numbers), a: the phrases of 2 to `longest` words that occur `least` times or more."""
    after = [f"w{k}" for k in range(2, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prefixes = _Langs(), _Prefixes(least)

        def told(phrases: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for (lang, *words), count in phrases:
                names = pa.DictionaryArray.from_arrays(pa.array(lang), pa.array(langs.names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, _lists(np.arange(len(count) + 1) * len(words), np.stack(words, axis=1).ravel(), pa.int64()), pa.array(count)], names=["lang", "words", "a"])

        for batch in batches:
            size = np.diff(batch.column("times").offsets.to_numpy())
            own = [langs.places(batch.column("lang")), batch.column("part").to_numpy(), batch.column("prefix").to_numpy()]
            yield from told(prefixes.add([*(np.repeat(x, size) for x in own), *(batch.column(c).flatten().to_numpy() for c in (*after, "times"))]))
        yield from told(prefixes.given(True))

    dealt = projected.repartition("prefix", "part").sortWithinPartitions("prefix", "part")
    found = dealt.mapInArrow(tidy(run), "lang string, words array<long>, a long")
    return found.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """phrases with l, r and score, floor(1000000 * a * a / (l * r)), of their lowest-scoring cut (of equal ones the first); exact while a is under 10**16."""
    single = words.where(F.col("f") >= least).select(F.array("id").alias("words"), F.col("f").alias("count"))
    units = phrases.select("words", F.col("a").alias("count")).unionByName(single)
    size = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    both = cuts.join(units.select(F.col("words").alias("left"), F.col("count").alias("l")), "left").join(units.select(F.col("words").alias("right"), F.col("count").alias("r")), "right")
    whole = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')})")
    lowest = both.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The rows of `found` but those whose words lie in a longer phrase that occurs at least `percent` of 100 times as often."""
    size = F.size("words")
    parts = phrases.where(size > 2).select("a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("n"))
    parts = parts.select("a", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("n") + 1), lambda s: F.slice("words", s, F.col("n")))).alias("words"))
    longer = parts.groupBy("words").agg(F.max("a").alias("longer"))
    return found.join(longer, "words", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def best(found: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """rank, phrase and the counts of the `top` best of each language."""
    found = stored(found, "phrases-scored")
    groups = max(1, math.isqrt(found.count() // max(top, 1)))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(groups))).orderBy(F.desc("score"), F.desc("a"))
    near = found.withColumn("place", F.rank().over(first)).where(F.col("place") <= top).drop("place")
    again = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = near.withColumn("place", F.rank().over(again)).where(F.col("place") <= top).drop("place")
    spelled = near.select("*", F.posexplode("words").alias("at", "id")).join(words.select("id", "word"), "id")
    texts = spelled.groupBy("lang", "words", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("xs"))
    texts = texts.withColumn("phrase", F.array_join(F.transform("xs", lambda x: x["word"]), " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = texts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, *, longest: int = 3, least: int = 10, top: int = 2000, covered_percent: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of 2 to `longest` words of each language."""
    if longest < 2 or least < 1 or top < 1:
        raise ValueError("phrases have two words at least, occur once at least, and one at least is ranked")
    texts = _input(docs, text_col, lang_col)
    words, seed = _numbered(texts)
    projected = project(texts, _frequent_places(words, least), _hot(words), longest, seed)
    phrases = stored(grow(projected, least, longest), "phrases")
    return best(uncovered(phrases, scored(phrases, words, least), covered_percent), words, top)
