"""Titles to catalogue records by similarity: all of them, in blocks.

The similarity is Ratcliff and Obershelp's: twice the matched characters M over all
characters S.  Matched blocks are set apart by an unmatched character of either string,
so there are at most S - 2M + 1 of them, and as a block of n characters has n - q + 1 grams
of q, strings of similarity r share at least S (r (2q - 1) / 2 - q + 1) - q + 1 grams, repeats
counted.
A title brings along the similarity of a record that shares its rarest grams of Q, or else most of
its grams of SHORT, and meets all records in blocks.  From HIGH on the grams of SHORT that
records as similar must share leave next to none of a block, by its lists of them.  What is left,
and all records for a title without a similar one, is bounded by the longest common subsequence, found
for many at once, and compared from the highest bound down until no bound reaches the best.

Joins are shuffled, whatever their size: tables that grow with the input don't pass through the driver.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.operators.slices import map_in_slices

#: Characters of the grams by which a first record is looked for.
Q = 4
#: Titles that are looked up at once, and for which a block of the second step is copied at least, and records of a block, about.
TITLES, RECORDS = 256, 32_768
#: Characters of the grams that a block has lists of, the similarity from which these leave few records, and records so few that they are compared without a bound.
SHORT, HIGH, FEW = 3, 0.85, 8
#: Rarest grams by which a first record is looked for, and records of one's list at most; a title without such a gram starts from most of its short ones.
FIRST, LIST = 6, 64


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _share(r: float, q: int) -> float:
    return r * (2 * q - 1) / 2 - q + 1


def _grams(text: str) -> list[str]:
    return [text[k : k + Q] for k in range(len(text) - Q + 1)]


def _numbered(texts: pd.Series) -> pd.Series:
    def one(text: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for gram in _grams(text):
            seen[gram] += 1
            out.append(f"{gram}{seen[gram]}")
        return out

    return texts.map(one)


def grams(text: Column) -> Column:
    """Grams of a text as strings, each repeat of one with its number, so that they are a set."""
    return F.pandas_udf(_numbered, "array<string>")(text)


def frequencies(records: DataFrame) -> DataFrame:
    """(gram, often): records (grams) that have a gram."""
    return records.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))


def lcs_bounds(title: str, codes: np.ndarray, of: dict[str, int]) -> np.ndarray:
    """Upper bounds of the longest common subsequence of a title with each row of characters (-1 beyond a row's end).

    Bit-parallel over 64 characters of the title at a time; the sums over these bound the whole.
    """
    total = np.zeros(len(codes), np.int64)
    one = np.uint64(1)
    for start in range(0, len(title), 64):
        piece = title[start : start + 64]
        masks = np.zeros(len(of) + 1, np.uint64)  # the last is for what lies beyond the end
        for k, c in enumerate(piece):
            if c in of:
                masks[of[c]] |= one << np.uint64(k)
        rows = np.full(len(codes), ~np.uint64(0))
        for column in codes.T:
            hit = rows & masks[column]
            rows = (rows + hit) | (rows - hit)
        used = np.uint64((1 << len(piece)) - 1)
        total += np.bitwise_count(~rows & used).astype(np.int64)
    return total


def first_guesses(titles: DataFrame, records: DataFrame, often: DataFrame) -> DataFrame:
    """(text, floor) of titles (text, grams): the similarity of the record (text, grams) that shares most of a title's rarest grams; null without one.

    A place to start from only: the best record is as similar at least.
    """
    rare = often.filter(F.col("often") <= LIST)
    each = titles.select("text", F.explode("grams").alias("gram")).join(rare.hint("merge"), "gram")
    ordered = each.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("o"))  # a title's own grams
    mine = ordered.select("text", F.explode(F.slice(F.transform("o", lambda x: x["gram"]), 1, FIRST)).alias("gram"))
    theirs = records.select(F.col("text").alias("record"), F.explode("grams").alias("gram")).join(rare.select("gram").hint("merge"), "gram")
    shared = mine.join(theirs.hint("merge"), "gram").groupBy("text", "record").agg(F.count("*").alias("k"))
    one = shared.groupBy("text").agg(F.max_by("record", F.struct("k", "record")).alias("record"))

    floors = one.select("text", F.pandas_udf(_ratios, "double")("text", "record").alias("floor"))
    return titles.select("text").join(floors.hint("merge"), "text", "left")


def better_guesses(guesses: DataFrame, records: DataFrame) -> DataFrame:
    """``guesses`` (text, floor) with that of the record (text) that shares most grams of SHORT where a floor is missing or below HIGH."""
    weak = F.coalesce(F.col("floor"), F.lit(0.0)) < HIGH

    def nearest(block: _Block, title: str, floor: float, lists: np.ndarray) -> tuple | None:
        return block.nearest(title, lists)

    found = _through_blocks(guesses.filter(weak), records.select("text", F.lit(0).alias("work_id")), nearest, "text string, record string, share double")
    one = found.groupBy("text").agg(F.max_by("record", F.struct("share", "record")).alias("record"))
    ratios = F.pandas_udf(_ratios, "double")("text", "record")
    both = guesses.join(one.select("text", ratios.alias("other")).hint("merge"), "text", "left")
    return both.select("text", F.greatest("floor", "other").alias("floor"))


def _ratios(texts: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(texts, others)], dtype=float)


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each gram of SHORT of the texts: the characters' numbers side by side."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    n = max(0, len(chars) - SHORT + 1)
    key = np.zeros(n, np.int64)
    for k in range(SHORT):
        key = key << 21 | chars[k : k + n]
    whole = row[:n] == row[len(row) - n :]
    return row[:n][whole], key[whole]


def _repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and keys in the order of keys, then rows, and the number of each among equal ones."""
    order = np.lexsort((row, key))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.arange(len(row))
    return row, key, at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


class _Block:
    """Records of a block with lists of their grams and, made when first asked for, as rows of characters."""

    def __init__(self, records: list[str], ids: list):
        self.records, self.ids = records, ids
        self.lengths = np.array([len(x) for x in records], np.int64)
        row, key, n = _repeats(*_keys(records))
        self.grams, gram = np.unique(key, return_inverse=True)
        gram = n * len(self.grams) + gram  # a gram's first, second, … in a record
        order = np.argsort(gram, kind="stable")
        self.gram, self.rows = gram[order], row[order]

    @functools.cached_property
    def of(self) -> dict[str, int]:
        return {c: k for k, c in enumerate(sorted(set("".join(self.records))))}

    @functools.cached_property
    def codes(self) -> np.ndarray:
        codes = np.full((len(self.records), int(self.lengths.max(initial=0))), len(self.of), np.int32)
        for row, text in zip(codes, self.records):
            row[: len(text)] = [self.of[c] for c in text]
        return codes

    def lists(self, titles: list[str]) -> list[np.ndarray]:
        """For each title where the lists of its grams start and end."""
        row, key, n = _repeats(*_keys(titles))
        order = np.argsort(row, kind="stable")
        row, key, n = row[order], key[order], n[order]
        gram = np.searchsorted(self.grams, key)
        gram[np.append(self.grams, -1)[gram] != key] = -1
        gram = np.where(gram < 0, -1, n * len(self.grams) + gram)
        spans = np.stack([np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, "right")])
        some = spans[0] < spans[1]
        return np.split(spans[:, some], np.searchsorted(row[some], np.arange(1, len(titles))), axis=1)

    def shared(self, lists: np.ndarray, without: int = 0) -> np.ndarray:
        """Grams of SHORT, repeats counted, that each record shares with a title of these lists, but for the longest of them."""
        if without:
            order = np.argsort(lists[1] - lists[0], kind="stable")
            lists = lists[:, order[: max(0, len(order) - without)]]
        if not lists.size:
            return np.zeros(len(self.records), np.int64)
        return np.bincount(np.concatenate([self.rows[a:z] for a, z in lists.T.tolist()]), minlength=len(self.records))

    def nearest(self, title: str, lists: np.ndarray) -> tuple[str, float] | None:
        """(record, share) that shares most grams of SHORT, for the lengths."""
        if not lists.size:
            return None
        share = self.shared(lists) / (self.lengths + len(title))
        k = int(np.argmax(share))
        return self.records[k], float(share[k])

    def _may_be(self, title: str, least: float, lists: np.ndarray | None) -> np.ndarray:
        """Records that can be as similar as ``least``, by length and by the grams that they share."""
        n, share = len(title), _share(least, SHORT)
        few = int((n + n * least / (2 - least)) * share - SHORT + 1 - 1e-6)  # with the shortest record
        if least < HIGH or few < 2:
            return np.flatnonzero(2 * np.minimum(self.lengths, n) / (self.lengths + n) >= least)
        # the longest lists, half as many as must be shared, are not read
        shared = self.shared(self.lists([title])[0] if lists is None else lists, few // 2) + few // 2
        some = np.flatnonzero(shared >= few)
        size = self.lengths[some] + n
        return some[(shared[some] >= size * share - SHORT + 1 - 1e-6) & (2 * np.minimum(self.lengths[some], n) / size >= least)]

    def best(self, title: str, least: float, lists: np.ndarray | None = None) -> tuple[int, float] | None:
        """(id, similarity) of the most similar record, the smallest id of equals; None under ``least``."""
        fits = self._may_be(title, least, lists)
        if len(fits) > FEW:
            codes = self.codes[fits, : int(self.lengths[fits].max(initial=0))]
            bound = 2 * lcs_bounds(title, codes, self.of) / (self.lengths[fits] + len(title))
        else:
            bound = np.ones(len(fits))
        best, at = least, None
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < best:
                break
            score = ratio(title, self.records[fits[k]])
            if score > best or score == best and (at is None or self.ids[fits[k]] < at):
                best, at = score, self.ids[fits[k]]
        return None if at is None else (at, best)


def best_in_blocks(titles: DataFrame, records: DataFrame, least: float) -> DataFrame:
    """(text, work_id, score): the most similar record (text, work_id) of ``least`` or more of each title (text, floor), from all records.

    ``floor``: a similarity that some record is known to have, or null.  Each title meets each
    block of records; a row for each title and block is all that leaves it.
    """
    asked = titles.select("text", F.greatest(F.coalesce("floor", F.lit(least)), F.lit(least)).alias("floor"))

    kind = records.schema["work_id"].dataType.simpleString()
    return best_of(_through_blocks(asked, records, _Block.best, f"text string, work_id {kind}, score double"), "text")


def _through_blocks(titles: DataFrame, records: DataFrame, search: Callable[[_Block, str, float, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """(text, …): what ``search`` finds for titles (text, floor) in each block of the records (text, work_id).

    A task gets the records of a block, then the titles one by one.
    """
    n, m = titles.count(), records.count()
    cores = titles.sparkSession.sparkContext.defaultParallelism
    # with few blocks of records there are copies of them, so that all cores have some
    m_blocks = max(1, -(-m // RECORDS))
    copies = max(1, min(-(-n // TITLES), -(-4 * cores // m_blocks)))
    block = lambda k: F.pmod(F.xxhash64("text"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    id_ = records.schema["work_id"].dataType
    left = titles.select(each(m_blocks).alias("b"), block(copies).alias("c"), F.lit(True).alias("asks"), "text", "floor", F.lit(None).cast(id_).alias("work_id"))
    right = records.select(block(m_blocks).alias("b"), each(copies).alias("c"), F.lit(False).alias("asks"), "text", F.lit(None).cast("double").alias("floor"), "work_id")
    met = left.unionByName(right).repartition(m_blocks * copies, "b", "c").sortWithinPartitions("b", "c", "asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now, texts, ids = None, None, [], []  # a block's records
        for rows in batches:
            out = []
            for key, part in rows.groupby(["b", "c"], sort=True):
                if key != at:
                    at, now, texts, ids = key, None, [], []
                theirs, mine = part[~part["asks"]], part[part["asks"]]
                texts += theirs["text"].tolist()
                ids += theirs["work_id"].tolist()
                if len(mine):
                    now = now or _Block(texts, ids)
                    titles, floors = mine["text"].tolist(), mine["floor"].tolist()
                    for k in range(0, len(titles), TITLES):
                        some = titles[k : k + TITLES]
                        out += [(x, *found) for x, f, lists in zip(some, floors[k:], now.lists(some)) if (found := search(now, x, f, lists))]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return map_in_slices(met, run, schema)


def best_of(found: DataFrame, key: str) -> DataFrame:
    """The row of highest score of each key, the smallest work_id of equals."""
    return found.groupBy(key).agg(F.min_by("work_id", F.struct(-F.col("score"), "work_id")).alias("work_id"), F.max("score").alias("score"))
