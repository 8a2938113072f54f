"""Dictionaries of millions of terms as sorted arrays that workers map into memory.

A term is a sequence of pieces.  Every beginning of it has a 64-bit hash; Spark sorts the
hashes of a dictionary in buckets by their leading bits and writes them with the terms
that end there.  Executors fetch the files once, lay the buckets end to end as arrays
beside them, and all their Python workers map these.  Hashes only say where to look: a
find is compared piece by piece with the term.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Terms that a bucket holds on average.
BUCKET = 20_000
#: Terms that a worker keeps decoded.
KEPT = 100_000
_BEGINNINGS = "which int, bucket long, hash long, term string"
_BUCKETS = "which int, bucket long, n_keys long, n_terms long, n_bytes long, keys binary, counts binary, sizes binary, data binary"
#: Fixed value: an odd multiplier with bits all over (2**64 over the golden ratio).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: From a label and a pattern to (table, pieces) of each table that it is stored in.
Forms = Callable[[str, str], list[tuple[int, list[str]]]]


def _hashes(pieces: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p) for p in pieces), np.uint64, len(pieces))


def _step(state: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Hashes of sequences that are longer by a piece."""
    x = (state ^ piece) * _SPREAD
    return x ^ (x >> np.uint64(29))


def store_terms(dictionary: DataFrame, path: str, forms: Forms) -> None:
    """Writes (label, pattern, canonical) rows as buckets to ``path``; nothing of them passes the driver.

    Repeated rows and shared beginnings go before the shuffle to buckets; rows without a
    pattern and patterns without pieces hold no term.
    """
    terms = dictionary.select("label", "pattern", "canonical").filter("pattern IS NOT NULL").repartition("label", "pattern", "canonical")
    bits = np.uint64(64 - max(1, math.ceil(math.log2(max(terms.count(), 1) / BUCKET + 1))))

    def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            stored = [(table, pieces, json.dumps([pieces, label, canonical])) for label, pattern, canonical in rows.itertuples(index=False, name=None) for table, pieces in forms(label, pattern) if pieces]
            tables, sizes = np.array([x[0] for x in stored], int), np.array([len(x[1]) for x in stored], int)
            whole, flat, start = np.array([x[2] for x in stored], object), _hashes([p for x in stored for p in x[1]]), np.cumsum(sizes) - sizes
            states, long = np.zeros(len(stored), np.uint64), np.arange(len(stored))
            for k in range(max(sizes, default=0)):
                long = long[sizes[long] > k]
                states[long] = h = _step(states[long], flat[start[long] + k])
                ends = np.where(sizes[long] == k + 1, whole[long], None)
                yield pd.DataFrame({"which": tables[long], "bucket": (h >> bits).astype(np.int64), "hash": h.view(np.int64), "term": ends})

    terms.mapInPandas(beginnings, _BEGINNINGS).distinct().groupBy("which", "bucket").applyInPandas(_packed, _BUCKETS).write.mode("overwrite").parquet(path)


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket: its hashes in order, how many terms end at each, the terms' sizes and bytes."""
    h = rows["hash"].to_numpy().view(np.uint64)
    keys = np.unique(h)
    ends = rows["term"].notna().to_numpy()
    at, terms = np.searchsorted(keys, h[ends]), rows["term"].to_numpy()[ends]
    order = np.argsort(at, kind="stable")
    blobs = [t.encode() for t in terms[order]]
    counts, sizes, data = np.bincount(at, minlength=len(keys)).astype(np.uint32), np.array([len(b) for b in blobs], np.uint32), b"".join(blobs)
    one = (rows["which"].iloc[0], rows["bucket"].iloc[0], len(keys), len(blobs), len(data), keys.tobytes(), counts.tobytes(), sizes.tobytes(), data)
    return pd.DataFrame([one], columns=[c.split()[0] for c in _BUCKETS.split(", ")])


def ship(spark: SparkSession, path: str) -> list[str]:
    """Names under which every executor gets a stored dictionary's files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [s.getPath() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    parts = sorted(f.toString() for f in files if f.getName().startswith("part-"))
    for f in parts:
        spark.sparkContext.addFile(f)
    return [os.path.basename(f) for f in parts]


class Terms:
    """One table of a stored dictionary, mapped into memory."""

    def __init__(self, folder: str, which: int):
        self.keys, self.first, self.ends, self.data = (_array(f"{folder}/{which}-{name}.npy") for name in ("keys", "first", "ends", "data"))
        self._decoded: dict[int, tuple[list[str], str, str]] = {}

    def _at(self, states: np.ndarray) -> np.ndarray:
        """Places of hashes among the keys, -1 of unknown ones."""
        if not len(self.keys):
            return np.full(len(states), -1)
        at = np.minimum(np.searchsorted(self.keys, states), len(self.keys) - 1)
        return np.where(self.keys[at] == states, at, -1)

    def _terms(self, key: int) -> Iterator[tuple[list[str], str, str]]:
        for k in range(self.first[key], self.first[key + 1]):
            if k not in self._decoded:
                if len(self._decoded) >= KEPT:
                    self._decoded.clear()
                self._decoded[k] = tuple(json.loads(self.data[self.ends[k] : self.ends[k + 1]].tobytes()))
            yield self._decoded[k]

    def find(self, pieces: list[tuple[str, int, int]]) -> Iterator[tuple[str, str, int, int]]:
        """(label, canonical, start, end) of every term in (piece, start, end)s; all places advance together."""
        words = [p for p, _, _ in pieces]
        hashes, starts = _hashes(words), np.arange(len(words))
        states, k = np.zeros(len(words), np.uint64), 0
        while len(starts):
            states = _step(states, hashes[starts + k])
            keys = self._at(states)
            starts, states, keys = starts[keys >= 0], states[keys >= 0], keys[keys >= 0]
            ending = self.first[keys + 1] > self.first[keys]
            for i, key in zip(starts[ending].tolist(), keys[ending].tolist()):
                for term, label, canonical in self._terms(key):
                    if term == words[i : i + k + 1]:
                        yield label, canonical, pieces[i][1], pieces[i + k][2]
            k += 1
            room = starts + k < len(words)
            starts, states = starts[room], states[room]

    def __contains__(self, name: str) -> bool:
        """Whether a term has this one piece."""
        key = self._at(_step(np.zeros(1, np.uint64), _hashes([name])))[0]
        return key >= 0 and any(term == [name] for term, _, _ in self._terms(key))

    def bytes(self) -> int:
        """Size of the arrays, which an executor's workers share."""
        return sum(a.nbytes for a in (self.keys, self.first, self.ends, self.data))


def _array(path: str) -> np.ndarray:
    small = os.path.getsize(path) <= 128  # a header alone can't be mapped
    return np.load(path, mmap_mode=None if small else "r")


def opened(names: list[str], tables: int) -> tuple[Terms, ...]:
    """On a worker: the tables 0, 1, … of shipped files; the executor's first worker lays out the arrays, others wait."""
    folder = SparkFiles.get(f"terms-{hashlib.sha256(repr(names).encode()).hexdigest()}")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(f"{folder}/done"):
            _lay_out([SparkFiles.get(n) for n in names], folder, tables)
            open(f"{folder}/done", "w").close()
    return tuple(Terms(folder, k) for k in range(tables))


def _lay_out(files: list[str], folder: str, tables: int) -> None:
    """Arrays of all buckets, one bucket in memory at a time."""
    import pyarrow.parquet as pq

    index = [pq.read_table(f, columns=["which", "bucket", "n_keys", "n_terms", "n_bytes"]).to_pandas() for f in files]
    index = pd.concat(index or [pd.DataFrame(columns=["which", "bucket", "n_keys", "n_terms", "n_bytes"])]).sort_values(["which", "bucket"])
    places, arrays = {}, {}
    for which in range(tables):
        mine = index[index["which"] == which]
        sizes = mine[["n_keys", "n_terms", "n_bytes"]].to_numpy(dtype=np.int64)
        before = np.cumsum(sizes, axis=0) - sizes
        places |= {(which, b): tuple(x) for b, x in zip(mine["bucket"], before.tolist())}
        keys, terms, data = sizes.sum(axis=0).tolist()
        make = lambda name, n, kind: np.lib.format.open_memmap(f"{folder}/{which}-{name}.npy", "w+", kind, (n,)) if n else _none(f"{folder}/{which}-{name}.npy", kind)
        arrays[which] = make("keys", keys, np.uint64), make("first", keys + 1, np.uint32), make("ends", terms + 1, np.int64), make("data", data, np.uint8)
    for f in files:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
            row = batch.to_pylist()[0]
            keys, first, ends, data = arrays[row["which"]]
            k, t, b = places[row["which"], row["bucket"]]
            keys[k : k + row["n_keys"]] = np.frombuffer(row["keys"], np.uint64)
            first[k + 1 : k + 1 + row["n_keys"]] = t + np.cumsum(np.frombuffer(row["counts"], np.uint32))
            ends[t + 1 : t + 1 + row["n_terms"]] = b + np.cumsum(np.frombuffer(row["sizes"], np.uint32))
            data[b : b + row["n_bytes"]] = np.frombuffer(row["data"], np.uint8)
    for mapped in arrays.values():
        for a in mapped:
            a.flush() if isinstance(a, np.memmap) else None


def _none(path: str, kind: type) -> np.ndarray:
    np.save(path, np.zeros(0, kind))
    return np.zeros(0, kind)
