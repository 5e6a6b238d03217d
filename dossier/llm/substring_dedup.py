"""Log-structured fingerprint index for repeated word windows.

The index is a folder of runs. A run is the sorted window hashes of one batch, cut into hash buckets and never changed; each
bucket of it is some rows of a bucketed table, so that a bucket of all runs is read by one task without a shuffle. A batch's
own windows are dealt to the buckets, each chunk of texts sending its sorted, different windows; there they are merge-joined
with the runs of history and with each other. A window is removed where history has it, or where a smaller document of the
batch has it. A match of the 64-bit hash is verified by a second hash of 24 bits, made from other halves of the words' digests, so
that words which collide in one don't in the other; words are not compared. Windows that
no run has become the batch's own run. Compaction merges runs of like age, so that their number grows with the logarithm of
the number of batches.

`substring_dedup` and `substring_dedup_rows` feed a whole corpus to such an index in batches of rising doc_id, so that what
history has always has a smaller id. `FingerprintIndex.add` takes batches that come later, by themselves. A bucket answers a
chunk with one bit for each window that the chunk sent, so answers are small, and the texts are cut once all are known.

Defined results: null and empty texts and those shorter than a window keep all their words. Rows with the same doc_id are
one document to each other: they never remove each other's words. A null doc_id counts as larger than every id. Very
long texts are handled whole. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialized, released, remove_path, scratch_path, shuffles_removed, text_rows
from .exchange import MB, by_bucket, chunked, mixed, pack, pack_sorted, parts, placed, rows, sizes, unpack, unpack_sorted, unparts

NO_ID = (1 << 63) - 1
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
SENT = "bucket int, chunk int, payload binary"
#: A run's table has the run itself in rows of no chunk, and in a column of their own the answers to its batch's chunks.
KEPT = f"{SENT}, answer binary"
#: Windows in one row of a run.
PART = 1 << 16


class Windows:
    """The words of a chunk's texts, one after the other, and the hashes of their windows."""

    def __init__(self, texts: pa.Table, window: int) -> None:
        from xxhash import xxh3_128_digest

        self.window = window
        self.ids = np.array([NO_ID if i is None else i for i in texts.column("doc_id").to_pylist()], np.int64)
        self.words: list[bytes] = []
        ends = []
        for text in texts.column("text").cast(pa.binary()).to_pylist():
            if text:
                self.words += text.split()
            ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if ends else self.ends
        # two halves of a word's digest, for two hashes of a window that don't depend on each other; some words at a time
        hashes = np.empty((2, len(self.words)), np.uint64)
        for k in range(0, len(self.words), 1 << 15):
            own = b"".join(map(xxh3_128_digest, self.words[k : k + (1 << 15)]))
            hashes[:, k : k + (1 << 15)] = np.frombuffer(own, ">u8").reshape(-1, 2).T
        counts = np.maximum(self.ends - self.starts - window + 1, 0)
        #: first words of windows, and the id of the document that each lies in
        self.at = np.arange(counts.sum()) + np.repeat(self.starts - np.cumsum(counts) + counts, counts)
        self.owner = np.repeat(self.ids, counts)
        #: 64 bits of one half and 24 of the other
        self.first = self._sums(hashes[0], 2)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.second = self._sums(hashes[1], 3)[self.at] >> np.uint64(40) if len(self.at) else np.zeros(0, np.uint64)
        self.keys = Keys(self.first, self.second)

    def _sums(self, hashes: np.ndarray, seed: int, block: int = 1 << 14) -> np.ndarray:
        """A hash of the window from each word on, in blocks that fit the processor's caches."""
        out = np.zeros(len(hashes) - self.window + 1, np.uint64)
        factors = mixed(np.arange(seed * 64 + 1, seed * 64 + 1 + self.window, dtype=np.uint64)) | np.uint64(1)
        held = np.empty(block, np.uint64)
        for at in range(0, len(out), block):
            own = out[at : at + block]
            for j in range(self.window):
                own += np.multiply(hashes[at + j : at + j + len(own)], factors[j], out=held[: len(own)])
            own[:] = mixed(own)
        return out


class Keys:
    """Windows in the order of their hashes, and the different ones among them."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one first hash for two windows
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.order, self.starts, self.number = order, np.flatnonzero(new), np.cumsum(new) - 1
        self.first, self.second = a[self.starts], b[self.starts]

    def least(self, ids: np.ndarray) -> np.ndarray:
        """The smallest id of each different window."""
        return np.minimum.reduceat(ids[self.order], self.starts) if len(self.starts) else ids[:0]

    def late(self, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which windows are known from elsewhere or have a larger id than another one here."""
        out = np.zeros(len(ids), bool)
        out[self.order] = known[self.number] | (ids[self.order] > self.least(ids)[self.number])
        return out


def pack_run(first: np.ndarray, second: np.ndarray) -> bytes:
    return parts(pack_sorted(first), second.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())


def unpack_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, second, *_ = unparts(raw)
    wide = np.zeros((len(second) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(second, np.uint8).reshape(-1, 3)
    return unpack_sorted(first), wide.view("<u4").ravel().astype(np.uint64)


def sent_run(w: Windows, n_buckets: int) -> list[tuple[int, bytes]]:
    """What a chunk sends: its different windows with the smallest document of each."""
    k, least = w.keys, w.keys.least(w.owner)
    return [(b, parts(pack_run(k.first[i:j], k.second[i:j]), pack(least[i:j]))) for b, i, j in by_bucket(k.first, n_buckets)]


def mark_known(keys: Keys, run: bytes, known: np.ndarray) -> None:
    """Merge-join of rising keys with a part of a run, whose range is all that is looked at."""
    theirs = unpack_run(run)
    if len(theirs[0]):
        i, j = np.searchsorted(keys.first, theirs[0][0]), np.searchsorted(keys.first, theirs[0][-1], side="right")
        known[i:j] |= in_run(keys.first[i:j], keys.second[i:j], *theirs)


def in_run(first: np.ndarray, second: np.ndarray, theirs: np.ndarray, verify: np.ndarray) -> np.ndarray:
    """Which of some rising keys a run has. Equal first hashes are verified by the second ones."""
    out = np.zeros(len(first), bool)
    at = np.searchsorted(theirs, first)
    while len(left := np.flatnonzero((at < len(theirs)) & ~out)):
        left = left[theirs[at[left]] == first[left]]
        if not len(left):
            break
        out[left] = verify[at[left]] == second[left]
        rest = left[~out[left]]
        at, kept = np.full(len(first), len(theirs)), at[rest] + 1
        at[rest] = kept
    return out


def judged(sent: pa.Table, history: pa.Table) -> pa.Table:
    """Work on a bucket of a batch: a bit for each window that a chunk sent, 1 if history or a smaller document has it; and
    the batch's own run, of the windows that history doesn't have."""
    if not sent.num_rows:
        return run_rows(0, [], [])
    runs, ids = [], []
    for raw in sent.column("payload").to_pylist():
        run, owners = unparts(raw)
        runs.append(unpack_run(run))
        ids.append(unpack(owners))
    keys = Keys(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))
    known = np.zeros(len(keys.first), bool)
    for raw in history.column("payload"):
        mark_known(keys, raw.as_py(), known)
    late = keys.late(np.concatenate(ids), known)
    ends = np.cumsum([len(i) for i in ids]).tolist()
    bits = [late[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
    told = [(chunk, np.packbits(own).tobytes()) for chunk, own in zip(sent.column("chunk").to_pylist(), bits, strict=True) if own.any()]
    return run_rows(sent.column("bucket")[0].as_py(), told, run_parts(keys.first[~known], keys.second[~known]))


def run_parts(first: np.ndarray, second: np.ndarray) -> list[bytes]:
    """A bucket of a run in rows of some hundred KB each, in rising order."""
    return [pack_run(first[k : k + PART], second[k : k + PART]) for k in range(0, len(first), PART)]


def run_rows(bucket: int, answers: list[tuple[int, bytes]], run: list[bytes]) -> pa.Table:
    n, m = len(answers), len(run)
    columns = {"bucket": [bucket] * (n + m), "chunk": [c for c, _ in answers] + [None] * m, "payload": [None] * n + run, "answer": [p for _, p in answers] + [None] * m}
    return rows({c: (v, pa.int32() if c in ("bucket", "chunk") else pa.binary()) for c, v in columns.items()})


def merged(table: pa.Table) -> pa.Table:
    """Work on a bucket of some runs: one run of all of them."""
    runs = [unpack_run(p) for p in table.column("payload").to_pylist()]
    keys = Keys(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))
    return run_rows(table.column("bucket")[0].as_py(), [], run_parts(keys.first, keys.second))


def late_windows(w: Windows, answers: pa.Table, n_buckets: int) -> np.ndarray:
    """Which windows of a chunk go, by the bits that the buckets answered."""
    known, edges = np.zeros(len(w.keys.first), bool), {b: (i, j) for b, i, j in by_bucket(w.keys.first, n_buckets)}
    for b, raw in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True):
        i, j = edges[b]
        known[i:j] = np.unpackbits(np.frombuffer(raw, np.uint8), count=j - i)
    return w.keys.late(w.owner, known)


def cleaned(w: Windows, late: np.ndarray, with_text: bool) -> pa.Table:
    """The result rows of a chunk."""
    change = np.zeros(len(w.words) + 1, np.int64)
    np.add.at(change, w.at[late], 1)
    np.add.at(change, w.at[late] + w.window, -1)
    gone = np.cumsum(change[:-1]) > 0
    out: list[list] = [[] for _ in range(6)]
    for doc, start, end in zip(w.ids.tolist(), w.starts.tolist(), w.ends.tolist(), strict=True):
        own = gone[start:end]
        removed = int(own.sum())
        words = w.words[start:end] if not removed else [w.words[start + k] for k in np.flatnonzero(~own)]
        kept = b" ".join(words)
        spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
        values = (None if doc == NO_ID else doc, end - start, removed, spans, hashlib.sha256(kept).hexdigest(), str(kept, "utf-8") if with_text else None)
        for c, v in zip(out, values, strict=True):
            c.append(v)
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)})


@dataclass(frozen=True)
class Run:
    """A run of the batches first to last, and where it is."""

    path: str
    first: int
    last: int
    n_buckets: int


class FingerprintIndex:
    """Runs of all windows seen so far, in a folder that all executors share.

    Each batch adds one run. Runs are levelled by how many batches they hold: before a batch is added, `fan` neighbouring runs
    that hold equally many are merged. A run is written elsewhere and moved to its name when it is complete, so that a batch
    that failed can be added again and one that is there can't be added twice. One batch is added at a time. The first batch
    sets the number of buckets. Where a bucket of history has come to more than `bucket_bytes`, or a later batch asks for more buckets, all
    runs are compacted into one whose buckets are split in two as often as is needed, so no task holds a bucket that grows with history.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = 13, n_buckets: int | None = None, fan: int = 2, bucket_bytes: int = 48 * MB) -> None:
        self.spark, self.folder, self.window, self.fan, self.bucket_bytes = spark, folder.rstrip("/"), window, fan, bucket_bytes
        self._asked = n_buckets

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[Run]:
        """Complete runs, oldest first; those that a merged run holds as well are left out."""
        path, system = self._hadoop(f"{self.folder}/run-*/_SUCCESS")
        named = (str(f.getPath().getParent()) for f in system.globStatus(path) or ())
        found = [Run(p, *map(int, re.fullmatch(r"run-(\d+)-(\d+)-b(\d+)", p.rpartition("/")[2]).groups())) for p in named]
        out: list[Run] = []
        for run in sorted(found, key=lambda r: (r.first, -r.last, -r.n_buckets)):
            if not out or run.last > out[-1].last:
                out.append(run)
        return out

    def n_buckets(self) -> int:
        return next((r.n_buckets for r in self.runs()), self._asked or 64)

    def add(self, docs: DataFrame, batch: int | None = None, with_text: bool = True, chunk_bytes: int = 4 * MB) -> DataFrame:
        """The batch's documents as `substring_dedup` returns them, judged by all earlier batches and the batch itself: a window
        of an earlier batch goes whatever its id, since that batch is already out. `batch` is its number, by default the next."""
        docs = text_rows(docs)
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_chunks, wanted = sizes(total, chunk_bytes)
        self._asked = self._asked or wanted
        self._split(sizes(total, chunk_bytes, least=1)[1])
        chunks, window, n_buckets = chunked(docs, n_chunks), self.window, self.n_buckets()
        answers = self.absorb(chunks, batch)
        finished = finishing(window, n_buckets, with_text)
        with shuffles_removed(self.spark):
            return materialized(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finished, RESULT), "cleaned")

    def absorb(self, chunks: DataFrame, batch: int | None = None) -> DataFrame:
        """Take the windows of (chunk, doc_id, text) rows into the index; (bucket, chunk, answer) with the bits of windows that go."""
        runs, window, n_buckets = self.runs(), self.window, self.n_buckets()
        number = max((r.last for r in runs), default=-1) + 1 if batch is None else batch
        if any(r.last >= number for r in runs):
            raise ValueError(f"batch {number} or a later one is in the index")
        runs = self._levelled(runs)

        def sent(key: tuple, texts: pa.Table) -> pa.Table:
            got = sent_run(Windows(texts, window), n_buckets)
            released()
            return rows({"bucket": ([b for b, _ in got], pa.int32()), "chunk": ([key[0].as_py()] * len(got), pa.int32()), "payload": ([p for _, p in got], pa.binary())})

        mine = chunks.groupBy("chunk").applyInArrow(sent, SENT)
        with self._tables(runs) as tables:
            work = mine.groupBy("bucket").cogroup(self._rows(tables).groupBy("bucket"))
            path = self._written(work.applyInArrow(judged, KEPT), number, number, n_buckets)
        answers = self.spark.read.schema(KEPT).parquet(path).where("chunk is not null")
        return materialized(answers.select("bucket", "chunk", "answer"), "answers")

    def compact(self) -> None:
        """Merge all runs into one; the old ones go after the new one is complete."""
        if len(runs := self.runs()) > 1:
            self._merge(runs)

    def _levelled(self, runs: list[Run]) -> list[Run]:
        while len(tail := runs[-self.fan :]) == self.fan > 1 and len({r.last - r.first for r in tail}) == 1:
            runs = [*runs[: -self.fan], self._merge(tail)]
        return runs

    def _merge(self, old: list[Run]) -> Run:
        first, last, n_buckets = old[0].first, old[-1].last, old[0].n_buckets
        with self._tables(old) as tables:
            path = self._written(self._rows(tables).groupBy("bucket").applyInArrow(merged, KEPT), first, last, n_buckets)
        for run in old:
            remove_path(self.spark, run.path)
        return Run(path, first, last, n_buckets)

    def _split(self, wanted: int) -> None:
        """Compact into more buckets if there are too few: buckets are ranges of hashes, so each is cut into equal ones."""
        if not (runs := self.runs()):
            return
        held = 0
        for run in runs:
            path, system = self._hadoop(run.path)
            held += system.getContentSummary(path).getLength()
        old = new = runs[0].n_buckets
        while new < max(wanted, -(-held // self.bucket_bytes)):
            new *= 2
        if new == old:
            return

        def dealt(batches):
            for batch in batches:
                for raw in batch.column("payload"):
                    first, second = unpack_run(raw.as_py())
                    parts_ = [(b, pack_run(first[i:j], second[i:j])) for b, i, j in by_bucket(first, new)]
                    yield from rows({"bucket": ([b for b, _ in parts_], pa.int32()), "chunk": ([None] * len(parts_), pa.int32()), "payload": ([p for _, p in parts_], pa.binary())}).to_batches()

        with self._tables(runs) as tables:
            self._written(self._rows(tables).mapInArrow(dealt, SENT).groupBy("bucket").applyInArrow(merged, KEPT), runs[0].first, runs[-1].last, new)
        for run in runs:
            remove_path(self.spark, run.path)

    def _tables(self, runs: list[Run]) -> Tables:
        return Tables(self.spark, [(r.path, r.n_buckets) for r in runs])

    def _rows(self, tables: list[str]) -> DataFrame:
        """The runs' own rows; tables of the same buckets stay where they are."""
        every = [self.spark.table(t).select("bucket", "chunk", "payload") for t in tables] or [self.spark.createDataFrame([], SENT)]
        return reduce(DataFrame.unionAll, every).where("chunk is null")

    def _written(self, df: DataFrame, first: int, last: int, n_buckets: int) -> str:
        """Write a run beside the index and move it to its name."""
        part, whole = f"{self.folder}/part-{uuid.uuid4().hex}", f"{self.folder}/run-{first:06d}-{last:06d}-b{n_buckets}"
        with Tables(self.spark, [(part, n_buckets)]) as (table,), shuffles_removed(self.spark):
            df.write.insertInto(table)
        (source, system), (target, _) = self._hadoop(part), self._hadoop(whole)
        if system.exists(target) or not system.rename(source, target):
            raise ValueError(f"{whole} is already there")
        return whole


def quoted(path: str) -> str:
    """A path for a string of SQL."""
    return path.replace("\\", "\\\\").replace("'", "\\'")


class Tables:
    """Folders as bucketed tables of the session's catalog, by new names, for as long as they are needed; the folders stay."""

    def __init__(self, spark: SparkSession, folders: list[tuple[str, int]]) -> None:
        self.spark, self.folders = spark, folders
        self.names = [f"run_{uuid.uuid4().hex}" for _ in folders]

    def __enter__(self) -> list[str]:
        for name, (path, n_buckets) in zip(self.names, self.folders, strict=True):
            self.spark.sql(f"CREATE TABLE {name} ({KEPT}) USING parquet OPTIONS (compression 'uncompressed', 'parquet.enable.dictionary' 'false') CLUSTERED BY (bucket) INTO {n_buckets} BUCKETS LOCATION '{quoted(path)}'")
        return self.names

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def finishing(window: int, n_buckets: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finished(texts: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(texts, window)
        out = cleaned(w, late_windows(w, answers, n_buckets), with_text)
        del w
        released()
        return out

    return finished


def batched(docs: DataFrame, batches: int, chunk_bytes: int) -> tuple[DataFrame, list[Column], int, Column]:
    """docs whose rows have places, the condition of each batch (rising doc_id, about as many rows each), the number of
    buckets, and the chunk of each row."""
    shares = [k / batches for k in range(1, batches)]
    total, edges = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.percentile_approx(F.col("doc_id").cast("long"), shares or [0.5])).first()
    n_chunks, n_buckets = sizes(total or 0, chunk_bytes, per_bucket=2)
    edges = sorted(set(edges or ())) if batches > 1 else []
    own, per = F.col("doc_id").cast("long"), -(-n_chunks // (len(edges) + 1))
    conditions = [F.lit(True) if low is None else own > low for low in (None, *edges)]
    conditions = [c if high is None else c & (own <= high) for c, high in zip(conditions, (*edges, None), strict=True)]
    if edges:
        conditions[-1] = conditions[-1] | own.isNull()
    docs, place = placed(docs)
    number = reduce(lambda rest, k: F.when(conditions[k], k).otherwise(rest), range(len(conditions)), F.lit(0))
    return docs, conditions, n_buckets, (number * per + F.pmod(place, F.lit(per))).cast("int")


def answers_of(docs: DataFrame, conditions: list[Column], chunk: Column, n_buckets: int, window: int) -> DataFrame:
    """Feed the batches to an index of their own; (bucket, chunk, answer) of all batches. The index goes when it has answered."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, scratch_path(spark, "index"), window, n_buckets)
    texts = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    answers = [index.absorb(docs.where(c).select(chunk.alias("chunk"), *texts), k) for k, c in enumerate(conditions)]
    remove_path(spark, index.folder)
    return reduce(DataFrame.unionAll, answers)


def substring_dedup(docs: DataFrame, window: int = 13, batches: int = 4, with_text: bool = True, chunk_bytes: int = 4 * MB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the number of its words, of those removed, and what is left.

    The corpus goes through a `FingerprintIndex` in `batches` batches of rising ids. For each batch its texts are dealt to
    chunks and its windows, about 11 bytes each, to buckets; history is read in place. At last the texts meet the answers.
    """
    docs, conditions, n_buckets, chunk = batched(text_rows(docs, id_col, text_col), batches, chunk_bytes)
    answers = answers_of(docs, conditions, chunk, n_buckets, window)
    chunks = docs.select(chunk.alias("chunk"), "doc_id", "text")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finishing(window, n_buckets, with_text), RESULT)


def substring_dedup_rows(docs: DataFrame, window: int = 13, batches: int = 4, chunk_bytes: int = 4 * MB) -> DataFrame:
    """The documents themselves, with all their columns, and what is left of their texts.

    A text that loses nothing stays as it is, another becomes its kept words joined by one space (n_chars, if there is such
    a column, follows); a document that loses all its words goes.
    """
    text_rows(docs)
    docs, conditions, n_buckets, chunk = batched(docs, batches, chunk_bytes)
    answers = answers_of(docs, conditions, chunk, n_buckets, window)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    chunks = docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    schema = chunks.select("doc_id", "text", "rest").schema.add("changed", "boolean")

    def finished(held: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(held, window)
        done = cleaned(w, late_windows(w, answers, n_buckets), True)
        removed, words = done.column("n_removed").to_numpy(), done.column("n_words").to_numpy()
        stays = pa.array((removed == 0) | (removed < words))
        changed = pa.array(removed > 0)
        text = pc.if_else(changed, done.column("kept_text"), held.column("text"))
        out = pa.table({"doc_id": held.column("doc_id"), "text": text, "rest": held.column("rest"), "changed": changed}).filter(stays)
        del w, done, text
        released()
        return out

    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finished, schema)
    kept = {c: F.col(f"rest.c{k}") for k, c in enumerate(others)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns))
