"""Near-duplicate records: improved consistent weighted sampling over TF-IDF weighted words, banded, verified.

The shingle of this project is one word (TESTDATA.md compares bags of words,
so order does not count). Steps, each a distributed pass:

1. ``features``: prompt bodies to bags of word ids; exact copies share a 128-bit fingerprint.
2. ``document_frequency``: counts over all records, in a table of fixed size (2**17 hashed
   slots), so what is broadcast does not grow with the data.
3. ``signatures``: 7 x 32 consistent weighted samples of sqrt(tf) * idf, folded to 32 band keys.
4. ``candidates``: one shuffle by band key; in every bucket, whatever its size, neighbours and a star of the least row,
   then in ``strays`` all pairs over the components that these links leave.
5. ``bounded``: pairs that a histogram of 64 bytes shows to have too few words in common are left out, without loss;
   ``verified``: exact weighted Jaccard on the word counts.
6. Components of the verified links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Vocabulary, bag, body_bytes, word_ids
from tessera.operators.components import components
from tessera.session import Scratch

BANDS, ROWS = 32, 7
SAMPLES = BANDS * ROWS
SLOTS = 1 << 17
#: Bounds of a word's inverse document frequency. Words of a family that holds a third of all rows
#: would weigh next to nothing without the lower one, and a few changed words all without the upper one.
LEAST_IDF, MOST_IDF = 1.0, 3.0
#: Parts of a bag's histogram: the words of two bags that fall into a part, the fewer of both, bound the words in common.
PARTS = 64

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int64), kind))


def features(df: DataFrame, key: str, text: str, template: bool = True, order: bool = False) -> DataFrame:
    """key, f1, f2 (fingerprint of the bag), n (words), w (sorted word ids), c (their counts); on request t, 32 bits of the words in text order.

    Null keys, null texts and texts without a word give no row.
    """
    vocabulary = Vocabulary()

    def run(batches):
        for batch in batches:
            keys, f1, f2, n, w, c, t = [], [], [], [], [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids = word_ids(body_bytes(x) if template else x, vocabulary)
                if not ids:
                    continue
                values, counts = bag(ids)
                print_ = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes() + counts.tobytes()), np.int64)
                keys.append(k), f1.append(print_[0]), f2.append(print_[1]), n.append(len(ids)), w.append(values), c.append(counts)
                if order:
                    t.append(np.array(ids, np.uint64).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int32()), _lists(w, pa.int64()), _lists(c, pa.int32()), *([_lists(t, pa.int32())] if order else [])],
                names=["key", "f1", "f2", "n", "w", "c", *(["t"] if order else [])],
            )

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").mapInArrow(
        run, "key long, f1 long, f2 long, n int, w array<long>, c array<int>" + (", t array<int>" if order else "")
    )


def document_frequency(feats: DataFrame) -> tuple[np.ndarray, int]:
    """Records per hashed slot, and records; over all rows of feats."""

    def run(batches):
        total, rows = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & (SLOTS - 1), minlength=SLOTS)
            rows += batch.num_rows
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], names=["slot", "n"])

    got = feats.select("w").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS, np.int64)
    rest = got[got.slot >= 0]
    df[rest.slot.to_numpy().astype(np.int64)] = rest.n.to_numpy()
    return df, int(got.n[got.slot < 0].sum())


class Sampler:
    """Consistent samples of weighted bags; those of a (word, count) are kept for the next bag."""

    LIMIT = 30_000

    def __init__(self, idf: np.ndarray):
        self.idf, self.at, self.used = idf, {}, 0
        self.rows = np.empty((1024, SAMPLES), np.uint64)
        self.salt = _mix(np.arange(1, SAMPLES * 5 + 1, dtype=np.uint64) * _GOLD).reshape(5, 1, SAMPLES)

    def make(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each sample, the order value (upper half) and the identity (lower half) of the element."""
        words = words.view(np.uint64)
        weight = np.log(np.sqrt(counts) * self.idf[(words & np.uint64(SLOTS - 1)).astype(np.int64)])[:, None]
        bits = _mix(words[None, :, None] ^ self.salt)
        u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        r, c, beta = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
        t = np.floor(weight / r + beta)
        a = np.exp(np.clip(np.log(c) - r * (t - beta) - r, -80, 80)).astype(np.float32)
        identity = _mix(words[:, None] ^ (t.astype(np.int64).view(np.uint64) * _GOLD)) >> np.uint64(32)
        return (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | identity

    def signatures(self, w: np.ndarray, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """SAMPLES identities of each bag; the bags are w[starts[i]:starts[i + 1]], none is empty."""
        names = list(zip(w.tolist(), c.tolist()))
        if self.used + len(set(names)) > self.LIMIT:
            self.at, self.used = {}, 0
        new = [x for x in dict.fromkeys(names) if x not in self.at]
        for k in range(0, len(new), 256):
            part = new[k : k + 256]
            made = self.make(np.array([x[0] for x in part], np.int64), np.array([x[1] for x in part], np.float64))
            if self.used + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.empty((max(len(part), self.used), SAMPLES), np.uint64)])
            self.rows[self.used : self.used + len(part)] = made
            self.at.update((x, self.used + i) for i, x in enumerate(part))
            self.used += len(part)
        least = np.minimum.reduceat(self.rows[[self.at[x] for x in names]], starts, axis=0)
        return least & np.uint64(0xFFFFFFFF)


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key ^ parts[:, :, k])
    return key.view(np.int64)


def signatures(feats: DataFrame, df: np.ndarray, rows: int) -> DataFrame:
    """key, f1, f2, n, h (PARTS bytes: how many words are in each part of the hash space, 255 for as many or more), bands."""
    idf = feats.sparkSession.sparkContext.broadcast(np.clip(np.log(max(rows, 1) / np.maximum(df, 1)), LEAST_IDF, MOST_IDF).astype(np.float32))

    def run(batches):
        sampler = Sampler(idf.value.astype(np.float64))
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                w, c = batch.column("w"), batch.column("c")
                starts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(w).to_numpy())[:-1]]).astype(np.int64)
                signature = sampler.signatures(w.flatten().to_numpy(), c.flatten().to_numpy(), starts)
                flat, length = w.flatten().to_numpy(), pa.compute.list_value_length(w).to_numpy()
                part = np.repeat(np.arange(batch.num_rows), length) * PARTS + (flat.view(np.uint64) >> np.uint64(40)).astype(np.int64) % PARTS
                parts = np.minimum(np.bincount(part, c.flatten().to_numpy(), batch.num_rows * PARTS), 255).astype(np.uint8).reshape(-1, PARTS)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in ("key", "f1", "f2", "n")), pa.array([x.tobytes() for x in parts], pa.binary()), _lists(list(_bands(signature)), pa.int64())],
                    names=["key", "f1", "f2", "n", "h", "bands"],
                )

    return feats.mapInArrow(run, "key long, f1 long, f2 long, n int, h binary, bands array<long>")


def _alike(n1, n2, percent):
    """Whether the numbers of words allow a pair to be near-same."""
    return np.minimum(n1, n2).astype(np.int64) * 100 >= percent * np.maximum(n1, n2)


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose histograms allow percent of the larger one's words in common; loses no near-same pair."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(h).to_pylist()), np.uint8).reshape(-1, PARTS) for h in ("ha", "hb"))
            least = np.minimum(x, y)
            most = least.astype(np.int64).sum(1) + np.where((least == 255).any(1), 1 << 40, 0)
            larger = np.maximum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()).astype(np.int64)
            ok = pa.array(most * 100 >= percent * larger)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    side = lambda s: reps.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("h").alias(f"h{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long")


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """(hot, a, b): pairs a < b of neighbours in a bucket and of its least row with each, and for each row of a bucket of more than two (true, row, band key)."""

    def run(batches):
        keep = None  # the rows of the last bucket, that may go on; of a large one the first and the last
        large = False
        names = ("band", "key", "n")
        for batch in batches:
            x = {k: batch.column(k).to_numpy() for k in names}
            carried = 0
            if keep is not None:
                carried = len(keep["band"])
                x = {k: np.concatenate([keep[k], x[k]]) for k in names}
            band, key = x["band"], x["key"]
            if not len(band):
                continue
            first = np.concatenate([[True], band[1:] != band[:-1]])
            begin = np.nonzero(first)[0]
            length = np.diff(np.append(begin, len(band)))
            bucket = np.cumsum(first) - 1
            hot = (length > 2) | ((np.arange(len(length)) == 0) & large & (carried > 0))
            is_hot = hot[bucket]
            left, right = [], []

            def take(i, j):
                ok = _alike(x["n"][i], x["n"][j], percent)
                left.append(key[i][ok]), right.append(key[j][ok])

            i = np.nonzero(~first[1:])[0]
            take(i, i + 1)
            i = np.nonzero(is_hot)[0]
            take(begin[bucket[i]], i)
            rows = np.nonzero(is_hot & (np.arange(len(band)) >= (carried if large else 0)))[0]
            a, b = np.concatenate([*left, key[:0]]), np.concatenate([*right, key[:0]])
            ok = a != b
            a, b = np.minimum(a, b)[ok], np.maximum(a, b)[ok]
            if len(a):
                a, b = np.unique(np.stack([a, b], 1), axis=0).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(a), bool), np.ones(len(rows), bool)])), pa.array(np.concatenate([a, key[rows]])), pa.array(np.concatenate([b, band[rows]]))],
                names=["hot", "a", "b"],
            )
            large = bool(hot[-1])
            at = [begin[-1], len(band) - 1] if large else slice(begin[-1], None)
            keep = {k: x[k][at] for k in names}

    bands = reps.select(F.explode("bands").alias("band"), "key", "n")
    return bands.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "hot boolean, a long, b long")


def strays(hot: DataFrame, links: DataFrame, reps: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of buckets over different components.

    A bucket's main component is the one with most of its rows. Each row
    outside it meets all rows of the bucket; rows of the main component don't
    meet each other, so a large family costs no pairs.
    """
    roots = components(links, Scratch(scratch.spark, "strays"))
    rows = hot.join(roots, hot.key == roots.node, "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    rows = scratch.keep(rows, "hot")
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    marks = reps.select("key", "n")
    rows = rows.join(main, "band").join(marks, "key")
    x, y = rows.where("root <> main").alias("x"), rows.alias("y")
    ok = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    return x.join(y, ok).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def verified(pairs: DataFrame, feats: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, jaccard) of the pairs whose bags share percent of the larger one's words.

    The weighted Jaccard similarity, common / (n_a + n_b - common), is exact, from the counts.
    """

    def run(batches):
        for batch in batches:
            side = [(batch.column(w), batch.column(c)) for w, c in (("wa", "ca"), ("wb", "cb"))]
            (wa, ca), (wb, cb) = [(w.flatten().to_numpy(), c.flatten().to_numpy()) for w, c in side]
            oa, ob = [np.append(0, np.cumsum(pa.compute.list_value_length(w).to_numpy())) for w, _ in side]
            common = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                p, q = wa[oa[k] : oa[k + 1]], wb[ob[k] : ob[k + 1]]
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                same = q[at] == p
                common[k] = np.minimum(ca[oa[k] : oa[k + 1]][same], cb[ob[k] : ob[k + 1]][at[same]]).sum()
            na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
            ok = common * 100 >= percent * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(common[ok]), pa.array((common / (na + nb - common))[ok])], names=["a", "b", "common", "jaccard"]
            )

    side = lambda s: feats.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("w").alias(f"w{s}"), F.col("c").alias(f"c{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(run, "a long, b long, common long, jaccard double")


def near_duplicates(df: DataFrame, key: str, text: str, percent: int = 85, template: bool = True) -> DataFrame:
    """(key, group_no, copies_of) of all records in a group of two or more.

    group_no is the least key of the group, copies_of the least key with the
    same bag of words. percent: words in common of the larger bag. Nulls,
    blank texts and texts without words are in no group; rows that repeat a
    key count once; further columns of df are not touched.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    feats = scratch.keep(features(df, key, text, template), "features")
    frequency, rows = document_frequency(feats)
    signs = scratch.keep(signatures(feats, frequency, rows), "signatures")
    reps = signs.groupBy("f1", "f2").agg(F.min("key").alias("key"), F.count_distinct("key").alias("copies"), *(F.first(c).alias(c) for c in ("n", "h", "bands")))
    reps = scratch.keep(reps, "reps")
    found = scratch.keep(candidates(reps, percent), "candidates")
    links = scratch.keep(verified(bounded(found.where("not hot").select("a", "b").distinct(), reps, percent), feats, percent), "links")
    hot = found.where("hot").select(F.col("b").alias("band"), F.col("a").alias("key")).distinct()
    if not found.where("hot").isEmpty():
        more = strays(hot, links, reps, scratch, percent)
        links = links.union(scratch.keep(verified(bounded(more, reps, percent), feats, percent), "strays"))
    roots = components(links.select("a", "b"), scratch)
    named = reps.join(roots, reps.key == roots.node, "left").where("root is not null or copies > 1")
    named = named.select("f1", "f2", F.coalesce("root", "key").alias("group_no"), F.col("key").alias("copies_of"))
    return signs.select("key", "f1", "f2").join(named, ["f1", "f2"]).select("key", "group_no", "copies_of").distinct()
