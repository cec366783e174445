"""Records of evaluation splits that also occur, exactly or almost, in training.

1. ``indexed``: the distinct evaluation records are laid down in shards; each shard becomes a full-text index
   of their words in text order (a Burrows-Wheeler transform whose rank structure and document numbers are kept,
   not the texts). All records are streamed through backward search: words are read from right to left, and a
   match ends where it can't be extended any more. The spans a record shares with an evaluation record are
   merged and counted; those that cover enough of it are candidates, and the words in common, counted
   with repeats, decide.
2. ``searched``, the exact check that follows: order does not count for TESTDATA's groups and relation carries
   over, so records whose spans are too short, or that are linked over others only, are looked up word by
   word in all evaluation records and all records linked to one, under other groups than their own, until no more are reached.
   That work grows with records times reached records.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.near_duplicates import features
from tessera.operators.components import components
from tessera.session import Scratch

#: Words of a span that counts as covered text.
SPAN = 8
#: A candidate covers one word in so many of a record; a span's rows, and a record's candidates, that are looked at. The exact check does the rest.
SHARE, ROWS, TOP = 4, 12, 6
#: Words of an index (12 bytes each), or different words whose postings go out at once.
SHARD = POSTINGS = 4_000_000
#: Linked records of more than so many are passed over as a whole by each of them.
FAMILY = 32
#: Keys of records that are newly linked go out as a whole up to so many (8 bytes each).
FRESH = 1_000_000
#: Near-same records have so many percent of the larger one's words in common.
PERCENT = 85


def split_name(label: Column) -> Column:
    """train, test or dev, whatever the spelling; null for null and other labels."""
    s = F.lower(F.trim(label))
    # The spellings of the three names.
    return F.when(s.rlike(r"^(train|trn)"), "train").when(s.rlike(r"^(test|tst)"), "test").when(s.rlike(r"^(dev|val)"), "dev")


def _spread(length: np.ndarray) -> np.ndarray:
    """0 to length - 1, for each length after the other."""
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


class WordIndex:
    """Index of texts of symbols from 1; counts, locates and extends matches by backward search."""

    def __init__(self, texts: list[np.ndarray] | np.ndarray, lengths: np.ndarray | None = None):
        if lengths is None:
            lengths = np.array([len(t) for t in texts], np.int64)
            texts = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
        # 0 ends a text
        symbols = np.insert(texts, np.cumsum(lengths), 0) if len(lengths) else np.zeros(1, np.int64)
        n = len(symbols)
        order = np.argsort(symbols)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], symbols[order][1:] != symbols[order][:-1]]))
        step = 1
        while step < n and rank.max() < n - 1:  # ranks of prefixes of double the length
            second = np.full(n, -1, np.int64)
            second[:-step] = rank[step:]
            both = rank * (n + 1) + second + 1
            order = np.argsort(both)
            rank[order] = np.cumsum(np.concatenate([[0], both[order][1:] != both[order][:-1]]))
            step *= 2
        transform = symbols[order - 1]
        # places of each symbol in the transform, one symbol after the other: a symbol's first row plus its rank is a place here
        starts = np.append(0, np.cumsum(np.bincount(symbols, minlength=2)))
        self._hold(starts, np.argsort(transform, kind="stable"), (np.cumsum(symbols == 0) - (symbols == 0))[order].astype(np.int32))

    def _hold(self, starts: np.ndarray, places: np.ndarray, docs: np.ndarray) -> "WordIndex":
        self.size, self.starts, self.docs = len(places), starts, docs
        self.ranks = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * self.size + places
        return self

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with symbol, then with what the rows low to high begin with."""
        return np.searchsorted(self.ranks, symbol * self.size + low), np.searchsorted(self.ranks, symbol * self.size + high)

    def spans(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, begin, end, low, high) of the matches of all texts (flat, one after the other), from right to left.

        Symbols of -1 match nothing. All texts advance together, one symbol a step.
        """
        k = len(lengths)
        order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)[order]
        length = lengths[order]
        live_at = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")  # texts of more than so many words
        out: list[tuple[np.ndarray, ...]] = []
        low, high, end = np.zeros(k, np.int64), np.full(k, self.size, np.int64), length.copy()
        for back in range(len(live_at)):
            m = int(live_at[back])
            at = length[:m] - 1 - back
            symbol = flat[ends[:m] - 1 - back]
            a, b = self.extend(low[:m], high[:m], np.maximum(symbol, 0))
            ok = (a < b) & (symbol > 0)
            done = np.nonzero(~ok & (end[:m] > at + 1))[0]
            if len(done):
                out.append((order[done], at[done] + 1, end[done], low[done], high[done]))
            again = np.nonzero(~ok)[0]
            fresh = np.clip(symbol[again], 0, len(self.starts) - 2)
            a[again], b[again] = self.starts[fresh], self.starts[fresh + 1]
            none = again[(a[again] >= b[again]) | (symbol[again] <= 0) | (symbol[again] > fresh)]
            end[again] = at[again] + 1
            end[none], a[none], b[none] = at[none], 0, self.size
            low[:m], high[:m] = a, b
        left = np.nonzero(end > 0)[0]
        out.append((order[left], np.zeros(len(left), np.int64), end[left], low[left], high[left]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def matches(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(begin, end, occurrences) of each text's matches, from right to left."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        flat = np.concatenate([*texts, np.empty(0, np.int64)]).astype(np.int64)
        found = self.spans(flat, np.array([len(t) for t in texts], np.int64))
        for text, begin, end, low, high in zip(*(x.tolist() for x in found)):
            out[text].append((begin, end, high - low))
        return [sorted(x, reverse=True) for x in out]


class Bags:
    """Bags of words, flat; counts words in common of many pairs at once."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, length: np.ndarray):
        self.words, self.counts, self.length = words, counts.astype(np.int64), length
        self.starts = np.cumsum(length) - length

    def common(self, mine: np.ndarray, other: "Bags", theirs: np.ndarray, below: int = 0) -> np.ndarray:
        """Words that bag mine[k] here and bag theirs[k] of the other have in common, with repeats; words may be numbers from 0 below some number."""
        if not len(mine):
            return np.empty(0, np.int64)
        sides = []
        for bags, k in ((self, mine), (other, theirs)):
            length = bags.length[k]
            place = np.repeat(bags.starts[k], length) + _spread(length)
            sides.append((np.repeat(np.arange(len(k)), length), bags.words[place], bags.counts[place]))
        (p, w, c), (q, v, d) = sides
        if not below:
            known, w = np.unique(w, return_inverse=True)
            at = np.minimum(np.searchsorted(known, v), len(known) - 1)
            held = known[at] == v
            q, v, d, below = q[held], at[held], d[held], len(known)
        if not len(w):
            return np.zeros(len(mine), np.int64)
        left, right = p * below + w, q * below + v  # both ascend, as words do in a bag
        found = np.minimum(np.searchsorted(left, right), len(left) - 1)
        same = left[found] == right
        return np.bincount(q[same], np.minimum(c[found[same]], d[same]), len(mine)).astype(np.int64)


LINKS = "a long, b long, words long, matched long, covered long, longest long, occurrences long"


def _build(part: pa.Table) -> pa.Table:
    """One shard's index, as one row of arrays."""
    t = part.column("t").combine_chunks()
    flat = t.flatten().to_numpy(zero_copy_only=False)
    vocabulary, symbols = np.unique(flat, return_inverse=True)
    index = WordIndex(symbols.astype(np.int64) + 1, pa.compute.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64))
    w = part.column("w").combine_chunks()
    columns = {"vocabulary": vocabulary, "starts": index.starts, "places": (index.ranks % index.size).astype(np.int32), "docs": index.docs, "keys": part.column("key").to_numpy(), "n": part.column("n").to_numpy(), "words": w.flatten().to_numpy(zero_copy_only=False)}
    columns |= {"counts": part.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False), "length": pa.compute.list_value_length(w).to_numpy(zero_copy_only=False)}
    return pa.table({k: pa.array([zstandard.compress(v.astype(_KINDS[k]).tobytes(), 3)], pa.binary()) for k, v in columns.items()})


_KINDS = {"vocabulary": np.int32, "starts": np.int64, "places": np.int32, "docs": np.int32, "keys": np.int64, "n": np.int32, "words": np.int64, "counts": np.int32, "length": np.int32}


class Shard:
    """The index of a shard and the bags of its records."""

    def __init__(self, sent: dict[str, bytes]):
        x = {k: np.frombuffer(zstandard.decompress(sent[k]), kind) for k, kind in _KINDS.items()}
        self.index = WordIndex.__new__(WordIndex)._hold(x["starts"], x["places"].astype(np.int64), x["docs"])
        self.vocabulary, self.keys, self.n = x["vocabulary"], x["keys"], x["n"].astype(np.int64)
        self.bags = Bags(x["words"], x["counts"], x["length"].astype(np.int64))

    def links(self, keys: np.ndarray, n: np.ndarray, flat: np.ndarray, lengths: np.ndarray, bags: Bags, percent: int) -> list[np.ndarray]:
        """LINKS of some records, found by their spans."""
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        text, begin, end, low, high = self.index.spans(np.where(self.vocabulary[at] == flat, at + 1, -1), lengths)
        long = end - begin >= SPAN
        text, size, low, rows = text[long], (end - begin)[long], low[long], (high - low)[long]
        seen = np.minimum(rows, ROWS)
        step = np.repeat(np.arange(len(seen)), seen)
        docs = self.index.docs[low[step] + _spread(seen) * rows[step] // seen[step]]
        # each record of the shard once for each span
        pairs = np.unique(step * len(self.keys) + docs)
        step, docs = np.divmod(pairs, len(self.keys))
        both, back = np.unique(text[step] * len(self.keys) + docs, return_inverse=True)
        covered = np.bincount(back, size[step], len(both)).astype(np.int64)
        best = np.zeros(len(both), np.int64)
        np.maximum.at(best, back, size[step] * (1 << 32) + rows[step])
        text, docs = np.divmod(both, len(self.keys))
        ok = (covered * SHARE >= n[text]) & (self.keys[docs] != keys[text]) & (np.minimum(n[text], self.n[docs]) * 100 >= percent * np.maximum(n[text], self.n[docs]))
        text, docs, covered, best = text[ok], docs[ok], covered[ok], best[ok]
        order = np.lexsort((docs, -covered, text))
        text, docs, covered, best = text[order], docs[order], covered[order], best[order]
        top = np.arange(len(text)) - np.searchsorted(text, text) < TOP
        text, docs, covered, best = text[top], docs[top], covered[top], best[top]
        common = bags.common(text, self.bags, docs)
        ok = common * 100 >= percent * np.maximum(n[text], self.n[docs])
        text, docs, common = text[ok], docs[ok], common[ok]
        return [keys[text], self.keys[docs], n[text], common, np.minimum(covered[ok], common), best[ok] >> 32, best[ok] & 0xFFFFFFFF]


def _batch_bags(batch: pa.RecordBatch) -> Bags:
    w, c = batch.column("w"), batch.column("c")
    return Bags(w.flatten().to_numpy(zero_copy_only=False), c.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64))


def indexed(bags: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """LINKS from records of bags(key, held, n, w, c, t) to held ones that the full-text index finds.

    A shard's index is built in a task of its own and has about SHARD words, so what is broadcast is
    bounded; all records are streamed past each shard.
    """
    held = bags.where("held")
    shards = int(held.agg(F.sum("n")).first()[0] or 0) // SHARD + 1
    parts = held.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).select("shard", "key", "n", "w", "c", "t")
    built = scratch.keep(parts.groupBy("shard").applyInArrow(lambda key, part: _build(part).append_column("shard", pa.array([key[0].as_py()], pa.int32())), ", ".join(f"{k} binary" for k in _KINDS) + ", shard int"), "index")
    out = bags.sparkSession.createDataFrame([], LINKS)
    for (shard,) in built.select("shard").orderBy("shard").collect():
        sent = bags.sparkSession.sparkContext.broadcast({k: bytes(v) for k, v in built.where(F.col("shard") == shard).first().asDict().items() if k in _KINDS})

        def run(batches, sent=sent):
            index = Shard(sent.value)
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    t = batch.column("t")
                    found = index.links(batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(np.int64), t.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64), _batch_bags(batch), percent)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=[x.split()[0] for x in LINKS.split(", ")])

        out = out.union(bags.select("key", "n", "w", "c", "t").mapInArrow(run, LINKS))
    return out


class Postings:
    """Bags of words by word; finds all bags that share percent of the larger one's words with a given bag."""

    def __init__(self, keys: np.ndarray, roots: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, starts: np.ndarray):
        # bags of one large root are neighbours, so a given root's are passed over at once; behind them, the others by size
        _, back, often = np.unique(roots, return_inverse=True, return_counts=True)
        many = often[back] > FAMILY
        order = np.lexsort((sizes, np.where(many, roots, 0), ~many))
        self.many = int(many.sum())
        length = np.diff(starts)[order]
        place = np.repeat(starts[:-1][order], length) + _spread(length)
        self.keys, self.roots, self.sizes = keys[order], roots[order], sizes[order]
        self.vocabulary, symbols = np.unique(words[place], return_inverse=True)
        self.bags = Bags(symbols, counts[place], length)
        postings = symbols * len(keys) + np.repeat(np.arange(len(keys)), length)
        order = np.argsort(postings)
        self.postings, self.times = postings[order], self.bags.counts[order]
        self.often = np.bincount(symbols, minlength=len(self.vocabulary))

    def near(self, words: np.ndarray, counts: np.ndarray, root: int, percent: int) -> np.ndarray:
        """Keys of the bags under other roots that are near-same to one bag of distinct words."""
        return self.near_all(Bags(words, counts, np.array([len(words)])), np.array([root]), percent)[1]

    def near_all(self, own: Bags, roots: np.ndarray, percent: int, at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(number of a given bag, key of a bag here) of all near-same pairs under different roots; exact.

        A bag of n words and a near-same one differ in at most n - least of them. So of any words that
        occur more often than that, the near-same bag has the rest; the rarest words are taken.
        """
        out = [(np.empty(0, np.int64), self.keys[:0])]
        size = np.add.reduceat(own.counts, own.starts) if len(own.starts) else own.counts[:0]
        for begin in range(0, len(size), at_once):
            n, root = size[begin : begin + at_once], roots[begin : begin + at_once]
            k = len(n)
            row = np.repeat(np.arange(k), own.length[begin : begin + k])
            first = own.starts[begin]
            words, counts = own.words[first : first + len(row)], own.counts[first : first + len(row)]
            at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == words
            smallest, largest = (percent * n + 99) // 100, n * 100 // percent
            differ = n - smallest
            order = np.lexsort((np.where(known, self.often[at], 0), row))
            c = counts[order]
            upto = np.cumsum(c) - np.repeat(np.cumsum(n) - n, own.length[begin : begin + k])  # of the rarer words of the row, with this one
            taken = order[(upto - c < (differ + 1 + n // 16)[row])]
            least = np.bincount(row[taken], counts[taken], k) - differ
            taken = taken[known[taken] & (np.bincount(row[~known], counts[~known], k) <= differ)[row[taken]]]
            taken = taken[np.argsort(at[taken])]  # neighbours in the postings are looked up one after the other
            of, symbol, times = row[taken], at[taken] * len(self.keys), counts[taken]
            alone = self.sizes[self.many :]
            ranges = [(self.many + np.searchsorted(alone, smallest), self.many + np.searchsorted(alone, largest + 1))]
            if self.many:
                several = self.roots[: self.many]
                ranges += [(np.zeros(k, np.int64), np.searchsorted(several, root)), (np.searchsorted(several, root, side="right"), np.full(k, self.many))]
            cells, shared = [], []
            for low, high in ranges:
                a, b = np.searchsorted(self.postings, symbol + low[of]), np.searchsorted(self.postings, symbol + high[of])
                length = np.maximum(b - a, 0)
                place = np.repeat(a, length) + _spread(length)
                cells.append(self.postings[place] + np.repeat(of * len(self.keys) - symbol, length))
                shared.append(np.minimum(self.times[place], np.repeat(times, length)))
            common = np.bincount(np.concatenate(cells), np.concatenate(shared), k * len(self.keys)).reshape(k, len(self.keys))
            mine, theirs = np.divmod(np.flatnonzero(common >= least[:, None]), len(self.keys))
            ok = (self.roots[theirs] != root[mine]) & (self.sizes[theirs] >= smallest[mine]) & (self.sizes[theirs] <= largest[mine])
            mine, theirs = mine[ok], theirs[ok]
            told = Bags(at[known], counts[known], np.bincount(row[known], minlength=k))
            for part in range(0, len(mine), 4096):
                x, y = mine[part : part + 4096], theirs[part : part + 4096]
                near = told.common(x, self.bags, y, len(self.vocabulary)) * 100 >= percent * np.maximum(self.sizes[y], n[x])
                out.append((x[near] + begin, self.keys[y[near]]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _links(bags: DataFrame, seeds: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a seed and any bag under another root with percent of the words in common.

    Seeds go out in blocks of about POSTINGS words; all bags are streamed past each block.
    """
    blocks = int(seeds.agg(F.sum(F.size("w"))).first()[0] or 0) // POSTINGS + 1
    out = None
    for block in range(blocks):
        part = seeds.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "root", "n", "w", "c").toArrow()
        if not part.num_rows:
            continue
        starts = np.append(0, np.cumsum(pa.compute.list_value_length(part.column("w")).to_numpy()))
        flat = [pa.compute.list_flatten(part.column(x)).to_numpy() for x in "wc"]
        sent = bags.sparkSession.sparkContext.broadcast((part.column("key").to_numpy(), part.column("root").to_numpy(), part.column("n").to_numpy().astype(np.int64), *flat, starts))

        def run(batches, sent=sent):
            index = Postings(*sent.value)
            for batch in batches:
                keys, roots = batch.column("key").to_numpy(), batch.column("root").to_numpy()
                at, near = index.near_all(_batch_bags(batch), roots, percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(near)], names=["a", "b"])

        found = bags.select("key", "root", "w", "c").mapInArrow(run, "a long, b long")
        out = found if out is None else out.union(found)
    return out


def searched(bags: DataFrame, roots: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(node, root) after all links are added that reach a held record of bags(key, held, n, w, c), directly or over others.

    First the held records and those linked to one are compared with all, then those that became linked to one, until there are no more.
    """
    least = bags.select("key", "held")

    def reached(roots: DataFrame) -> DataFrame:
        """(key, root, seed) of all records; seeds are under the root of a held one."""
        now = least.join(roots, F.col("key") == F.col("node"), "left").select("key", "held", F.coalesce("root", "key").alias("root"))
        return now.join(now.where("held").select("root", F.lit(True).alias("seed")).distinct(), "root", "left").select("key", "root", F.coalesce("seed", F.lit(False)).alias("seed")).distinct()

    # the words go over one shuffle, with the root and whether they are asked about first
    bags = scratch.keep(bags.select("key", "n", "w", "c").hint("merge").join(reached(roots), "key").select("key", "root", "seed", "n", "w", "c"), "rooted")
    seeds, tried = bags.where("seed"), bags.where("seed").select("key")
    for k in itertools.count():
        if k:
            fresh = scratch.keep(reached(roots).where("seed").select("key").join(tried, "key", "left_anti"), f"fresh{k}")
            few = fresh.count() <= FRESH
            seeds = scratch.keep(bags.join(F.broadcast(fresh) if few else fresh.hint("merge"), "key", "left_semi").select("key", "root", "n", "w", "c"), f"seeds{k}")
            tried = tried.union(fresh)
        if seeds.isEmpty():
            return roots
        found = scratch.keep(_links(bags, seeds, percent), f"found{k}")
        if found.isEmpty():
            return roots
        roots = components(found.union(roots.select("node", "root")), Scratch(scratch.spark, "searched"))


HITS = "row_no long, group_no long, words long, matched long, covered long, longest long, occurrences long"


def overlaps(df: DataFrame, key: str, text: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(members, hits) of a table with a key, a text and a split label.

    members: row_no, group_no, copies_of, split_name of all records in near-duplicate groups that
    have both a training and an evaluation record. hits: HITS, for each record (one of
    equal bags of words) that the index links to an evaluation record: words in common (matched), in merged spans (covered), of the
    longest span and its occurrences. Records with a null or unknown split label
    take part in the grouping but are no members; nulls and blank texts are in no group.
    """
    scratch = Scratch(df.sparkSession, "overlap")
    labels = df.select(F.col(key).cast("long").alias("key"), split_name(F.col(split)).alias("split_name")).where("split_name is not null").distinct()
    feats = scratch.keep(features(df, key, text, order=True), "features")
    held = F.count_if(F.col("split_name") != "train") > 0
    prints = scratch.keep(feats.select("key", "f1", "f2").join(labels, "key", "left").groupBy("f1", "f2").agg(F.min("key").alias("key"), held.alias("held")), "prints")
    bags = scratch.keep(feats.hint("merge").join(prints, ["key", "f1", "f2"]).dropDuplicates(["key", "f1", "f2"]).select("key", "held", "n", "w", "c", "t"), "bags")
    links = scratch.keep(indexed(bags, scratch), "links")
    roots = scratch.keep(components(links.select("a", "b"), Scratch(df.sparkSession, "linked")), "roots")
    roots = searched(bags, roots, scratch)
    named = prints.join(roots, prints.key == roots.node, "left").select("f1", "f2", F.coalesce("root", "key").alias("group_no"), F.col("key").alias("copies_of"))
    rows = feats.select("key", "f1", "f2").join(labels, "key").join(named, ["f1", "f2"]).select(F.col("key").alias("row_no"), "group_no", "copies_of", "split_name").distinct()
    rows = scratch.keep(rows, "rows")
    both = rows.groupBy("group_no").agg(F.count_if(F.col("split_name") == "train").alias("n_train"), F.count_if(F.col("split_name") != "train").alias("n_eval")).where("n_train > 0 and n_eval > 0")
    members = scratch.keep(rows.join(both.select("group_no"), "group_no"), "members")
    best = links.groupBy("a").agg(F.max(F.struct("matched", "covered", "longest", "occurrences", "words")).alias("x"))
    hits = best.join(members.select("group_no", "copies_of").distinct(), F.col("a") == F.col("copies_of")).select(F.col("a").alias("row_no"), "group_no", *(f"x.{c}" for c in ("words", "matched", "covered", "longest", "occurrences")))
    return members, scratch.keep(hits, "hits")


def pairs(members: DataFrame, hits: DataFrame) -> DataFrame:
    """(row_a, row_b, train_no, eval_no, eval_split, matched): each training record beside all evaluation records of its group.

    matched: the most words that the training record's bag has in common with an evaluation record the index links it to; 0 where it
    is linked over others or by the exact check only.
    """
    train = members.where("split_name = 'train'").select("group_no", "copies_of", F.col("row_no").alias("train_no"))
    classes = hits.groupBy(F.col("row_no").alias("copies_of"), "group_no").agg(F.max("matched").alias("matched"))
    held = members.where("split_name <> 'train'").select("group_no", F.col("row_no").alias("eval_no"), F.col("split_name").alias("eval_split"))
    out = train.join(classes, ["group_no", "copies_of"], "left").join(held, "group_no").where("train_no <> eval_no")
    return out.select(F.least("train_no", "eval_no").alias("row_a"), F.greatest("train_no", "eval_no").alias("row_b"), "train_no", "eval_no", "eval_split", F.coalesce("matched", F.lit(0)).alias("matched"))
