"""MinHash near-duplicate groups with odd sketches.

Each document's distinct word shingles give a MinHash sample. Its values are banded to find candidates, and folded
into a parity bitmap, the odd sketch: the bits that differ between two sketches estimate how many samples differ, most
precisely where similarity is high. Candidates whose sketches allow the similarity are confirmed on full shingle sets.

Documents with equal shingle sets are one class, named by a 128-bit hash of the set (node); only classes are banded. Each member of a
bucket is a candidate with the bucket's hub, which joins nearly all of a group. Members of one bucket that are still in
different components are then compared: in a small bucket pair by pair, else those outside a main component with all
others that they meet, block by block, on sketches first and then, where those allow it, on sets. So no pair of a bucket is passed over unless it is connected already, and no group is
gathered in one task. Aggregates that are joined back are written first: both sides of such a join are then plain
shuffles, which Spark splits where a key is hot.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qhapaq.llm.batches import named, steps
from qhapaq.operators.graph import components
from qhapaq.shared import ship, written

_MIX, _PRIME = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rules:
    """shingle: words. percent: least similarity, 100 * common / all. bands * rows samples; a pair at 80% shares no
    band with probability (1 - 0.8**5)**32 = 3e-6. slack: how far below percent a sketch's estimate may lie (5 standard
    deviations). small: size of a bucket that is compared whole. block: members of a block, and set_block: shingles of one, on average
    at most. broadcast: candidates up to which their hashes go to all executors; bitmap_bits: size of what does beyond."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    sketch_words: int = 8
    slack: float = 0.18
    small: int = 16
    block: int = 2048
    set_block: int = 1 << 20
    broadcast: int = 1_000_000
    bitmap_bits: int = 28


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; all words as one if they are fewer; empty without words."""
    words = (text or "").encode().translate(_A_TO_Z).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out + h[k: len(words) - width + 1 + k]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


@functools.lru_cache(maxsize=2)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, n, np.uint32)[:, None], (rng.integers(0, 2**32, n, np.uint32) | np.uint32(1))[:, None]


def minhash(found: np.ndarray, n: int) -> np.ndarray:
    """n MinHash samples of a set of 64-bit hashes."""
    flip, odd = _seeds(n)
    low = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    best = np.full(n, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 2048):
        x = (low[None, i: i + 2048] ^ flip) * odd
        np.minimum(best, x.min(1), out=best)
    return best


def _set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def features(found: np.ndarray, rules: Rules) -> tuple[bytes, list[int], list[int]]:
    """Key of the set, band keys and odd sketch."""
    n = rules.bands * rules.rows
    sample = _mixed(minhash(found, n).astype(np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(32)))
    bands = _mixed((sample.reshape(rules.bands, rules.rows) * (_PRIME ** np.arange(1, rules.rows + 1, dtype=np.uint64))).sum(1, dtype=np.uint64))
    bits = np.bincount((sample % np.uint64(64 * rules.sketch_words)).astype(np.int64), minlength=64 * rules.sketch_words) & 1
    sketch = np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")
    return _set_key(found), bands.view(np.int64).tolist(), sketch.tolist()


def estimate(differ: float | np.ndarray, rules: Rules) -> float | np.ndarray:
    """Similarity from the number of sketch bits that differ."""
    bits, n = 64 * rules.sketch_words, rules.bands * rules.rows
    return 1 + bits / (4 * n) * np.log(np.maximum(1 - 2 * np.asarray(differ, float) / bits, 1e-9))


def most_differing(rules: Rules) -> int:
    """Sketch bits that may differ for a pair to stay a candidate."""
    least = rules.percent / 100 - rules.slack
    return max(d for d in range(32 * rules.sketch_words) if estimate(d, rules) >= least)


FEATURES = "doc_id {id}, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def described(docs: DataFrame, rules: Rules, doc_id: str, text: str) -> DataFrame:
    """One row of features per row, in one pass; documents without words have none but n_shingles 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = FEATURES.format(id=dict(rows.dtypes)["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            out = []
            for t in b.column(1):
                found = shingles(t.as_py(), rules.shingle)
                out.append((len(found), *(features(found, rules) if len(found) else (None, None, None))))
            n, keys, bands, sketches = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return rows.mapInArrow(run, schema)


def _differ(a: str, b: str, words: int) -> Column:
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(words)])


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of fixed size that has the hash of every candidate, put together in pages by executors; a full one lets
    every row pass and costs only time."""
    page = 1 << 18

    def run(group: pa.Table) -> pa.Table:
        marks = np.zeros(page, np.uint8)
        marks[group["h"].to_numpy() % page] = 1
        return pa.table({"page": group["page"][:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    h = F.pmod("h", F.lit(1 << bits))
    pages = hashes.select(h.alias("h")).distinct().withColumn("page", F.floor(F.col("h") / page).cast("int"))
    out = bytearray(1 << (bits - 3))
    for at, part in zip(*(c.to_pylist() for c in pages.groupBy("page").applyInArrow(run, "page int, bits binary").toArrow().columns)):
        out[at * (page >> 3): (at + 1) * (page >> 3)] = part
    return bytes(out)


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """(node, shingles) of the classes in keys (distinct nodes), from the texts of their representatives.

    Up to `broadcast` representatives go to every executor as 8-byte hashes and pick the texts there; beyond that a bitmap
    of fixed size does. Either way only the sets of what passes are shuffled, not the texts.
    """
    wanted = written(classes.join(keys, "node", "left_semi").select("node", F.xxhash64("rep").alias("h")), "wanted")
    few = wanted.count() <= rules.broadcast
    rows = docs.select("text", F.xxhash64("doc_id").alias("h"))
    if few:
        rows = rows.join(F.broadcast(wanted.select("h").distinct()), "h", "left_semi").select("text", "h")
    held = None if few else docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, rules.bitmap_bits))
    mask = (1 << rules.bitmap_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            if held is not None:
                h = b.column(1).to_numpy() & mask
                b = b.filter(pa.array((np.frombuffer(held.value, np.uint8)[h >> 3] >> (h & 7).astype(np.uint8)) & 1, pa.uint8()).cast(pa.bool_()))
            found = [shingles(t.as_py(), rules.shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                                             ["node", "shingles"])

    found = rows.mapInArrow(run, "node binary, shingles array<long>")
    return written(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    a, b = F.col("sa"), F.col("sb")
    common = F.size(F.array_intersect(a, b))
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
            .filter(100 * common >= rules.percent * (F.size(a) + F.size(b) - common)).select("a", "b"))


def _sketched(pairs: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """(a, b, differ) of the pairs whose sizes and sketches allow the similarity."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    differ = _differ("sa", "sb", rules.sketch_words)
    sizes = 100 * F.least("na", "nb") >= rules.percent * F.greatest("na", "nb")
    return (pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes).select("a", "b", differ.alias("differ"))
            .filter(F.col("differ") <= most_differing(rules)))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _split(buckets: DataFrame, labels: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """What is left to compare in buckets (bucket, node) whose members are in different components.

    Pairs (a, b) of buckets of up to `small` members, unless their main component is larger than that; and for all
    others (main, node, component): the members that meet under a main component, in whichever bucket.
    """
    at = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    at = written(at, "buckets-labelled")
    main = (at.groupBy("bucket", "component").count().groupBy("bucket")
            .agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("m"), F.max("count").alias("top"))
            .filter(F.col("m") > F.col("top")))
    whole = labels.groupBy(F.col("component").alias("main")).agg(F.count("*").alias("whole"))
    main = written(main.join(whole, "main", "left").select("bucket", "main", (F.greatest("m", "whole") <= rules.small).alias("few")), "buckets-main")
    member = written(at.join(main, "bucket"), "buckets-split")
    few = member.filter("few").groupBy("bucket").agg(F.collect_list(F.struct("node", "component")).alias("x"))
    few = few.select("x", F.explode("x").alias("p")).select("p", F.explode("x").alias("q")).filter(
        (F.col("p.component") != F.col("q.component")) & (F.col("p.node") < F.col("q.node")))
    return (few.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(),
            member.filter(~F.col("few")).select("main", "node", "component").distinct())


class _Joined(dict):
    """Union of component numbers inside a block."""

    def of(self, x: int) -> int:
        while self.get(x, x) != x:
            x = self[x]
        return x


def allowed(left: np.ndarray, k: int, component: np.ndarray, size: np.ndarray, rules: Rules) -> np.ndarray:
    """Those of left that are in another component than k and whose sizes allow the similarity."""
    return left[(component[left] != component[k]) & (100 * np.minimum(size[left], size[k]) >= rules.percent * np.maximum(size[left], size[k]))]


def block_links(left: np.ndarray, right: np.ndarray, component: np.ndarray, size: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], rules: Rules) -> list[tuple[int, int]]:
    """Confirmed links between members of left and right (positions) that join different components.

    Each right member meets the left ones that sketches allow, closest first, on full sets; once it is joined to a
    component, the rest of that component is passed over. So links are at most as many as members.
    """
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    mark, most, joined, out = np.zeros(ids.max() + 1, np.int64), most_differing(rules), _Joined(), []
    for k in right.tolist():
        z = allowed(left, k, component, size, rules)
        differ = np.bitwise_count(sketch[z] ^ sketch[k]).sum(1, dtype=np.int64)
        z = z[np.argsort(differ, kind="stable")][: int((differ <= most).sum())]
        own = ids[ends[k] - size[k]: ends[k]]
        mark[own] = 1
        step = 16
        while len(z):
            now, z = z[:step], z[step:]
            step *= 2
            now = now[[joined.of(c) != joined.of(component[k]) for c in component[now].tolist()]] if len(now) else now
            if not len(now):
                continue
            flat = np.concatenate([ids[ends[i] - size[i]: ends[i]] for i in now.tolist()])
            common = np.add.reduceat(mark[flat], np.cumsum(size[now]) - size[now])
            for i in now[100 * common >= rules.percent * (size[now] + size[k] - common)].tolist():
                if joined.of(int(component[i])) != joined.of(int(component[k])):
                    joined[joined.of(int(component[i]))] = joined.of(int(component[k]))
                    out.append((i, k))
        mark[own] = 0
    return out


def _size_class(percent: int) -> Column:
    """Sets whose sizes are two classes apart are too unequal to be so alike."""
    return F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n_shingles").cast("int")


def _in_blocks(rows: DataFrame, rules: Rules, weight: Column, most: int, what: list[str], compare: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """compare on every pair of blocks of rows (main, node, component, n_shingles, ...) that may hold alike sets.

    Members outside the main component meet those of their size class and of the two beside it. A block has about `most` of
    weight; each row goes to as many tasks as the other side has blocks.
    """
    rows = written(rows.withColumns({"class": _size_class(rules.percent), "h": F.xxhash64("node"), "w": weight}), "meeting")
    outside = F.col("component") != F.col("main")
    right = rows.filter(outside).withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])))
    counts = rows.groupBy("main", "class").agg(F.sum("w").alias("m")).join(
        right.groupBy("main", "class").agg(F.sum("w").alias("r")), ["main", "class"])
    part = lambda n: F.ceil(F.col(n) / most).cast("int").alias(n)
    counts = written(counts.select("main", "class", part("m"), part("r")), "meeting-sizes")
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["main", "class", *what]
    left = rows.join(counts, ["main", "class"]).select(*keys, F.lit(True).alias("left"), own("m").alias("i"), every("r").alias("j"))
    right = right.join(counts, ["main", "class"]).select(*keys, F.lit(False).alias("left"), every("m").alias("i"), own("r").alias("j"))
    return left.unionByName(right).groupBy("main", "class", "i", "j").applyInArrow(compare, schema)


def _met(meeting: DataFrame, docs: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """Links (a, b) among the members that meet under a main component, in blocks of bounded size.

    Blocks of sketches alone tell first which members have a partner of another component that sketches allow; only those
    meet again with their sets. No pairs are passed on, only members and confirmed links.
    """
    rows = meeting.join(classes.select("node", "n_shingles", "sketch"), "node")

    def column(group: pa.Table, name: str) -> np.ndarray:
        return group[name].combine_chunks().to_numpy(zero_copy_only=False)

    def arrays(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        component = group["component"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(component), -1)
        return column(group, "left").astype(bool), component, column(group, "n_shingles").astype(np.int64), sketch

    def near(group: pa.Table) -> pa.Table:
        is_left, component, size, sketch = arrays(group)
        left, right, hit = np.flatnonzero(is_left), np.flatnonzero(~is_left), np.zeros(len(is_left), bool)
        most = most_differing(rules)
        for k in right.tolist():
            z = allowed(left, k, component, size, rules)
            z = z[np.bitwise_count(sketch[z] ^ sketch[k]).sum(1, dtype=np.int64) <= most]
            hit[z] = True
            hit[k] |= len(z) > 0
        return group.filter(pa.array(hit)).select(["main", "node"])

    found = _in_blocks(rows, rules, F.lit(1), rules.block, ["node", "component", "n_shingles", "sketch"], near, "main binary, node binary")
    rows = written(rows.join(found.distinct(), ["main", "node"], "left_semi"), "meeting-near")
    rows = rows.join(_sets(docs, rows.select("node").distinct(), classes, rules), "node")

    def compare(group: pa.Table) -> pa.Table:
        is_left, component, size, sketch = arrays(group)
        nodes = group["node"].combine_chunks()
        sets = np.split(group["shingles"].combine_chunks().flatten().to_numpy(), np.cumsum(size)[:-1])
        links = block_links(np.flatnonzero(is_left), np.flatnonzero(~is_left), component, size, sketch, sets, rules)
        x, y = pa.array([i for i, _ in links], pa.int64()), pa.array([j for _, j in links], pa.int64())
        return pa.table({"x": nodes.take(x), "y": nodes.take(y)})

    found = _in_blocks(rows, rules, F.col("n_shingles") + rules.set_block // rules.block, rules.set_block, ["node", "component", "n_shingles", "sketch", "shingles"], compare, "x binary, y binary")
    return found.select(*_ordered(F.col("x"), F.col("y"))).distinct()


def linked(docs: DataFrame, rules: Rules | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents are linked if 100 * common >= percent * all distinct shingles; component_id is the least doc_id that can
    be reached over links, and kept says that it is the row's own. Runs jobs when called. Defined cases: a null or empty text, or
    one of blanks, has no shingles and is linked with nothing; rows with the same doc_id are one document to link, which
    has the links of all its texts; a null doc_id is linked with nothing, has a null component_id and is kept; an empty table
    gives no rows; other columns are ignored.
    """
    rules = rules or Rules()
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    all_rows = written(described(docs, rules, "doc_id", "text"), "features")
    rows = all_rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumnRenamed("set_key", "node")
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), *[F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    classes = written(classes, "classes")
    # a document whose rows have different sets joins their classes
    several = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("m")).filter(F.col("b") != F.col("m")).select("doc_id", "b")
    same = rows.join(written(several, "several"), "doc_id").select(F.col("node").alias("a"), "b").filter(F.col("a") != F.col("b")).distinct()
    labels = written(components(_near(docs, classes, rules).unionByName(same)), "labels")
    found = classes.join(labels, "node", "left").select("node", "rep", "last", F.coalesce("component", "node").alias("component"))
    least = written(found.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    found = found.join(least, "component", "left").select("node", "rep", "last", F.least("rep", "least").alias("component_id"))
    moved = written(found.filter((F.col("component_id") != F.col("rep")) | (F.col("rep") != F.col("last"))).select("node", "component_id"), "moved")
    out = all_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("node")).join(moved, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _near(docs: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """Confirmed links (a, b) that connect what is similar among classes."""
    member = classes.select("node", F.explode("bands").alias("bucket"))
    hub = F.min_by("node", F.xxhash64("node", "bucket"))  # another one in each band
    buckets = written(member.groupBy("bucket").agg(hub.alias("hub"), F.count("*").alias("n")).filter("n > 1"), "buckets-shared")
    in_bucket = written(member.join(buckets, "bucket"), "buckets")
    pairs = in_bucket.select(*_ordered(F.col("node"), F.col("hub"))).filter(F.col("a") != F.col("b")).distinct()
    pairs = written(_sketched(pairs, classes, rules), "pairs")
    sets = _sets(docs, _ends(pairs), classes, rules)
    both = pairs.select(F.col("a").alias("node"), "a", "b", "differ").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "differ"))
    best = both.groupBy("node").agg(F.min(F.struct("differ", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    links = written(_confirmed(best, sets, rules), "links")
    open_ = written(_apart(pairs, components(links)).join(best, ["a", "b"], "left_anti").select("a", "b"), "pairs-open")
    links = links.unionByName(written(_confirmed(open_, sets, rules), "links"))
    few, meeting = _split(in_bucket.filter("n > 2").select("bucket", "node"), components(links), rules)
    few = written(_sketched(few, classes, rules).join(pairs, ["a", "b"], "left_anti").select("a", "b"), "pairs-few")
    if not few.isEmpty():
        links = links.unionByName(written(_confirmed(few, _sets(docs, _ends(few), classes, rules), rules), "links"))
    meeting = written(meeting, "meeting")
    if not meeting.isEmpty():
        links = links.unionByName(written(_met(meeting, docs, classes, rules), "links"))
    return links


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    return (pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
            .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns))


def one_of_each(docs: DataFrame, rules: Rules | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs but for near-duplicates: of each group the row of its least doc_id, and of rows that share a
    doc_id one. All columns stay. Rows without shingles or without a doc_id are in no group and stay."""
    found = linked(docs, rules, doc_id=doc_id, text=text)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    columns = [named(c) for c in docs.columns]
    left = docs.join(gone, doc_id, "left_anti").select(*columns)
    again = written(found.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy(F.col("doc_id").alias(doc_id)).count().filter("count > 1").select(doc_id), "repeated")
    if again.isEmpty():
        return left
    once = left.join(again, doc_id, "left_semi").dropDuplicates([doc_id])
    return left.join(again, doc_id, "left_anti").select(*columns).unionByName(once.select(*columns))
