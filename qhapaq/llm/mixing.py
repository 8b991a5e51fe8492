"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are counted by membership pattern (their set of sources); the
flow network has an arc for each pattern and repetition, whose cost grows with the repetition, arcs from a pattern to
its sources, and an arc with the quota from each source to the sink. Costs depend on the repetition alone, so the
cheapest flow adds one repetition of all patterns at a time and augments, by layers (Dinic's algorithm): a round of
augmenting costs what the memberships are, whatever the number of patterns that still have room. The driver plans, as
patterns are counts of memberships, not documents. The tokens that leave a pattern are then
taken from its documents: whole passes over all of them, and a seeded part of one more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qhapaq.llm.batches import as_row
from qhapaq.shared import ship, written

Source = str | None
#: Up to so many membership patterns are broadcast; more are joined by shuffle.
BROADCAST_PATTERNS = 100_000
#: Documents of a pattern are ordered by a seeded hash. Its bits give nested buckets of this many.
BUCKETS, LEVELS = 1024, 2


def in_order(sources: set[Source]) -> list[Source]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, repeats: float) -> list[float]:
    """Share total by weight; none gets over repeats times its size, and what is over is shared again by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes)) if weights[i] > 0], float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        open_ = [i for i in open_ if i not in set(full)]
        left -= sum(out[i] for i in full)
    return out


def route(capacity: dict[tuple[Source, ...], int], quota: dict[Source, int], repeats: int) -> dict[tuple[Source, ...], dict[Source, int]]:
    """The cheapest greatest flow from patterns to sources, repetition by repetition."""
    flow: dict[tuple[Source, ...], dict[Source, int]] = {p: dict.fromkeys(p, 0) for p in capacity}
    left = dict(quota)
    of: dict[Source, list[tuple[Source, ...]]] = {}
    for p in capacity:
        for s in p:
            of.setdefault(s, []).append(p)
    for _ in range(repeats):
        room = dict(capacity)
        for p in capacity:  # what needs no rerouting
            for s in p:
                x = min(room[p], left[s])
                flow[p][s] += x
                room[p] -= x
                left[s] -= x
        while layers := _layers(room, flow, of, left):
            _fill(layers, room, flow, of, left)
    return flow


def _layers(room: dict, flow: dict, of: dict, left: dict) -> dict | None:
    """Steps of patterns and sources from those patterns that have room, up to the first sources that do; none if no path is left.

    A pattern leads to its sources, a source to the patterns whose flow to it could go elsewhere.
    """
    step = {("p", p): 0 for p, n in room.items() if n}
    front, found = list(step), False
    while front and not found:
        after = []
        for kind, x in front:
            for y in x if kind == "p" else of[x]:
                node = ("s", y) if kind == "p" else ("p", y)
                if node not in step and (kind == "p" or flow[y][x]):
                    step[node] = step[kind, x] + 1
                    found |= kind == "p" and left[y] > 0
                    after.append(node)
        front = after
    return step if found else None


def _fill(step: dict, room: dict, flow: dict, of: dict, left: dict) -> None:
    """Push along shortest paths until each is blocked; a way that proved shut is not tried again."""
    tried: dict = {}
    for start in [p for p, n in room.items() if n]:
        path = [("p", start)]
        while path and room[start]:
            kind, x = node = path[-1]
            if kind == "s" and left[x]:
                ways = [(path[i + 1][1], path[i][1]) for i in range(1, len(path) - 1, 2)]
                n = min([room[start], left[x], *(flow[p][s] for p, s in ways)])
                for i in range(0, len(path) - 1, 2):
                    flow[path[i][1]][path[i + 1][1]] += n
                for p, s in ways:
                    flow[p][s] -= n
                room[start] -= n
                left[x] -= n
                path = [("p", start)]
                continue
            ahead, k = x if kind == "p" else of[x], tried.get(node, 0)
            while k < len(ahead):
                nxt = ("s", ahead[k]) if kind == "p" else ("p", ahead[k])
                if step.get(nxt) == step[node] + 1 and (kind == "p" or flow[ahead[k]][x]):
                    break
                k += 1
            tried[node] = k
            if k < len(ahead):
                path.append(nxt)
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


@dataclass(frozen=True)
class Plan:
    """sources, their sizes and targets in order; tokens that each pattern gives, and its size."""

    sources: list[Source]
    sizes: list[int]
    targets: list[float]
    taken: dict[tuple[Source, ...], int]
    capacity: dict[tuple[Source, ...], int]


def plan(capacity: dict[tuple[Source, ...], int], weigh: Callable[[list[Source]], Sequence[float]], share: float, repeats: int) -> Plan:
    """share: tokens of the mix as a multiple of all tokens. weigh gives the ordered sources' weights."""
    sources = in_order({s for p in capacity for s in p})
    size = dict.fromkeys(sources, 0)
    for p, n in capacity.items():
        for s in p:
            size[s] += n
    sizes = [size[s] for s in sources]
    goal = targets(sizes, weigh(sources), share * sum(capacity.values()), repeats)
    flow = route(capacity, {s: round(t) for s, t in zip(sources, goal)}, repeats)
    return Plan(sources, sizes, goal, {p: sum(f.values()) for p, f in flow.items()}, capacity)


def sized(docs: DataFrame, seed: int, keep: list[str] | None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row with _size (words; null text 0), _pattern (sorted sources, null last) and _order (seeded hash)."""
    kind = dict(docs.dtypes)[source]
    rows = as_row(docs, keep, _id=doc_id, _text=text, _source=source)
    pattern = F.array_distinct(F.col("_source")) if kind.startswith("array") else F.array(F.col("_source").cast("string"))
    pattern = F.concat(F.array_sort(F.filter(pattern, lambda s: s.isNotNull())), F.filter(pattern, lambda s: s.isNull()))
    pattern = F.when(F.size(F.coalesce(pattern, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    return rows.select("row", *[c.alias(name) for name, c in {
        "_size": F.coalesce(F.regexp_count(F.col("_text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        "_pattern": pattern, "_order": F.xxhash64(F.lit(seed), F.col("_id").cast("string"))}.items()])


def _bucket(level: int) -> F.Column:
    return F.pmod(F.shiftright("_order", 10 * level), F.lit(BUCKETS)).cast("int")


def _planned(rows: DataFrame, weigh: Callable, share: float, repeats: int) -> tuple[Plan, DataFrame]:
    """The plan, and by pattern: whole passes, the rest's last buckets at each level and what is left for those."""
    spark = rows.sparkSession
    totals = rows.groupBy("_pattern").agg(F.sum("_size").alias("n")).collect()
    few = len(totals) <= BROADCAST_PATTERNS
    made = plan({tuple(r["_pattern"]): r["n"] for r in totals}, weigh, share, repeats)
    schema = "_pattern array<string>, _passes long, _left long, " + ", ".join(f"_b{i} int" for i in range(LEVELS))
    state = {p: [made.taken[p] // n if n else 0, made.taken[p] % n if n else 0] for p, n in made.capacity.items()}
    for level in range(LEVELS):
        at = spark.createDataFrame([(list(p), *s, *[None] * (LEVELS - level)) for p, s in state.items()], schema)
        inside = _with(rows, at, few)
        for i in range(level):
            inside = inside.filter(_bucket(i) == F.col(f"_b{i}"))
        sums = inside.groupBy("_pattern", "_left", _bucket(level).alias("b")).agg(F.sum("_size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_pattern").orderBy("b"))
        first = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("_left")).groupBy("_pattern").agg(F.min(F.struct("b", (F.col("_left") - F.col("upto") + F.col("n")).alias("left"))).alias("x"))
        found = {tuple(r["_pattern"]): (r["x"]["b"], r["x"]["left"]) for r in first.collect()}
        state = {p: [s[0], found[p][1] if p in found else 0, *s[2:], found[p][0] if p in found else 0] for p, s in state.items()}
    return made, spark.createDataFrame([(list(p), *s) for p, s in state.items()], schema)


def _with(rows: DataFrame, patterns: DataFrame, few: bool) -> DataFrame:
    """Join by pattern; array elements may be null, which equality of arrays takes as equal."""
    return rows.join(F.broadcast(patterns) if few else patterns, "_pattern", "left")


def _taken(rows: DataFrame, at: DataFrame, few: bool) -> DataFrame:
    """rows with _taken; only the few in a pattern's last bucket of the last level are ordered one by one."""
    rows = _with(rows, at, few)
    last, before = F.lit(True), F.lit(False)
    for i in range(LEVELS):
        before = before | (last & (_bucket(i) < F.col(f"_b{i}")))
        last = last & (_bucket(i) == F.col(f"_b{i}"))
    whole = F.col("_passes") * F.col("_size")
    clear = rows.filter(~last).withColumn("_taken", whole + F.when(before, F.col("_size")).otherwise(0))
    order = Window.partitionBy("_pattern").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("_size").over(order), F.lit(0))
    edge = rows.filter(last).withColumn("_taken", whole + F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - used)))
    return clear.unionByName(edge).drop("_passes", "_left", *[f"_b{i}" for i in range(LEVELS)])


def mix(docs: DataFrame, weigh: Callable[[list[Source]], Sequence[float]], *, share: float = 1.5, repeats: int = 2, seed: int = 17,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> tuple[Plan, DataFrame]:
    """The plan, and row (a struct of the columns keep, all if None), size, pattern and taken (words, repeats counted).

    source is a string or an array of strings. Sizes are written once to the shared folder and all counting reads
    them. Jobs run when this is called, and the driver holds one entry for each pattern and membership. No group of rows is gathered but the last bucket of each pattern, about a millionth of its documents. The
    document at the edge is taken in part, so patterns give what the flow asks to the word. Defined cases: a null text
    has size 0 and is taken 0 times; null and empty sources are one source, null; repeated rows count and are taken
    each; ties of the hash go by size; an empty table gives an empty plan and no rows; other columns stay in row.
    """
    ship(docs.sparkSession)
    slim = keep == [doc_id]
    sizes = written(sized(docs, seed, [doc_id], doc_id, text, source), "mix")
    made, at = _planned(sizes, weigh, share, repeats)
    rows = sizes if slim else sized(docs, seed, keep, doc_id, text, source)
    return made, _taken(rows, at, len(made.capacity) <= BROADCAST_PATTERNS).select("row", F.col("_size").alias("size"), F.col("_pattern").alias("pattern"), F.col("_taken").alias("taken"))


def in_turn(*weights: float) -> Callable[[list[Source]], list[float]]:
    """Weights that repeat along the ordered sources."""
    return lambda sources: [weights[i % len(weights)] for i in range(len(sources))]
