"""Filter interaction audit by decision diagrams (operator 13).

Each document gets a mask of the filters that it fails; per part (source) the
masks are counted, so at most ``2**filters`` rows of a part leave the
distributed work.  From these a decision diagram is built whose nodes hold the
number of documents below them (all, good ones, toxic ones): a node tests one
filter, its low child stands for the documents that pass, its high child for
those that fail; equal subdiagrams are shared and an empty one is a single node.

All orders of the filters are visited one adjacent level swap after the other.  A
swap rewrites the nodes of the upper level in place and makes the lower level
anew; the rest of the diagram stays.  In any order the path of low edges from
the root is the way of the documents that pass everything: the node's high
child is what the step removes, its low child what it keeps.  The root's high
child counts all that fail the first filter, the last node's high child those
that fail only the last one.

A copy is known by (text digest, id): each digest's smallest id is found by a
grouped minimum, and a row fails filter E if it isn't that row.  The join back is
on digest *and* id, so a group of copies of any size has no hot key.

Defined results
* a null text is empty; a null source is the part ``''``, as an empty one is;
* a null id is neither smaller nor larger than another: such a row does not fail
  E, makes no other row fail it, and has no label;
* rows that repeat id and text don't fail E for each other;
* of several labels of one id, one with quality (toxic) 1 is enough;
* an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import staged, text_or_empty, words_of

LETTERS = "ABCDE"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


# ---------------------------------------------------------------- the diagram


class Node:
    """Documents (all, good, toxic) under a node, and its two children."""

    __slots__ = ("weight", "low", "high")

    def __init__(self, weight, low=None, high=None):
        self.weight = weight
        self.low = low or self  # terminals and the empty node are their own children
        self.high = high or self


class Diagram:
    """Count-weighted decision diagram over ``n`` filters; filter k is bit k."""

    def __init__(self, counts: dict[int, tuple[int, ...]], n: int):
        width = len(next(iter(counts.values()), (0,)))
        self.empty = Node((0,) * width)
        self.order = list(range(n))
        self.levels: list[dict] = [{} for _ in range(n)]
        ends: dict = {}
        self.root = self._build(dict(counts), 0, ends)

    def _build(self, counts, level, ends) -> Node:
        if not counts:
            return self.empty
        if level == len(self.order):
            (weight,) = counts.values()
            return ends.setdefault(weight, Node(weight))
        bit = 1 << level
        low = self._build({m: w for m, w in counts.items() if not m & bit}, level + 1, ends)
        high = self._build({m: w for m, w in counts.items() if m & bit}, level + 1, ends)
        return self._shared(self.levels[level], low, high)

    def _shared(self, level: dict, low: Node, high: Node) -> Node:
        if low is self.empty and high is self.empty:
            return self.empty
        key = (id(low), id(high))
        if key not in level:
            level[key] = Node(tuple(map(sum, zip(low.weight, high.weight, strict=True))), low, high)
        return level[key]

    def swap(self, k: int) -> None:
        """Exchange the filters of levels ``k`` and ``k + 1``."""
        below: dict = {}
        upper = list(self.levels[k].values())
        for node in upper:
            passed, failed = node.low, node.high
            node.low = self._shared(below, passed.low, failed.low)
            node.high = self._shared(below, passed.high, failed.high)
        self.levels[k] = {(id(node.low), id(node.high)): node for node in upper}
        self.levels[k + 1] = below
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def path(self) -> list[Node]:
        """The nodes met by documents that pass all filters so far."""
        nodes, node = [], self.root
        for _ in self.order:
            nodes.append(node)
            node = node.low
        return nodes


def adjacent_swaps(n: int):
    """Levels to swap, one after the other, to visit every order of ``n`` once:
    the largest element moves through each order of the others, to and fro."""
    if n < 2:
        return
    down = True
    for inner in [*adjacent_swaps(n - 1), None]:
        yield from (reversed(range(n - 1)) if down else range(n - 1))
        if inner is not None:
            yield inner + (1 if down else 0)
        down = not down


def audit_rows(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of all orders of ``letters`` for one part's masks."""
    diagram = Diagram(counts, len(letters))
    seen, fails, alone, shapley = [], {}, {}, dict.fromkeys(range(len(letters)), 0)

    def visit():
        name = "".join(letters[f] for f in diagram.order)
        path = diagram.path()
        fails[diagram.order[0]] = path[0].high.weight[0]
        alone[diagram.order[-1]] = path[-1].high.weight[0]
        for step, (f, node) in enumerate(zip(diagram.order, path, strict=True), 1):
            removed, good, toxic = node.high.weight
            shapley[f] += removed
            seen.append((name, step, f, node.low.weight[0], removed, good, toxic))

    visit()
    for k in adjacent_swaps(len(letters)):
        diagram.swap(k)
        visit()
    return [(name, step, kept, removed, fails[f] - removed, alone[f], good, toxic, shapley[f])
            for name, step, f, kept, removed, good, toxic in seen]


# ---------------------------------------------------------------- on Spark


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, mask (bit k: fails filter k of LETTERS), good, toxic."""
    text = text_or_empty()
    # The five filters of the contract.
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_t"))
    d = d.withColumn("_w", words_of(F.col("_t")))
    n, different = F.size("_w"), F.size(F.array_distinct("_w"))
    capitals = F.char_length(F.regexp_replace("_t", "[^A-Z]+", ""))
    own = [n < 200, 100 * different < 50 * n,
           100 * capitals.cast("long") > 2 * F.char_length("_t").cast("long"),
           F.col("_t").rlike(r"[#$%&*|]")]
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(own)), F.lit(0))
    rows = staged(d.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"),
                           mask.alias("mask")), "audit-rows")  # one scan of the texts
    firsts = (rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("first", F.lit(True)))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = (labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
             .agg(one("quality").alias("good"), one("toxic").alias("toxic")))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
            .select("part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"),
                    F.coalesce("toxic", F.lit(0)).alias("toxic")))


def audited(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """All orders and steps per part, from rows (part, mask, good, toxic)."""
    counts = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def run(part: pd.DataFrame) -> pd.DataFrame:  # at most 2 ** len(letters) rows
        found = {int(m): (int(n), int(g), int(t))
                 for m, n, g, t in zip(part["mask"], part["n"], part["good"], part["toxic"], strict=True)}
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out = pd.DataFrame(audit_rows(found, letters), columns=names[1:])
        out.insert(0, "part", part["part"].iloc[0])
        return out.astype({"step": np.int32})

    return counts.groupBy("part").applyInPandas(run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, per part of ``docs``."""
    return audited(failure_masks(docs, labels))
