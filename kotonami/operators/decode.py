"""The Viterbi kernel: costed nodes and edges of a sentence in, ranked candidates of each clause out."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer candidates than this get compounds; each step follows this many nodes, at most this deep.
FEW, BRANCHES, DEPTH = 5, 3, 4
SCHEMA = "sent_id {kind}, clause_i INT, rank INT, surface STRING, yomi STRING, cost DOUBLE, compound_word BOOLEAN, on_path BOOLEAN"


class Sentence:
    """One lattice: nodes (start, end, surface, yomi, cost) by index, costs of edges by pair of indices."""

    def __init__(self, nodes: list[tuple], edges: dict[tuple[int, int], float], default_edge: float):
        self.nodes, self.edges, self.default = nodes, edges, default_edge
        self.by_end: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(nodes):
            self.by_end[n[1]].append(i)
        self.eos = max(range(len(nodes)), key=lambda i: nodes[i][1])
        self.bos = min(range(len(nodes)), key=lambda i: nodes[i][1])
        self.forward: dict[int, float] = {self.bos: 0.0}
        self.back: dict[int, int] = {}
        for end in sorted(self.by_end):
            for i in self.by_end[end]:
                if i == self.bos:
                    continue
                best = min(((self.forward[p] + self.edge(p, i), k, p) for k, p in enumerate(self.by_end.get(nodes[i][0], ())) if p in self.forward and p != i), default=None)
                if best is not None:  # of equal ones the first
                    self.forward[i], self.back[i] = best[0] + nodes[i][4], best[2]

    def edge(self, a: int, b: int) -> float:
        return self.edges.get((a, b), self.default)

    def path(self) -> list[int]:
        """Node indices between the sentinels; empty where the end can't be reached."""
        if self.eos not in self.back:
            return []
        out, at = [], self.back[self.eos]
        while at != self.bos:
            out.append(at)
            at = self.back[at]
        return out[::-1]

    def clauses(self) -> list[list[tuple[str, str, float, bool, bool]]]:
        """(surface, yomi, cost, compound, on the path) of each clause, cheapest first, compounds last."""
        out = []
        for i in self.path():
            start, end, _, yomi, _ = self.nodes[i]
            strict = [(self.nodes[j][2], self.nodes[j][3], self.forward[j], False, j == i) for j in self.by_end[end] if self.nodes[j][0] == start and j in self.forward]
            strict.sort(key=lambda c: c[2])
            if len(strict) < FEW:
                made = [(s, y, c, True, False) for s, y, c in self.compounds(start, end, yomi)]
                strict += sorted(made, key=lambda c: c[2])
            out.append(strict)
        return out

    def compounds(self, start: int, end: int, yomi: str) -> list[tuple[str, str, float]]:
        """Chains of shorter nodes that fill the span, searched backwards.

        A step's rank is the cost from the head plus that from the tail; the tail's cost counts
        again at every further step.
        """
        found = []
        todo = deque([(end, "", "", 0.0, None, 0)])
        while todo:
            at, surface, read, tail, after, depth = todo.popleft()
            if depth > DEPTH:
                continue
            if len(read) == len(yomi):
                found.append((surface, read, tail))
                continue
            steps = []
            for j in self.by_end.get(at, ()):
                n = self.nodes[j]
                if n[0] >= start and n[3] != yomi and j in self.forward and j not in (self.bos, self.eos):
                    own = tail + n[4] + (self.default if after is None else self.edge(j, after))
                    steps.append((self.forward[j] + own, j, own))
            for _, j, own in heapq.nsmallest(BRANCHES, steps):
                n = self.nodes[j]
                todo.append((at - (n[1] - n[0]), n[2] + surface, n[3] + read, tail + own, j, depth + 1))
        return found


def decode(nodes: DataFrame, edges: DataFrame, default_edge: float) -> DataFrame:
    """Ranked candidates of every clause of every sentence.

    `nodes`: sent_id, node_idx, start_pos, end_pos, surface, yomi, node_cost; `edges`: sent_id,
    prev_idx, node_idx, edge_cost (pairs that are missing cost `default_edge`). A sentence is one
    row while it is decoded: its nodes and edges as arrays, joined once.
    """
    kind = nodes.schema["sent_id"].dataType.simpleString()
    n = nodes.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("node_idx", "start_pos", "end_pos", "surface", "yomi", "node_cost"))).alias("ns"))
    e = edges.groupBy("sent_id").agg(F.collect_list(F.struct("prev_idx", "node_idx", "edge_cost")).alias("es"))

    def run(batches):
        for pdf in batches:
            rows = []
            for sid, ns, es in zip(pdf.sent_id, pdf.ns, pdf.es):
                place = {x["node_idx"]: k for k, x in enumerate(ns)}
                costs = {(place[x["prev_idx"]], place[x["node_idx"]]): x["edge_cost"] for x in (es if es is not None else ())}
                sentence = Sentence([(x["start_pos"], x["end_pos"], x["surface"], x["yomi"], x["node_cost"]) for x in ns], costs, default_edge)
                for c, clause in enumerate(sentence.clauses()):
                    rows += [(sid, c, r, *candidate) for r, candidate in enumerate(clause, 1)]
            yield pd.DataFrame(rows, columns=["sent_id", "clause_i", "rank", "surface", "yomi", "cost", "compound_word", "on_path"])

    return n.join(e, "sent_id", "left").mapInPandas(run, SCHEMA.format(kind=kind))


def best_text(candidates: DataFrame) -> DataFrame:
    """(sent_id, surface): the first candidates of all clauses."""
    first = candidates.where("rank = 1").groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("clause_i", "surface"))).alias("c"))
    return first.select("sent_id", F.array_join(F.transform("c", lambda x: x["surface"]), "").alias("surface"))


def page(candidates: DataFrame, size: int = 10) -> DataFrame:
    """Candidates with the page that shows them."""
    return candidates.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int"))
