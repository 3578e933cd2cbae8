"""Workflows as graphs: nodes joined by edges that may carry conditions. All requests move together, one node a round; a
request's next node is the first edge whose condition holds for its row, so loops are edges that lead back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.operators.search import plain_unions
from vectide.plans import workflow
from vectide.sources.written import written

START, END = "START", "END"
#: Graphs by the name that requests ask for.
REGISTRY: dict[str, Graph] = {}


@dataclass
class Graph:
    name: str
    nodes: dict[str, tuple] = field(default_factory=dict)
    edges: list[tuple[str, str, Callable[[], Column] | None]] = field(default_factory=list)

    def add_node(self, name: str, *steps) -> Graph:
        """A node of one or more workflow steps."""
        if name in self.nodes or name in (START, END):
            raise ValueError(f"there is a node {name} already")
        self.nodes[name] = steps
        return self

    def add_edge(self, source: str, target: str, when: Callable[[], Column] | None = None) -> Graph:
        """Edges of one node are tried in the order in which they were added; one without a condition always holds. A
        condition may use column `round`, the number of nodes that the request has passed."""
        self.edges.append((source, target, when))
        return self

    def check(self) -> None:
        """Every edge joins known nodes, and every node and the start have a way on that always holds."""
        known = {START, END, *self.nodes}
        if unknown := {n for s, t, _ in self.edges for n in (s, t)} - known:
            raise ValueError(f"no such nodes: {sorted(unknown)}")
        if stuck := {START, *self.nodes} - {s for s, _, when in self.edges if when is None}:
            raise ValueError(f"no edge always leads on from: {sorted(stuck)}")

    def next_of(self, source: str) -> Column:
        out = [(t, when) for s, t, when in self.edges if s == source]
        return reduce(lambda rest, e: F.lit(e[0]) if e[1] is None else F.when(e[1](), e[0]).otherwise(rest), reversed(out), F.lit(END))


def register(graph: Graph) -> Graph:
    graph.check()
    REGISTRY[graph.name] = graph
    return graph


def run(requests: DataFrame, graph: Graph, corpus: workflow.Corpus, rounds: int = 12) -> DataFrame:
    """(id, workflow, answer, passed) for every request (id, question); passed counts nodes. Requests that have not reached
    the end after `rounds` nodes keep the answer they have. The state is written after each round, so a plan holds one
    round and no node runs twice."""
    graph.check()
    plain_unions(requests.sparkSession)
    state = workflow.start(requests).withColumn("round", F.lit(0))
    names = state.columns
    here = state.withColumn("at", graph.next_of(START))
    reached = {t for s, t, _ in graph.edges if s == START}
    done = [here.where(F.col("at") == END)]
    for _ in range(rounds):
        reached -= {END}
        if not reached:
            break
        moved = []
        for name in sorted(reached):
            out = workflow._apply(here.where(F.col("at") == name).select(*names), graph.nodes[name], corpus).select(*names)
            moved.append(out.withColumn("round", F.col("round") + 1).withColumn("at", graph.next_of(name)))
        here = written(reduce(lambda a, b: a.unionByName(b), moved), "graph-round")
        done.append(here.where(F.col("at") == END))
        reached = {t for s, t, _ in graph.edges if s in reached}
    done.append(here.where(F.col("at") != END))
    every = reduce(lambda a, b: a.unionByName(b), done)
    return every.select("id", F.lit(graph.name).alias("workflow"), "answer", F.col("round").alias("passed"))


def run_registered(requests: DataFrame, corpus: workflow.Corpus, rounds: int = 12) -> DataFrame:
    """Requests (id, question, workflow), each by the registered graph it names."""
    plain_unions(requests.sparkSession)
    return reduce(lambda a, b: a.unionByName(b), [run(requests.where(F.col("workflow") == name), g, corpus, rounds) for name, g in REGISTRY.items()])


def multistep(k: int = 1, rounds: int = 3) -> Graph:
    """The multi-step workflow as a graph: ask, leave if there is no further question, look up, answer, ask again."""
    steps = workflow.multistep(k, 1).nodes[0].nodes
    graph = Graph("multistep_graph").add_node("ask", steps[0]).add_node("answer", *steps[1:])
    graph.add_edge(START, "ask").add_edge("ask", END, lambda: F.contains(F.col("query"), F.lit(workflow.STOP))).add_edge("ask", "answer")
    return graph.add_edge("answer", END, lambda: F.col("round") >= 2 * rounds).add_edge("answer", "ask")
