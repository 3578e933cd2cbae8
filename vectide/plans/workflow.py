"""Workflows of retrieval and generation steps over a table of requests.

A workflow is a list of nodes; run() applies them to all requests at once, each step one DataFrame plan. The encoder and
the generator are functions of columns or tables, so that models can be put in; the built-in ones are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.operators import search
from vectide.operators.search import plain_unions
from vectide.sources.written import written

STOP = "None"


def extractive(prompt: Column) -> Column:
    """The built-in generator: the last twelve words of the prompt."""
    return F.array_join(F.slice(F.split(F.trim(prompt), r"\s+"), -F.least(F.lit(12), F.size(F.split(F.trim(prompt), r"\s+"))), 12), " ")


@dataclass(frozen=True)
class Corpus:
    """Documents with their embeddings: (vec_id, embedding, text). Every retrieval reads `rows`: give a written table (see
    `stored`), or each encodes the documents anew."""

    rows: DataFrame
    encode: Callable[[DataFrame], DataFrame]  # (id, text) -> (id, embedding)
    metric: str = "inner_product"


def stored(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, metric: str = "inner_product") -> Corpus:
    """A corpus whose encoded rows are written once."""
    rows.write.mode("overwrite").parquet(path)
    return Corpus(rows.sparkSession.read.schema(rows.schema).parquet(path), encode, metric)


@dataclass(frozen=True)
class Retrieve:
    """Sets `documents` to the k nearest texts of column `query`."""

    k: int = 1
    query: str = "query"


@dataclass(frozen=True)
class Generate:
    """Sets column `output` to the generator's answer to a prompt made of the row's columns. The answers are written: a
    model is asked once a row, whatever later steps make of its answer."""

    prompt: Callable[[], Column]
    output: str
    generator: Callable[[Column], Column] = extractive


@dataclass(frozen=True)
class SetColumn:
    """Carries state from one step to the next."""

    name: str
    value: Callable[[], Column]


@dataclass(frozen=True)
class Repeat:
    """Runs the nodes up to `rounds` times; rows for which `stop` holds keep their state from then on."""

    nodes: tuple
    rounds: int
    stop: Callable[[], Column] | None = None
    stop_after: int = 0  # the check comes after this many of the nodes


@dataclass(frozen=True)
class Workflow:
    name: str
    nodes: tuple = field(default_factory=tuple)


def _retrieve(requests: DataFrame, node: Retrieve, corpus: Corpus) -> DataFrame:
    asked = corpus.encode(requests.select(F.col("id"), F.col(node.query).alias("text"))).select(F.col("id").alias("q_id"), "embedding")
    hits = search.knn(asked, corpus.rows, node.k, corpus.metric, digits=9)
    texts = hits.join(corpus.rows.select("vec_id", "text"), "vec_id")
    lists = texts.groupBy(F.col("q_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("documents"))
    return requests.drop("documents").join(lists, "id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))


def _apply(requests: DataFrame, nodes: tuple, corpus: Corpus) -> DataFrame:
    for node in nodes:
        if isinstance(node, Retrieve):
            requests = _retrieve(requests, node, corpus)
        elif isinstance(node, Generate):
            requests = written(requests.withColumn(node.output, node.generator(node.prompt())), "generated")
        elif isinstance(node, SetColumn):
            requests = requests.withColumn(node.name, node.value())
        elif isinstance(node, Repeat):
            state = requests.columns
            finished = None
            for _ in range(node.rounds):
                requests = _apply(requests, node.nodes[: node.stop_after], corpus)
                if node.stop is not None:
                    out = requests.where(node.stop())
                    finished = out if finished is None else finished.unionByName(out, allowMissingColumns=True)
                    requests = requests.where(~node.stop())
                requests = _apply(requests, node.nodes[node.stop_after :], corpus)
            requests = requests if finished is None else requests.unionByName(finished, allowMissingColumns=True)
            requests = requests.select(*[c for c in requests.columns if c in state or c in {"documents", "answer", "reasoning", "step", "query"}])
        else:
            raise TypeError(f"no node: {node!r}")
    return requests


def start(requests: DataFrame) -> DataFrame:
    """The state of requests (id, question) before the first step."""
    return requests.select("id", "question", F.col("question").alias("query"), F.array().cast("array<string>").alias("documents"), F.lit("").alias("answer"), F.lit("").alias("reasoning"), F.lit("").alias("step"))


def run(requests: DataFrame, workflow: Workflow, corpus: Corpus) -> DataFrame:
    """(id, workflow, answer) for every request (id, question). State: query, documents, answer, reasoning, step."""
    return _apply(start(requests), workflow.nodes, corpus).select("id", F.lit(workflow.name).alias("workflow"), "answer")


def run_mixed(requests: DataFrame, workflows: dict[str, Workflow], corpus: Corpus) -> DataFrame:
    """Requests (id, question, workflow) of several workflows in one plan."""
    plain_unions(requests.sparkSession)
    parts = [run(requests.where(F.col("workflow") == name), w, corpus) for name, w in workflows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _line(*parts) -> Callable[[], Column]:
    return lambda: F.concat(*[p() if callable(p) else F.lit(p) for p in parts])


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _docs() -> Column:
    return T.references(F.col("documents"))


def sequential(k: int = 1) -> Workflow:
    return Workflow("sequential", (Retrieve(k), Generate(_line("Documents:\n", _docs, "Question: ", _col("question")), "answer")))


def hyde(k: int = 1) -> Workflow:
    return Workflow("hyde", (Generate(_line("Write a passage for: ", _col("question")), "query"), Retrieve(k), Generate(_line("Documents:\n", _docs, "Question: ", _col("question")), "answer")))


def recomp(k: int = 1) -> Workflow:
    return Workflow("recomp", (Retrieve(k), Generate(_line("Summarise for: ", _col("question"), "\n", _docs), "step"), Generate(_line("Summary: ", _col("step"), "\nQuestion: ", _col("question")), "answer")))


def iterative(k: int = 1, rounds: int = 4) -> Workflow:
    """Each round asks with the last generation; the answer is all generations."""
    body = (Retrieve(k), Generate(_line("Documents:\n", _docs, "Question: ", _col("query")), "step"), SetColumn("answer", _line(_col("answer"), _col("step"))), SetColumn("query", _col("step")))
    return Workflow("iterative", (Repeat(body, rounds),))


def multistep(k: int = 1, rounds: int = 3, decompose: Callable[[Column], Column] = extractive) -> Workflow:
    """A sub-question, its documents and answer each round, until the sub-question says there is none."""
    body = (
        Generate(_line("Earlier: ", _col("reasoning"), "\nNext question for: ", _col("question")), "query", decompose),
        Retrieve(k),
        Generate(_line("Documents:\n", _docs, "Question: ", _col("query")), "step"),
        SetColumn("reasoning", _line(_col("reasoning"), _col("query"), " ", _col("step"), "\n")),
        SetColumn("answer", _col("step")),
    )
    return Workflow("multistep", (Repeat(body, rounds, lambda: F.contains(F.col("query"), F.lit(STOP)), 1),))
