r"""Main text of web pages: gradient-boosted trees over the nodes of the page, then a hierarchical choice.

Each node gets the probabilities of three states from its features (subtree density, attribute tokens, depth, siblings):
all of it is main text, none is, or it holds both. The states of a page are chosen together so that no node contradicts
one above it: below ``main`` all is main, below ``none`` nothing is, and only a node in the third state leaves the choice
to its children. That is a sum over the tree, maximized from the leaves up in time linear in the nodes.

The trees are fitted once in each driver process on ``TRAINING_PAGES`` made-up pages (``page_maker``), a fixed bound, and
travel to the tasks in the closure (well under a megabyte).

Defined cases: null html is empty and has the empty text; markup without text too; broken markup is read as far as it
goes; repeated rows get equal texts; pages of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import filled
from tilewright.llm import boosting, html_tree
from tilewright.llm.page_maker import Maker

TRAINING_PAGES = 700
SEED = 11
NONE, MAIN, BOTH = 0, 1, 2
_NODES_AT_ONCE = 20_000


def true_states(nodes: list[html_tree.Node]) -> np.ndarray:
    """States of a made-up page's nodes from the labels of its runs; -1 for a node without text."""
    has = np.zeros((len(nodes), 2), bool)
    for node in reversed(nodes):
        if node.text:
            has[node.number, int(node.label == "c")] = True
        if node.parent is not None:
            has[node.parent.number] |= has[node.number]
    return np.select([has.all(axis=1), has[:, 1], has[:, 0]], [BOTH, MAIN, NONE], -1)


@cache
def fitted_trees(pages: int = TRAINING_PAGES, seed: int = SEED) -> boosting.BoostedTrees:
    """Trees fitted on made-up pages; the same for equal arguments."""
    maker = Maker(seed)
    rows, states = [], []
    for _ in range(pages):
        nodes = html_tree.nodes_of(html_tree.parse(maker.page()))
        state = true_states(nodes)
        rows.append(html_tree.features(nodes)[state >= 0])
        states.append(state[state >= 0])
    return boosting.fit(np.concatenate(rows), np.concatenate(states), 3)


def decode(nodes: list[html_tree.Node], scores: np.ndarray) -> list[str]:
    """Texts of the nodes in state ``MAIN`` under the best states without contradiction, in page order."""
    n = len(nodes)
    best = scores.copy()
    for node in nodes:
        if node.text:
            best[node.number, BOTH] = -np.inf
    for node in reversed(nodes[1:]):
        k, up = node.number, node.parent.number
        best[up, NONE] += best[k, NONE]
        best[up, MAIN] += best[k, MAIN]
        best[up, BOTH] += best[k].max()
    state = np.zeros(n, np.int64)
    state[0] = BOTH
    for node in nodes[1:]:
        above = state[node.parent.number]
        state[node.number] = best[node.number].argmax() if above == BOTH else above
    return [node.text for node in nodes if node.text and state[node.number] == MAIN]


def extract_texts(sources: list[str], trees: boosting.BoostedTrees) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    pending: list[tuple[list[html_tree.Node], np.ndarray]] = []

    def settle() -> None:
        if not pending:
            return
        scores = trees.log_probabilities(np.concatenate([x for _, x in pending]))
        at = 0
        for nodes, _ in pending:
            out.append("\n\n".join(decode(nodes, scores[at : at + len(nodes)])))
            at += len(nodes)
        pending.clear()

    waiting = 0
    for source in sources:
        nodes = html_tree.nodes_of(html_tree.parse(source))
        pending.append((nodes, html_tree.features(nodes)))
        waiting += len(nodes)
        if waiting >= _NODES_AT_ONCE:
            settle()
            waiting = 0
    settle()
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages(page_id, url, html)``."""
    trees = fitted_trees()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract_texts(part.column("html").to_pylist(), trees)
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", filled(F.col("html")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
