"""Main text of web pages by a tree-structured graphical model over their DOM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .dom import EDGES, NAMES, PageParser, features, parse
from .labelled_pages import labelled_pages

TRAINING_PAGES = 600
STEPS = 150


class Forest:
    """The trees of several pages in one set of arrays; a parent comes before its children."""

    def __init__(self, pages: list[PageParser]):
        parents, depths, self.starts = [], [], []
        node_rows, node_columns, edge_rows, edge_columns = [], [], [], []
        for page in pages:
            base = len(parents)
            self.starts.append(base)
            found, edges = features(page)
            for i, node in enumerate(page.nodes):
                parents.append(base + node.parent if node.parent >= 0 else -1)
                depths.append(node.depth)
                node_rows += [base + i] * len(found[i])
                node_columns += found[i]
                edge_rows += [base + i] * len(edges[i])
                edge_columns += edges[i]
        self.parent, depth = np.array(parents, int), np.array(depths, int)
        self.nodes, self.edges = (np.array(node_rows, int), np.array(node_columns, int)), (np.array(edge_rows, int), np.array(edge_columns, int))
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def __len__(self):
        return len(self.parent)


class TreeModel:
    """Node potentials from features, parent-child potentials from edge features; exact marginals."""

    def __init__(self):
        self.node = np.zeros(len(NAMES))
        self.edge = np.zeros((len(EDGES), 2, 2))

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and of every node the joint with its parent's label.

        Sum-product messages go up level by level from the leaves, then down from the roots.
        """
        n = len(forest)
        inward = np.zeros((n, 2))
        rows, columns = forest.nodes
        inward[:, 1] = np.bincount(rows, self.node[columns], n)
        ties = np.zeros((n, 2, 2))
        rows, columns = forest.edges
        for a in (0, 1):
            for b in (0, 1):
                ties[:, a, b] = np.bincount(rows, self.edge[columns, a, b], n)
        up = np.zeros((n, 2))
        for level in reversed(forest.levels[1:]):
            sent = ties[level] + inward[level][:, None, :]
            up[level] = np.logaddexp(sent[..., 0], sent[..., 1])
            np.add.at(inward, forest.parent[level], up[level])
        down = np.zeros((n, 2))
        joint = np.full((n, 2, 2), 0.25)
        for level in forest.levels[1:]:
            above = forest.parent[level]
            rest = inward[above] + down[above] - up[level]
            sent = rest[:, :, None] + ties[level]
            down[level] = np.logaddexp(sent[:, 0], sent[:, 1])
            both = sent + inward[level][:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint[level] = both / both.sum((1, 2), keepdims=True)
        belief = inward + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint

    def train(self, forest: Forest, gold: np.ndarray, steps: int = STEPS, rate: float = 0.1, penalty: float = 1e-4) -> None:
        """Adam on the exact log-likelihood: observed minus expected features of nodes and edges."""
        n = len(forest)
        inner = forest.parent >= 0
        seen = np.zeros((n, 2, 2))
        seen[np.flatnonzero(inner), gold[forest.parent[inner]], gold[inner]] = 1
        moments = [np.zeros_like(x) for x in (self.node, self.node, self.edge, self.edge)]
        rows, columns = forest.nodes
        edge_rows, edge_columns = forest.edges
        for step in range(1, steps + 1):
            p, joint = self.marginals(forest)
            by_node = np.bincount(columns, (gold - p)[rows], len(self.node)) / n - penalty * self.node
            gap = (seen - joint) * inner[:, None, None]
            by_edge = np.zeros_like(self.edge)
            np.add.at(by_edge, edge_columns, gap[edge_rows])
            by_edge = by_edge / n - penalty * self.edge
            for at, (weights, g) in enumerate(((self.node, by_node), (self.edge, by_edge))):
                first, second = moments[2 * at], moments[2 * at + 1]
                first *= 0.9
                first += 0.1 * g
                second *= 0.99
                second += 0.01 * g * g
                weights += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)


def _gold(pages: list[PageParser]) -> np.ndarray:
    return np.array([bool(node.gold) for page in pages for node in page.nodes], int)


@cache
def trained_model(pages: int = TRAINING_PAGES, steps: int = STEPS, seed: int = 11) -> TreeModel:
    """A model fitted to generated labelled pages; a few seconds on the driver, whatever the data."""
    parsed = [parse(html) for html in labelled_pages(pages, seed)]
    model = TreeModel()
    model.train(Forest(parsed), _gold(parsed), steps)
    return model


def extract_texts(model: TreeModel, pages: list[str], threshold: float = 0.5) -> list[str]:
    """The text blocks whose node is content with at least ``threshold``, in page order, one per line."""
    parsed = [parse(html) for html in pages]
    forest = Forest(parsed)
    p, _ = model.marginals(forest)
    return [
        "\n".join(text for at, text in page.blocks if p[start + at] >= threshold)
        for page, start in zip(parsed, forest.starts, strict=True)
    ]


def extract(pages: DataFrame, model: TreeModel, threshold: float = 0.5) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    The whole html is read.  Null and empty html give an empty text.  Repeated rows are read one by
    one; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract_texts(model, [h or "" for h in part.column(2).to_pylist()], threshold)
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7_extraction(spark, folder):
    return extract(table(spark, folder, "pages"), trained_model())
