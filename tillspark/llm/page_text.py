"""The main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.llm.common import Shipped
from tillspark.llm.page_blocks import FEATURES, FIRST_WEIGHTS, Page, features, parse
from tillspark.session import materialize

SAMPLE_PAGES = 2_000
STEPS = 6
PRIOR_BLOCKS = 20.0
# Terminal capacities: what a text may say at most, and what the elements around it say.
TEXT_LIMIT = 3.0
MAIN_GAIN, OUTSIDE_LOSS, ASIDE_LOSS = 4.0, 2.0, 12.0
# Smoothness: between neighbours in the page, and between one block and the next with the same parent.
ADJACENT, SIBLING, CLIMB = 2.0, 1.0, 16


def tree_distance(page: Page, a: int, b: int) -> int:
    """Steps in the DOM from one element to another, CLIMB where they are farther apart."""
    steps = 0
    while a != b and steps < CLIMB:
        if a > b:  # an element comes after those around it
            a = page.parents[a]
        else:
            b = page.parents[b]
        steps += 1
    return steps


def scores(page: Page, weights: np.ndarray) -> list[float]:
    """How far each block pulls towards content (above 0) or boilerplate."""
    if not page.blocks:
        return []
    places = page.places()
    told = np.clip(np.array(features(page)) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    of = [places[b.element] for b in page.blocks]
    outside = OUTSIDE_LOSS if "main" in of else 0.0
    gain = {"main": MAIN_GAIN, "aside": -ASIDE_LOSS, "": -outside}
    return [float(t) + gain[p] for t, p in zip(told, of)]


def edges(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness between blocks: adjacent ones by DOM distance, and the next under one parent."""
    out, latest = [], {}
    for at, block in enumerate(page.blocks):
        up = page.parents[block.element]
        if at:
            distance = tree_distance(page, page.blocks[at - 1].element, block.element)
            out.append((at - 1, at, ADJACENT * 2 / (2 + distance)))
        if up in latest and latest[up] < at - 1:
            out.append((latest[up], at, SIBLING))
        latest[up] = at
    return out


def settle(pull: list[float], links: list[dict[int, float]]) -> list[int]:
    """Labels (1, 0) of the blocks that no cut can gain by turning, -1 for the rest.

    A block whose pull is at least all its edges together keeps its side in
    a smallest cut; its edges then pull its neighbours, here in place.
    """
    label = [-1] * len(pull)
    queue = deque(range(len(pull)))
    while queue:
        at = queue.popleft()
        if label[at] >= 0 or abs(pull[at]) < sum(links[at].values()) or pull[at] == 0 and links[at]:
            continue
        label[at] = int(pull[at] > 0)
        for other, weight in links[at].items():
            pull[other] += weight if label[at] else -weight
            del links[other][at]
            queue.append(other)
    return label


def minimum_cut(pull: list[float], links: list[dict[int, float]], nodes: list[int]) -> set[int]:
    """The nodes on the source side of a smallest cut, by Dinic's maximum flow.

    A positive pull is a capacity from the source, a negative one to the sink.
    """
    place = {n: i + 2 for i, n in enumerate(nodes)}
    graph: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    head: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(head))
        graph[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((there, back))

    for n in nodes:
        if pull[n] > 0:
            add(0, place[n], pull[n], 0.0)
        elif pull[n] < 0:
            add(place[n], 1, -pull[n], 0.0)
        for other, weight in links[n].items():
            if n < other:
                add(place[n], place[other], weight, weight)
    while True:
        level = [-1] * len(graph)
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-12 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[1] < 0:
            return {n for n in nodes if level[place[n]] >= 0}
        tried = [0] * len(graph)
        path: list[int] = []
        at = 0
        while True:
            if at == 1:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                at = head[path[cut] ^ 1]
                del path[cut:]
            while tried[at] < len(graph[at]):
                e = graph[at][tried[at]]
                if room[e] > 1e-12 and level[head[e]] == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(graph[at]):
                path.append(e)
                at = head[e]
            elif at == 0:
                break
            else:
                at = head[path.pop() ^ 1]
                tried[at] += 1


def content_labels(page: Page, weights: np.ndarray) -> list[bool]:
    """For each block, whether the smallest cut leaves it with the content."""
    pull = scores(page, weights)
    links: list[dict[int, float]] = [{} for _ in pull]
    for a, b, weight in edges(page):
        links[a][b] = links[b][a] = weight
    label = settle(pull, links)
    rest = [i for i, x in enumerate(label) if x < 0]
    content = minimum_cut(pull, links, rest) if rest else set()
    return [x == 1 or i in content for i, x in enumerate(label)]


def main_text(html: str | None, weights: np.ndarray) -> str:
    page = parse(html or "")
    return "\n".join(b.text for b, kept in zip(page.blocks, content_labels(page, weights)) if kept)


def labelled_blocks(html: pd.Series) -> list[tuple[list[list[float]], list[int]]]:
    """Features and marks of the blocks whose elements say what they are."""
    out = []
    for text in html:
        page = parse(text or "")
        places = page.places()
        told = [(x, int(places[b.element] == "main")) for x, b in zip(features(page), page.blocks) if places[b.element]]
        out.append(([x for x, _ in told], [m for _, m in told]))
    return out


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the text features, fitted where elements tell content from boilerplate.

    Ridge-penalised logistic regression around FIRST_WEIGHTS by Newton
    steps; each step adds up gradients and curvatures per partition. The
    sample is bounded: the `sample_pages` different pages whose hashes come
    first. Content and boilerplate weigh the same in all.
    """
    hashed = pages.select(F.xxhash64(html_col).alias("at"), F.col(html_col).alias("html")).filter("html <> ''")
    picked = hashed.select("at").distinct().orderBy("at").limit(sample_pages)
    sample = hashed.join(F.broadcast(picked), "at", "left_semi").groupBy("at").agg(F.first("html").alias("html"))

    @F.pandas_udf("x array<array<double>>, y array<int>")
    def blocks(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(labelled_blocks(html), columns=["x", "y"])

    table = materialize(sample.select(blocks("html").alias("b")).select("b.x", "b.y").filter("size(y) > 0"), "blocks")
    ones, total = table.select(
        F.sum(F.aggregate("y", F.lit(0), lambda a, v: a + v)).alias("ones"), F.sum(F.size("y")).alias("total")
    ).first()
    first = np.array(FIRST_WEIGHTS)
    if not ones or ones == total:
        return first
    balance = {1: total / (2 * ones), 0: total / (2 * (total - ones))}
    weights, width = first.copy(), len(FEATURES)
    for _ in range(STEPS):
        now = weights.copy()

        def sums(batches):
            hessian, gradient = np.zeros((width, width)), np.zeros(width)
            for batch in batches:
                for rows, marks in zip(batch["x"], batch["y"]):
                    x = np.stack([np.asarray(r, float) for r in rows])
                    share = np.where(np.asarray(marks) == 1, balance[1], balance[0])
                    p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
                    gradient += x.T @ (share * (np.asarray(marks) - p))
                    hessian += (x * (share * p * (1 - p))[:, None]).T @ x
            yield pd.DataFrame({"h": [hessian.ravel()], "g": [gradient]})

        # One row per partition of a bounded sample.
        parts = table.mapInPandas(sums, "h array<double>, g array<double>").toPandas()
        hessian = np.sum([np.asarray(h) for h in parts["h"]], axis=0).reshape(width, width) + PRIOR_BLOCKS * np.eye(width)
        gradient = np.sum([np.asarray(g) for g in parts["g"]], axis=0) - PRIOR_BLOCKS * (weights - first)
        weights = weights + np.linalg.solve(hessian, gradient)
    return weights


def text_column(spark, weights: np.ndarray, html: Column) -> Column:
    shared = Shipped(spark, weights)

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, shared.value) for p in pages], dtype=object)

    return extract(html)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    A block is the text of one block-level element, white space turned into
    one space and character references decoded. A classifier of its text
    and the elements around it set its capacity to content or boilerplate;
    neighbours in the page and blocks of one parent are joined by edges
    that weigh less with their distance in the DOM; the smallest cut
    decides all blocks of a page together. Scripts, styles and other parts
    that a reader does not see as text are not blocks. Kept blocks are
    joined by a newline in page order.

    Null, empty and blank pages give an empty text. Text without any markup
    is one block. Repeated rows each give a row, null ids and urls stay
    null, an empty table gives an empty result, other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    text = text_column(pages.sparkSession, learn(rows), F.col("html"))
    return rows.select("page_id", "url", text.alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
