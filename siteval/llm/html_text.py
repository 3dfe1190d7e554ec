"""Main text of web pages by boosted trees over DOM elements.

Elements are described by depth, siblings, density of text and links below
them, and words of their tags and attributes.  Trees are fitted to the elements
of at most ``sample`` pages, chosen by a hash of their id, that mark their
article; the marks on the page are the labels.  Each element's log odds then go
through a decoding over the tree: nothing is kept below a dropped element, and
the sum of the odds is greatest.  Kept text is joined by blocks.

Null and empty pages give an empty text; every page is read whole; rows of null
or repeated ids are kept row by row; without a page to learn from, marks and
link share decide; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm import dom
from siteval.llm.common import map_texts, text_of, written

SAMPLE = 300
TREES, DEPTH = 12, 4
CLIP = 4.0


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> list | None:
    """Trees as nested tuples (feature, threshold, left, right) or numbers."""
    chosen = pages.select(F.col(id_col).alias("_id"), text_of(html_col).alias("_text"))
    ids = chosen.select("_id").where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = chosen.join(F.broadcast(ids), "_id")  # at most ``sample`` ids

    def start():
        def describe(texts):
            xs, ys = [], []
            for t in texts:
                rows = dom.features(dom.parse(t))
                y = dom.taught(rows)
                xs.append([] if y is None else rows[:, dom.SHOWN].ravel().tolist())
                ys.append([] if y is None else y.tolist())
            return [xs, ys]

        return describe

    rows = map_texts(chosen, ["_id"], "_x array<double>, _y array<int>", start)
    k = len(dom.SHOWN)
    rows = rows.select("_x", F.posexplode("_y").alias("i", "_label"))
    rows = rows.select(F.col("_label").cast("double").alias("label"), F.slice("_x", F.col("i") * k + 1, F.lit(k)).alias("_x"))
    rows = written(rows.select("label", array_to_vector("_x").alias("features")), "page-elements")
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(rows)
    return plain_trees(model)


def plain_trees(model: GBTClassificationModel) -> list:
    def walk(node):
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return (int(split.featureIndex()), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return [(float(w), walk(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]


def _tree_values(tree, x: np.ndarray, at: np.ndarray, out: np.ndarray, weight: float) -> None:
    if not isinstance(tree, tuple):
        out[at] += weight * tree
        return
    f, threshold, left, right = tree
    low = x[at, f] <= threshold
    _tree_values(left, x, at[low], out, weight)
    _tree_values(right, x, at[~low], out, weight)


def log_odds(trees: list | None, rows: np.ndarray) -> np.ndarray:
    if trees is None:
        c = dom.COLUMN
        bad = rows[:, c["surroundings marks"]] + rows[:, c["not shown"]] + (rows[:, c["share of link text"]] > 0.5)
        return np.where(bad > 0, -CLIP, 1.0)
    rows, out = rows[:, dom.SHOWN], np.zeros(len(rows))
    for weight, tree in trees:
        _tree_values(tree, rows, np.arange(len(rows)), out, weight)
    return np.clip(2 * out, -CLIP, CLIP)


def main_text(html: str, trees: list | None) -> str:
    if not html:
        return ""
    page = dom.parse(html)
    return dom.text_of_kept(page, dom.decode(page, log_odds(trees, dom.features(page))))


def main_texts(pages: DataFrame, trees: list | None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col), F.col(url_col), text_of(html_col).alias("_text"))
    made = map_texts(rows, [id_col, url_col], "text string", lambda: lambda texts: [[main_text(t, trees) for t in texts]])
    return made.withColumn("n_chars", F.length("text").cast("long"))
