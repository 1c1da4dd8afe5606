"""Main text of web pages: leaf blocks labelled by a bidirectional LSTM over the whole page.

A page's blocks (text between block-level tags) become hashed vectors of their tag path (tags, class, id and role words)
and of their words; the network reads the sequence both ways and gives each block a probability of being main text.
Each block's score is then its logit and, three times as heavy, the mean logit of the blocks that stand in the same elements
(``consensus``): blocks whose wording is odd follow their neighbours. The kept blocks are joined in page order by newlines. Character references are decoded, and white space inside a block
becomes one space.

The weights in ``block_weights.npz`` come from ``train_labeller`` on invented pages; nothing is fitted to a corpus.

Nulls: a null page is empty and has no text; other nulls stay. Whole pages are read: their tags are found in linear time, and
blocks, paths and names are not capped. Repeated rows each give a row; nothing ties. Columns whose names clash stay, except
one named as the result, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blstm
from .common import read_table
from .htmlblocks import PATH_DIM, TAG_DIM, Block, Vectors, blocks
from .pagegen import make_page
from .textbatch import lean

WEIGHTS = "block_weights.npz"
#: Invented pages of the shipped weights: seeds 0 to TRAIN_PAGES - 1, and so many passes over them.
TRAIN_PAGES, EPOCHS = 12000, 8
#: Elements of a padded batch of pages (steps x pages); bounds a worker's memory. A longer page goes alone.
BATCH_STEPS = 4096


def labelled(html: str, main: str) -> tuple[list[Block], np.ndarray]:
    """Blocks with labels, by walking the main text's lines along the page."""
    found, lines = blocks(html), main.split("\n") if main else []
    labels, at = np.zeros(len(found), np.float32), 0
    for i, b in enumerate(found):
        if at < len(lines) and b.text == lines[at]:
            labels[i] = 1
            at += 1
    return found, labels


def train_labeller(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 0) -> dict[str, np.ndarray]:
    vectors, x, y = Vectors(), [], []
    for k in range(pages):
        found, labels = labelled(*make_page(k))
        if found:
            x.append(vectors.page(found))
            if k % 3 == 0:  # where the path tells enough, wording must not matter
                x[-1][:, PATH_DIM + TAG_DIM :] = 0
            y.append(labels)
    return blstm.train(x, y, epochs, seed=seed)


def save_weights(weights: dict, path: str) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in weights.items()})


def load_weights() -> dict[str, np.ndarray]:
    data = files(__package__).joinpath(WEIGHTS).read_bytes()
    return {k: v.astype(np.float32) for k, v in np.load(io.BytesIO(data)).items()}


def label_pages(weights: dict, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities of every page's blocks; pages of similar length share a padded batch."""
    out: list = [np.zeros(0, np.float32)] * len(pages)
    order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= BATCH_STEPS:
            to += 1
        x, lengths = blstm.padded([pages[i] for i in order[at:to]])
        p = blstm.scores(weights, x, lengths)
        for j, i in enumerate(order[at:to]):
            out[i] = p[: lengths[j], j]
        at = to
    return out


def consensus(found: list[Block], p: np.ndarray) -> np.ndarray:
    """Probabilities drawn towards those of the blocks with the same path of block-level elements: alike blocks belong together."""
    logit = np.clip(np.log(np.maximum(p, 1e-6)) - np.log(np.maximum(1 - p, 1e-6)), -6, 6)
    _, which = np.unique([b.group for b in found], return_inverse=True)
    groups = which.max() + 1
    mean = np.bincount(which, logit, groups) / np.bincount(which, minlength=groups)
    return 1 / (1 + np.exp(-(logit + 3 * mean[which]) / 4))


def main_texts(weights: dict, vectors: Vectors, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    keep = label_pages(weights, [vectors.page(b) for b in found])
    return ["\n".join(b.text for b, p in zip(bs, consensus(bs, ps)) if p >= 0.5) if bs else "" for bs, ps in zip(found, keep)]


#: Pages labelled together.
GROUP = 256


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text", weights: dict | None = None) -> DataFrame:
    """``df`` without ``html``, with the main text in ``out``. An existing column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(weights or load_weights())
    keep = [c for c in df.columns if c not in (html, out)]
    cols = [f"__bl_{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, cols)], F.col(html).cast("string").alias("__bl_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                texts = main_texts(shared.value, vectors, [p or "" for p in part.column(len(cols)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(cols))), pa.array(texts, pa.string())], names=[*cols, "__bl_text"])

    schema = rows.drop("__bl_html").withColumn("__bl_text", F.lit("")).schema
    return rows.mapInArrow(lean(run), schema).select(*[F.col(x).alias(c) for c, x in zip(keep, cols)], F.col("__bl_text").alias(out))


def op4_block_labeller(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
