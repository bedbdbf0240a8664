"""Main text of web pages: leaf blocks labelled by a linear-chain CRF, joined in page order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.html_blocks import leaf_blocks
from scriptorium.llm.html_crf import Model
from scriptorium.llm.html_training import MODEL_FILE


@lru_cache(maxsize=1)
def default_model() -> str:
    """The model trained by ``scriptorium.llm.html_training``, as JSON."""
    return MODEL_FILE.read_text()


@lru_cache(maxsize=2)
def _model(packed: str) -> Model:
    return Model.from_json(packed)


def main_text(html: str, model: Model) -> str:
    """The main blocks of a page, one a line; empty if it has none."""
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, label in zip(blocks, model.decode(blocks)) if label)


def extracted(pages: DataFrame, model_json: str | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Defined cases: a null, empty or tagless html is text without ancestors and judged as such (null and empty: no
    text); a page is parsed whole, in time linear in its length; equal scores count as main text; repeated rows are
    extracted alike; bytes that are not UTF-8 are read as replacement characters; an empty table gives an empty
    result; other columns are not read. The model, a few kilobytes, travels with the plan.
    """
    packed = model_json or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(packed)
        for batch in batches:
            texts = [main_text(h, model) if h else "" for h in batch.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.make_valid_utf8("url").alias("url"), F.make_valid_utf8("html").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
