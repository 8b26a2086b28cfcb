"""Main text of web pages: a bidirectional LSTM labels every block in the context of the whole page."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def main_texts(weights: dict, pages: list[str | None], threshold: float = 0.5) -> list[str]:
    import numpy as np

    from groundwell.llm.html_blocks import blocks
    from groundwell.llm.html_lstm import main_text_odds

    found = [blocks(x or "") for x in pages]
    odds = main_text_odds(weights, found)
    least = float(np.log(threshold / (1 - threshold)))
    return ["\n".join(b.text for b, z in zip(x, zs) if z > least) for x, zs in zip(found, odds)]


def handfuls(pages: Iterable[str | None], at_once: int, chars_at_once: int) -> Iterator[list[str | None]]:
    """The pages in order, ``at_once`` together or fewer where they are long; a page that is longer by itself is alone."""
    held, size = [], 0
    for x in pages:
        if held and (len(held) == at_once or size + len(x or "") > chars_at_once):
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x or "")
    if held:
        yield held


def extract_main_text(
    df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = 0.5, at_once: int = 128, chars_at_once: int = 1 << 20
) -> DataFrame:
    """One row per input row: the ``keep`` columns, ``text`` and ``n_chars`` (its code points).

    Blocks labelled main text are joined in page order by a newline; a null,
    empty or wholly boilerplate page gives the empty text. Unclosed and
    misnested tags are mended as browsers do; time and memory grow with a page's
    length, whatever its markup. Repeated rows are pages of their own, an empty
    table gives no rows, and columns not in ``keep`` are dropped.
    """
    from groundwell.llm.html_lstm import load

    weights = load()
    slim = df.select(*keep, F.col(html).alias("__html"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            for pages in handfuls((x.as_py() for x in batch.column(len(keep))), at_once, chars_at_once):
                part = batch.slice(at, len(pages))
                at += len(pages)
                texts = main_texts(weights, pages, threshold)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
