"""Models as given functions: encoders, rerankers and labellers, called with batches inside the executors.

A model is named ``module:factory``; the factory is called once in each worker
process and gives the function. So nothing heavy is pickled, and a worker that
is lost costs its batches only.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from groundwell.operators.fusion import rerank
from groundwell.operators.retrieve import candidate_texts

_LOADED: dict[str, Callable] = {}

# Fixed value: what such encoders put before a query's text to tell it from a document's.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def model(name: str) -> Callable:
    """The function that ``module:factory`` makes, once a worker process."""
    if name not in _LOADED:
        module, _, factory = name.partition(":")
        _LOADED[name] = getattr(importlib.import_module(module), factory)()
    return _LOADED[name]


def encode(df: DataFrame, text: str, encoder: str, is_query: bool = False, out: str = "embedding", batch: int = 32, prefix: str = "") -> DataFrame:
    """Adds unit vectors: the encoder is ``f(texts, is_query) -> list of vectors``, called with up to ``batch`` texts; null texts get null.

    ``prefix`` goes before each text of a query, for encoders that know queries by it (``QUERY_PREFIX``).
    """
    cols = df.columns
    kinds = dict(df.dtypes)
    where = cols.index(text)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        f = model(encoder)
        for b in batches:
            texts = b.column(where).to_pylist()
            made: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(some), batch):
                ids = some[at : at + batch]
                v = np.asarray(f([(prefix if is_query else "") + texts[i] for i in ids], is_query), np.float64)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                for i, x in zip(ids, (v / np.where(size == 0, 1.0, size)).astype(np.float32).tolist()):
                    made[i] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], [*cols, out])

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", `{out}` array<float>")


def score_pairs(pairs: DataFrame, scorer: str, note: str = "note", text: str = "text") -> DataFrame:
    """Adds ``score``: the cross-encoder is ``f(list of (note, text)) -> scores``, one call for each Arrow batch."""
    cols, kinds = pairs.columns, dict(pairs.dtypes)
    a, t = cols.index(note), cols.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = model(scorer)
        for b in batches:
            made = f(list(zip(b.column(a).to_pylist(), b.column(t).to_pylist()))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(x) for x in made], pa.float64())], [*cols, "score"])

    return pairs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", score double")


def rerank_fresh(candidates: DataFrame, notes: DataFrame, texts: DataFrame, cached: DataFrame, scorer: str, top_k: int) -> tuple[DataFrame, DataFrame]:
    """Reranked candidates, and the scores that the cache lacks: only those pairs reach the model.

    ``candidates`` has (query_id, doc_id, rank), ``notes`` (query_id, note),
    ``cached`` (query_id, doc_id, score); missing texts are empty.
    """
    missing = candidates.select("query_id", "doc_id").join(cached, ["query_id", "doc_id"], "left_anti")
    pairs = candidate_texts(missing, texts).join(notes.select("query_id", "note"), "query_id")
    fresh = score_pairs(pairs, scorer).select("query_id", "doc_id", "score")
    return rerank(candidates, cached, fresh, top_k), fresh


def label(prompts: DataFrame, labeller: str) -> DataFrame:
    """Adds ``raw, in_tokens, out_tokens, provider_usd, served_model, error`` to rows with ``system, user``.

    The labeller is ``f(system, user) -> dict`` of those names; what it raises
    becomes the row's ``error`` and leaves the other rows alone.
    """
    cols, kinds = prompts.columns, dict(prompts.dtypes)
    sys_at, user_at = cols.index("system"), cols.index("user")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        f = model(labeller)
        for b in batches:
            made = []
            for system, user in zip(b.column(sys_at).to_pylist(), b.column(user_at).to_pylist()):
                try:
                    made.append(f(system, user))
                except Exception as e:  # noqa: BLE001 - told in the row
                    made.append({"error": str(e) or type(e).__name__})
            of = lambda name, kind: pa.array([m.get(name) for m in made], kind)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, of("raw", pa.string()), of("in_tokens", pa.int64()), of("out_tokens", pa.int64()), of("provider_usd", pa.float64()), of("served_model", pa.string()), of("error", pa.string())],
                [*cols, "raw", "in_tokens", "out_tokens", "provider_usd", "served_model", "error"],
            )

    return prompts.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", raw string, in_tokens long, out_tokens long, provider_usd double, served_model string, error string")
