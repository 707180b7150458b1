"""Embedding of passages by a pluggable client, with the policy for texts that it refuses."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TooLarge(Exception):
    """A client raises it for a batch that is over its limit."""


#: Texts -> [(index, vector)], in any order.
Client = Callable[[list[str]], list[tuple[int, list[float]]]]


def hashing_client(dim: int = 64, limit: int | None = None) -> Callable[[], Client]:
    """A deterministic offline client: words hashed into dim signed places, unit length. limit: characters a call may have."""

    def make() -> Client:
        def embed(texts: list[str]) -> list[tuple[int, list[float]]]:
            if limit is not None and sum(map(len, texts)) > limit:
                raise TooLarge
            out = []
            for i, text in enumerate(texts):
                v = np.zeros(dim)
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1 if h >> 63 else -1
                out.append((i, (v / (np.linalg.norm(v) or 1)).tolist()))
            return out

        return embed

    return make


def null_client(dim: int) -> Callable[[], Client]:
    return lambda: lambda texts: [(i, [0.0] * dim) for i in range(len(texts))]


#: Vector, whether the text was cut, and (type, message) of what the client raised for it.
Embedded = tuple[list[float] | None, bool, tuple[str, str] | None]


def _embed(client: Client, texts: list[str], dim: int) -> list[Embedded]:
    """A batch for which the client raises anything is halved, so that a text that fails fails alone; a text that is too large is cut in half until it is accepted. A text that is refused however short, or that raises anything else, has no vector."""
    try:
        got = [v for _, v in sorted(client(texts), key=lambda x: x[0])]
        if len(got) != len(texts) or any(len(v) != dim for v in got):
            raise ValueError(f"{len(texts)} vectors of {dim} were expected")
    except Exception as broken:  # noqa: BLE001  whatever it is, it is this batch's, and the run goes on
        if len(texts) > 1:
            half = len(texts) // 2
            return _embed(client, texts[:half], dim) + _embed(client, texts[half:], dim)
        if not isinstance(broken, TooLarge) or not texts[0]:
            return [(None, False, (type(broken).__name__, str(broken)[:200]))]
        vector, _, error = _embed(client, [texts[0][: len(texts[0]) // 2]], dim)[0]
        return [(vector, error is None, error)]
    return [(v, False, None) for v in got]


class Unavailable(Exception):
    """A client raises it where the same request may succeed later."""


def _patient(client: Client, retries: int, wait: float) -> Client:
    """The client, asked again after growing waits while it is unavailable."""

    def embed(texts: list[str]) -> list[tuple[int, list[float]]]:
        for n in range(retries):
            try:
                return client(texts)
            except Unavailable:
                time.sleep(wait * 2**n)
        return client(texts)

    return embed


def _requests(texts: list[str], count: int, chars: int) -> Iterator[list[str]]:
    """Texts in order, so many a request and no more characters than `chars`, but for a single text."""
    held, size = [], 0
    for text in texts:
        if held and (len(held) == count or size + len(text) > chars):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def overlapped(make_client: Callable[[], Client], texts: list[str], dim: int, batch: int, chars: int, in_flight: int, retries: int, wait: float) -> list[Embedded]:
    """Results in the order of texts, with at most `in_flight` requests at a time; each of its threads has a client of its own."""
    own = threading.local()

    def ask(part: list[str]) -> list[Embedded]:
        if not hasattr(own, "client"):
            own.client = _patient(make_client(), retries, wait)
        return _embed(own.client, part, dim)

    with ThreadPoolExecutor(in_flight) as pool:
        return [x for part in pool.map(ask, _requests(texts, batch, chars)) for x in part]


_ERROR = pa.struct([("type", pa.string()), ("message", pa.string())])


def embed(chunks: DataFrame, make_client: Callable[[], Client], dim: int, model: str, batch: int = 32, chars: int = 100_000, in_flight: int = 1, retries: int = 4, wait: float = 0.5) -> DataFrame:
    """chunks with embedding array<float> (null if it failed), truncated, error struct<type, message> (null if it did not) and model.

    A request has at most `batch` texts and about `chars` characters. A task keeps `in_flight` requests going, which pays for clients that wait for a service, and
    takes the results in order; a client that is Unavailable is asked again `retries` times.
    """
    schema = f"chunk_id string, embedding array<float>, truncated boolean, error struct<type:string,message:string>, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema if f.name != 'chunk_id')}"
    rest = [c for c in chunks.columns if c != "chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = _patient(make_client(), retries, wait) if in_flight == 1 else None
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            got = [x for part in _requests(texts, batch, chars) for x in _embed(client, part, dim)] if client else overlapped(make_client, texts, dim, batch, chars, in_flight, retries, wait)
            errors = pa.array([e and {"type": e[0], "message": e[1]} for *_, e in got], _ERROR)
            yield pa.RecordBatch.from_arrays([b["chunk_id"], pa.array([v for v, *_ in got], pa.list_(pa.float32())), pa.array([t for _, t, _ in got], pa.bool_()), errors, *(b[c] for c in rest)], ["chunk_id", "embedding", "truncated", "error", *rest])

    return chunks.mapInArrow(run, schema).withColumn("model", F.lit(model))


def check_served(make_client: Callable[[], Client], model: str, dim: int) -> None:
    """Before anything is read or written: what the client serves is what is configured.

    A client may say so by an attribute `served` (model, dimension); else one short text shows the dimension. A client that fails even
    for that is left to fail document by document.
    """
    client = make_client()
    served = getattr(client, "served", None)
    if served is None:
        try:
            served = model, len(client(["."])[0][1])
        except Exception:  # noqa: BLE001
            return
    check_model(served[0], model, served[1], dim)


def check_model(served: str, configured: str, dim: int, expected: int) -> None:
    """Before anything is written: the served model and its dimension are those of the configuration."""
    if served != configured or dim != expected:
        raise ValueError(f"served {served!r} ({dim}), configured {configured!r} ({expected})")
