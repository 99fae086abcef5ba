"""A source for services that give some variables of all units at a time.

The caller gives a function that fetches one request; each pair of vintage and
chunk of variables is an input partition, and chunks are merged by unit.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrapanel.sources.files import merge_chunks, with_absent

#: Variables of one request.
LARGEST_REQUEST = 45

Fetch = Callable[[int, list[str]], list[dict]]


class BadRequest(Exception):
    """The service knows none, or not all, of the variables."""


def variable_chunks(codes: Sequence[str], most: int = LARGEST_REQUEST) -> list[list[str]]:
    return [list(codes[at : at + most]) for at in range(0, len(codes), most)]


def with_retry(call: Callable[[], list[dict]], tries: int = 2, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Again after a failure, each time after twice the wait; what is no use to repeat is raised at once."""
    for n in range(tries):
        try:
            return call()
        except BadRequest:
            raise
        except Exception:
            if n == tries - 1:
                raise
            sleep(wait * 2**n)
    return []


def fetch_chunk(fetch: Fetch, vintage: int, codes: list[str], key: str) -> list[dict]:
    """A chunk; if the service refuses it, each variable by itself, without those that it refuses."""
    try:
        return with_retry(lambda: fetch(vintage, codes))
    except BadRequest:
        merged: dict[str, dict] = {}
        for code in codes:
            try:
                for row in with_retry(lambda c=code: fetch(vintage, [c])):
                    merged.setdefault(row[key], {key: row[key]}).update(row)
            except BadRequest:
                continue
        return list(merged.values())


def read_vintage(spark: SparkSession, fetch: Fetch, vintage: int, codes: Sequence[str], key: str = "geoid") -> DataFrame:
    """All variables of a vintage by unit, as text; variables that the service lacks are NULL."""
    parts = []
    for chunk in variable_chunks(codes):
        fields = pa.schema([(key, pa.string()), *[(c, pa.string()) for c in chunk]])

        def run(batches: Iterator[pa.RecordBatch], chunk=chunk, fields=fields) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                rows = fetch_chunk(fetch, vintage, chunk, key)
                yield pa.RecordBatch.from_pylist([{f: None if r.get(f) is None else str(r[f]) for f in fields.names} for r in rows], fields)

        parts.append(spark.range(1, numPartitions=1).mapInArrow(run, ", ".join(f"`{f}` string" for f in fields.names)))
    return with_absent(merge_chunks(parts, key), codes)
