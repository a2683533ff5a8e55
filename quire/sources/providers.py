"""Recognition and metadata services behind a callable that the caller gives. Nothing here opens a connection.

Calls cost money and may be repeated by retries of a task, so results are written by cache key before anything reads them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.session import reachable

# Attempts, and the first wait, which doubles.
ATTEMPTS, FIRST_WAIT = 4, 0.8


class ProviderError(Exception):
    """What a provider raises: an HTTP status, or none where no answer came."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def is_retryable(status: Column | int | None):
    """429 and server errors; of a column or a number. No status (no answer) is worth another attempt too."""
    if isinstance(status, Column):
        return (status == 429) | status.between(500, 599)
    return status is None or status == 429 or 500 <= status <= 599


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
    wait = FIRST_WAIT
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except ProviderError as e:
            if attempt == ATTEMPTS - 1 or not is_retryable(e.status):
                raise
            sleep(wait)
            wait *= 2
    raise AssertionError


def recognised(jobs: DataFrame, provider: Callable[[bytes, dict], str], options: dict | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(cache_key, json, error) for jobs (cache_key, content) that no cache has; equal keys are called once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, content in zip(b["cache_key"], b["content"], strict=True):
                try:
                    rows.append((key, with_retries(lambda c=content: provider(bytes(c), options or {}), sleep), None))
                except ProviderError as e:
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=["cache_key", "json", "error"])

    reachable(jobs.sparkSession)
    return jobs.select("cache_key", "content").dropDuplicates(["cache_key"]).mapInPandas(run, "cache_key string, json string, error string")


def fake(content: bytes, options: dict) -> str:
    """A provider for tests: each form-fed part of the bytes is a page."""
    import json

    return json.dumps({"model": options.get("model", "fake"), "pages": [{"index": i, "markdown": p} for i, p in enumerate(content.decode("utf-8", "replace").split("\f"))]})
