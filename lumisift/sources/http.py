"""Fetching as a stage of its own: rows go through a fetcher in Arrow batches, with retries."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions import text as S

#: Seconds after each failed try but the last, and a try's time limit.
WAITS, LIMIT_S = (1, 3, 5), 20
#: How the library names itself; set another with functools.partial(get, agent=...).
AGENT = "lumisift"
#: Addresses that one task fetches at a time.
AT_ONCE = 16


def get(url: str, agent: str = AGENT) -> tuple[int, bytes]:
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=LIMIT_S) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def fetched(url: str, get: Callable[[str], tuple[int, bytes]] = get, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of a 200; another try after a 429 or a failure, up to three; None otherwise."""
    for left, wait in zip(range(len(WAITS) - 1, -1, -1), WAITS, strict=True):
        try:
            status, body = get(url)
        except OSError:
            status, body = 429, b""
        if status == 200:
            return body
        if status != 429:
            return None
        if left:
            sleep(wait)
    return None


def pages(urls: DataFrame, get: Callable[[str], tuple[int, bytes]] = get, binary: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """urls(key, url) with body: text, or bytes of images, whose addresses are made original first; null where fetching failed. A task fetches at_once addresses side by side."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            with ThreadPoolExecutor(at_once) as pool:
                body = list(pool.map(lambda u: fetched(u, get) if u else None, part["url"]))
            yield part.assign(body=body if binary else [b if b is None else b.decode("utf-8", "replace") for b in body])

    own = urls.select("key", (S.original_image_url("url") if binary else F.col("url")).alias("url"))
    return own.mapInPandas(run, f"key string, url string, body {'binary' if binary else 'string'}")
