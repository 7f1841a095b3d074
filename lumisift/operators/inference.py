"""Models as columns: a client is made once for each worker and gets texts or images in Arrow batches.

No model is shipped. StubClient is deterministic, so that everything around a model can be tested;
a real client needs the same methods.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.operators import prompts

DIMENSIONS, TEXT_TOKENS, BATCH_ROWS = 768, 80, 80
#: Inputs and answers that are Python objects at one time: a vector takes 8 bytes a number in Arrow and 32 as a list.
SLICE_ROWS = 256
#: Tokens at most and temperature of each kind of generation.
LIMITS = {"summarize": (1024, 0.6), "assemble": (1500, 0.3), "question_answer": (2048, 0.3), "name_entity": (1024, 0.3), "caption": (1024, None), "short_caption": (512, None), "beam_caption": (32, None), "enrich": (1500, 0.3), "plain": (1024, None)}
#: Our own prompts for the strategies.
STRATEGIES = {
    "summarize": "Summarise the facts of this report:\n{{ article }}",
    "question_answer": "Write questions and answers on the report for a picture that shows: {{ generated_caption }}\n{{ article }}",
    "name_entity": "Name the people, places, organisations and dates in:\n{{ article }}",
    "assemble": "Facts: {{ summary.fact }}\nPicture: {{ generated_caption }}\nCaption found: {{ crawl_caption }}\nNames: {{ name_entity_keyword }}\nQuestions: {{ question_answer }}\nWrite one caption.",
    "enrich": "Picture: {{ generated_caption }}\nContext: {{ context }}\nWrite a fuller caption.",
    "enrich_2": "Context: {{ context }}\nNames: {{ name_entity_keyword }}\nPicture: {{ generated_caption }}\nRewrite the caption with both.",
    "provided_context": "Use only this context: {{ context }}\nCaption: {{ generated_caption }}",
}


class Client(Protocol):
    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...
    def embed_images(self, images: list[bytes]) -> list[list[float]]: ...
    def generate(self, prompts: list[str], max_tokens: int, temperature: float | None) -> list[str]: ...
    def caption(self, images: list[bytes], max_tokens: int) -> list[str]: ...
    def chat(self, messages: list[list[tuple[str, str]]], max_tokens: int, temperature: float | None) -> list[str]: ...


class StubClient:
    """Vectors and texts from MD5 hashes of the input, so that SQL can say the same."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def _vector(self, data: bytes) -> list[float]:
        seed = int(hashlib.md5(data).hexdigest()[:7], 16)
        v = (seed * np.arange(1, self.dimensions + 1) % 9973) / 9973 - 0.5
        return (v / np.linalg.norm(v)).tolist()

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(" ".join(t.split()[:TEXT_TOKENS]).encode()) for t in texts]

    def embed_images(self, images: list[bytes]) -> list[list[float]]:
        return [self._vector(i) for i in images]

    def generate(self, prompts: list[str], max_tokens: int, temperature: float | None) -> list[str]:
        return [" ".join(f"{hashlib.md5(p.encode()).hexdigest()[:8]} {' '.join(p.split())}".split()[:max_tokens]) for p in prompts]

    def caption(self, images: list[bytes], max_tokens: int) -> list[str]:
        return [f"image {hashlib.md5(i).hexdigest()[:8]}" for i in images]

    def chat(self, messages: list[list[tuple[str, str]]], max_tokens: int, temperature: float | None) -> list[str]:
        """An answer to each conversation of (role, text) turns."""
        return self.generate(["\n".join(f"{role}: {text}" for role, text in m) for m in messages], max_tokens, temperature)


def _each(kind: str, make: Callable[[], Client], call: Callable[[Client, list], list], failed):
    """A column function; inputs that are null, or on which the client fails, give `failed`."""

    kinds = {"string": pa.string(), "array<double>": pa.list_(pa.float64())}

    def answers(client: Client, batch: pa.Array) -> pa.Array:
        texts = batch.to_pylist()
        known = [i for i, x in enumerate(texts) if x is not None]
        out: list = [failed] * len(texts)
        try:
            found = call(client, [texts[i] for i in known])
        except Exception:  # noqa: BLE001  one by one, so that one bad input costs itself only
            found = []
            for i in known:
                try:
                    found += call(client, [texts[i]])
                except Exception:  # noqa: BLE001
                    found.append(failed)
        for i, x in zip(known, found, strict=True):
            out[i] = x
        return pa.array(out, kinds[kind])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = make()
        for batch in batches:
            parts = [answers(client, batch.slice(at, SLICE_ROWS)) for at in range(0, len(batch), SLICE_ROWS)]
            pa.default_memory_pool().release_unused()
            yield pa.concat_arrays(parts) if parts else pa.array([], kinds[kind])

    return run


def encode_text(c: Column, make: Callable[[], Client] = StubClient) -> Column:
    return _each("array<double>", make, lambda m, x: m.embed_texts(x), None)(c)


def encode_image(c: Column, make: Callable[[], Client] = StubClient) -> Column:
    return _each("array<double>", make, lambda m, x: m.embed_images([bytes(i) for i in x]), None)(c)


def caption(c: Column, kind: str = "caption", make: Callable[[], Client] = StubClient) -> Column:
    most = LIMITS[kind][0]
    return _each("string", make, lambda m, x: m.caption([bytes(i) for i in x], most), "")(c)


def generate(c: Column, kind: str = "plain", make: Callable[[], Client] = StubClient) -> Column:
    most, heat = LIMITS.get(kind, LIMITS["plain"])
    return _each("string", make, lambda m, x: m.generate(list(x), most, heat), "")(c)


def chat(messages: Column, kind: str = "plain", make: Callable[[], Client] = StubClient) -> Column:
    """The next turn of conversations, arrays of (role, text)."""
    most, heat = LIMITS.get(kind, LIMITS["plain"])
    return _each("string", make, lambda m, x: m.chat([[(t["role"], t["text"] or "") for t in turns] for turns in x], most, heat), "")(messages)


class Assembler:
    """All strategies behind one name, with one client for all of them."""

    def __init__(self, make: Callable[[], Client] = StubClient, templates: dict[str, str] | None = None):
        self.make, self.templates = make, templates or STRATEGIES

    def run(self, composed: DataFrame, strategy: str = "assemble") -> DataFrame:
        return run_strategy(composed, strategy, self.make, self.templates)

    def embeddings(self, c: Column) -> Column:
        return encode_text(c, self.make)

    def chat(self, messages: Column) -> Column:
        return chat(messages, make=self.make)


def in_batches(rows: DataFrame, call: Callable[[list], list], column: str, kind: str, size: int = BATCH_ROWS) -> DataFrame:
    """rows with `out`: call gets the column's values in lists of size rows, the last of a task shorter."""
    given = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            while len(held) >= size:
                now, held = held.iloc[:size], held.iloc[size:].reset_index(drop=True)
                yield now.assign(out=call(now[column].tolist()))
        if held is not None and len(held):
            yield held.assign(out=call(held[column].tolist()))

    return rows.select(*given).mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"out {kind}"]))


def run_strategy(composed: DataFrame, strategy: str, make: Callable[[], Client] = StubClient, templates: dict[str, str] = STRATEGIES) -> DataFrame:
    """query_id, strategy, text."""
    if strategy not in templates:
        raise ValueError(f"strategy {strategy} is unknown")
    asked = prompts.rendered(composed, templates[strategy])
    return asked.select("query_id", F.lit(strategy).alias("strategy"), generate(F.col("prompt"), strategy, make).alias("text"))


def caption_candidates(slots: DataFrame, images: DataFrame, make: Callable[[], Client] = StubClient) -> DataFrame:
    """query_id, rank, image_id, caption: slots(query_id, rank, image_id) with short captions of images(image_id, content); '' where captioning fails."""
    return slots.join(images, "image_id", "left").select("query_id", "rank", "image_id", F.coalesce(caption(F.col("content"), "short_caption", make), F.lit("")).alias("caption"))
