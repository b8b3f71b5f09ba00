"""Inference as a map over partitions, behind a provider.

No model is shipped. ``HttpProvider`` talks to a chat-completion service;
``EchoProvider`` is a deterministic stub for tests and is labelled as such in
its output.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import qaparse
from folioframe.functions import text as tx
from folioframe.operators.regions import crop_verdict
from folioframe.operators.rows import merged_results, pending
from folioframe.plans.staging import stage


class Provider(Protocol):
    def load(self) -> None:
        """Called once per task, before any batch."""

    def predict(self, prompts: list[str], images: list[list[str]]) -> list[str]:
        """One output per prompt."""


class EchoProvider:
    """Stub: gives back the start of the prompt."""

    def __init__(self, width: int = 40):
        self.width = width

    def load(self) -> None:
        pass

    def predict(self, prompts: list[str], images: list[list[str]]) -> list[str]:
        return [f"[stub] {p[: self.width]}" for p in prompts]


class HttpProvider:
    """A chat-completion service: one request per prompt, images as URLs or data URLs.

    The key is read on the worker from the environment variable ``key_env``, so it
    is part of no plan. A request is tried ``tries`` times; then its row gets the error.
    """

    def __init__(self, url: str, model: str, key_env: str | None = None, temperature: float = 0.0, top_p: float = 1.0,
                 max_tokens: int | None = None, tries: int = 2, wait: float = 0.5, timeout: float = 120.0):
        self.url, self.key_env, self.tries, self.wait, self.timeout = url.rstrip("/") + "/chat/completions", key_env, tries, wait, timeout
        self.settings = {"model": model, "temperature": temperature, "top_p": top_p} | ({} if max_tokens is None else {"max_tokens": max_tokens})
        self.headers = {"Content-Type": "application/json"}

    def load(self) -> None:
        if self.key_env is not None:
            key = os.environ.get(self.key_env)
            if not key:
                raise EnvironmentError(f"the environment variable {self.key_env} is not set")
            self.headers = {**self.headers, "Authorization": f"Bearer {key}"}

    def _ask(self, prompt: str, images: list[str]) -> str:
        content: object = prompt
        if images:
            content = [*[{"type": "image_url", "image_url": {"url": u}} for u in images], {"type": "text", "text": prompt}]
        body = json.dumps({**self.settings, "messages": [{"role": "user", "content": content}]}).encode("utf-8")
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, self.headers), timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"] or ""
            except Exception:
                if not left:
                    raise
                time.sleep(self.wait)
        raise AssertionError

    def predict(self, prompts: list[str], images: list[list[str]]) -> list[str]:
        return [self._ask(p, i) for p, i in zip(prompts, images)]


def _outputs(provider: Provider, prompts: list[str], images: list[list[str]]) -> Iterable[tuple[str | None, str | None]]:
    """A failing batch is tried item by item; a failing item gives an error."""
    try:
        got = provider.predict(prompts, images)
        if len(got) == len(prompts):
            return [(g, None) for g in got]
    except Exception:  # providers may raise anything
        pass
    out: list[tuple[str | None, str | None]] = []
    for p, i in zip(prompts, images):
        try:
            out.append((provider.predict([p], [i])[0], None))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"[:300]))
    return out


def generate(df: DataFrame, make: Callable[[], Provider], prompt: str, images: str, batch: int = 16) -> DataFrame:
    """Add ``predict`` and ``error`` to every row. One provider per task, ``batch`` prompts at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames):
        provider = make()
        provider.load()
        for b in frames:
            got: list[tuple[str | None, str | None]] = []
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                prompts = [p or "" for p in part[prompt]]
                got += _outputs(provider, prompts, [list(i) if i is not None else [] for i in part[images]])
            yield b.assign(predict=[g[0] for g in got], error=[g[1] for g in got])

    return df.mapInPandas(run, f"{schema}, predict string, error string")


def generate_pairs(df: DataFrame, make: Callable[[], Provider], prompt: str, images: str, batch: int = 16) -> DataFrame:
    """Question-answer generation: ``raw_output`` and parsed ``qas`` per row. Rows whose output is a verdict instead are asked once more."""

    def once(rows: DataFrame) -> DataFrame:
        out = generate(rows, make, prompt, images, batch).withColumnRenamed("predict", "raw_output")
        out = out.withColumn("qas", qaparse.parsed_items(F.col("raw_output")))
        return stage(out.withColumn("retry", (F.size("qas") <= 0) & F.coalesce(tx.looks_like_verdict(F.col("raw_output")), F.lit(False))), "generated-pairs")

    first = once(df)
    again = once(first.filter("retry").select(*df.columns))
    return first.filter("not retry").unionByName(again)


def judge_crops(crops: DataFrame, make: Callable[[], Provider], prompt: str, images: str, batch: int = 16) -> DataFrame:
    """Crops with ``raw_output``, ``keep``, ``type`` and ``error``; a crop without an output has no verdict (null)."""
    out = stage(generate(crops, make, prompt, images, batch).withColumnRenamed("predict", "raw_output"), "judged-crops")
    v = F.when(F.col("raw_output").isNotNull(), crop_verdict(F.col("raw_output")))
    return out.withColumn("__v", v).select(*out.columns, F.col("__v.keep").alias("keep"), F.col("__v.type").alias("type"))


def judge_answers(df: DataFrame, make: Callable[[], Provider], key: str, question: Column, truth: Column, response: Column, batch: int = 16) -> DataFrame:
    """key, judge ('True', 'False' or the raw text; null where the call failed)."""
    asked = df.select(key, tx.judge_prompt(question, truth, response).alias("__prompt"), F.array().cast("array<string>").alias("__images"))
    return generate(asked, make, "__prompt", "__images", batch).select(key, tx.verdict(F.col("predict")).alias("judge"), "error")


def generate_answers(inputs: DataFrame, stored: DataFrame | None, make: Callable[[], Provider], key: str, prompt: str, images: str,
                     order: str = "ord", most_images: int | None = None, batch: int = 16) -> DataFrame:
    """Answers with resume: rows without a stored success are asked, results of the others are kept. One row per key."""
    todo = inputs if stored is None else pending(inputs, stored, key, order)
    sent = F.coalesce(F.col(images), F.array().cast("array<string>"))
    todo = todo.withColumn("num_images", F.size(sent)).withColumn(images, sent if most_images is None else F.slice(sent, 1, most_images))
    fresh = stage(generate(todo.withColumn("num_images_sent", F.size(images)), make, prompt, images, batch), "answers").withColumn(order, F.lit(1 << 62))
    return fresh if stored is None else merged_results(stored, fresh.select(*stored.columns), key, order)
