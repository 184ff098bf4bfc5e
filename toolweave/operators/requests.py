"""Requests to language-model services: bodies as columns, calls in batches with retries.

A service is any picklable function from a request body to a response text; what
it raises counts as a failed attempt. Nothing here knows an address or a key.
"""

from __future__ import annotations

import json
import math
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Send = Callable[[str], str]


def chat_body(model: str, messages: Column, **settings: float | int | bool) -> Column:
    """The JSON body of a chat request; ``messages`` is an array of (role, content)."""
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), *[F.lit(v).alias(k) for k, v in settings.items()]))


def messages_of(system: Column, user: Column, shots: list[tuple[str, str]] | None = None) -> Column:
    """A system message, where there is one, the exchanges ``shots`` (user, assistant) as examples, and the user's message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    examples = [message(role, F.lit(text)) for shot in shots or [] for role, text in zip(("user", "assistant"), shot, strict=True)]
    whole = F.array(message("system", system), *examples, message("user", F.coalesce(user, F.lit(""))))
    return F.filter(whole, lambda m: (m["role"] != "system") | (F.coalesce(m["content"], F.lit("")) != ""))


def embedding_body(model: str, text: Column) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), text.alias("input")))


def http_post(url: str, headers: dict[str, str], timeout: float = 10.0) -> Send:
    """A service behind an address: posts the body, gives the response's text."""

    def send(body: str) -> str:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read().decode()

    return send


def with_retries(send: Send, attempts: int, delay: float) -> Callable[[str | None], str | None]:
    """``send``, tried again after growing delays; null where there is no body or every attempt fails."""

    def once(body: str | None) -> str | None:
        for k in range(attempts if body is not None else 0):
            try:
                return send(body)
            except Exception:  # whatever a service raises is a failed attempt
                if k + 1 < attempts:
                    time.sleep(delay * 2**k)
        return None

    return once


class Slots:
    """Start times that the tasks of a call share without talking: slots of the wall clock, dealt out in turn.

    Slot ``s`` begins ``s`` gaps after the epoch and belongs to the task numbered
    ``s`` modulo ``tasks``, which uses it once at most. However the tasks are
    scheduled, no more calls start in a minute than it has slots.
    """

    def __init__(self, task: int, tasks: int, per_minute: float):
        self.task, self.tasks, self.gap, self.last, self.lock = task, tasks, 60.0 / per_minute, -1, threading.Lock()

    def following(self, now: float) -> int:
        """The task's first slot that begins at ``now`` or later and is not used."""
        least = max(math.ceil(now / self.gap), self.last + 1)
        return least + (self.task - least) % self.tasks

    def wait(self) -> None:
        with self.lock:
            self.last = self.following(time.time())
            until = self.last * self.gap
        while (left := until - time.time()) > 0:
            time.sleep(left)


def call_service(requests: DataFrame, send: Send, body: str = "body", attempts: int = 5, delay: float = 3.0, threads: int = 8, per_minute: float | None = None) -> DataFrame:
    """``requests`` with ``response``: each batch's bodies go out side by side, order is kept.

    ``per_minute`` is a quota of the whole call, repeated attempts included: the
    rows are dealt over as many tasks as there are cores (and lose their order),
    and each attempt waits for one of its task's ``Slots``. The machines' clocks
    must agree; a task that is tried again sends its bodies again, in later slots.
    """
    names, at = requests.columns, requests.columns.index(body)
    schema = requests.withColumn("response", F.lit(None).cast("string")).schema
    tasks = requests.sparkSession.sparkContext.defaultParallelism if per_minute else 1
    rows = requests.repartition(tasks) if per_minute else requests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(TaskContext.get().partitionId(), tasks, per_minute) if per_minute else None

        def in_time(text: str) -> str:
            if slots:
                slots.wait()
            return send(text)

        once = with_retries(in_time, attempts, delay)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                answers = list(pool.map(once, batch.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*names, "response"])

    return rows.mapInArrow(run, schema)


def service_for(model: str, routes: dict[str, Send]) -> Send:
    """The service of the first route whose name occurs in the model's, in any case."""
    for part, send in routes.items():
        if part.lower() in model.lower():
            return send
    raise KeyError(f"no service for {model}")


def most_free(free: list[float], n: int) -> list[int]:
    """The ``n`` devices with the most free memory, the first of equals."""
    return sorted(range(len(free)), key=lambda k: (-free[k], k))[:n]


def rewrite_requests(queries: DataFrame, template: str, model: str, **settings: float) -> DataFrame:
    """(qid, body): requests that rewrite each query by a template with a ``{query}`` place."""
    prompt = F.replace(F.lit(template), F.lit("{query}"), F.coalesce("query", F.lit("")))
    return queries.select("qid", chat_body(model, messages_of(F.lit(None).cast("string"), prompt), **settings).alias("body"))


def echo(body: str) -> str:
    """A service for tests: answers a chat or an embedding request from the request itself; fails for texts that ask it to."""
    read = json.loads(body)
    text = read["input"] if "input" in read else read["messages"][-1]["content"]
    if "fail" in text:
        raise ConnectionError(text)
    if "input" in read:
        return json.dumps({"data": [{"embedding": [float(len(text)), 1.0]}]})
    return json.dumps({"choices": [{"message": {"content": f"<think>{len(text)}</think>\n\n{text}"}}]}, ensure_ascii=False)
