"""The service surface as plain functions: requests in, dictionaries out (``server`` puts them on HTTP).

``AdmissionGate`` bounds concurrent requests, ``Engine`` keeps an index loaded and answers batches,
``stream`` yields the events of a streamed completion.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.config import Generation
from tessera.operators import conversation, hooks, lifecycle
from tessera.operators import index as I
from tessera.operators import retrieve as R
from tessera.operators import scope as S
from tessera.operators.durable import materialize
from tessera.schema import RETRIEVAL, Retrieval
from tessera.shipping import ship

REQUEST = {"qid": "long", "question": "string", "project": "string", "build": "string", "task": "string", "history": "string", "prior_user": "boolean"}
TEMPLATE = "{{scope_rules}}\n\n{{context}}\n\n{{history}}\n\nQuestion: {{question}}"


class Busy(Exception):
    """No place left; ``retry_after`` says in how many seconds to try again."""

    def __init__(self, retry_after: int):
        super().__init__(f"try again in {retry_after} s")
        self.retry_after = retry_after


class AdmissionGate:
    """At most ``concurrent`` requests run and ``depth`` wait; others are turned away at once."""

    def __init__(self, concurrent: int = 6, depth: int = 12, retry_after: int = 15):
        self.concurrent, self.depth, self.retry_after = concurrent, depth, retry_after
        self._slots, self._lock, self._admitted, self._active = threading.Semaphore(concurrent), threading.Lock(), 0, 0

    @contextmanager
    def admitted(self) -> Iterator[None]:
        with self._lock:
            if self._admitted >= self.concurrent + self.depth:
                raise Busy(self.retry_after)
            self._admitted += 1
        try:
            with self._slots:
                with self._lock:
                    self._active += 1
                try:
                    yield
                finally:
                    with self._lock:
                        self._active -= 1
        finally:
            with self._lock:
                self._admitted -= 1

    def check(self) -> None:
        """Turn a request away before its response begins, if there is no place."""
        with self._lock:
            if self._admitted >= self.concurrent + self.depth:
                raise Busy(self.retry_after)

    def snapshot(self) -> dict[str, int]:
        with self._lock:
            return {"active": self._active, "waiting": self._admitted - self._active, "capacity": self.concurrent + self.depth}


def health() -> dict[str, str]:
    return {"status": "ok"}


def models(name: str = "tessera") -> dict:
    return {"object": "list", "data": [{"id": name, "object": "model"}]}


@dataclass
class Engine:
    """A loaded index and the hooks it answers with."""

    spark: SparkSession
    store: I.Store
    config: Retrieval = RETRIEVAL
    model: hooks.Model = hooks.extractive_model
    template: str = TEMPLATE
    gate: AdmissionGate = field(default_factory=AdmissionGate)
    embedder: hooks.Embedder = hooks.hashing_embedder
    reranker: hooks.Reranker = hooks.lexical_reranker
    generation: Generation = field(default_factory=Generation)
    base_url: str = "http://localhost:8000"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    lexical: I.Lexical | None = None
    timeout: float | None = 300.0

    def load(self) -> None:
        """Take the newest version of the index."""
        ship(self.spark)
        chunks = self.store.load("chunks")
        if chunks is None:
            raise FileNotFoundError(f"no index under {self.store.root}")
        self.lexical = self.store.lexical()
        self.tables = {"chunks": chunks, "catalog": materialize(S.catalog(self.lexical.leads), "catalog", keep=True), "vectors": self.store.load("vectors")}

    def retrieve(self, questions: DataFrame, config: Retrieval | None = None) -> DataFrame:
        """``questions``: (qid, query, project, build).  Dense recall comes first, then sparse."""
        if not self.tables:
            self.load()
        chunks, catalog, config = self.tables["chunks"], self.tables["catalog"], config or self.config
        dense = None
        if self.tables["vectors"] is not None:
            asked = I.unit_vectors(hooks.embedded(questions, "query", self.embedder))
            dense = R.dense_pool(asked, self.tables["vectors"], chunks, self.lexical.leads, catalog, config)
        return R.retrieve(questions, chunks, self.lexical, catalog, config, dense=dense, reranker=self.reranker)

    def query(self, request: dict, timeout: float | None = 300.0, tag: str | None = None) -> dict:
        """Answer one request {question, project?, build?, history?}; past ``timeout`` its jobs, which run
        under ``tag``, are cancelled and a TimeoutError is raised."""
        with self.gate.admitted():
            began, tag, late = time.monotonic(), tag or f"request-{id(request)}", threading.Event()
            self.spark.addTag(tag)
            timer = threading.Timer(timeout, lambda: (late.set(), self.spark.interruptTag(tag))) if timeout and timeout > 0 else None
            if timer:
                timer.start()
            try:
                return self._answer(request) | {"seconds": round(time.monotonic() - began, 3)}
            except Exception as failed:
                if late.is_set():
                    raise TimeoutError(f"no answer within {timeout} s") from failed
                raise
            finally:
                if timer:
                    timer.cancel()
                self.spark.removeTag(tag)

    def answers(self, requests: DataFrame) -> DataFrame:
        """The whole way of ``requests`` (see ``lifecycle.requests``) to answers."""
        if not self.tables:
            self.load()
        return lifecycle.answered(requests, self.retrieve, self.tables["catalog"], self.tables["chunks"], self.model, self.template.replace("{{scope_rules}}", ""), self.generation, self.config, self.base_url, self.config.expand_sections)

    def _answer(self, request: dict) -> dict:
        told = {c: request.get(c) for c in ("project", "build", "task")}
        turns = [t for t in request.get("history") or [] if t.get("role") in ("user", "assistant") and str(t.get("content") or "").strip()] if not isinstance(request.get("history"), str) else []
        told |= {"history": request["history"]} if isinstance(request.get("history"), str) else {}
        row = {"qid": 0, "question": request["question"].strip(), "prior_user": any(t["role"] == "user" for t in turns), **told}
        asked = self.spark.createDataFrame([tuple(row.get(c) for c in REQUEST)], ", ".join(f"{c} {kind}" for c, kind in REQUEST.items()))
        if turns:
            said = self.spark.createDataFrame([(0, i, t["role"], str(t["content"])) for i, t in enumerate(turns)], "conv_id long, turn int, role string, content string")
            recent = conversation.rewrite_history(said, self.generation.history_turns).select(F.col("conv_id").alias("qid"), F.col("history").alias("recent"))
            block = conversation.answer_history(said, said).select(F.col("conv_id").alias("qid"), "history")
            asked = asked.drop("history").join(recent, "qid", "left").join(block, "qid", "left")
        row = self.answers(asked).first()
        return {"answer": row["answer"], "route": row["route"], "insufficient_context": row["insufficient_context"], "citations": [c.asDict() for c in row["citations"] or []]}

    def complete(self, request: dict, tag: str | None = None) -> dict:
        """A chat completion: messages in, one choice out.  Background prompts of a chat client skip
        retrieval and go to the model as they are."""
        last, history = last_message(request)
        if is_auxiliary(last):
            return _completion(self.model([last])[0], [])
        got = self.query({"question": last, "history": history, **{k: request.get(k) for k in ("project", "build", "task")}}, self.timeout, tag)
        return _completion(got["answer"], got["citations"])


def last_message(request: dict) -> tuple[str, list[dict]]:
    """The last user message that is not blank, and the turns before it.  Contents may be texts or lists of
    parts, of which the texts count."""
    messages = request.get("messages")
    if not isinstance(messages, list) or not all(isinstance(m, dict) for m in messages):
        raise ValueError("messages must be a list of objects")
    turns = [{"role": m.get("role"), "content": content_text(m.get("content"))} for m in messages]
    asked = [i for i, t in enumerate(turns) if t["role"] == "user" and t["content"].strip()]
    if not asked:
        raise ValueError("no user message")
    return turns[asked[-1]]["content"], turns[: asked[-1]]


def content_text(content: object) -> str:
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(str(p.get("text") or "") for p in content if isinstance(p, dict) and p.get("type", "text") == "text")
    raise ValueError("content must be a text or a list of parts")


def source_text(spark: SparkSession, mirror_root: str, target_file: str) -> str | None:
    """The processed text of a document, by its label; null if there is none."""
    row = spark.read.parquet(mirror_root).filter(F.col("target_file") == target_file).select("content").first()
    return None if row is None else row["content"]


def asset_file(spark: SparkSession, mirror_root: str, relative: str) -> str | None:
    """Where an asset lies below the mirror; null if it does not exist or leaves the mirror."""
    parts: list[str] = []
    for part in relative.split("/"):
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if not parts:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{mirror_root.rstrip('/')}/{'/'.join(parts)}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.toString() if fs.exists(path) and fs.getFileStatus(path).isFile() else None


def is_auxiliary(content: str) -> bool:
    low = content.strip().lower()
    return low.startswith("### task:") and ("<chat_history>" in low or "### chat history:" in low) and any(m in low for m in X.AUXILIARY)


def _completion(text: str, citations: list[dict]) -> dict:
    return {"object": "chat.completion", "choices": [{"index": 0, "message": {"role": "assistant", "content": text}, "finish_reason": "stop"}], "sources": sources(citations)}


def sources(citations: list[dict]) -> list[dict]:
    out = []
    for i, c in enumerate(citations, 1):
        name = f"[{i}] {(c['source_file'] or '').rsplit('/', 1)[-1] or c['chunk_id']}"
        out.append({"document": [c["excerpt"]], "metadata": [{"source": c["url"], "name": name}], "source": {"name": name, "url": c["url"]}})
    return out


def frame(payload: dict | str) -> str:
    """One server-sent event."""
    return f"data: {payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)}\n\n"


def parse_frame(line: str) -> dict | str | None:
    if not line.startswith("data:"):
        return None
    body = line[5:].strip()
    return body if body == "[DONE]" else json.loads(body)


def status_frame(text: str, done: bool = False) -> str:
    return frame({"event": {"type": "status", "data": {"description": text, "done": done}}})


def stream(answer: str, size: int = 200, status: str | None = None) -> Iterator[str]:
    if status:
        yield status_frame(status)
    for at in range(0, len(answer), size):
        yield frame({"object": "chat.completion.chunk", "choices": [{"index": 0, "delta": {"content": answer[at : at + size]}, "finish_reason": None}]})
    yield frame({"object": "chat.completion.chunk", "choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]})
    yield frame("[DONE]")
