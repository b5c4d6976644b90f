"""From ranked evidence to a prompt, an answer and a grade."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scoring import judged
from sparkloom.functions.text import snippet
from sparkloom.operators.ranking import of_hits
from sparkloom.session import materialise

NOTHING_FOUND = "No relevant documentation excerpts were found."
NO_EVIDENCE = "No evidence provided."


def citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, rank, chunk_id, score) with their chunk's texts and a snippet; a missing chunk leaves nulls."""
    keep = [c for c in ("doc_id", "doc_title", "section_title", "section_level", "source_url", "content") if c in chunks.columns]
    hits = materialise(hits, "cited")
    return hits.join(of_hits(hits, chunks.select("chunk_id", *keep)), "chunk_id", "left").withColumn("content_snippet", snippet("content"))


def contexts(questions: DataFrame, cited: DataFrame) -> DataFrame:
    """query_id and context: the excerpts in order, each under its number, document and section; a fixed sentence if there are none."""
    head = F.format_string("[Source %d] (Document: %s | Section: %s)\n%s", "rank", F.coalesce("doc_title", F.lit("")), F.coalesce("section_title", F.lit("")), F.coalesce("content", F.lit("")))
    blocks = cited.withColumn("block", head).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"))
    return questions.select("query_id").join(blocks, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), F.trim(question), F.lit("\n\nAnswer:"))


def evidence_text(snippets: Column) -> Column:
    """Numbered snippets of an array for a judge; a fixed sentence if there are none."""
    numbered = F.transform(snippets, lambda s, i: F.concat(F.lit("[Evidence Snippet "), (i + 1).cast("string"), F.lit("]\n"), F.trim(s)))
    return F.when(F.coalesce(F.size(snippets), F.lit(0)) <= 0, NO_EVIDENCE).otherwise(F.array_join(numbered, "\n\n"))


class Provider(Protocol):
    """A language model: prompts to answers, batch by batch, on the executors."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class FixedAnswer:
    """A stand-in that answers with one text, or with what a function makes of the prompt."""

    def __init__(self, answer: str = "This is a fixed answer.", make: Callable[[str], str] | None = None):
        self.answer, self.make = answer, make
        #: The prompts that this copy was called with; executors have copies of their own.
        self.calls: list[str] = []

    def __call__(self, prompts: list[str]) -> list[str]:
        self.calls += prompts
        return [self.make(p) if self.make else self.answer for p in prompts]


class ChatProvider:
    """A chat endpoint in the common completions format, called over HTTPS with bounded retries.

    429 and 5xx are tried again after the server's or a doubling delay; a spent daily quota is not. `send(url, headers, body)` gives
    (status, headers, text) and can be replaced, as in tests without a network.
    """

    def __init__(self, url: str, key: str, model: str, retries: int = 3, base: float = 2.0, most: float = 60.0, timeout: float = 60.0, temperature: float = 0.0, send: Callable | None = None, sleep: Callable[[float], None] | None = None):
        if min(retries, base, most) < 0:
            raise ValueError("retries and delays must not be negative")
        if not key:
            raise ValueError("an API key is needed")
        import time

        self.url, self.key, self.model, self.temperature = url.rstrip("/"), key, model, temperature
        self.retries, self.base, self.most, self.timeout = retries, base, most, timeout
        self.send, self.sleep = send or self._send, sleep or time.sleep

    def request(self, text: str) -> tuple[str, dict, dict]:
        """URL, headers and body of a call."""
        return f"{self.url}/chat/completions", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": text}]}

    @staticmethod
    def answer(data: dict) -> str:
        return data["choices"][0]["message"]["content"] or ""

    def _send(self, url: str, headers: dict, body: dict) -> tuple[int, Mapping[str, str], str]:
        import json
        import urllib.error
        import urllib.request

        call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as got:
                return got.status, dict(got.headers), got.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read().decode(errors="replace")
        except urllib.error.URLError as e:
            return 599, {}, str(e.reason)

    def delay(self, headers: Mapping[str, str], text: str, attempt: int) -> float:
        import re

        told = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
        hint = re.search(r"try again in (\d+(?:\.\d+)?)\s*s", text, re.I)
        try:
            wait = float(told)
        except ValueError:
            wait = 0.0
        if not wait > 0:
            wait = float(hint[1]) + 0.5 if hint else self.base * 2**attempt
        return min(wait, self.most)

    def ask(self, text: str) -> str:
        import json

        why = ""
        for attempt in range(self.retries + 1):
            status, headers, body = self.send(*self.request(text))
            if status == 200:
                if (out := self.answer(json.loads(body))).strip():
                    return out
                why = "blank answer"
            elif status == 429 and ("tokens per day" in body.lower() or "(tpd)" in body.lower()):
                raise RuntimeError(f"daily quota spent: {body[:200]}")
            elif status == 429 or status >= 500:
                why = f"status {status}"
            else:
                raise RuntimeError(f"status {status}: {body[:200]}")
            if attempt < self.retries:
                self.sleep(self.delay(headers, body, attempt))
        raise RuntimeError(f"no answer after {self.retries + 1} calls: {why}")

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.ask(p) for p in prompts]


class GenerateContentProvider(ChatProvider):
    """An endpoint in the generateContent format."""

    def request(self, text: str) -> tuple[str, dict, dict]:
        return f"{self.url}/models/{self.model}:generateContent", {"x-goog-api-key": self.key}, {"contents": [{"role": "user", "parts": [{"text": text}]}], "generationConfig": {"temperature": self.temperature}}

    @staticmethod
    def answer(data: dict) -> str:
        return "".join(p.get("text", "") for p in data["candidates"][0]["content"]["parts"])


PROVIDERS: dict[str, Callable[..., Provider]] = {"mock": FixedAnswer, "openai": ChatProvider, "gemini": GenerateContentProvider}


def provider(name: str, **options) -> Provider:
    if name.strip().lower() not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[name.strip().lower()](**options)


def generate(prompts: DataFrame, model: Provider) -> DataFrame:
    """prompts (query_id, prompt) with answer, error, and token counts by white space. A prompt that fails doesn't stop the others."""
    kind = prompts.schema["query_id"].dataType.simpleString()

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return model([text])[0], None
        except Exception as e:  # the failure is the row's result
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [one(t) for t in texts]
            used = [(len(t.split()), len((a or "").split())) for t, (a, _) in zip(texts, got)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string()), pa.array([p for p, _ in used], pa.int64()), pa.array([c for _, c in used], pa.int64())],
                names=["query_id", "answer", "error", "prompt_tokens", "completion_tokens"],
            )

    out = prompts.select("query_id", "prompt").mapInArrow(run, f"query_id {kind}, answer string, error string, prompt_tokens long, completion_tokens long")
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def judge_prompt(question: Column, reference: Column, evidence: Column, answer: Column) -> Column:
    return F.concat(
        F.lit("Grade the answer from 0 to 4 for correctness against the reference, faithfulness to the evidence and relevance to the question. Reply with one JSON object with the keys correctness, faithfulness, relevance and reason.\n\n[QUESTION]\n"),
        F.trim(question),
        F.lit("\n\n[REFERENCE]\n"),
        F.trim(reference),
        F.lit("\n\n[EVIDENCE]\n"),
        evidence,
        F.lit("\n\n[ANSWER]\n"),
        F.trim(answer),
    )


TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def judge(answers: DataFrame, model: Provider) -> DataFrame:
    """answers (query_id, question, reference, evidence, answer) with scores, a struct, and the judge's tokens; a blank answer is not sent and
    has zeros and no tokens."""
    blank = F.coalesce(F.trim("answer"), F.lit("")) == ""
    asked = answers.where(~blank).withColumn("prompt", judge_prompt(*(F.col(c) for c in ("question", "reference", "evidence", "answer"))))
    replies = generate(asked, model).select("query_id", judged(F.coalesce("answer", F.lit(""))).alias("scores"), *(F.col(c).alias(f"judge_{c}") for c in TOKENS))
    zero = F.lit(0.0)
    none = F.struct(zero.alias("correctness"), zero.alias("faithfulness"), zero.alias("relevance"), zero.alias("overall"), F.lit("Blank answer.").alias("reason"))
    return answers.join(replies, "query_id", "left").withColumn("scores", F.coalesce("scores", none))
