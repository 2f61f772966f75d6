"""The boundary to language and embedding models: prompts out as columns, answers back as typed rows.

A client is any object with ``complete(prompt) -> str`` (or ``embed(texts)``); it is made once for each
partition. The stubs here are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip_fence

FACT = "array<struct<subject:string,predicate:string,object:string,confidence:double,context_sentence:string>>"
PROMPTS = {
    "concept_extractor": "List the facts of the passage below as JSON: an array of objects with subject, predicate, object, confidence, context_sentence.\nLanguage: {language}\n\n{content}",
    "reference_extractor": "List citations, bibliography entries, footnotes and internal references below as JSON: type, text, target.\n\n{content}",
    "decontextualizer": "Rewrite the passage so that it stands alone. Context before it:\n{context}\n\nPassage:\n{content}",
    "summarizer": "Summary so far:\n{summary}\n\nExtend it by this passage:\n{content}",
    "densifier": "Make this summary denser without making it longer:\n{summary}",
    "community_summarizer": "Summarise this group of entities.\nMembers: {members}\nRelations:\n{relations}",
    "profile_generator": "Describe {entity} by these relations:\n{relations}",
    "synthesizer": "Write a synthesis from this summary and these groups:\n{summary}\n\n{communities}",
    "image_analyzer": "Describe this image of a document as JSON: type, description, entities.\nCaption: {caption}",
    "entity_normalizer": "Which of these names mean the same? Answer as JSON: an array of arrays.\n{names}",
    "relation_normalizer": "Give each relation below its canonical name as JSON: an object.\nKnown relations: {taxonomy}\n\n{relations}",
    "critic": "List unsupported statements of the synthesis as JSON.\nSynthesis:\n{synthesis}\n\nFacts:\n{facts}",
}


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class StubClient:
    """Answers from queued texts by turn, or with a JSON echo of the prompt's hash."""

    def __init__(self, answers: tuple[str, ...] = ()):
        self.answers, self.turn = answers, 0

    def complete(self, prompt: str) -> str:
        if self.answers:
            self.turn += 1
            return self.answers[(self.turn - 1) % len(self.answers)]
        return json.dumps({"echo": prompt_hash(prompt), "length": len(prompt)})


def prompt_hash(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()[:16]


def render(template: str, **parts: Column) -> Column:
    """A template's named places filled with columns (null as empty)."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), F.coalesce(parts[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def complete(rows: DataFrame, prompt_col: str, make: Callable[[], Client] = StubClient, retries: int = 2) -> DataFrame:
    """Adds answer, attempts and error; retries stay inside the row, so a failure never repeats a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            answers, attempts, errors = [], [], []
            for prompt in pdf[prompt_col]:
                answer, error = None, None
                for attempt in range(1, retries + 2):
                    try:
                        answer, error = client.complete(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 - recorded in the row
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                attempts.append(attempt)
                errors.append(error)
            yield pdf.assign(answer=answers, attempts=attempts, error=errors)

    schema = rows.schema.simpleString()[len("struct<") : -1]
    return rows.mapInPandas(run, f"{schema},answer string,attempts int,error string")


def parse_facts(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Facts of JSON answers (fenced or not) with their ordinal; malformed answers and incomplete facts give none."""
    parsed = F.from_json(strip_fence(F.col(answer_col)), FACT, {"mode": "PERMISSIVE"})
    rows = answers.select("*", F.posexplode(parsed).alias("seq", "fact"))
    whole = "fact.subject is not null and fact.predicate is not null and fact.object is not null"
    return rows.filter(whole).select(*[c for c in answers.columns if c != answer_col], "seq", "fact.*").withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def embed_stub(texts: pd.Series, size: int = 128) -> pd.Series:
    """Unit vectors from sha256 of each text: bytes / 255 - 0.5, repeated to ``size``."""
    out = []
    for t in texts:
        raw = np.frombuffer(hashlib.sha256((t or "").encode()).digest(), np.uint8) / 255.0 - 0.5
        v = np.resize(raw, size)
        out.append((v / max(np.linalg.norm(v), 1e-10)).tolist())
    return pd.Series(out)


def embed(text: Column, size: int = 128, model: Callable[[pd.Series, int], pd.Series] = embed_stub) -> Column:
    """Embeddings by a stub, as an Arrow UDF; batches go to the model whole."""
    return F.pandas_udf(lambda s: model(s, size), "array<double>")(text)


def embed_words(texts: pd.Series, size: int = 128) -> pd.Series:
    """Unit vectors from the words of each text, each a signed place by its hash; texts that share words are near each other. Null without a word."""
    words = [(t or "").lower().split() for t in texts]
    place: dict[str, int] = {}
    flat = np.fromiter((place.setdefault(w, len(place)) for line in words for w in line), np.int64)
    # each different word of the batch is hashed once
    h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in place], np.uint64)
    row = np.repeat(np.arange(len(words)), [len(line) for line in words])
    v = np.zeros((len(words), size))
    if len(flat):
        np.add.at(v, (row, (h % np.uint64(size)).astype(np.int64)[flat]), np.where(h >> np.uint64(63), 1.0, -1.0)[flat])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return pd.Series([x if m else None for x, m in zip((v / np.maximum(n, 1e-10)).tolist(), n[:, 0], strict=True)], dtype=object)


IMAGE_TYPES = ["diagram", "chart", "table_image", "photo", "screenshot", "decorative"]
IMAGE_PROMPT = "Say what this image of a document shows, as JSON: type (one of " + ", ".join(IMAGE_TYPES) + "), description, entities (list of names)."


def analyze_images(images: DataFrame, make: Callable[[], object], most: int = 500) -> DataFrame:
    """Adds type, description, entities to images (image_id, content binary, media_type).

    A client shows them by ``describe(prompt, image, media_type)``; one without ``supports_vision`` makes
    them decorative. An answer that is no JSON object becomes the description of a photo, its first ``most`` characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        sees = bool(getattr(client, "supports_vision", False))
        for pdf in batches:
            rows = []
            for content, media in zip(pdf["content"], pdf["media_type"], strict=True):
                if not sees:
                    rows.append(("decorative", "[not analysed: the model sees no images]", []))
                    continue
                answer = client.describe(IMAGE_PROMPT, bytes(content), media)
                try:
                    found = json.loads(answer)
                    rows.append((str(found.get("type") or "photo"), str(found.get("description") or ""), [str(e) for e in found.get("entities") or []]))
                except (ValueError, AttributeError, TypeError):
                    rows.append(("photo", answer[:most], []))
            yield pdf.assign(type=[r[0] for r in rows], description=[r[1] for r in rows], entities=[r[2] for r in rows])

    schema = images.schema.simpleString()[len("struct<") : -1]
    return images.mapInPandas(run, f"{schema},type string,description string,entities array<string>")


def refine(chunks: DataFrame, make: Callable[[], Client] = StubClient, by: str = "document_id") -> DataFrame:
    """(by, summary, steps): a summary carried from chunk to chunk in order; sequential per document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        client, summary = make(), ""
        for content in pdf.sort_values("position")["content"]:
            summary = client.complete(PROMPTS["summarizer"].format(summary=summary, content=content))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "summary": [summary], "steps": [len(pdf)]})

    return chunks.select(by, "position", "content").groupBy(by).applyInPandas(fold, f"{by} {chunks.schema[by].dataType.simpleString()}, summary string, steps long")


def densify(rows: DataFrame, make: Callable[[], Client] = StubClient, rounds: int = 5, by: str = "document_id") -> DataFrame:
    """(by, summary): ``rounds`` rewrites of each summary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            out = []
            for s in pdf["summary"]:
                for _ in range(rounds):
                    s = client.complete(PROMPTS["densifier"].format(summary=s))
                out.append(s)
            yield pdf[[by]].assign(summary=out)

    return rows.select(by, "summary").mapInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, summary string")


def route(component: str, settings: dict[str, str], phases: dict[str, str] | None = None, fallback: str = "stub:default") -> tuple[str, str]:
    """(provider, model) for a component: its own setting, its phase's, the default, the fallback; empty counts as unset."""
    choices = (settings.get(component), settings.get((phases or {}).get(component, "")), settings.get("default"), fallback)
    provider, _, model = next(c for c in choices if c).partition(":")
    return provider, model
