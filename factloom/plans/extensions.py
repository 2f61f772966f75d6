"""Parts that can be replaced by name: chunkers, stores, exporters, model clients, embedders.

``register(kind, name, make)`` adds one, ``make(kind, name, ...)`` builds it. Clients and embedders of remote
models are registered by whoever has a network; a transport is any function from a request (dict) to a reply (dict).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators import chunking, models
from factloom.sources import stores

KINDS = ("chunker", "cache", "writer", "vector_store", "graph_store", "exporter", "client", "embedder")
_parts: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable) -> None:
    if kind not in KINDS:
        raise ValueError(f"no kind named {kind}")
    _parts[kind, name] = make


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _parts if k == kind)


def make(kind: str, name: str, *args, **options):
    """What is registered under the name; "none" is nothing; an unknown name tells which there are."""
    if name == "none":
        return None
    if (kind, name) not in _parts:
        raise ValueError(f"no {kind} named {name}; there are: {', '.join(names(kind)) or 'none'}")
    return _parts[kind, name](*args, **options)


class RemoteClient:
    """Messages to a remote model: ``transport(request) -> reply`` with model, messages, temperature, max_tokens in and text out."""

    def __init__(self, model: str, transport: Callable[[dict], dict], temperature: float = 0.2, max_tokens: int = 4096, system: str = "", vision: bool = False):
        self.model, self.transport, self.temperature, self.max_tokens, self.system, self.supports_vision = model, transport, temperature, max_tokens, system, vision

    def _ask(self, content) -> str:
        messages = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": content}]
        return str(self.transport({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens})["text"])

    def complete(self, prompt: str) -> str:
        return self._ask(prompt)

    def describe(self, prompt: str, image: bytes, media_type: str) -> str:
        import base64

        return self._ask([{"type": "image", "media_type": media_type, "data": base64.b64encode(image).decode()}, {"type": "text", "text": prompt}])


def remote_embedder(model: str, transport: Callable[[dict], dict]) -> Callable[[Column], Column]:
    """A column function that sends each Arrow batch of texts to a remote model at once."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(transport({"model": model, "texts": [t or "" for t in texts]})["vectors"])

    return embed


def client_for(settings, agent: str, phase: str = "", **options) -> Callable[[], models.Client]:
    """A factory of an agent's client by the settings' provider and model; made once on each partition."""
    provider, model = settings.model_for(agent, phase)
    if ("client", provider) not in _parts:
        raise ValueError(f"no client named {provider}; there are: {', '.join(names('client'))}")
    build = _parts["client", provider]
    return lambda: build(model, **options)


register("chunker", "structural", lambda **o: lambda docs, id_col, text_col: chunking.structural(docs, id_col, text_col, **o))
register("chunker", "semantic", lambda **o: lambda parts, id_col, order_col, text_col, vector_col: chunking.semantic(parts, id_col, order_col, text_col, vector_col, **o))
register("cache", "parquet", lambda spark, path: stores.Table(spark, path, ["document_id"]))
register("writer", "files", lambda spark, root: stores.Files(spark, root))
register("vector_store", "parquet", lambda spark, path: stores.VectorStore(spark, path))
register("graph_store", "parquet", lambda spark, path: stores.GraphStore(spark, path))
for _kind in ("json", "graphml", "gexf", "cypher"):
    register("exporter", _kind, lambda k=_kind: lambda nodes, edges, path: stores.export_graph(nodes, edges, path, k))
register("client", "stub", lambda model="default", answers=(): models.StubClient(answers))
register("embedder", "stub", lambda model="hash", size=128: lambda text: models.embed(text, size))
