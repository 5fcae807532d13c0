"""Model providers: a protocol, an offline default and a registry.

A provider is made on the worker by its factory, so only the factory travels;
heavy models load once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions.vectors import hash_vector
from corpusloom.operators.kg import rule_extractor


class Provider(Protocol):
    def embed_texts(self, texts: Sequence[str], *, dimensions: int | None = None) -> list[list[float]]: ...

    def ask_llm(self, query: str) -> str: ...

    def capabilities(self) -> dict: ...


class OfflineProvider:
    """Deterministic vectors and rule-based replies; needs no network and no model."""

    def embed_texts(self, texts: Sequence[str], *, dimensions: int | None = None) -> list[list[float]]:
        return [hash_vector(t, dimensions or 384).tolist() for t in texts]

    def ask_llm(self, query: str) -> str:
        return rule_extractor(query)

    def capabilities(self) -> dict:
        return {"name": "offline", "embed": True, "chat": True, "dims": 384}


#: Factories by name; plug-ins add theirs with :func:`register`.
FACTORIES: dict[str, Callable[[], Provider]] = {"offline": OfflineProvider}


def register(name: str, factory: Callable[[], Provider]) -> None:
    FACTORIES[name] = factory


def get(name: str = "offline") -> Provider:
    if name not in FACTORIES:
        raise KeyError(f"unknown provider {name}; known: {', '.join(sorted(FACTORIES))}")
    return FACTORIES[name]()


def batch_iter(items: Sequence[Any], size: int) -> Iterator[Sequence[Any]]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def embedder(factory: Callable[[], Provider] = OfflineProvider, *, dims: int = 384, batch: int = 128):
    """Arrow UDF that embeds texts in batches; null texts count as empty."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = factory()
        for texts in parts:
            rows = texts.fillna("").tolist()
            yield pd.Series([v for part in batch_iter(rows, batch) for v in provider.embed_texts(part, dimensions=dims)])

    return run


# --- hosted and local models, each made where its package is installed --------


class OpenAIProvider:
    """Client of the OpenAI API, or of an Azure deployment of it; keys come from the environment."""

    def __init__(self, *, chat_model: str = "gpt-4o-mini", embed_model: str = "text-embedding-3-small", azure: bool = False, batch: int = 512):
        import openai

        self.client = openai.AzureOpenAI() if azure else openai.OpenAI()
        self.chat_model, self.embed_model, self.azure, self.batch = chat_model, embed_model, azure, batch

    def embed_texts(self, texts: Sequence[str], *, dimensions: int | None = None) -> list[list[float]]:
        more = {"dimensions": dimensions} if dimensions else {}
        return [list(d.embedding) for part in batch_iter(list(texts), self.batch) for d in self.client.embeddings.create(model=self.embed_model, input=list(part), **more).data]

    def ask_llm(self, query: str) -> str:
        reply = self.client.chat.completions.create(model=self.chat_model, messages=[{"role": "user", "content": query}])
        return reply.choices[0].message.content or ""

    def capabilities(self) -> dict:
        return {"name": "azure" if self.azure else "openai", "embed": True, "chat": True, "dims": 1536}


class GeminiProvider:
    """Client of the Gemini API; an embedding that fails is an empty vector."""

    def __init__(self, *, chat_model: str = "gemini-1.5-flash", embed_model: str = "text-embedding-004"):
        from google import genai

        self.client, self.chat_model, self.embed_model = genai.Client(), chat_model, embed_model

    def embed_texts(self, texts: Sequence[str], *, dimensions: int | None = None) -> list[list[float]]:
        out = []
        for t in texts:
            try:
                found = self.client.models.embed_content(model=self.embed_model, contents=t).embeddings
                out.append(list(found[0].values)[:dimensions])
            except Exception:
                out.append([])
        return out

    def ask_llm(self, query: str) -> str:
        return self.client.models.generate_content(model=self.chat_model, contents=query).text or ""

    def capabilities(self) -> dict:
        return {"name": "gemini", "embed": True, "chat": True, "dims": 768}


class LocalProvider:
    """Sentence vectors and a small chat model on the worker, loaded at first use."""

    def __init__(self, *, chat_model: str = "microsoft/phi-2", embed_model: str = "sentence-transformers/all-MiniLM-L6-v2", batch: int = 256, temperature: float = 0.2):
        import sentence_transformers

        self.encoder = sentence_transformers.SentenceTransformer(embed_model)
        self.chat_model, self.batch, self.temperature, self.chat = chat_model, batch, temperature, None

    def embed_texts(self, texts: Sequence[str], *, dimensions: int | None = None) -> list[list[float]]:
        return [v[:dimensions].tolist() for v in self.encoder.encode(list(texts), batch_size=self.batch)]

    def ask_llm(self, query: str) -> str:
        if self.chat is None:
            import transformers

            self.chat = transformers.pipeline("text-generation", model=self.chat_model)
        return self.chat(query, max_new_tokens=512, do_sample=True, temperature=self.temperature, return_full_text=False)[0]["generated_text"]

    def capabilities(self) -> dict:
        return {"name": "local", "embed": True, "chat": True, "dims": self.encoder.get_sentence_embedding_dimension()}


FACTORIES |= {"openai": OpenAIProvider, "azure": lambda: OpenAIProvider(azure=True), "gemini": GeminiProvider, "local": LocalProvider}
