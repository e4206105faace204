"""Settings of the service and of the chat pipeline."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from importlib import metadata

from pyspark.sql import functions as F

from quillmesh.operators.guards import GuardChain, injection_guards, parse_mode, server_chain


@dataclass(frozen=True)
class Settings:
    """Settings of a service; each from the variable of its name in capitals after a prefix, and blank ones are these defaults."""

    provider_id: str = "ollama"
    max_input_chars: int = 4000
    injection_guard_mode: str = "on"
    port: int = 8686
    skills_dir: str | None = None
    routing_config: str | None = None
    server_api_key: str | None = None
    provider_base_url: str | None = None
    provider_api_key: str | None = None
    retriever_command: str | None = None
    retriever_url: str | None = None
    retriever_tool: str | None = None
    validator_url: str | None = None
    validator_token: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "QUILLMESH_") -> "Settings":
        """A number that is none and an unknown mode are errors, before anything is opened."""
        env = os.environ if env is None else env
        given = {f.name: (env.get(prefix + f.name.upper()) or "").strip() for f in fields(cls)}
        own = {k: int(v) if k in ("port", "max_input_chars") else v for k, v in given.items() if v}
        return cls(**{**own, "injection_guard_mode": parse_mode(given["injection_guard_mode"])})

    @property
    def injection_mode(self) -> str:
        return self.injection_guard_mode

    def input_chain(self) -> GuardChain:
        return server_chain(self.max_input_chars, self.injection_guard_mode)

    def untrusted_chain(self) -> GuardChain:
        """The guards for what retrieval and tools bring in: those of the mode."""
        return GuardChain(injection_guards(self.injection_guard_mode))


def authorized(header, path, key: str | None):
    """Whether requests with an Authorization header may pass, as a column: all without a key, those for /health, and those with the key as
    bearer. The scheme is read whatever its case; digests are compared, so that time tells nothing of the key."""
    if not (key or "").strip():
        return F.lit(True)
    token = F.regexp_extract(header, r"(?i)^\s*bearer\s+(.*?)\s*$", 1)
    return F.coalesce(path == "/health", F.lit(False)) | F.coalesce(F.sha2(token, 256) == F.sha2(F.lit(key), 256), F.lit(False))


class ProviderRegistry:
    """Providers by id; the last registered of an id wins."""

    def __init__(self):
        self._by_id: dict[str, Callable] = {}

    def register(self, provider_id: str, complete: Callable) -> None:
        self._by_id[provider_id] = complete

    def resolve(self, provider_id: str) -> Callable:
        if provider_id not in self._by_id:
            raise KeyError(f"unknown_provider: {provider_id}")
        return self._by_id[provider_id]

    def discover(self, group: str = "quillmesh.providers") -> "ProviderRegistry":
        """Registers what installed distributions offer under an entry point group, by name; what can't be loaded is left out."""
        for found in sorted(metadata.entry_points(group=group), key=lambda e: e.name):
            try:
                self.register(found.name, found.load())
            except Exception:
                logging.getLogger(__name__).exception("provider %s can't be loaded", found.name)
        return self

    def ids(self) -> list[str]:
        return sorted(self._by_id)


class PersonaManager:
    """The active persona: name and system prompt prefix, or none."""

    def __init__(self, name: str | None = None, prefix: str | None = None):
        self.active = (name, prefix)

    def switch(self, name: str | None, prefix: str | None = None) -> None:
        self.active = (name, prefix)


@dataclass(frozen=True)
class EngineConfig:
    """What a chat run uses. Tools need an executor; at least one provider call. The persona's prefix, if there is one, comes before
    ``persona_prefix``. For what executor and retriever are, see ``plans.pipeline``."""

    input_chain: GuardChain = field(default_factory=lambda: GuardChain([]))
    untrusted_chain: GuardChain = field(default_factory=lambda: GuardChain([]))
    output_chain: GuardChain = field(default_factory=lambda: GuardChain([]))
    default_route: tuple[str, str] | None = None
    persona_prefix: str | None = None
    include_catalog: bool = True
    default_top_k: int = 4
    max_tool_calls: int = 5
    tools: tuple = ()
    tool_executor: Callable | None = None
    retriever: Callable | None = None
    persona: PersonaManager | None = None

    def __post_init__(self):
        if self.tools and self.tool_executor is None:
            raise ValueError("tools need an executor")
        if self.max_tool_calls < 1:
            raise ValueError("max_tool_calls must be at least 1")
        if self.default_top_k < 1:
            raise ValueError("default_top_k must be at least 1")

    def prefix(self) -> str | None:
        """The system prefix in force: the active persona's, else the configured one."""
        own = self.persona.active[1] if self.persona is not None else None
        return own if own is not None else self.persona_prefix
