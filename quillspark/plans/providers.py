"""Model providers: which one and which model a request means; strategies can be registered."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

# Fixed values.
KEYS: dict[str, str | None] = {"openai": "OPENAI_API_KEY", "gemini": "GEMINI_API_KEY", "claude": "ANTHROPIC_API_KEY", "ollama": None}
SETTINGS = {"openai": "INSIGHT_MODEL_OPENAI", "gemini": "INSIGHT_MODEL_GEMINI", "claude": "INSIGHT_MODEL_CLAUDE", "ollama": "OLLAMA_MODEL"}
PREFIXES = {"gemini": "gemini/", "claude": "anthropic/", "ollama": "ollama/"}
BASE_URL, LOCAL = "OLLAMA_BASE_URL", "http://localhost:11434"


@dataclass(frozen=True)
class Resolution:
    provider: str
    model_id: str
    extra: dict = field(default_factory=dict)

    @property
    def shown(self) -> str:
        return f"{self.provider}:{self.model_id}"


class Registry:
    """defaults: the model of each provider where the environment names none."""

    def __init__(self, defaults: Mapping[str, str]):
        self.defaults = dict(defaults)
        self.strategies: dict[str, Callable[[Mapping[str, str]], Resolution]] = {p: self._usual(p) for p in KEYS}
        self.keys = dict(KEYS)

    def _usual(self, provider: str) -> Callable[[Mapping[str, str]], Resolution]:
        def resolve(env: Mapping[str, str]) -> Resolution:
            model = env.get(SETTINGS[provider], self.defaults[provider]).removeprefix(PREFIXES.get(provider, "\0"))
            return Resolution(provider, model, {"base_url": env.get(BASE_URL, LOCAL)} if provider == "ollama" else {})

        return resolve

    @staticmethod
    def canonical(name: str) -> str:
        key = name.strip().lower()
        return "claude" if key == "anthropic" else key

    def register(self, name: str, strategy: Callable[[Mapping[str, str]], Resolution]) -> None:
        self.strategies[name.strip().lower()] = strategy
        self.keys.setdefault(name.strip().lower(), None)

    def names(self) -> list[str]:
        return sorted(self.strategies)

    def resolve(self, name: str, env: Mapping[str, str]) -> Resolution:
        """KeyError for a provider that isn't registered."""
        return self.strategies[self.canonical(name)](env)

    def explicit(self, model: str) -> Resolution:
        """The provider that a model's name implies."""
        s = model.strip()
        start, _, rest = s.partition("/")
        provider = {"gemini": "gemini", "google": "gemini", "anthropic": "claude", "ollama": "ollama"}.get(start.lower()) if "/" in s else None
        if provider:
            return Resolution(provider, rest, {"base_url": LOCAL} if provider == "ollama" else {})
        if s.lower().startswith("claude-"):
            return Resolution("claude", s)
        return Resolution("openai", s or self.defaults["openai"])

    def request(self, llm: str | None, model: str | None, env: Mapping[str, str]) -> Resolution:
        """A named provider goes before a named model; without both the first provider's default."""
        return self.resolve(llm, env) if llm else self.explicit(model) if model else self.resolve("openai", env)

    def key_name(self, provider: str) -> str | None:
        return self.keys.get(self.canonical(provider))
