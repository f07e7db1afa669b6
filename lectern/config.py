"""What a deployment sets: service, models by role, sizes. Frozen, so that it travels to workers as it is."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from lectern.models import ChatClient, LecternError

ROLES = ("hybrid", "long_context", "another_long_context", "smartest", "vision", "vision_fallback")


@dataclass(frozen=True)
class Config:
    host: str = "http://127.0.0.1:11434"
    timeout: float = 900.0
    context_tokens: int = 8192
    models: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Config:
        """LECTERN_HOST, LECTERN_TIMEOUT, LECTERN_CONTEXT_TOKENS and LECTERN_MODEL_<ROLE>; nothing is guessed for a role that is unset."""
        env = os.environ if env is None else env
        host = env.get("LECTERN_HOST", cls.host)
        if "://" not in host:
            host = f"http://{host}"
        if host.count(":") < 2:
            host += ":11434"
        models = {r: env[k] for r in ROLES if (k := f"LECTERN_MODEL_{r.upper()}") in env}
        return cls(host, float(env.get("LECTERN_TIMEOUT", cls.timeout)), int(env.get("LECTERN_CONTEXT_TOKENS", cls.context_tokens)), models)

    def client(self, role: str, think: bool = True) -> ChatClient:
        if role not in self.models:
            raise LecternError("no model is set for the role", role=role)
        return ChatClient(self.host, self.models[role], self.timeout, think)
