"""Model profiles: how a hosted model is asked and how its answer is read.

A profile is a value: name, endpoint, rate, prices and one of three layouts.  ``HostedModel`` turns it into a provider for
the call stage; the access key is read on the executor from a named environment variable and never becomes part of a plan.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass

from .calls import CallError

#: What the three layouts call their parts.
CHAT, MESSAGES, KEYED = "chat", "messages", "keyed"
CALL_S = 120


@dataclass(frozen=True)
class Profile:
    name: str
    model_id: str
    endpoint: str
    layout: str
    requests_per_minute: int = 50
    max_tokens: int = 1000
    cost_per_1k_input: float = 0.0
    cost_per_1k_output: float = 0.0

    def headers(self, key: str) -> dict[str, str]:
        own = {CHAT: {"Authorization": f"Bearer {key}"}, MESSAGES: {"x-api-key": key, "anthropic-version": "2023-06-01"}, KEYED: {"x-goog-api-key": key}}
        return {"Content-Type": "application/json"} | own[self.layout]

    def request(self, prompt: str, instructions: str = "") -> dict:
        """The body of a request; instructions go where the provider can cache them."""
        if self.layout == KEYED:
            body = {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": self.max_tokens}}
            return body | ({"systemInstruction": {"parts": [{"text": instructions}]}} if instructions else {})
        user = [{"role": "user", "content": prompt}]
        if self.layout == MESSAGES:
            system = {"system": [{"type": "text", "text": instructions, "cache_control": {"type": "ephemeral"}}]} if instructions else {}
            return {"model": self.model_id, "max_tokens": self.max_tokens, "messages": user} | system
        first = [{"role": "system", "content": instructions}] if instructions else []
        return {"model": self.model_id, "messages": first + user, "max_completion_tokens": self.max_tokens}

    def answer(self, payload: dict) -> str:
        """The text of an answer; empty if there is none."""
        if self.layout == CHAT:
            found = [c.get("message", {}).get("content") for c in payload.get("choices", [])[:1]]
        elif self.layout == MESSAGES:
            found = [p.get("text") for p in payload.get("content", [])]
        else:
            found = [p.get("text") for c in payload.get("candidates", [])[:1] for p in c.get("content", {}).get("parts", [])]
        return "".join(x for x in found if x)


class HostedModel:
    """A provider (see ``calls.Provider``) that asks the model of a profile."""

    def __init__(self, profile: Profile, key_variable: str, instructions: str = ""):
        self.profile, self.key_variable, self.instructions = profile, key_variable, instructions
        self.name, self.requests_per_minute = profile.name, profile.requests_per_minute

    def call(self, prompt: str) -> str:
        body = json.dumps(self.profile.request(prompt, self.instructions)).encode()
        request = urllib.request.Request(self.profile.endpoint, body, self.profile.headers(os.environ.get(self.key_variable, "")))
        try:
            with urllib.request.urlopen(request, timeout=CALL_S) as answer:
                return self.profile.answer(json.load(answer))
        except urllib.error.HTTPError as e:
            raise CallError(e.code, str(e)) from e
