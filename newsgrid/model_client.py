"""Clients that answer prompts: an offline one for tests, and one over HTTP that takes its address and key from the environment."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol


@dataclass(frozen=True)
class Options:
    """How a prompt is answered: temperature, most tokens of the reply, and seconds to wait."""

    temperature: float
    tokens: int
    timeout: float


# The options of the three kinds of request.
BATCH, SINGLE, SUMMARY = Options(0.1, 200, 120), Options(0.1, 50, 60), Options(0.3, 1500, 120)


class Client(Protocol):
    def complete(self, prompts: list[str], options: Options = BATCH) -> list[dict]:
        """A reply for each prompt: `reply`, `status`, `error`."""


class Offline:
    """Answers every prompt with the same text."""

    def __init__(self, reply: str = "") -> None:
        self.reply = reply

    def complete(self, prompts: list[str], options: Options = BATCH) -> list[dict]:
        return [{"reply": self.reply, "status": 200, "error": None} for _ in prompts]


class Http:
    """Posts each prompt to a generate endpoint, `at_once` of them at a time: NEWSGRID_MODEL_URL, NEWSGRID_MODEL_NAME and
    NEWSGRID_MODEL_KEY name it. A status other than 200 has no reply; what goes wrong on the way is the error."""

    def __init__(self, at_once: int = 4) -> None:
        self.url, self.model, self.key = (os.environ.get(f"NEWSGRID_MODEL_{k}", "") for k in ("URL", "NAME", "KEY"))
        self.at_once = at_once

    def available(self) -> bool:
        """Whether the endpoint answers; keyword analytics never wait for it."""
        try:
            with urllib.request.urlopen(self.url, timeout=10) as r:
                return r.status == 200
        except (OSError, ValueError):
            return False

    def _one(self, prompt: str, options: Options) -> dict:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": options.temperature, "num_predict": options.tokens}}).encode()
        try:
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            with urllib.request.urlopen(request, timeout=options.timeout) as r:
                return {"reply": json.loads(r.read()).get("response", ""), "status": r.status, "error": None}
        except urllib.error.HTTPError as e:
            return {"reply": None, "status": e.code, "error": None}
        except (OSError, ValueError) as e:
            return {"reply": None, "status": None, "error": str(e)}

    def complete(self, prompts: list[str], options: Options = BATCH) -> list[dict]:
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(lambda p: self._one(p, options), prompts))
