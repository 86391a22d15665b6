"""Translation services behind the one interface of translate.Backend.

Every service is a function of (text, source, target) made by a factory; what goes over the network is one
``fetch(method, url, headers, body) -> (status, bytes)``, so a test needs no network and a cluster can bring
its own client.  Errors become TranslationError, which keeps the source text of the chunk and warns.
"""

from __future__ import annotations

import json
import re
import shutil
import subprocess
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from ..data import languages as L
from ..functions.text import ANSI
from .translate import FREE_TIER, MOCK_PREFIX, Backend, Pace, TranslationError, UsageLimitExceeded, instruction, timeout_of

Fetch = Callable[[str, str, dict, bytes | None], tuple[int, bytes]]

# Addresses and limits of the services.
GOOGLE = "https://translate.googleapis.com/translate_a/single"
MYMEMORY = "https://api.mymemory.translated.net/get"
OPENAI = "https://api.openai.com/v1/chat/completions"
OLLAMA_HOST = "http://localhost:11434"
MYMEMORY_CHARACTERS = 500


def over_http(timeout: float) -> Fetch:
    def fetch(method: str, url: str, headers: dict, body: bytes | None) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=timeout) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()
        except OSError as e:
            raise TranslationError(f"no connection: {e}") from e

    return fetch


def _json(fetch: Fetch, method: str, url: str, payload: dict | None = None, headers: dict | None = None) -> dict | list:
    body = None if payload is None else json.dumps(payload).encode()
    status, data = fetch(method, url, {"Content-Type": "application/json"} | (headers or {}), body)
    if status != 200:
        raise TranslationError(f"status {status}")
    try:
        return json.loads(data)
    except ValueError as e:
        raise TranslationError("answer is no JSON") from e


def google(fetch: Fetch | None = None, timeout: float = 60) -> Backend:
    fetch = fetch or over_http(timeout)

    def call(text: str, source: str, target: str) -> str:
        code = lambda c: L.GOOGLE.get(c.lower(), c.lower())
        data = _json(fetch, "GET", GOOGLE + "?" + urllib.parse.urlencode({"client": "gtx", "sl": code(source), "tl": code(target), "dt": "t", "q": text}))
        if not data or not data[0]:
            raise TranslationError("empty answer")
        return "".join(part[0] for part in data[0] if part and part[0])

    return Backend("google", call, pace=Pace(2.0), retries=5, backoff=3.0)


def mymemory(fetch: Fetch | None = None, timeout: float = 30) -> Backend:
    fetch = fetch or over_http(timeout)

    def call(text: str, source: str, target: str) -> str:
        code = lambda c: L.MYMEMORY.get(c.lower(), c.lower())
        out = []
        for i in range(0, len(text), MYMEMORY_CHARACTERS):
            query = {"q": text[i : i + MYMEMORY_CHARACTERS], "langpair": f"{code(source)}|{code(target)}"}
            data = _json(fetch, "GET", MYMEMORY + "?" + urllib.parse.urlencode(query))
            if data.get("responseStatus") != 200:
                raise TranslationError(str(data.get("responseDetails", "failed")))
            out.append(data["responseData"]["translatedText"])
        return "".join(out)

    return Backend("mymemory", call, pace=Pace(1.0))


def shell(path: str | None = None, engine: str = "google", timeout: float = 60) -> Backend:
    """The trans program, fed on standard input; its colours are stripped."""

    def call(text: str, source: str, target: str) -> str:
        program = path or shutil.which("trans")
        if not program:
            raise TranslationError("the trans program is not installed")
        ask, attempt = [program, "-brief", "-no-ansi", "-e", engine, "-s", source, "-t", target], 0
        while True:
            try:
                done = subprocess.run(ask, input=text, capture_output=True, text=True, timeout=timeout * timeout_of(attempt) / timeout_of(0))
                break
            except subprocess.TimeoutExpired as e:  # a slow answer gets more time, other errors a new attempt
                attempt += 1
                if attempt == 3:
                    raise TranslationError(str(e)) from e
            except OSError as e:
                raise TranslationError(str(e)) from e
        if done.returncode or not done.stdout.strip():
            raise TranslationError(done.stderr.strip() or "empty answer")
        return re.sub(ANSI, "", done.stdout).strip()

    return Backend("trans", call, pace=Pace(2.0))


def ollama(model: str = "llama3.2", host: str = OLLAMA_HOST, fetch: Fetch | None = None, timeout: float = 120) -> Backend:
    fetch = fetch or over_http(timeout)

    def call(text: str, source: str, target: str) -> str:
        name = lambda c: L.NAMES.get(c.lower(), c)
        ask = f"{instruction(name(source), name(target))}\n\n{text}"
        data = _json(fetch, "POST", f"{host}/api/generate", {"model": model, "prompt": ask, "stream": False, "options": {"temperature": 0.3}})
        return data.get("response", "").strip()

    return Backend("ollama", call)


def openai(api_key: str, model: str = "gpt-4o-mini", temperature: float = 0.3, fetch: Fetch | None = None, timeout: float = 60) -> Backend:
    fetch = fetch or over_http(timeout)

    def call(text: str, source: str, target: str) -> str:
        name = lambda c: L.NAMES.get(c.lower(), c)
        system = instruction(name(source), name(target))
        limit = "max_completion_tokens" if model.startswith("gpt-5") else "max_tokens"
        payload = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "temperature": temperature, limit: 4096}
        choices = _json(fetch, "POST", OPENAI, payload, {"Authorization": f"Bearer {api_key}"}).get("choices") or []
        answer = choices[0].get("message", {}).get("content", "").strip() if choices else ""
        if not answer:
            raise TranslationError("empty answer")
        return answer

    return Backend("openai", call)


def gcp(project: str, used: int = 0, location: str = "global", enforce_free_tier: bool = True) -> Backend:
    """The cloud service.  What a whole job sends is judged before its first call (translate.guard or within_limit), and
    written to the usage table after it (translate.characters_sent), since workers cannot count for each other;
    a single text beyond what is left is refused here as well."""

    def call(text: str, source: str, target: str) -> str:
        if enforce_free_tier and used + len(text) > FREE_TIER:
            raise UsageLimitExceeded(f"{used} of {FREE_TIER} characters are used")
        try:
            from google.cloud import translate_v3 as service
        except ImportError as e:
            raise TranslationError("google-cloud-translate is not installed") from e
        answer = service.TranslationServiceClient().translate_text(
            request={"parent": f"projects/{project}/locations/{location}", "contents": [text], "mime_type": "text/plain", "source_language_code": source, "target_language_code": target}
        )
        return answer.translations[0].translated_text

    return Backend("gcp_cloud", call)


def mock(prefix: str = MOCK_PREFIX) -> Backend:
    return Backend("mock", lambda text, source, target: prefix + text)


FACTORIES: dict[str, Callable[..., Backend]] = {"mock": mock, "google": google, "mymemory": mymemory, "trans": shell, "ollama": ollama, "openai": openai, "gcp_cloud": gcp}


def create(name: str = "mock", **options) -> Backend:
    """A backend by name; unknown names and options are plan-time mistakes."""
    if name not in FACTORIES:
        raise ValueError(f"no translation backend {name!r}; there are {', '.join(sorted(FACTORIES))}")
    return FACTORIES[name](**options)
