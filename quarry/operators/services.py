"""The remote services behind plain callables, and deterministic stand-ins that need no network.

* a chat client: ``chat(messages) -> reply text``; :func:`http_chat` speaks the common chat-completions protocol
* an extractor: ``extract(text) -> {"datasets_used": bool, "datasets": [...]}``
* an embedder: ``embed(texts) -> float32 matrix``
* a judge: ``judge(a, b) -> True, False or None`` (None: unknown, not to be remembered)
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
import zlib
from collections.abc import Callable

import numpy as np

EXISTENCE_PROMPT = 'Does the following paper use datasets in its research? Answer with one JSON object, {"datasets_used": true} or {"datasets_used": false}, and nothing else.'
EXTRACTION_PROMPT = (
    "List the datasets the paper uses as a JSON array. Each element has the keys title (the official name), description (50 to 100 words on the dataset), "
    "task (a short phrase for what the paper does with it, without the dataset's name) and link (its URL, or the text None)."
)
KEYWORDS_PROMPT = "Give one to five keywords that sum up the task, separated by commas, and nothing else."
IDENTITY_PROMPT = (
    "Are these two datasets exactly the same? Other versions, years, splits or subsets are different datasets; other spellings of one name are the same.\n"
    '1. {title1}: {description1} ({link1})\n2. {title2}: {description2} ({link2})\nAnswer with one JSON object: {{"is_same": true}} or {{"is_same": false}}.'
)
ANSWER_PROMPT = "Answer from the datasets below only. Rank them by how well they suit the task, name the best {top_k} and say briefly why; leave out near-duplicates and add nothing of your own.\n\nDatasets:\n{context}\n\nTask: {task}\n\nAnswer:"


def http_chat(base: str, key: str, model: str, temperature: float = 0.1, timeout: float = 120.0) -> Callable[[list[dict]], str]:
    """A chat client over HTTP."""

    def chat(messages: list[dict]) -> str:
        body = json.dumps({"model": model, "temperature": temperature, "messages": messages}).encode()
        request = urllib.request.Request(f"{base.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return chat


def http_embedder(base: str, key: str, model: str, batch: int = 100, timeout: float = 120.0) -> Callable[[list[str]], np.ndarray]:
    """An embedder over HTTP, ``batch`` texts a request, line ends as spaces."""

    def embed(texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), batch):
            body = json.dumps({"model": model, "input": [t.replace("\n", " ") for t in texts[at : at + batch]]}).encode()
            request = urllib.request.Request(f"{base.rstrip('/')}/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                out += [x["embedding"] for x in sorted(json.load(reply)["data"], key=lambda x: x["index"])]
        return np.array(out, dtype=np.float32)

    return embed


def with_retries(call: Callable, limit: int = 1, delay: float = 1.0, most: float = 30.0) -> Callable:
    """Repeats a failing call up to ``limit`` tries, each time waiting twice as long, ``most`` seconds at most."""

    def tried(*args):
        wait = delay
        for n in range(max(1, limit)):
            try:
                return call(*args)
            except Exception:
                if n + 1 >= max(1, limit):
                    raise
                time.sleep(min(wait, most))
                wait *= 2

    return tried


def json_in_reply(reply: str):
    """The JSON value in a chatty reply: the outermost brackets, else braces, first as they are, then without
    ``//`` comments; ``\\_`` counts as ``_`` and control characters in strings are fine.  None if nothing parses."""
    spans = []
    for opening, closing in (("[{", "]}"), ("{[", "}]")):
        start = next((reply.find(c) for c in opening if c in reply), -1)
        end = next((reply.rfind(c) for c in closing if c in reply), -1)
        if 0 <= start <= end:
            spans.append(reply[start : end + 1].replace("\\_", "_"))
    for span in [*spans, *(re.sub(r"//[^\n]*", "", s) for s in spans)]:
        try:
            return json.loads(span, strict=False)
        except ValueError:
            continue
    return None


def keywords_in(reply: str) -> list[str]:
    words = [w.strip() for w in reply.split(",") if w.strip()]
    return [*words[:-1], words[-1][:-1] if words[-1].endswith(".") else words[-1]] if words else []


PROMPTS = {"existence": EXISTENCE_PROMPT, "extraction": EXTRACTION_PROMPT, "keywords": KEYWORDS_PROMPT}
DECOMPOSITION_PROMPT = (
    "Does this describe one specific research task, or several? Answer with one JSON object: "
    '{{"is_specific": true or false, "tasks": [the tasks, each a short phrase of its own]}}.\n\n{task}'
)


def decompose(task: str, chat: Callable[[list[dict]], str]) -> list[str]:
    """The tasks that a description is made of; itself if it is specific or the reply makes no sense."""
    span = re.search(r"\{.*\}", chat([{"role": "user", "content": DECOMPOSITION_PROMPT.format(task=task)}]), re.S)
    try:
        told = json.loads(span[0], strict=False) if span else None
    except ValueError:
        told = None
    found = [t.strip() for t in told.get("tasks") or [] if isinstance(t, str) and t.strip()] if isinstance(told, dict) else []
    return [task] if not found or told.get("is_specific") is True else found


def chat_extractor(chat: Callable[[list[dict]], str], prompts: dict[str, str] | None = None) -> Callable[[str], dict]:
    """Extraction by chat: are datasets used, which, and the keywords of each task.  ``prompts`` replaces some of
    ``PROMPTS``."""
    told = {**PROMPTS, **(prompts or {})}

    def extract(text: str) -> dict:
        messages = [{"role": "system", "content": told["existence"]}, {"role": "user", "content": text}]
        first = chat(messages)
        if not next(iter(json_in_reply(first).values())):
            return {"datasets_used": False, "datasets": []}
        messages += [{"role": "assistant", "content": first}, {"role": "user", "content": told["extraction"]}]
        found = []
        for d in json_in_reply(chat(messages)):
            reply = chat([{"role": "system", "content": told["keywords"]}, {"role": "user", "content": d.get("task")}])
            found.append({"title": d.get("title"), "description": d.get("description"), "task_description": d.get("task"), "link": d.get("link"), "task": keywords_in(reply)})
        return {"datasets_used": True, "datasets": found}

    return extract


_NAMED = re.compile(r"((?:[A-Z0-9][\w-]*[ ]){1,5})(?:dataset|data set|corpus|benchmark)\b")
_URL = re.compile(r"https?://[^\s)\]>,]+")


def rule_extractor(text: str) -> dict:
    """Datasets named as 'Some Name dataset' (or corpus, benchmark): the sentence describes it, the next one (or
    the same) tells the task, the longest words are its keywords."""
    sentences, found = re.split(r"(?<=[.!?])\s+", text), {}
    for k, s in enumerate(sentences):
        for m in _NAMED.finditer(s):
            task = sentences[k + 1] if k + 1 < len(sentences) else s
            words = sorted({w.lower() for w in re.findall(r"[^\W\d_]{4,}", task)}, key=lambda w: (-len(w), w))[:5]
            found.setdefault(m[1].strip(), {"title": m[1].strip(), "description": s.strip(), "task_description": task.strip(), "link": (_URL.findall(s) or ["None"])[0], "task": words})
    return {"datasets_used": bool(found), "datasets": list(found.values())}


def hash_embedder(dimension: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words and word pairs; equal texts get equal vectors, empty ones zero."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, t in zip(out, texts, strict=True):
            words = re.findall(r"\w+", t.lower())
            for f in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(f.encode())
                row[h % dimension] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def chat_judge(chat: Callable[[list[dict]], str], retries: int = 3, delay: float = 10.0) -> Callable[[dict, dict], bool | None]:
    """Asks whether two datasets (title, description, link) are the same; None if no answer can be had."""

    def judge(a: dict, b: dict) -> bool | None:
        prompt = IDENTITY_PROMPT.format(**{f"{k}{n}": d.get(k) for n, d in ((1, a), (2, b)) for k in ("title", "description", "link")})
        for n in range(max(1, retries)):
            try:
                told = json_in_reply(chat([{"role": "user", "content": prompt}]))
                if isinstance(told, dict) and isinstance(told.get("is_same"), bool):
                    return told["is_same"]
            except Exception:
                pass
            if n + 1 < retries:
                time.sleep(delay)
        return None

    return judge


def same_words_judge(a: dict, b: dict) -> bool:
    """The built-in judge: equal sets of title words and, where both have one, the same link."""
    words = [set(re.findall(r"\w+", (d.get("title") or "").lower())) for d in (a, b)]
    links = {d.get("link") for d in (a, b)} - {None, "", "None"}
    return bool(words[0]) and words[0] == words[1] and len(links) < 2
