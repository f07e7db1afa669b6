"""Steps behind a chat service, with what each accepts and what it does when no answer is acceptable.

A chat is any function of a list of messages that gives the answer's text, so that every policy can be tried without a service.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from lectern.models import ChatClient, LecternError, content_of
from lectern.operators.splitter import count_tokens, delimiter_split, find_anchor

Chat = Callable[[list[dict]], str]

_BLOCK = re.compile(r"```(?:txt)?\n(.*?)\n```", re.DOTALL | re.IGNORECASE)
_STRICT_BLOCK = re.compile(r"```txt\n(.*?)\n```", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"</?mark-yellow>")


def chat_with(client: ChatClient, most_tokens: int, as_json: bool = False) -> Chat:
    return lambda messages: content_of(client(messages, most_tokens, as_json))


def object_in(text: str) -> dict:
    found = json.loads(text[text.index("{") : text.rindex("}") + 1])
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def ask(text: str) -> list[dict]:
    return [{"role": "user", "content": text}]


@dataclass(frozen=True)
class Splitter:
    """Proposes where a segment is cut: the model names the beginning of the second section in its own words of the text.

    Chats are begun anew ``len(chats)`` times, with ``tries`` answers each; an answer that can't be found, or is near an end, is
    pointed out in the same chat. Then the delimiter nearest to the middle is taken. A chat that runs out of tokens ends it all.
    """

    chats: Sequence[Chat]
    tries: int = 3
    show: Callable[[str], str] = lambda segment: segment

    def __call__(self, segment: str) -> int:
        shown = self.show(segment)
        request = f'Find the best place to cut this text in two near its middle. Answer with {{"begin_second_section": "the first three to five words of the second part, copied exactly"}}.\n\n{shown}'
        for chat in self.chats:
            messages = ask(request)
            for attempt in range(self.tries):
                try:
                    anchor = object_in(chat(messages)).get("begin_second_section")
                except LecternError:
                    return delimiter_split(segment)
                except Exception:  # noqa: BLE001  a failed call is one try
                    continue
                if not anchor:
                    continue
                at = find_anchor(segment, anchor)
                if at > 0:
                    return at
                where = "is not in the text" if anchor not in segment else "is too near to an end"
                urge = "Copy three to five words exactly." if attempt == 0 else "Copy three to five words from the very middle, character by character."
                messages = [*messages, {"role": "user", "content": f"{anchor!r} {where}. {urge}"}]
        return delimiter_split(segment)


@dataclass(frozen=True)
class PairJudge:
    """Which of two items serves the query better; no answer after ``tries`` is an error, since a guess would bend the order."""

    chat: Chat
    query: str
    tries: int = 5

    def __call__(self, left: dict, right: dict) -> tuple[str, str]:
        side = lambda name, x: f"{name} ({x.get('filename', '')})\nSummary: {x.get('summary', '')}\nEvidence: {x.get('evidence', '')}\nText:\n{x.get('text', '')}"
        request = f'What is looked for: {self.query}\n\n{side("A", left)}\n\n{side("B", right)}\n\nWhich serves better? Answer with {{"rationale": ..., "winner": "A" or "B"}}.'
        error: Exception | None = None
        for _ in range(self.tries):
            try:
                found = object_in(self.chat(ask(request)))
                if found.get("winner") in ("A", "B"):
                    return ("left" if found["winner"] == "A" else "right"), str(found.get("rationale", ""))
            except Exception as e:  # noqa: BLE001
                error = e
        raise LecternError("no winner", tries=self.tries) from error


@dataclass(frozen=True)
class Cleaner:
    """Raw text to prose; after ``tries`` the raw text stays."""

    chat: Chat
    tries: int = 6

    def __call__(self, raw: str) -> str:
        messages = ask(f"Rewrite this text as plain prose, all of it and in order, without markup. Answer with one txt code block only.\n\n{raw}")
        for _ in range(self.tries):
            try:
                found = _BLOCK.search(self.chat(messages))
                if found:
                    return found[1]
                messages = [*messages, {"role": "user", "content": "Answer with exactly one txt code block that holds all of the text."}]
            except Exception as e:  # noqa: BLE001
                messages = [*messages, {"role": "user", "content": f"The last answer failed ({e}). Answer with one txt code block."}]
        return raw


def tags_ok(text: str, require: bool = False) -> bool:
    tags = [m[0] for m in _TAG.finditer(text)]
    return len(tags) % 2 == 0 and all(t.startswith("</") == bool(i % 2) for i, t in enumerate(tags)) and (bool(tags) or not require)


@dataclass(frozen=True)
class Highlighter:
    """Text with highlight tags around what serves the intent.

    The answer must be one block of nearly the length of the input with proper tags; ``exact`` also asks that the text without
    tags is unchanged. The second half of the tries uses the second chat. Long texts are worked on in parts. If nothing is
    highlighted in the end, it is tried again as a whole; then it is an error.
    """

    chats: tuple[Chat, Chat]
    intent: str
    tries: int = 8
    exact: bool = False
    single: int = 6000
    part: int = 5000

    def one(self, text: str, evidence: str) -> str:
        fenced = f"```txt\n{text}\n```"
        request = f"What is looked for: {self.intent}\n\n{evidence}\n\nRepeat this text in full in one txt code block, with <mark-yellow> and </mark-yellow> around the passages that serve it.\n\n{fenced}"
        for attempt in range(self.tries):
            try:
                found = _STRICT_BLOCK.findall(self.chats[attempt >= self.tries // 2](ask(request)))
            except Exception:  # noqa: BLE001
                continue
            if len(found) == 1 and len(found[0]) + 11 >= 0.98 * len(fenced) and tags_ok(found[0]) and (not self.exact or _TAG.sub("", found[0]) == text):
                return found[0]
        raise LecternError("no acceptable highlighting", tries=self.tries)

    def __call__(self, text: str, evidences: Sequence[str]) -> str:
        known = evidences[0] if len(evidences) == 1 else "\n".join(f"Part {i}: {x}" for i, x in enumerate(evidences, 1))
        n = count_tokens(text)
        parts = [text] if n < self.single else even_parts(text, -(-n // self.part))
        for _ in range(self.tries):
            whole = "".join(self.one(p, f"Known evidence:\n{known}") for p in parts)
            if tags_ok(whole, require=True):
                return whole
        raise LecternError("nothing was highlighted", tries=self.tries)


def even_parts(text: str, n: int) -> list[str]:
    """``n`` parts of equal length, each moved past the end of its line; the last ones may be empty."""
    at, step = [0], len(text) // max(n, 1)
    for _ in range(n - 1):
        end = text.find("\n", at[-1] + step)
        at.append(len(text) if end < 0 else end + 1)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


@dataclass(frozen=True)
class Transcriber:
    """A page image to Markdown: the first chat ``tries`` times, then the second; waits grow between failed calls."""

    chats: tuple[Callable[[list[dict]], str], Callable[[list[dict]], str]]
    tries: int = 3
    wait: Callable[[float], None] = time.sleep

    def __call__(self, image_base64: str, page: int) -> tuple[str, int]:
        mark = f"{page:06d}"
        for attempt in range(1, 2 * self.tries + 1):
            urge = ("", " Check the markers.", " Give nothing but the markers and what stands between them.")[min(2, (attempt - 1) % self.tries)]
            text = f"Write this page as Markdown between <<<MD_START page={mark}>>> and <<<MD_END page={mark}>>>; a blank page is <!-- PAGE BLANK -->.{urge}"
            try:
                answer = self.chats[attempt > self.tries]([{"role": "user", "content": text, "images": [image_base64]}])
            except Exception:  # noqa: BLE001
                self.wait(min(2 ** (attempt - 1), 8))
                continue
            found = page_markdown(answer, mark)
            if found:
                return found, attempt
        raise LecternError("the page could not be transcribed", page=page)


def page_markdown(answer: str, mark: str, most: int = 400_000) -> str | None:
    """What stands between the one start and the one end marker of a page, in this order; null if it is empty or too large."""
    start, end = (list(re.finditer(rf"<<<MD_{x}\s+page={mark}>>>", answer)) for x in ("START", "END"))
    if len(start) != 1 or len(end) != 1 or start[0].end() >= end[0].start():
        return None
    found = answer[start[0].end() : end[0].start()].strip()
    return found if 0 < len(found) <= most else None
