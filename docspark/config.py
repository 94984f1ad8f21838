"""Settings: limits, thresholds and word lists. Rules are data: pass your own where the defaults don't suit."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


#: Headings of the text that a generator is given (operators.answer.prompt), and the speakers of a dialogue: a generator that
#: begins to write them again has nothing more to say.
PROMPT_HEADINGS = ("Conversation so far:", "Context:", "Question:", "<context>")
ROLES = ("System", "Human", "User", "Assistant", "Note")
#: A label of a link that consists of such words only says nothing about what it leads to.
NAVIGATION = (
    "a", "access", "and", "as", "attached", "attachment", "browse", "button", "click", "copy", "details", "display", "document", "download", "english", "arabic",
    "file", "full", "get", "go", "here", "in", "info", "link", "more", "new", "on", "open", "or", "page", "pdf", "please", "press", "print", "read", "save", "see",
    "show", "tap", "text", "the", "this", "to", "version", "view", "visit", "window", "www",
    "ابدأ", "اضغط", "اقرأ", "التحميل", "الرابط", "الملف", "المزيد", "تحميل", "تنزيل", "رابط", "عرض", "على", "عربي", "فتح", "للتحميل", "ملف", "من", "هنا",
)


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 400
    chunk_overlap: int = 3
    min_chunk_chars: int = 80
    min_sentence_chars: int = 10
    min_page_chars: int = 30
    top_k: int = 8
    fetch_k: int = 20
    similarity_floor: float = 0.5
    low_confidence: float = 0.72
    keyword_similarity: float = 0.75
    cache_similarity: float = 0.95
    cache_ttl_seconds: int = 2_592_000
    snippet_chars: int = 1_000
    stream_snippet_chars: int = 300
    summary_every: int = 6
    latency_window: int = 50
    page_language_share: float = 0.25
    query_language_share: float = 0.30
    thresholds: tuple[float, ...] = (0.79, 0.75, 0.72, 0.70, 0.65, 0.60)
    postprocess: bool = True
    not_found: tuple[str, ...] = ("not found in the documents", "does not contain a clear answer", "unable to answer", "لا تتوفر إجابة")
    drift: tuple[str, ...] = ("in conclusion", "in general terms")
    markers: tuple[str, ...] = PROMPT_HEADINGS + tuple(f"{role}:" for role in ROLES)
    out_of_scope: tuple[str, ...] = ("\\bweather\\b", "\\brecipes?\\b", "\\bfootball\\b")
    generic_words: tuple[str, ...] = NAVIGATION
    generic_patterns: tuple[str, ...] = ("^\\d+\\s*(?:pages?|bytes?|[kmg]b)$", "\\.pdf$")
    skip_patterns: tuple[str, ...] = ("/login", "/search", "/contact", "\\.(jpg|png|css|js)$", "/print/")
    must_contain: tuple[str, ...] = ("rule", "circular", "law", "polic", "guid", "doc")
    max_depth: int = 3
    rules: tuple[tuple[str, str], ...] = ()


def from_environment(prefix: str = "DOCSPARK_") -> Settings:
    """Numbers and switches from the environment; text behind # is a comment, what can't be read keeps the default."""
    given = {}
    for f in fields(Settings):
        raw = os.environ.get(prefix + f.name.upper(), "").split("#")[0].strip()
        default = f.default
        if not raw or not isinstance(default, (bool, int, float)):
            continue
        try:
            given[f.name] = raw.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw)
        except ValueError:
            continue
    return Settings(**given)
